import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.functions.columns import FEATURES
from cellwise.functions.pvalue import beta_inc, correlation_p, inversions, kendall_p, p_correlation
from cellwise.operators import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, the rest are spread."""
    rng = np.random.default_rng(1)
    v = np.where(np.arange(900) % 3 == 0, 5.0, np.round(rng.normal(size=900) * 10, 1))
    return pd.DataFrame({"id": np.arange(900), "g": np.arange(900) % 4, "v": v, "w": rng.permutation(900).astype(float),
                         "y": rng.integers(0, 2, 900)})


def test_quantiles_match_numpy(spark, skewed):
    q = R.quantiles(spark.createDataFrame(skewed), "v", {"a": 0.01, "b": 0.5, "c": 0.975}).first()
    assert np.allclose([q.a, q.b, q.c], np.percentile(skewed.v, [1, 50, 97.5]))


def test_grouped_summary(spark, skewed):
    out = R.summary(spark.createDataFrame(skewed), "v", by=["g"], std="sample").toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        assert out.loc[g, "n"] == len(part)
        assert np.isclose(out.loc[g, "p90"], np.percentile(part.v, 90))
        assert np.isclose(out.loc[g, "std"], part.v.std(ddof=1))


def test_spearman_with_hot_value(spark, skewed):
    rho = R.spearman(spark.createDataFrame(skewed), "v", "w").first().rho
    assert np.isclose(rho, skewed.v.rank().corr(skewed.w.rank()))


def test_weighted_spearman_repeats_rows(spark, skewed):
    df = skewed.assign(m=skewed.id % 3 + 1)
    rho = R.spearman(spark.createDataFrame(df), "v", "w", weight=F.col("m")).first().rho
    rep = df.loc[df.index.repeat(df.m)]
    assert np.isclose(rho, rep.v.rank().corr(rep.w.rank()))


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert math.isclose(R.auc(df, "s", "y").first().auc, 0.75)
    assert math.isclose(R.average_precision(df, "s", "y").first().average_precision, 0.8333333333333333)


def test_auc_skips_missing_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 1), (0.0, 0)], "s double, y int")
    assert R.auc(df, "s", "y").first().auc == 1.0


def test_take_ranked_ties(spark, skewed):
    got = {r.id for r in R.take_ranked(spark.createDataFrame(skewed), "v", "id", 400, True).collect()}
    want = set(skewed.sort_values(["v", "id"], ascending=[False, True]).id[:400])
    assert got == want


def test_numbered_is_dense_and_ordered(spark, skewed):
    out = R.numbered(spark.createDataFrame(skewed), [F.desc("v"), F.asc("id")]).toPandas().sort_values("position")
    assert list(out.position) == list(range(900))
    assert list(out.id) == list(skewed.sort_values(["v", "id"], ascending=[False, True]).id)


def test_partition_count_does_not_matter(spark, skewed):
    df = spark.createDataFrame(skewed)
    rows = [R.cumulative(df.repartition(n), "v").orderBy("v").collect() for n in (1, 5)]
    assert rows[0] == rows[1]


def test_kendall_tau_b(spark):
    a, b = [1, 2, 3, 4, 4], [1, 3, 2, 5, 4]
    df = spark.range(1).select(R.kendall_columns([F.lit(float(x)) for x in a], [F.lit(float(x)) for x in b]).alias("t"))
    pairs = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i in range(5) for j in range(i)]
    want = sum(p * q for p, q in pairs) / math.sqrt(sum(p * p for p, _ in pairs) * sum(q * q for _, q in pairs))
    assert math.isclose(df.first().t, want)


def test_p_values(spark):
    assert math.isclose(beta_inc(2.0, 3.0, 0.4), 0.5248, rel_tol=1e-9)
    # r = .5, n = 10: t = 1.6330, two-sided p = .1411
    assert abs(correlation_p(0.5, 10) - 0.14111) < 1e-4
    df = spark.createDataFrame([(0.5, 10.0), (1.0, 5.0), (None, 5.0)], "r double, n double")
    got = [r.p for r in df.select(p_correlation("r", "n").alias("p")).collect()]
    assert abs(got[0] - 0.14111) < 1e-4 and got[1] == 0.0


def test_random_quantiles_many_groups(spark):
    random.seed(3)
    rows = [(random.randrange(30), random.random()) for _ in range(2000)]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    out = R.quantiles(spark.createDataFrame(pdf), "v", {"m": 0.5}, by=["g"]).toPandas().set_index("g").m
    assert np.allclose(out.sort_index(), pdf.groupby("g").v.median())


def test_kendall_p_is_exact_without_ties():
    assert inversions(4) == [1, 3, 5, 6, 5, 3, 1]
    a = list(range(7))
    assert math.isclose(kendall_p(a, a), 2 / 5040) and math.isclose(kendall_p(a, a[::-1]), 2 / 5040)
    orders = list(itertools.permutations(range(5)))
    score = lambda p: sum((p[i] > p[j]) - (p[i] < p[j]) for i in range(5) for j in range(i))
    for p in orders[::7]:
        want = sum(abs(score(q)) >= abs(score(p)) for q in orders) / len(orders)
        assert math.isclose(kendall_p(range(5), p), min(1.0, want))
    assert kendall_p([1, 1, 1], [1, 2, 3]) is None
    assert 0 < kendall_p([1, 2, 3, 3, 4], [1, 2, 2, 3, 4]) < 0.1


def test_feature_order():
    assert FEATURES == ["slope", "ghi", "elev", "northness", "dist_transmision", "dist_almacen", "dist_subestaciones"]


def test_top_sites_order_by_the_unrounded_score(spark, tmp_path):
    """Scores that differ beyond the sixth decimal: the query and its SQL rank them alike."""
    import duckdb

    from cellwise.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    base = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part embeddings".split():
        con.execute(f"create view {t} as from '{base}/{t}.parquet'")
    # the lower the key, the lower the price, by less than the rounding
    con.execute(f"copy (select s.* replace (450000.0 + o_orderkey * 1e-5 as o_totalprice) from '{base}/orders.parquet' s) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as from '{tmp_path}/orders.parquet'")
    want = {(r, c) for r, c, _ in con.execute(ORACLES["top_sites"]).fetchall()}
    assert {(r.r, r.c) for r in QUERIES["top_sites"](spark, str(tmp_path)).collect()} == want
