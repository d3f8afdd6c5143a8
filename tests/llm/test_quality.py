import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.llm import quality
from cellwise.llm.common import remainder, table
from cellwise.llm.queries import QUERIES

from .fixtures import documents, empty

SF = "/root/testdata/sf0.01"


def gain_at(x, g, h, f, v, least, ridge):
    left = x[:, f] <= v
    if min(left.sum(), (~left).sum()) < least:
        return 0.0
    return sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)


def naive_gain(x, g, h, least, ridge):
    """Best gain over all limits between distinct values."""
    return max(gain_at(x, g, h, f, v, least, ridge) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1])


def test_splits_equal_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 4)).astype(np.float32)
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.1)).astype(float)
    p = np.full(300, y.mean())
    limits = [quality.edges(c, 64) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(limits, x.T)])
    (feature, limit, child, value), step = quality.grow(code, limits, p - y, p * (1 - p), 2, 64, 5, 1.0)
    g, h = p - y, p * (1 - p)
    f, v = feature[0], limit[0]
    assert f == 1 and gain_at(x, g, h, f, v, 5, 1.0) == pytest.approx(naive_gain(x, g, h, 5, 1.0))
    for side, k in ((x[:, f] <= v, child[0]), (x[:, f] > v, child[0] + 1)):
        best = naive_gain(x[side], g[side], h[side], 5, 1.0)
        assert gain_at(x[side], g[side], h[side], feature[k], limit[k], 5, 1.0) == pytest.approx(best)
        rows = side & (x[:, feature[k]] <= limit[k])
        assert np.allclose(step[rows], -g[rows].sum() / (h[rows].sum() + 1.0))


def test_arrays_give_what_a_walk_gives():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)
    for row, score in zip(x, model.score(x)):
        raw = model.base
        for t in range(len(model.feature)):
            k = 0
            while model.child[t, k] != k:
                k = model.child[t, k] + (row[model.feature[t, k]] > model.limit[t, k])
            raw += model.value[t, k]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_statistics():
    names = quality.STATISTICS
    s = dict(zip(names, quality.statistics("Ab ab ab\nXX!! é1 é1\n\nAb ab ab".encode())))
    assert len(quality.statistics(b"x")) == len(names)
    assert s["log_chars"] == pytest.approx(np.log1p(29)) and s["log_words"] == pytest.approx(np.log1p(9))
    assert s["repeated_next"] == pytest.approx(3 / 8) and s["distinct_words"] == pytest.approx(4 / 9)
    assert s["marked_words"] == pytest.approx(1 / 9) and s["shouted_words"] == pytest.approx(1 / 9)
    assert s["titled_words"] == pytest.approx(2 / 9) and s["distinct_lines"] == pytest.approx(2 / 3)
    assert s["word_length"] == pytest.approx((2 * 6 + 4 + 3 + 3) / 9) and s["other"] == pytest.approx(2 / 29)
    for nothing in (None, b"", b" \n\t"):
        assert not quality.statistics(nothing).any()


def test_held_out_quality(spark):
    found = QUERIES["op11_boosted_quality"](spark, SF)
    got = found.join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() > 0.95
    assert found.count() == table(spark, SF, "documents").count()
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()
    assert found.where("predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_odd_rows(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit("x").alias("score"))
    labels = labels.union(labels).union(spark.createDataFrame([(None, 1, "x"), (3, None, "x")], labels.schema))
    got = quality.classified(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    assert got.count() == docs.count() and got.columns.count("score") == 1 and "lang" in got.columns
    assert got.where("score is null or isnan(score)").isEmpty()
    equal = got.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id").groupBy("t").agg(F.countDistinct("score").alias("c"))
    assert equal.where("c > 1").isEmpty()
    same = quality.classified(docs.repartition(3), labels, remainder(F.col("doc_id"), 5) != 0)
    assert sorted(map(tuple, same.select(F.coalesce("doc_id", F.lit(-1)), "score").collect())) == sorted(
        map(tuple, got.select(F.coalesce("doc_id", F.lit(-1)), "score").collect()))


def test_empty_tables_and_one_label(spark):
    docs = documents(spark)
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"))
    assert quality.classified(empty(spark), labels, F.lit(True)).count() == 0
    none = quality.classified(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert {r["predicted"] for r in quality.classified(docs, labels, F.lit(True)).collect()} == {1}


def test_conflicting_labels_do_not_train(spark):
    docs = documents(spark)
    labels = docs.where("doc_id < 20").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("quality"))
    x, y = quality.training_rows(quality.measured(docs), labels, F.lit(True), "doc_id", "quality", 100)
    assert len(x) == len(y) == 0
