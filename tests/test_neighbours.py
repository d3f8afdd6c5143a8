"""Nearest features in many dimensions: tiles against brute force."""

import numpy as np
import pandas as pd
import pytest

from cellwise.operators import nearest as N
from cellwise.operators import neighbours as T

DIMS = [f"d{i}" for i in range(7)]


def brute(p, f, mine=None, group=None):
    d = np.sqrt(((p[:, None, :] - f[None, :, :]) ** 2).sum(2))
    if mine is not None:
        d[mine[:, None] == group[None, :]] = np.inf
    return d.min(1), d.argmin(1)


@pytest.mark.parametrize("kind", ["free", "mixed", "apart", "self"])
def test_nearest_in_seven_dimensions(spark, monkeypatch, kind):
    monkeypatch.setattr(T, "TILE_ROWS", 64)
    monkeypatch.setattr(T, "MOST_POINTS", 100)
    rng = np.random.default_rng(7)
    f = np.round(rng.normal(0, 1, (1500, 7)) * [3, 2, 1, 1, .5, .1, 0], 1)  # ties, copies and a direction without spread
    f[:200] = f[0]
    p = f if kind == "self" else np.vstack([rng.normal(0, 2, (500, 7)), np.repeat(f[5:6], 300, 0)])
    # "apart": a group fills its side of the space, so a point finds nothing usable in its own tile
    group = {"mixed": rng.integers(0, 4, len(f)), "apart": (f[:, 0] > 0).astype(int), "self": np.arange(len(f))}.get(kind)
    mine = {"mixed": rng.integers(0, 4, len(p)), "apart": (p[:, 0] > 0).astype(int), "self": group}.get(kind)
    pts, fts = pd.DataFrame(p, columns=DIMS).assign(k=np.arange(len(p))), pd.DataFrame(f, columns=DIMS).assign(q=np.arange(len(f)))
    if kind != "free":
        pts["g"], fts["g"] = mine, group
    got = N.nearest(spark.createDataFrame(pts), spark.createDataFrame(fts), "k", "q", dims=DIMS,
                    group=None if kind == "free" else "g").toPandas().sort_values("k")
    dist, who = brute(p, f, mine, group)
    assert got["k"].tolist() == list(range(len(p)))
    np.testing.assert_allclose(got["dist"], dist, atol=1e-12)
    assert got["q"].tolist() == who.tolist()


def test_search_within_a_bound(monkeypatch):
    """One tile: leaves are visited by their boxes, and nothing beyond the bound is found."""
    asked = []
    box = T._to_boxes
    monkeypatch.setattr(T, "_to_boxes", lambda p, lo, hi, far=False: asked.append(1) or box(p, lo, hi, far))
    f = np.random.default_rng(1).normal(0, 1, (20000, 7))
    tree = T.splits(f[::10], 200)
    tiles = T.tile_of(f, tree)
    sizes = np.bincount(tiles)
    assert len(sizes) >= 10 and sizes.min() > 0 and sizes.max() < 20000 / 5
    whole = T.Tile(f, f, f, np.arange(20000), np.arange(20000))
    dist, who = T.search(f[:300], np.arange(300), whole, "group", np.full(300, np.inf))
    want, at = brute(f[:300], f, np.arange(300), np.arange(20000))
    np.testing.assert_allclose(dist, want, atol=1e-12)
    assert who.tolist() == at.tolist() and asked
    assert not np.isfinite(T.search(f[:300], np.arange(300), whole, "group", want / 2)[0]).any()


@pytest.mark.parametrize("radius", [None, 40.0])
@pytest.mark.parametrize("shape", ["point", "segment"])
def test_dated_features_and_radius(spark, monkeypatch, shape, radius):
    monkeypatch.setattr(T, "TILE_ROWS", 64)
    monkeypatch.setattr(T, "MOST_POINTS", 100)
    rng = np.random.default_rng(3)
    n, m = 400, 500
    a, b = np.round(rng.uniform(0, 1000, (n, 2)), 0), np.round(rng.uniform(0, 1000, (n, 2)), 0)
    b[:20] = a[:20]
    start = rng.integers(0, 3000, n)
    p, limit = rng.uniform(-50, 1050, (m, 2)), rng.integers(-100, 3000, m)
    day = lambda v: pd.Series(pd.Timestamp("2000-01-01") + pd.to_timedelta(v, "D")).dt.date
    pts = pd.DataFrame({"k": np.arange(m), "x": p[:, 0], "y": p[:, 1], "limit": day(limit)})
    fts = pd.DataFrame({"q": np.arange(n), "x": a[:, 0], "y": a[:, 1], "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1], "f_op": day(start)})
    got = N.nearest(spark.createDataFrame(pts), spark.createDataFrame(fts), "k", "q", shape=shape, start="f_op", cutoff="limit",
                    max_dist=radius, keep_all=True).toPandas().sort_values("k")
    along = b - a if shape == "segment" else np.zeros((n, 2))
    size = (along ** 2).sum(1)
    t = (((p[:, None] - a) * along).sum(2) / np.where(size == 0, 1, size)).clip(0, 1)
    d = np.sqrt(((p[:, None] - (a + t[:, :, None] * along)) ** 2).sum(2))
    d[start[None, :] > limit[:, None]] = np.inf
    d[d > (radius or np.inf)] = np.inf
    want = np.where(np.isfinite(d.min(1)), d.min(1), np.nan)
    assert np.isnan(want).any() and not np.isnan(want).all()
    np.testing.assert_allclose(got["dist"], want, atol=1e-9)
    assert got["q"].fillna(-1).astype(int).tolist() == np.where(np.isnan(want), -1, d.argmin(1)).tolist()


def test_distances_are_searched_once_and_in_tiles(spark, monkeypatch):
    """Plain points are searched in tiles too, and the maps of an audit read the distances of their samples once."""
    from pyspark.sql import functions as F

    from cellwise.functions.columns import FEATURES
    from cellwise.operators import infrastructure as I
    from cellwise.plans import learning as L

    searched = []
    tiles = N.nearest_in_tiles
    monkeypatch.setattr(N, "nearest_in_tiles", lambda *a: searched.append(1) or tiles(*a))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("k") * 40).cast("int"))
    s = spark.range(60).select(F.col("id").alias("k"), ((F.col("id") * 37) % 100).cast("double").alias("x"), ((F.col("id") * 53) % 90).cast("double").alias("y")
                               ).withColumn("f_ref", day).withColumn("clase", (F.col("k") % 2).cast("int"))
    s = s.select("*", *[((F.col("k") * (7 + i)) % 11).cast("double").alias(f) for i, f in enumerate(FEATURES)])
    layer = spark.range(30).select(F.col("id").alias("q"), ((F.col("id") * 29) % 100).cast("double").alias("x"), ((F.col("id") * 17) % 90).cast("double").alias("y"),
                                   F.when(F.col("id") % 3 == 0, "DEDICADO").otherwise("ZONAL").alias("tipo"), F.lit("2001-01-01").cast("date").alias("f_op"))
    long = I.distance_table(s.where("k > 0").unionByName(s.where("k = 0").withColumn("x", F.lit(None).cast("double"))),
                            {name: (layer, "q", "point") for name in I.LAYER_OF.values()}, "k", "f_ref")
    assert len(searched) == 9
    wide = I.experiment_features(long, "k")
    # the sample without a place has a row (without distances) where its layer is dated, as in the long table
    assert {r.experiment for r in wide.where("k = 0").collect()} == {e for e, v in I.EXPERIMENTS.items() if "previas" in v.values()}
    want = {(e, r["k"], f): r["dist"] for r in long.collect() for e in I.EXPERIMENTS for f, v in I.experiment_variants(e).items() if (f, v) == (r["feature"], r["variant"])}
    got = {(r["experiment"], r["k"], f): r[f] for r in wide.collect() for f in I.LAYER_OF}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}

    seen = spark.sparkContext.accumulator(0)

    def once(v):
        seen.add(1)
        return v

    rows = wide.where("k > 0").repartition(4).localCheckpoint()
    maps = L.audit_maps(s, rows.withColumn("k", F.udf(once, "long")("k")), s.select(F.col("k").alias("r"), F.col("k").alias("c"), *FEATURES),
                        {n: s.select(F.col("k").alias("r"), F.col("k").alias("c"), *I.LAYER_OF) for n in ("linea_base", "tres_sin_dedicadas")}, "k", {"n_estimators": 2, "max_depth": 2})
    assert sorted(maps) == ["linea_base", "tres_sin_dedicadas"] and maps["linea_base"].count() == 60
    assert seen.value <= rows.count()


def test_scenarios_share_the_fit_of_a_training_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cellwise.operators import aoa as A
    from cellwise.plans import learning as L

    asked, fit = [], A.fit
    monkeypatch.setattr(A, "fit", lambda *a: asked.append(1) or fit(*a))
    rows = spark.range(80).select("id", (F.col("id") % 2).alias("label"), *[((F.col("id") * (3 + i)) % 17).cast("double").alias(f) for i, f in enumerate("abcd")])
    train = rows.where("id < 40")
    pairs = L.spatial_scenarios(train, rows, rows.where("id >= 40"), "label")
    got = {r.escenario: r for r in L.applicability_scenarios(pairs, "id", list("abcd")).collect()}
    assert set(got) == {"in_sample", "loro_0", "loro_1", "transferencia"} and len(asked) == 3
    assert got["in_sample"].umbral == got["transferencia"].umbral and (got["in_sample"].n_cells, got["transferencia"].n_cells) == (80, 40)
