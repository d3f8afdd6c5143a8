import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.functions import columns as K
from cellwise.operators import infrastructure as I
from cellwise.operators import nearest as N
from cellwise.operators import polygons as P
from cellwise.operators import proximity as X

X0, Y0 = 300000.0, 7000000.0


@pytest.fixture(scope="module")
def substations(spark):
    """1, 2 and 5 km east of the sample: dedicated 2020, zonal 2010, national without date."""
    rows = [(1, X0 + 1000, Y0, "DEDICADO", dt.datetime(2020, 3, 1), "SOLAR SPA"),
            (2, X0 + 2000, Y0, "ZONAL", dt.datetime(2010, 1, 1), "OTRA"), (3, X0 + 5000, Y0, "NACIONAL", None, "OTRA")]
    return spark.createDataFrame(rows, "id int, x double, y double, tipo string, f_op timestamp_ntz, propiedad string")


def sample(spark, ref=dt.datetime(2022, 1, 1)):
    return spark.createDataFrame([(1, X0, Y0, ref, " solar spa ")], "k int, x double, y double, ref timestamp_ntz, dueno string")


def dist(df):
    return [None if r.dist is None else round(r.dist, 6) for r in df.orderBy("k").collect()]


def test_variants_on_substations(spark, substations):
    s = sample(spark)
    assert dist(I.visible_distance(s, substations, "k", "id", "todas")) == [1000.0]
    assert dist(I.visible_distance(s, substations, "k", "id", "sin_dedicadas")) == [2000.0]
    for ref, want in ((dt.datetime(2022, 1, 1), 1000.0), (dt.datetime(2020, 6, 1), 2000.0), (dt.datetime(2005, 1, 1), None)):
        assert dist(I.visible_distance(sample(spark, ref), substations, "k", "id", "previas", "ref")) == [want]


def test_unknown_variant_raises(spark, substations):
    with pytest.raises(ValueError):
        I.visible_distance(sample(spark), substations, "k", "id", "otra")


def test_variants_on_lines(spark):
    rows = [(1, X0 + 500, Y0 - 1e4, X0 + 500, Y0 + 1e4, "DEDICADO", dt.datetime(2021, 5, 1)),
            (2, X0 + 3000, Y0 - 1e4, X0 + 3000, Y0 + 1e4, "NACIONAL", dt.datetime(2005, 1, 1))]
    lines = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double, tipo string, f_op timestamp_ntz")
    assert dist(I.visible_distance(sample(spark), lines, "k", "id", "todas", shape="segment")) == [500.0]
    assert dist(I.visible_distance(sample(spark), lines, "k", "id", "sin_dedicadas", shape="segment")) == [3000.0]


def test_leak_diagnosis(spark, substations):
    r = I.leak_diagnosis(sample(spark), substations, "k", "id", "ref", "dueno", "propiedad").first()
    assert (r.n, r.pct_dedicada, r.pct_no_previa, r.pct_mismo_dueno) == (1, 100.0, 0.0, 100.0)


def test_empty_layer_options(spark, substations):
    none = substations.where("id > 99")
    with pytest.raises(ValueError):
        N.nearest_distance(sample(spark), none, "k", "id")
    assert N.nearest_distance(sample(spark), none, "k", "id", on_empty="zero").first().dist == 0.0
    assert N.nearest_distance(sample(spark), none, "k", "id", on_empty="null").first().dist is None


def test_storage_inherits_type(spark):
    sto = spark.createDataFrame([(1, "se_solar "), (2, "SE_TRONCAL"), (3, "SE_DESCONOCIDA")], "id int, nombre_se string")
    sub = spark.createDataFrame([(1, "SE_SOLAR", "DEDICADO"), (2, "SE_TRONCAL", "NACIONAL"), (3, "SE_SOLAR", "ZONAL")], "sid int, nombre string, tipo string")
    out = I.inherit_type(sto, sub, "nombre_se", "nombre", "sid")
    assert [r.tipo for r in out.orderBy("id").collect()] == ["DEDICADO", "NACIONAL", "S/I"]
    assert I.exclude_dedicated(out).count() == 2


def brute(pts, fts):
    d = np.hypot(pts.x.to_numpy()[:, None] - fts.x.to_numpy()[None], pts.y.to_numpy()[:, None] - fts.y.to_numpy()[None])
    return d


@pytest.mark.parametrize("kind", ["uniform", "cluster", "same_place", "line"])
def test_nearest_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    m = 700
    if kind == "uniform":
        f = rng.uniform(0, 1e5, (m, 2))
    elif kind == "cluster":  # a third of the features in a few metres
        f = np.vstack([rng.uniform(0, 1e5, (m - m // 3, 2)), 5e4 + rng.uniform(0, 3, (m // 3, 2))])
    elif kind == "same_place":
        f = np.repeat(rng.uniform(0, 1e5, (7, 2)), 100, axis=0)
    else:
        f = np.stack([np.linspace(0, 1e5, m), np.full(m, 3.0)], axis=1)
    fts = pd.DataFrame(f, columns=["x", "y"]).assign(fid=np.arange(m))
    pts = pd.DataFrame(np.vstack([rng.uniform(-2e4, 1.2e5, (300, 2)), 5e4 + rng.uniform(-5, 8, (50, 2))]), columns=["x", "y"]).assign(k=np.arange(350))
    got = N.nearest(spark.createDataFrame(pts), spark.createDataFrame(fts), "k", "fid").toPandas().sort_values("k")
    d = brute(pts, fts)
    assert np.allclose(got.dist, d.min(axis=1))
    assert list(got.fid) == list(d.argmin(axis=1))


def test_nearest_other_group(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"]).assign(k=np.arange(200), g=np.arange(200) // 25)
    df = spark.createDataFrame(p)
    got = N.nearest(df, df.withColumnRenamed("k", "q"), "k", "q", dims=["a", "b", "c"], group="g").toPandas().sort_values("k")
    v = p[["a", "b", "c"]].to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    d[p.g.to_numpy()[:, None] == p.g.to_numpy()[None]] = np.inf
    assert np.allclose(got.dist, d.min(axis=1))


def test_within_radius(spark):
    rng = np.random.default_rng(7)
    a = pd.DataFrame(rng.uniform(0, 1000, (300, 2)), columns=["x", "y"]).assign(k=np.arange(300))
    b = pd.DataFrame(rng.uniform(0, 1000, (40, 2)), columns=["x", "y"]).assign(q=np.arange(40))
    kept = {r.k for r in N.within(spark.createDataFrame(a), spark.createDataFrame(b), "k", "q", 60.0, keep=False).collect()}
    assert kept == set(a.k[brute(a, b).min(axis=1) > 60.0])


def square(spark, x0, y0, x1, y1, zid=1):
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    df = spark.createDataFrame([(zid, [tuple(map(float, p)) for p in pts])], "zone_id int, ring array<struct<x:double,y:double>>")
    return P.ring_edges(df, "zone_id", "ring")


def test_hole_is_outside(spark):
    edges = square(spark, 0, 0, 100, 100).union(square(spark, 40, 40, 60, 60))
    pts = spark.createDataFrame([(1, 50.0, 50.0), (2, 10.0, 10.0), (3, 150.0, 10.0)], "k int, x double, y double")
    assert {r.k for r in P.inside(pts, edges, "k", "zone_id").collect()} == {2}
    assert {r.k for r in P.inside(pts, edges, "k", "zone_id", keep=False).collect()} == {1, 3}


def test_memberships_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for pid in range(6):
        cx, cy, m = *rng.uniform(0, 100, 2), int(rng.integers(4, 60))
        ang, rad = np.sort(rng.uniform(0, 2 * np.pi, m)), rng.uniform(2, 40, m)
        xs, ys = cx + rad * np.cos(ang), cy + rad * np.sin(ang)
        rows += [(pid, xs[i], ys[i], xs[(i + 1) % m], ys[(i + 1) % m]) for i in range(m)]
    e = pd.DataFrame(rows, columns=["pid", "x1", "y1", "x2", "y2"])
    p = pd.DataFrame(rng.uniform(-20, 120, (800, 2)), columns=["x", "y"]).assign(k=np.arange(800))
    got = set(map(tuple, P.memberships(spark.createDataFrame(p), spark.createDataFrame(e), "k", "pid").collect()))
    want = set()
    for k, x, y in zip(p.k, p.x, p.y):
        hit = ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)
        n = e.pid[hit].value_counts()
        want |= {(k, int(z)) for z, c in n.items() if c % 2}
    assert got == want


def greedy(p, tol):
    kept, out = [], {}
    for k, x, y in zip(p.k, p.x, p.y):
        near = [(j, np.hypot(x - a, y - b)) for j, a, b in kept if np.hypot(x - a, y - b) < tol]
        if near:
            out[k] = near[0][0]
        else:
            kept.append((k, x, y))
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "hot"])
def test_duplicates_equal_greedy(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "random":
        xy = rng.uniform(0, 600, (400, 2))
    elif kind == "chain":  # each record is close to the one before only
        xy = np.stack([np.arange(12) * 40.0, np.zeros(12)], axis=1)
    else:  # a third of the records in one place
        xy = np.vstack([rng.uniform(0, 2000, (200, 2)), 700 + rng.uniform(0, 1, (100, 2))])
        rng.shuffle(xy)
    p = pd.DataFrame(xy, columns=["x", "y"]).assign(k=np.arange(len(xy)))
    got = {r.k: r.kept for r in X.spatial_duplicates(spark.createDataFrame(p), "k", 50.0).collect()}
    assert got == greedy(p, 50.0)


def test_clip_segment(spark):
    df = spark.createDataFrame([(-5.0, 5.0, 15.0, 5.0), (20.0, 0.0, 30.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    box = [F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]
    got = [r.s for r in df.select(K.clip_segment(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *box).alias("s")).collect()]
    assert tuple(got[0]) == (0.0, 5.0, 10.0, 5.0) and got[1] is None


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-70.4, -23.65), (-68.2, -27.1), (-71.9, -18.5)], "lon double, lat double")
    x, y = K.utm_xy("lon", "lat", 19, True)
    lon, lat = K.utm_lonlat("x", "y", 19, True)
    out = df.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    for r in out:
        # the third-order series leaves a fraction of a millimetre
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    # on the central meridian the easting is 500 km
    x, y = K.utm_xy(F.lit(-69.0), F.lit(-23.0), 19, True)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 500000.0) < 1e-6 and 7.45e6 < r.y < 7.46e6


@pytest.mark.parametrize("n,tile", [(50, 256), (500, 256), (300, 8)])
def test_chain_of_duplicates_takes_few_rounds(spark, monkeypatch, n, tile):
    """Records 30 m apart in key order: one round per tile crossed, not one per link."""
    from cellwise.operators import proximity as X
    rounds, cut = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df: rounds.append(1) or cut(df))
    df = spark.createDataFrame([(i, 30.0 * i, 0.0) for i in range(n)], "id long, x double, y double")
    got = {r.id: r.kept for r in X.spatial_duplicates(df, "id", 50.0, tile=tile).collect()}
    assert got == {i: i - 1 for i in range(1, n, 2)}
    assert len(rounds) <= 3 + 2 * (2 + 30 * n // (35 * tile))


def test_crowded_squares_of_duplicates(spark):
    """Many records in few squares give the same answer as visiting them one by one."""
    from cellwise.operators.proximity import spatial_duplicates
    rng = np.random.default_rng(8)
    xy = np.round(rng.normal(0, 60, (400, 2)), 1)
    kept, want = [], {}
    for i, (x, y) in enumerate(xy):
        first = next((k for k in kept if math.hypot(*(xy[k] - xy[i])) < 50.0), None)
        if first is None:
            kept.append(i)
        else:
            want[i] = first
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    for options in ({}, {"tile": 2, "per_square": 3}):
        assert {r.id: r.kept for r in spatial_duplicates(df, "id", 50.0, **options).collect()} == want
