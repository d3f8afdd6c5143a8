"""Crowded places: a third of the rows in one cell, place, block or node."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.operators import components as C
from cellwise.operators import joins as J
from cellwise.operators import nearest as N
from cellwise.operators import polygons as P


def edges_of(spark, rings):
    rows = [(z, *map(float, a), *map(float, b)) for z, ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]
    return spark.createDataFrame(rows, "zone_id int, x1 double, y1 double, x2 double, y2 double")


def star_ring(rng, cx, cy, radius, n):
    angle = np.sort(rng.random(n)) * 2 * math.pi
    r = radius * (0.5 + 0.5 * rng.random(n))
    return list(zip(cx + r * np.cos(angle), cy + r * np.sin(angle)))


def parity(edges, px, py):
    e = edges
    up = (e[:, 2] > py[:, None]) != (e[:, 4] > py[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (e[:, 3] - e[:, 1]) * (py[:, None] - e[:, 2]) / (e[:, 4] - e[:, 2]) + e[:, 1]
    return up & (px[:, None] < at)


def members(edges, points):
    pdf = edges.toPandas().to_numpy()
    px, py = points["x"].to_numpy(), points["y"].to_numpy()
    hit = parity(pdf, px, py)
    return {(int(k), int(z)) for z in np.unique(pdf[:, 0]) for k in points["k"][hit[:, pdf[:, 0] == z].sum(axis=1) % 2 == 1]}


def test_polygons_with_a_crowded_cell(spark):
    """One third of the edges in a ten-thousandth of the area, and a star of edges that meet in one vertex."""
    rng = np.random.default_rng(5)
    rings = [(0, star_ring(rng, 50, 50, 45, 300)), (1, star_ring(rng, 20.003, 20.001, 0.01, 500)), (2, star_ring(rng, 20.003, 20.001, 0.004, 300))]
    spikes = []
    for k in range(150):  # a fan of thin triangles with a common vertex
        a = 2 * math.pi * k / 150
        spikes += [(80.0, 20.0), (80 + 9 * math.cos(a), 20 + 9 * math.sin(a)), (80 + 9 * math.cos(a + 0.02), 20 + 9 * math.sin(a + 0.02))]
    rings.append((3, spikes))
    edges = edges_of(spark, rings)
    wide, tight, fan = rng.random((800, 2)) * 110 - 5, 20.002 + rng.random((800, 2)) * 0.012 - 0.005, [80, 20] + rng.normal(size=(500, 2)) * 0.5
    xy = np.concatenate([wide, tight, fan])
    points = pd.DataFrame({"k": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    df = spark.createDataFrame(points)
    want = members(edges, points)
    assert len({z for _, z in want}) == 4
    rows = [(r.k, r.zone_id) for r in P.memberships(df, edges, "k", "zone_id", 16).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    grid = P._index_grid(edges)
    levels = P.cell_index(edges.withColumn("zone_id", F.lit(0)), "zone_id", grid, 16)
    assert len(levels) > 3
    most = [index.where("x1 is not null").groupBy("r", "c").count().agg(F.max("count")).first()[0] for _, index, _ in levels[:-1]]
    assert max(m or 0 for m in most) <= 16  # whatever goes on is tested below
    assert levels[-1][1].where("x1 is not null").groupBy("r", "c").count().where("count > 16").count() <= 64  # around the fan's vertex


def test_crowded_keys_are_dealt(spark):
    left = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900).alias("cell"))
    right = spark.range(600).select(F.col("id").cast("int").alias("cell"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(7, -1)], "cell int, v long"))
    left = left.withColumn("cell", F.col("cell").cast("int"))
    a, b, keys = J.dealt(left, right, ["cell"], F.col("k"), least=100)
    assert keys == ["cell", "_salt"]
    limit = J.crowd_limit(30_000, 8, 100)
    assert a.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 1.3 * limit
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = J.dealt_join(left, right, ["cell"], F.col("k"), how, least=100)
        want = left.join(right, "cell", how)
        assert sorted(got.columns) == sorted(want.columns)
        assert got.select(sorted(got.columns)).exceptAll(want.select(sorted(want.columns))).isEmpty()
        assert got.count() == want.count()


def test_lines_cut_by_polygons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(3, 3), (7, 3), (7, 7), (3, 7)]
    wedge = [(20, 0), (30, 5), (20, 10), (23, 5)]
    edges = edges_of(spark, [(1, square), (1, hole), (2, wedge), (3, [(10, 0), (15, 0), (15, 10), (10, 10)])])
    rows = [(1, -5, 5, 35, 5), (2, 1, 1, 2, 2), (3, -5, -5, -1, -1), (4, 0, 0, 10, 10), (5, 5, -1, 5, 11), (6, -1, 3, 12, 3),
            (7, 20, 0, 20, 10), (8, 4, 4, 6, 6), (9, 1, 1, 1, 1), (10, 25, -5, 25, 15)]
    lines = spark.createDataFrame([(k, *map(float, v)) for k, *v in rows], "line_id int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in P.cut_lines(lines, edges, "line_id", "zone_id").collect():
        got.setdefault((r.line_id, r.zone_id), []).append(round(r.length, 6))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1, 1] == [3, 3] and got[1, 3] == [5] and got[1, 2] == [7]  # through a hole and a notch's vertex
    assert got[2, 1] == [round(math.sqrt(2), 6)] and (3, 1) not in got and (8, 1) not in got and 9 not in {k for k, _ in got}
    assert got[4, 1] == [round(3 * math.sqrt(2), 6)] * 2  # corner to corner, through the hole's corners
    assert got[5, 1] == [3, 3] and got[10, 2] == [5]
    assert sum(got[6, 1]) in (6.0, 10.0)  # along a side of the hole: the border belongs to one side
    # lengths by dense sampling
    rng = np.random.default_rng(8)
    rings = [(0, star_ring(rng, 50, 50, 40, 40)), (1, star_ring(rng, 60, 40, 30, 25))]
    edges = edges_of(spark, rings)
    ends = rng.random((30, 4)) * 100
    lines = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(ends)], "line_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.line_id, r.zone_id): r.n for r in P.cut_lines(lines, edges, "line_id", "zone_id").groupBy("line_id", "zone_id").agg(F.sum("length").alias("n")).collect()}
    pdf, t = edges.toPandas().to_numpy(), (np.arange(4000) + 0.5) / 4000
    for k, (x1, y1, x2, y2) in enumerate(ends):
        hit = parity(pdf, x1 + (x2 - x1) * t, y1 + (y2 - y1) * t)
        for z in (0, 1):
            share = (hit[:, pdf[:, 0] == z].sum(axis=1) % 2).mean()
            assert got.get((k, z), 0.0) == pytest.approx(share * math.hypot(x2 - x1, y2 - y1), abs=0.3)


def test_components_with_a_hub(spark):
    """A star of 60,000 nodes beside a path and a second star that meets it late."""
    star = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(100_000, 100_300).select("id", (F.col("id") + 1).alias("b"))
    other = spark.range(200_001, 205_000).select(F.lit(200_000).cast("long"), F.col("id"))
    bridge = spark.createDataFrame([(59_999, 204_999)], "a long, b long")
    edges = star.union(path).union(other).union(bridge)
    got = {r.root: r["count"] for r in C.graph_components(edges).groupBy("root").count().collect()}
    assert got == {0: 65_000, 100_000: 301}
    links = star.select(F.col("a").alias("u"), F.col("b").alias("v"))
    a, b, keys = J.dealt(links, links.groupBy("u").agg(F.min("v").alias("m")), ["u"], F.col("v"))
    assert keys == ["u", "_salt"] and a.groupBy(*keys).count().agg(F.max("count")).first()[0] < 1.2 * J.crowd_limit(60_000, 8)


def crowd(rng, n):
    """Features a third of which share one place."""
    xy = np.where(np.arange(n)[:, None] % 3 == 0, 50.0, rng.random((n, 2)) * 100)
    return pd.DataFrame({"id": rng.permutation(n), "x": xy[:, 0], "y": xy[:, 1], "start": rng.integers(0, 500, n), "team": rng.integers(0, 40, n)})


@pytest.mark.parametrize("rule", ["dated", "grouped"])
def test_nearest_among_coincident_features(spark, rule):
    rng = np.random.default_rng(9)
    feats = crowd(rng, 24_000)
    points = pd.DataFrame({"k": np.arange(60), "x": 40 + rng.random(60) * 20, "y": 40 + rng.random(60) * 20,
                           "cutoff": rng.integers(-5, 520, 60), "mine": rng.integers(0, 40, 60)})
    points.loc[:5, ["x", "y"]] = 50.0
    f = feats.to_dict("list")
    fx, fy, fs, ft, fi = (np.array(f[c]) for c in ("x", "y", "start", "team", "id"))
    want = {}
    for p in points.itertuples():
        ok = fs <= p.cutoff if rule == "dated" else ft != p.mine
        if ok.any():
            d = np.sqrt((fx - p.x) ** 2 + (fy - p.y) ** 2)
            want[p.k] = min((round(float(a), 9), int(i)) for a, i in zip(d[ok], fi[ok]))
    df = spark.createDataFrame(feats).withColumnRenamed("team", "mine")
    how = {"start": "start", "cutoff": "cutoff"} if rule == "dated" else {"group": "mine"}
    got = N.nearest(spark.createDataFrame(points), df, "k", "id", **how)
    assert {r.k: (round(r.dist, 9), r.id) for r in got.collect()} == want
    kept = N._one_place(df.select(F.col("id").alias("_order"), F.col("x").alias("g_x"), F.col("y").alias("g_y"), F.col("start").alias("_start"),
                                  F.col("mine").alias("_group"), F.struct("id").alias("_attrs")), ["g_x", "g_y"], rule == "dated", rule == "grouped")
    assert kept.where("g_x = 50 and g_y = 50").count() <= (40 if rule == "dated" else 2)
