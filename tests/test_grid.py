import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.functions import columns as K
from cellwise.operators import components as C
from cellwise.operators import grid as G
from cellwise.operators import polygons as P
from cellwise.operators import proximity as X
from cellwise.plans import suitability as U


def cells(spark, a, name="v"):
    r, c = np.nonzero(~np.isnan(a))
    return spark.createDataFrame(pd.DataFrame({"r": r.astype("int64"), "c": c.astype("int64"), name: a[r, c]}))


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.where(F.col(name).isNotNull()).collect():
        out[r["r"], r["c"]] = r[name]
    return out


def test_grid_from_bounds():
    g = G.GridSpec.from_bounds(0, 0, 10, 6, 4.0, 32719)
    assert (g.width, g.height, g.y0) == (3, 2, 6.0)
    with pytest.raises(ValueError):
        g.require(4326)
    with pytest.raises(ValueError):
        g.require(32719, G.GridSpec(1000, 1000, 1, 1, 2, 2))
    assert G.GridSpec(0, 0, 1, 1, 2, 2).stamp(4326).srid == 4326


def test_centroid_to_cell_floors(spark):
    g = G.GridSpec(0.0, 5000.0, 500.0, 500.0, 10, 10)
    p = spark.createDataFrame([(1250.0, 1250.0), (90000.0, 1250.0), (-10.0, 1250.0)], "x double, y double")
    rows = p.select(g.row("y").alias("r"), g.column("x").alias("c")).where(g.holds()).collect()
    assert [(r.r, r.c) for r in rows] == [(7, 2)]


def test_border_is_not_mixed_with_no_signal(spark):
    src = np.full((6, 6), 2000.0)
    src[:, 3:] = 0.0
    gs = G.GridSpec(0, 600, 100, 100, 6, 6)
    gd = G.GridSpec(30, 570, 70, 70, 7, 7)
    out = array(G.resample_keep_zero(cells(spark, src), "v", gs, gd.cells(spark), gd), (7, 7))
    live = out[out > 0]
    assert np.allclose(live, 2000.0, rtol=1e-12) and (out == 0).any()


def test_bilinear_matches_plane(spark):
    rr, cc = np.mgrid[0:8, 0:9]
    gs = G.GridSpec(0, 800, 100, 100, 9, 8)
    gd = G.GridSpec(120, 700, 37, 41, 10, 8)
    out = array(G.resample(cells(spark, 3.0 * cc + 5.0 * rr), "v", gs, gd.cells(spark), gd), (8, 10))
    x = 120 + (np.arange(10) + 0.5) * 37
    y = 700 - (np.arange(8) + 0.5) * 41
    want = 3.0 * (x[None] / 100 - 0.5) + 5.0 * ((800 - y[:, None]) / 100 - 0.5)
    assert np.allclose(out, want)


def test_sample_falls_back_to_window(spark):
    a = np.arange(16.0).reshape(4, 4)
    a[1, 1] = np.nan
    g = G.GridSpec(0, 4, 1, 1, 4, 4)
    p = spark.createDataFrame([(1, 1.5, 2.5), (2, 3.5, 0.5), (3, 9.0, 9.0)], "k int, x double, y double")
    out = {r.k: r.v for r in G.sample_at(p, "k", cells(spark, a), "v", g).collect()}
    assert np.isclose(out[1], np.mean([0, 1, 2, 4, 6, 8, 9, 10])) and out[2] == 15.0 and out[3] is None


def test_circular_fallback(spark):
    a = np.full((3, 3), np.nan)
    a[0, 0], a[2, 2] = 350.0, 10.0
    g = G.GridSpec(0, 3, 1, 1, 3, 3)
    p = spark.createDataFrame([(1, 1.5, 1.5)], "k int, x double, y double")
    v = G.sample_at(p, "k", cells(spark, a), "v", g, circular=True).first().v
    assert min(v, 360 - v) < 1e-9


def test_terrain_of_a_plane(spark):
    rr, cc = np.mgrid[0:5, 0:5]
    g = G.GridSpec(0, 50, 10, 10, 5, 5)
    out = G.terrain(cells(spark, cc * 10.0), "v", g).where("r = 2 and c = 2").first()
    assert abs(out.slope - 45.0) < 1e-9 and abs(out.aspect - 270.0) < 1e-9  # rises east, faces west
    north = G.terrain(cells(spark, rr * 10.0), "v", g).where("r = 2 and c = 2").first()
    assert min(north.aspect, 360 - north.aspect) < 1e-9  # rises south, faces north
    flat = G.terrain(cells(spark, np.ones((5, 5))), "v", g)
    assert flat.where("r = 2 and c = 2").first().aspect is None
    assert flat.where("r = 0 and c = 2").first().slope is None


def test_distance_transform(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((37, 53)) < 0.02
    mask[5, 7] = True
    r, c = np.nonzero(mask)
    df = spark.createDataFrame(pd.DataFrame({"r": r, "c": c}))
    g = G.GridSpec(0, 0, 90.0, 70.0, 53, 37)
    out = array(X.distance_transform(df, g), (37, 53), "dist")
    rr, cc = np.mgrid[0:37, 0:53]
    want = np.sqrt(((cc[..., None] - c) * 90.0) ** 2 + ((rr[..., None] - r) * 70.0) ** 2).min(axis=2)
    assert np.allclose(out, want)
    with pytest.raises(ValueError):
        X.distance_transform(df.where("r < 0"), g)


def test_diagonal_cells_are_one_zone(spark):
    df = spark.createDataFrame([(4, 4), (5, 5), (0, 9)], "r int, c int")
    out = C.label_components(df, G.GridSpec(0, 0, 1, 1, 10, 10), tile=3)
    assert out.select("zone").distinct().count() == 2


@pytest.mark.parametrize("tile", [4, 64])
def test_components_match_flood_fill(spark, tile):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 30)) < 0.42
    seen = np.full(mask.shape, -1)
    for i, j in zip(*np.nonzero(mask)):
        if seen[i, j] < 0:
            stack = [(i, j)]
            seen[i, j] = i * 30 + j
            while stack:
                a, b = stack.pop()
                for p in range(max(a - 1, 0), min(a + 2, 40)):
                    for q in range(max(b - 1, 0), min(b + 2, 30)):
                        if mask[p, q] and seen[p, q] < 0:
                            seen[p, q] = i * 30 + j
                            stack.append((p, q))
    r, c = np.nonzero(mask)
    df = spark.createDataFrame(pd.DataFrame({"r": r, "c": c}))
    out = C.label_components(df, G.GridSpec(0, 0, 1, 1, 30, 40), tile=tile).collect()
    assert all(seen[x["r"], x["c"]] == x["zone"] for x in out) and len(out) == mask.sum()


def test_halo_tiling(spark):
    """Values mod 17 + 5 times 100, one empty tile, each tile seen with its halo."""
    a = (np.arange(120.0).reshape(10, 12) % 17) + 5
    a[0:4, 0:4] = np.nan
    out = array(G.apply_tiled(cells(spark, a), "v", 4, 2, lambda x, r0, c0: x * 100), (10, 12))
    assert np.allclose(out, a * 100, equal_nan=True)


def test_cell_comparison(spark):
    a = np.full((2, 3), 2000.0)
    b = a.copy()
    b[0, 1], b[1, 2] = 2002.0, 0.0
    r = G.compare_cells(cells(spark, a), cells(spark, b), "v", 0.05).first()
    assert round(r.pct_identical, 2) == 66.67 and r.n_zero == 1 and r.max_rel_pct == 100.0 and r.n_above_tol == 2


def test_full_grid_fills_nodata(spark):
    a = np.array([[1.0, np.nan], [np.nan, 4.0]])
    out = G.to_full_grid(cells(spark, a), G.GridSpec(0, 2, 1, 1, 2, 2), "v")
    assert sorted(r.v for r in out.collect()) == [-9999.0, -9999.0, 1.0, 4.0]


def test_mosaic_first_valid_and_repeated_tile(spark):
    rows = [("a", 0, 0, 0, None), ("b", 1, 0, 0, 7.0), ("a", 2, 0, 0, 9.0), ("b", 1, 0, 1, 3.0), ("c", 2, 0, 1, 4.0)]
    out = G.mosaic(spark.createDataFrame(rows, "tile_name string, prio int, r int, c int, v double"))
    assert {(r.r, r.c): r.v for r in out.collect()} == {(0, 0): 7.0, (0, 1): 3.0}


def test_crop_keeps_the_reference(spark):
    df, g = G.crop(cells(spark, np.arange(25.0).reshape(5, 5)), G.GridSpec(100, 200, 10, 10, 5, 5), 1, 2, 2, 2)
    assert (g.x0, g.y0, g.width) == (120, 190, 2) and sorted(r.v for r in df.collect()) == [7.0, 8.0, 12.0, 13.0]


def test_rasterize_disc_and_touch(spark):
    g = G.GridSpec(0, 100, 10, 10, 10, 10)
    p = spark.createDataFrame([(1, 50.0, 50.0, 12.0)], "k int, x double, y double, rad double")
    assert P.rasterize_discs(p, "k", "rad", g).count() == 4
    line = spark.createDataFrame([(1, 5.0, 95.0, 95.0, 95.0)], "k int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.r, r.c) for r in P.rasterize_lines(line, "k", g).collect()}
    assert got == {(0, c) for c in range(10)}


def test_irradiance_units(spark):
    def run(vals):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
        med = df.agg(F.percentile("v", F.lit(0.5))).scalar()
        return [r.d for r in df.select("i", K.daily_unit("v", med).alias("d")).orderBy("i").collect()]

    day = [6.2, 7.4, None, 5.0]
    assert run(day) == day
    assert np.allclose([v for v in run([None if v is None else v * 365 for v in day]) if v], [6.2, 7.4, 5.0])
    with pytest.raises(Exception, match="irradiance unit"):
        run([250.0, 270.0])


def test_irradiance_alignment(spark):
    src = np.full((20, 20), 6.5)
    src[:, :8] = 0.0
    gs = G.GridSpec(0, 2000, 100, 100, 20, 20)
    gd = G.GridSpec(400, 1600, 90, 90, 12, 10)
    out = array(U.align_irradiance(cells(spark, src), "v", gs, gd.cells(spark), gd), (10, 12))
    assert np.isnan(out[:, 0]).all() and np.allclose(out[:, 6:], 6.5)


def test_minmax_constant_layer(spark):
    df = spark.createDataFrame([(0, 0, 3.0, 1.0), (0, 1, 3.0, 5.0)], "r int, c int, k double, v double")
    out = U.normalised(df, {"k": True, "v": False}).orderBy("c").collect()
    assert [(r.n_k, r.n_v) for r in out] == [(0.0, 1.0), (0.0, 0.0)]
