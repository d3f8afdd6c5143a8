"""Tiled resampling, nested zones, fits side by side and line-delimited layers."""

import json
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.operators import components as C
from cellwise.operators import grid as G
from cellwise.runtime import together
from cellwise.sources import readers as R


def naive_bilinear(src, grid, x, y):
    u, w = (x - grid.x0) / grid.dx - 0.5, (grid.y0 - y) / grid.dy - 0.5
    qc, qr = int(np.floor(u)), int(np.floor(w))
    fu, fw = u - qc, w - qr
    num = den = 0.0
    for i, j, weight in ((0, 0, (1 - fw) * (1 - fu)), (0, 1, (1 - fw) * fu), (1, 0, fw * (1 - fu)), (1, 1, fw * fu)):
        v = src.get((qr + i, qc + j))
        if v is not None:
            num, den = num + weight * v, den + weight
    return num / den if den > 0 else None


@pytest.mark.parametrize("cell", [0.7, 3.1])
def test_bilinear_over_tile_borders(spark, monkeypatch, cell):
    monkeypatch.setattr(G, "tile_side", lambda a, b: 4)
    rng = np.random.default_rng(3)
    src_grid = G.GridSpec(10.0, 50.0, 1.0, 1.5, 23, 19)
    dst_grid = G.GridSpec(8.0, 52.0, cell, cell, int(27 / cell), int(33 / cell))
    src = {(r, c): float(rng.normal()) for r in range(19) for c in range(23) if rng.random() < 0.8}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in src.items()] + [(1, 1, None)] * ((1, 1) not in src), "r long, c long, v double")
    dst = dst_grid.cells(spark).withColumn("big", F.col("r") + (1 << 60)).withColumn("name", F.when(F.col("c") % 2 == 0, "x"))
    got = G.resample(df, "v", src_grid, dst, dst_grid)
    assert got.columns == ["r", "c", "big", "name", "v"]
    rows = got.collect()
    assert len(rows) == dst_grid.width * dst_grid.height
    for k in rows:
        want = naive_bilinear(src, src_grid, dst_grid.x0 + (k.c + 0.5) * cell, dst_grid.y0 - (k.r + 0.5) * cell)
        assert (k.v is None) == (want is None) and (want is None or k.v == pytest.approx(want))
        assert k.big == k.r + (1 << 60)


def test_halo_deals_the_source_about_once(spark):
    src = G.GridSpec(0.0, 0.0, 1.0, 1.0, 300, 300).cells(spark).withColumn("v", F.lit(1.0))
    assert 90_000 <= G.tiles_with_halo(src, "v", 256).count() < 1.05 * 90_000
    same = G.GridSpec(0.0, 0.0, 1.0, 1.0, 300, 300)
    assert G.tile_side(same, same) == 256 and G.tile_side(same, G.GridSpec(0.0, 0.0, 0.01, 0.01, 9, 9)) ** 2 * 1e4 <= 1 << 18
    plan = G.resample(src, "v", same, same.cells(spark), same)._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning") <= 4  # each side once (analysed and physical plans are both printed)


def test_nested_zones_equal_single_masks(spark):
    rng = np.random.default_rng(6)
    grid = G.GridSpec(0.0, 0.0, 1.0, 1.0, 40, 40)
    level = rng.integers(0, 5, (40, 40))
    rows = [(r, c, int(level[r, c]), int(rng.integers(0, 3))) for r in range(40) for c in range(40) if level[r, c] < 4]
    df = spark.createDataFrame(rows, "r long, c long, level int, p int")
    got = {(k.level, k.zone): (k.n, k.p) for k in C.nested_zones(df, grid, 4, ("p",), tile=7).collect()}
    want = {}
    for i in range(4):
        lab = C.label_components(df.where(F.col("level") <= i), grid).join(df, ["r", "c"]).groupBy("zone").agg(
            F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))
        want |= {(i, k.zone): (k.n, k.p) for k in lab.collect()}
    assert got == want
    assert C.nested_zones(df.limit(0), grid, 4, ("p",)).count() == 0


def test_nested_zones_with_a_hub(spark):
    """One zone over the whole map from the first level on."""
    grid = G.GridSpec(0.0, 0.0, 1.0, 1.0, 60, 60)
    df = grid.cells(spark).withColumn("level", (F.col("r") % 3).cast("int"))
    got = C.nested_zones(df, grid, 3, tile=4).groupBy("level").agg(F.count("*").alias("z"), F.sum("n").alias("n")).orderBy("level").collect()
    assert [(k.level, k.z, k.n) for k in got] == [(0, 20, 1200), (1, 20, 2400), (2, 1, 3600)]


def test_independent_tasks_run_side_by_side_in_order(spark):
    seen, lock, most = set(), threading.Lock(), [0]

    def task(k):
        with lock:
            seen.add(k)
            most[0] = max(most[0], len(seen))
        inner = together(spark, [lambda: k * 10, lambda: k * 10 + 1])  # no further threads inside
        time.sleep(0.2)
        with lock:
            seen.discard(k)
        return spark.range(k).count(), inner

    got = together(spark, [lambda k=k: task(k) for k in range(8)], at_most=3)
    assert got == [(k, [k * 10, k * 10 + 1]) for k in range(8)] and 1 < most[0] <= 3
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1 // 0, lambda: 2])


def test_layer_with_a_feature_per_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    features = [{"type": "Feature", "properties": {"id": f"z{i}", "name": "x" * 300}, "geometry": {
        "type": "Polygon", "coordinates": [[[float(a), float(b)] for a, b in [*ring, ring[0]]]]}} for i, ring in enumerate(rng.random((400, 5, 2)))]
    whole, lines = tmp_path / "whole.json", tmp_path / "lines.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    lines.write_text('{\n"type": "FeatureCollection",\n"features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]\n}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(40_000))
    try:
        a, b = R.read_geojson(spark, str(whole), "polygon"), R.read_geojson(spark, str(lines), "polygon", lines=True)
        cols = ["feature_id", "x1", "y1", "x2", "y2"]
        assert a.count() == b.count() == 2000
        assert a.select(cols).exceptAll(b.select(cols)).isEmpty()
        assert spark.read.text(str(lines)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    points = tmp_path / "points.json"
    points.write_text("\n".join(json.dumps({"type": "Feature", "properties": {"id": str(i)}, "geometry": {"type": "Point", "coordinates": [i, -i]}}) for i in range(5)))
    assert {(p.feature_id, p.x, p.y) for p in R.read_geojson(spark, str(points), "point", lines=True).collect()} == {(str(i), i, -i) for i in range(5)}


def test_layer_dictionary(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame(pd.DataFrame({"k": [1, 2], "layer": [name] * 2})).write.parquet(str(tmp_path / name))
    got = R.read_layers(spark, {n: str(tmp_path / n) for n in ("a", "b")})
    assert list(got) == ["a", "b"] and {r.layer for r in got["b"].collect()} == {"b"}
