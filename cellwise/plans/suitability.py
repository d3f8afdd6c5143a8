"""Suitability layers: feature table, weighted profiles, masks, display layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators.grid import GridSpec, resample
from ..operators.nearest import nearest
from ..operators.polygons import rasterize, rasterize_lines
from ..operators.proximity import distance_transform
from ..operators.ranks import quantiles


@dataclass(frozen=True)
class Zone:
    """A study zone: its region codes and how they match."""

    name: str
    codes: Sequence[str]
    filter_mode: str = "exact"
    layers: Mapping[str, str] = field(default_factory=dict)


def layer_cells(layer: DataFrame, key: str, grid: GridSpec, shape: str) -> DataFrame:
    """Cells that a point or line layer occupies."""
    if shape == "segment":
        return rasterize_lines(layer, key, grid).select("r", "c").distinct()
    at = layer.select(grid.row("y").alias("r"), grid.column("x").alias("c"))
    return at.where(grid.holds()).distinct()


def distance_band(cells: DataFrame, layer: DataFrame, key: str, grid: GridSpec, shape: str,
                  mode: str = "raster") -> DataFrame:
    """Distance of every cell to a layer: ``raster`` between cells, ``exact`` to the vectors."""
    if mode == "raster":
        return distance_transform(layer_cells(layer, key, grid, shape), grid)
    if mode != "exact":
        raise ValueError(f"unknown distance mode: {mode}")
    pts = cells.select(grid.cell_id().alias("cell"), "r", "c", grid.x().alias("x"), grid.y().alias("y"))
    near = nearest(pts.select("cell", "x", "y"), layer, "cell", key, shape=shape).select("cell", "dist")
    return pts.select("cell", "r", "c").join(near, "cell").select("r", "c", "dist")


def build_features(spark: SparkSession, grid: GridSpec, bands: Mapping[str, tuple[DataFrame, GridSpec]],
                   layers: Mapping[str, tuple[DataFrame, str, str]], region_edges: DataFrame | None = None,
                   polygon: str = "zone_id", mode: str = "raster") -> DataFrame:
    """Feature rows of the valid cells of a zone.

    ``bands`` hold ``ghi, slope, elev, aspect`` with their grids; ``layers`` hold
    one (frame, key, shape) per distance feature. Aspect is taken from the nearest
    cell, the other bands bilinearly.
    """
    cells = grid.cells(spark)
    if region_edges is not None:
        cells = rasterize(region_edges, polygon, grid, all_touched=True).select("r", "c").distinct()
    out = cells
    for band, (df, g) in bands.items():
        if g == grid:
            out = out.join(df.select("r", "c", band), ["r", "c"])
        else:
            out = resample(df, band, g, out, grid, "nearest" if band == "aspect" else "bilinear")
    out = out.withColumn("northness", K.northness("aspect"))
    for feature, (layer, key, shape) in layers.items():
        d = distance_band(cells, layer, key, grid, shape, mode).withColumnRenamed("dist", feature)
        out = out.join(d, ["r", "c"])
    return out.dropna(subset=K.FEATURES).select("r", "c", *K.FEATURES)


def normalised(cells: DataFrame, benefit: Mapping[str, bool]) -> DataFrame:
    """Min-max layers ``n_<criterion>`` over the valid cells."""
    lim = cells.agg(*[F.min(k).alias(f"lo_{k}") for k in benefit], *[F.max(k).alias(f"hi_{k}") for k in benefit])
    s = lim.select(F.struct("*")).scalar()
    return cells.withColumn("_l", s).select(
        *cells.columns, *[K.minmax(k, F.col(f"_l.lo_{k}"), F.col(f"_l.hi_{k}"), b).alias(f"n_{k}")
                          for k, b in benefit.items()])


def profile(cells: DataFrame, benefit: Mapping[str, bool], weights: Mapping[str, float], name: str,
            excluded: DataFrame | None = None) -> DataFrame:
    """Weighted linear combination of normalised criteria; exclusions become zero."""
    n = normalised(cells, benefit)
    out = n.withColumn(name, K.weighted({k: F.col(f"n_{k}") for k in benefit}, weights)).drop(
        *[f"n_{k}" for k in benefit])
    return out if excluded is None else exclude_cells(out, excluded, name)


def exclude_cells(cells: DataFrame, excluded: DataFrame, value: str) -> DataFrame:
    marks = excluded.select("r", "c").distinct().withColumn("_x", F.lit(True))
    out = cells.join(marks, ["r", "c"], "left")
    return out.withColumn(value, K.force_zero(value, F.coalesce("_x", F.lit(False)))).drop("_x")


def align_irradiance(src: DataFrame, value: str, src_grid: GridSpec, dst: DataFrame, dst_grid: GridSpec) -> DataFrame:
    """Irradiance on another grid in daily units; cells without signal stay missing."""
    live = src.select("r", "c", K.missing_if_no_signal(value).alias(value))
    median = quantiles(live, value, {"m": 0.5}).scalar()
    return resample(live.withColumn(value, K.daily_unit(value, median)), value, src_grid, dst, dst_grid)


def shared_limits(layers: Sequence[DataFrame], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentile limits over several layers together."""
    both = layers[0].select(value)
    for df in layers[1:]:
        both = both.unionByName(df.select(value))
    return quantiles(both, value, {"lo": low, "hi": high})


def stretched(cells: DataFrame, value: str, mode: str = "percentile", hide_below: float | None = None) -> DataFrame:
    """Display layer: ``unit`` keeps 0..1, ``percentile`` stretches between p2 and p98,
    ``category`` keeps codes."""
    if mode == "category":
        return cells.withColumn("shade", F.col(value).cast("double"))
    if mode == "unit":
        return cells.withColumn("shade", K.stretch(value, 0.0, 1.0, hide_below))
    if mode != "percentile":
        raise ValueError(f"unknown display mode: {mode}")
    lim = shared_limits([cells], value).select(F.struct("*")).scalar()
    return cells.withColumn("_l", lim).withColumn(
        "shade", K.stretch(value, F.col("_l.lo"), F.col("_l.hi"), hide_below)).drop("_l")


def extent(layers: Sequence[DataFrame], x: str = "x", y: str = "y") -> DataFrame:
    """Combined bounding box of several layers."""
    out = layers[0].select(x, y)
    for df in layers[1:]:
        out = out.unionByName(df.select(x, y))
    return out.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))
