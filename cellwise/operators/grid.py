"""Cell tables: affine, resampling, neighbourhoods, tiling, mosaics.

A raster is a table ``(r, c, bands...)`` plus a small :class:`GridSpec`. Rows run
south, columns run east; a missing value is NULL or an absent row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NODATA, add, col
from .joins import dealt_join
from .ranks import cumulative, _at


@dataclass(frozen=True)
class GridSpec:
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    srid: int | None = None

    @staticmethod
    def from_bounds(xmin: float, ymin: float, xmax: float, ymax: float,
                    res: float, srid: int | None = None) -> "GridSpec":
        """Reference grid that covers the bounds at a resolution."""
        width = max(1, math.ceil((xmax - xmin) / res))
        height = max(1, math.ceil((ymax - ymin) / res))
        return GridSpec(float(xmin), float(ymax), float(res), float(res), width, height, srid)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return (self.x0, self.y0 - self.height * self.dy,
                self.x0 + self.width * self.dx, self.y0)

    @property
    def cell_area(self) -> float:
        return self.dx * self.dy

    def stamp(self, srid: int) -> "GridSpec":
        """Put back a lost reference system; refuse to change a known one."""
        if self.srid not in (None, srid):
            raise ValueError(f"grid is in {self.srid}, not {srid}: reproject it first")
        return replace(self, srid=srid)

    def require(self, srid: int, other: "GridSpec | None" = None) -> "GridSpec":
        """Check the reference system and, if given, that the extents overlap."""
        if self.srid != srid:
            raise ValueError(f"grid must be in {srid}, found {self.srid}")
        if other is not None:
            a, b = self.bounds, other.bounds
            if a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1]:
                raise ValueError("grids do not overlap")
        return self

    def x(self, c: Column | str = "c") -> Column:
        return F.lit(self.x0) + (col(c) + 0.5) * F.lit(self.dx)

    def y(self, r: Column | str = "r") -> Column:
        return F.lit(self.y0) - (col(r) + 0.5) * F.lit(self.dy)

    def row(self, y: Column | str) -> Column:
        return F.floor((F.lit(self.y0) - col(y)) / F.lit(self.dy))

    def column(self, x: Column | str) -> Column:
        return F.floor((col(x) - F.lit(self.x0)) / F.lit(self.dx))

    def holds(self, r: Column | str = "r", c: Column | str = "c") -> Column:
        return col(r).between(0, self.height - 1) & col(c).between(0, self.width - 1)

    def cell_id(self, r: Column | str = "r", c: Column | str = "c") -> Column:
        return col(r) * F.lit(self.width).cast("bigint") + col(c)

    def cells(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.width * self.height)
        w = F.lit(self.width).cast("bigint")
        return ids.select(F.expr(f"id div {self.width}").alias("r"), F.pmod("id", w).alias("c"))

    def window(self, r0: int, c0: int, height: int, width: int) -> "GridSpec":
        return replace(self, x0=self.x0 + c0 * self.dx, y0=self.y0 - r0 * self.dy,
                       width=width, height=height)

    def coarser(self, factor: int) -> "GridSpec":
        return replace(self, dx=self.dx * factor, dy=self.dy * factor,
                       width=math.ceil(self.width / factor), height=math.ceil(self.height / factor))


def with_centres(df: DataFrame, grid: GridSpec) -> DataFrame:
    return df.withColumn("x", grid.x()).withColumn("y", grid.y())


def to_full_grid(df: DataFrame, grid: GridSpec, value: str, nodata: float | None = NODATA) -> DataFrame:
    """Every cell of the grid with its value, missing cells filled."""
    full = grid.cells(df.sparkSession).join(df.select("r", "c", value), ["r", "c"], "left")
    return full if nodata is None else full.withColumn(value, F.coalesce(value, F.lit(float(nodata))))


# -- resampling -----------------------------------------------------------------

def _bilinear(keep: pa.Table, src: pa.Table, value: str, tile: int) -> pa.Table:
    """Values of the target rows of one source tile; the tile's cells come with a halo of one cell to the south and east."""
    qr, qc, u, w = (keep[c].to_numpy() for c in ("_qr", "_qc", "_u", "_w"))
    grid, known = np.zeros((tile + 1, tile + 1)), np.zeros((tile + 1, tile + 1), bool)
    if len(src) and len(keep):
        r0, c0 = qr[0] // tile * tile, qc[0] // tile * tile
        r, c = src["r"].to_numpy() - r0, src["c"].to_numpy() - c0
        grid[r, c], known[r, c] = src["v"].to_numpy(), True
    else:
        r0 = c0 = 0
    fu, fw = u - qc, w - qr
    num, den = np.zeros(len(qr)), np.zeros(len(qr))
    for i, j, weight in ((0, 0, (1 - fw) * (1 - fu)), (0, 1, (1 - fw) * fu), (1, 0, fw * (1 - fu)), (1, 1, fw * fu)):
        a, b = (qr - r0 + i, qc - c0 + j) if len(src) else (np.zeros(len(qr), int), np.zeros(len(qr), int))
        num += np.where(known[a, b], weight * grid[a, b], 0.0)
        den += np.where(known[a, b], weight, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = pa.array(num / den, mask=~(den > 0))
    return keep.drop_columns(["_tr", "_tc", "_qr", "_qc", "_u", "_w"]).append_column(value, out)


def tile_side(src_grid: GridSpec, dst_grid: GridSpec, most: int = 1 << 18) -> int:
    """Side of a source tile that holds at most about ``most`` source cells, and target cells."""
    ratio = (src_grid.dx * src_grid.dy) / (dst_grid.dx * dst_grid.dy)
    return max(1, min(256, int(math.sqrt(most / max(1.0, ratio)))))


def tiles_with_halo(src: DataFrame, value: str, tile: int) -> DataFrame:
    """Source cells by tile, those on the first row or column of a tile also in the tile before."""
    at = lambda c: F.expr(f"floor({c} / {tile})")
    tiles = lambda c: F.array_distinct(F.array(at(c), at(f"({c} - 1)")))
    rows = src.where(F.col(value).isNotNull()).select(F.col("r").cast("bigint"), F.col("c").cast("bigint"), F.col(value).cast("double").alias("v"))
    return rows.withColumn("_tr", F.explode(tiles("r"))).withColumn("_tc", F.explode(tiles("c")))


def resample(src: DataFrame, value: str, src_grid: GridSpec, dst: DataFrame,
             dst_grid: GridSpec, method: str = "bilinear") -> DataFrame:
    """Value of ``src`` at the centres of the ``dst`` cells.

    Bilinear weights are renormalised over the neighbours that hold a value. The
    source is dealt once into tiles with a halo, the target rows once to the tile
    of their neighbourhood; values are computed inside the tiles.
    """
    u = (dst_grid.x() - F.lit(src_grid.x0)) / F.lit(src_grid.dx)
    w = (F.lit(src_grid.y0) - dst_grid.y()) / F.lit(src_grid.dy)
    keep = [k for k in dst.columns if k != value]
    if method == "nearest":
        at = dst.select(*keep, F.floor(w).alias("_r"), F.floor(u).alias("_c"))
        band = src.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value))
        return at.join(band, ["_r", "_c"], "left").drop("_r", "_c")
    if method != "bilinear":
        raise ValueError(f"unknown resampling method: {method}")
    tile = tile_side(src_grid, dst_grid)
    at = dst.select(*keep, (u - 0.5).alias("_u"), (w - 0.5).alias("_w"))
    at = at.select("*", F.floor("_w").alias("_qr"), F.floor("_u").alias("_qc"))
    at = at.select("*", F.expr(f"floor(_qr / {tile})").alias("_tr"), F.expr(f"floor(_qc / {tile})").alias("_tc"))
    schema = T.StructType([*[dst.schema[k] for k in keep], T.StructField(value, T.DoubleType())])
    both = at.groupBy("_tr", "_tc").cogroup(tiles_with_halo(src, value, tile).groupBy("_tr", "_tc"))
    return both.applyInArrow(partial(_bilinear, value=value, tile=tile), schema)


def resample_keep_zero(src: DataFrame, value: str, src_grid: GridSpec, dst: DataFrame,
                       dst_grid: GridSpec) -> DataFrame:
    """Bilinear over cells with signal; cells whose nearest source has none become 0."""
    flagged = src.where(F.col(value).isNotNull()).select(
        "r", "c", F.when(F.col(value) > 0, F.col(value)).alias(value),
        (F.col(value) <= 0).alias("_none"))
    smooth = resample(flagged.select("r", "c", value), value, src_grid, dst, dst_grid)
    both = resample(flagged.select("r", "c", "_none"), "_none", src_grid, smooth, dst_grid, "nearest")
    return both.withColumn(value, F.when(F.col("_none"), F.lit(0.0)).otherwise(F.col(value))).drop("_none")


def sample_at(points: DataFrame, key: str, band: DataFrame, value: str, grid: GridSpec,
              circular: bool = False) -> DataFrame:
    """Band value at each point; where it is missing, the mean of the valid 3x3.

    The window mean is computed per missing cell, not per point, so that many
    points in one cell cost one row.
    """
    at = points.withColumn("_r", grid.row("y")).withColumn("_c", grid.column("x"))
    have = band.where(F.col(value).isNotNull()).select(
        F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).cast("double").alias(value))
    holes = (at.where(grid.holds("_r", "_c")).select("_r", "_c").distinct()
             .join(have.select("_r", "_c"), ["_r", "_c"], "left_anti"))
    around = holes.select(
        F.col("_r").alias("hr"), F.col("_c").alias("hc"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                            for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"))
    around = around.select("hr", "hc", (F.col("hr") + F.col("o.i")).alias("_r"),
                           (F.col("hc") + F.col("o.j")).alias("_c")).join(have, ["_r", "_c"])
    if circular:
        rad = F.radians(value)
        mean = F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))
    else:
        mean = F.avg(value)
    filled = around.groupBy(F.col("hr").alias("_r"), F.col("hc").alias("_c")).agg(mean.alias(value))
    return dealt_join(at, have.unionByName(filled), ["_r", "_c"], F.col(key), "left").drop("_r", "_c")


def sample_or_mean(points: DataFrame, key: str, band: DataFrame, value: str,
                   grid: GridSpec) -> DataFrame:
    """Sampled value, or the mean of the whole band where the window is empty too."""
    mean = band.agg(F.avg(value).alias("m")).scalar()
    return sample_at(points, key, band, value, grid).withColumn(value, F.coalesce(value, mean))


# -- neighbourhoods ----------------------------------------------------------------

def neighbours(df: DataFrame, value: str) -> DataFrame:
    """The 3x3 values around each cell as ``n_<di>_<dj>`` columns (m, z, p for -1, 0, 1).

    Two window passes, along rows and along columns of the grid; each window
    group is one line of cells.
    """
    tag = {-1: "m", 0: "z", 1: "p"}
    along = Window.partitionBy("r").orderBy("c")
    west, east = F.lag(F.struct("c", value)).over(along), F.lead(F.struct("c", value)).over(along)
    line = df.select(
        "r", "c",
        F.when(west["c"] == F.col("c") - 1, west[value]).alias("h_m"), F.col(value).alias("h_z"),
        F.when(east["c"] == F.col("c") + 1, east[value]).alias("h_p"))
    across = Window.partitionBy("c").orderBy("r")
    pack = F.struct("r", "h_m", "h_z", "h_p")
    north, south = F.lag(pack).over(across), F.lead(pack).over(across)
    cols = []
    for j in (-1, 0, 1):
        h = f"h_{tag[j]}"
        cols.append(F.when(north["r"] == F.col("r") - 1, north[h]).alias(f"n_m_{tag[j]}"))
        cols.append(F.col(h).alias(f"n_z_{tag[j]}"))
        cols.append(F.when(south["r"] == F.col("r") + 1, south[h]).alias(f"n_p_{tag[j]}"))
    return line.select("r", "c", *cols)


def _gradients(grid: GridSpec) -> tuple[Column, Column]:
    n = lambda k: F.col(f"n_{k}")
    east = ((n("m_p") + 2.0 * n("z_p") + n("p_p")) - (n("m_m") + 2.0 * n("z_m") + n("p_m"))) / (8.0 * grid.dx)
    south = ((n("p_m") + 2.0 * n("p_z") + n("p_p")) - (n("m_m") + 2.0 * n("m_z") + n("m_p"))) / (8.0 * grid.dy)
    return east, south


def terrain(df: DataFrame, elev: str, grid: GridSpec) -> DataFrame:
    """Slope and aspect in degrees; NULL where a neighbour is missing, flat has no aspect."""
    p, s = _gradients(grid)
    d = neighbours(df, elev).select("r", "c", p.alias("p"), s.alias("s"), F.col("n_z_z").alias("_z"))
    p, s = F.col("p"), F.when(F.col("_z").isNotNull(), F.col("s"))
    aspect = F.pmod(F.degrees(F.atan2(-p, s)), F.lit(360.0))
    return d.select("r", "c", F.degrees(F.atan(F.sqrt(p * p + s * s))).alias("slope"),
                    F.when((p != 0) | (s != 0), aspect).alias("aspect"))


# -- windows, overviews, tiles --------------------------------------------------------

def crop(df: DataFrame, grid: GridSpec, r0: int, c0: int, height: int, width: int
         ) -> tuple[DataFrame, GridSpec]:
    kept = df.where(F.col("r").between(r0, r0 + height - 1) & F.col("c").between(c0, c0 + width - 1))
    return (kept.withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0),
            grid.window(r0, c0, height, width))


def overview(df: DataFrame, grid: GridSpec, value: str, max_side: int, method: str = "nearest"
             ) -> tuple[DataFrame, GridSpec]:
    """Smaller grid whose longer side is at most ``max_side``."""
    f = max(1, math.ceil(max(grid.width, grid.height) / max_side))
    out = grid.coarser(f)
    if method == "nearest":
        pick = f // 2
        kept = df.where((F.pmod("r", F.lit(f)) == pick) & (F.pmod("c", F.lit(f)) == pick))
        return kept.select(F.expr(f"r div {f}").alias("r"), F.expr(f"c div {f}").alias("c"), value), out
    return df.groupBy(F.expr(f"r div {f}").alias("r"), F.expr(f"c div {f}").alias("c")).agg(
        F.avg(value).alias(value)), out


def mosaic(tiles: DataFrame) -> DataFrame:
    """Merge tiles ``(tile_name, prio, r, c, v)``: a repeated tile name counts once,
    then the first valid value of a cell wins."""
    first = tiles.groupBy("tile_name").agg(F.min("prio").alias("prio"))
    kept = tiles.where(F.col("v").isNotNull()).join(first, ["tile_name", "prio"], "left_semi")
    return kept.groupBy("r", "c").agg(
        F.min_by("v", F.struct("prio", "tile_name")).alias("v"))


def apply_tiled(df: DataFrame, value: str, tile: int, halo: int, fn: Callable, skip_empty: bool = True
                ) -> DataFrame:
    """Run ``fn(array, r0, c0) -> array`` on tiles with a halo and keep the interiors.

    A group holds at most ``(tile + 2 * halo)^2`` cells. Tiles whose interior has
    no data are left out when ``skip_empty`` is set.
    """
    reach = range(-math.ceil(halo / tile), math.ceil(halo / tile) + 1) if halo else range(1)
    tr, tc = F.expr(f"r div {tile}"), F.expr(f"c div {tile}")
    spread = df.where(F.col(value).isNotNull()).select(
        "r", "c", value,
        F.explode(F.array(*[F.struct((tr + i).alias("tr"), (tc + j).alias("tc"))
                            for i in reach for j in reach])).alias("t")).select("r", "c", value, "t.*")
    spread = spread.where(
        (F.col("r") >= F.col("tr") * tile - halo) & (F.col("r") < (F.col("tr") + 1) * tile + halo)
        & (F.col("c") >= F.col("tc") * tile - halo) & (F.col("c") < (F.col("tc") + 1) * tile + halo)
        & (F.col("tr") >= 0) & (F.col("tc") >= 0))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile - halo, int(key[1]) * tile - halo
        side = tile + 2 * halo
        block = np.full((side, side), np.nan)
        block[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf[value].to_numpy()
        inner = slice(halo, halo + tile)
        if skip_empty and np.isnan(block[inner, inner]).all():
            return pd.DataFrame({"r": [], "c": [], value: []}).astype({"r": "int64", "c": "int64"})
        out = np.asarray(fn(block, r0, c0), dtype="float64")[inner, inner]
        rr, cc = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"r": rr + r0 + halo, "c": cc + c0 + halo, value: out[rr, cc]})

    return spread.groupBy("tr", "tc").applyInPandas(run, f"r bigint, c bigint, {value} double")


# -- overlay and comparison --------------------------------------------------------------

def overlay(layers: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    """Join cell tables on their cell."""
    out = layers[0]
    for other in layers[1:]:
        out = out.join(other, ["r", "c"], how)
    return out


def compare_cells(a: DataFrame, b: DataFrame, value: str, tol: float) -> DataFrame:
    """Agreement of two rasters: share identical, relative differences in percent, zeros."""
    va, vb = F.col("_a"), F.col("_b")
    both = (a.select("r", "c", F.col(value).alias("_a"))
            .join(b.select("r", "c", F.col(value).alias("_b")), ["r", "c"])
            .where(va.isNotNull() & vb.isNotNull())
            .select(F.coalesce(100.0 * F.try_divide(F.abs(vb - va), F.abs(va)),
                               F.when(va == vb, 0.0).otherwise(100.0)).alias("rel"),
                    (va == vb).cast("int").alias("same"), (vb == 0).cast("int").alias("zero")))
    t = cumulative(both, "rel", {"n": F.count(F.lit(1)), "same": F.sum("same"), "zero": F.sum("zero")})
    return t.agg(F.sum("n").alias("n"),
                 (100.0 * F.sum("same") / F.sum("n")).alias("pct_identical"),
                 _at(t, "rel", 0.5).alias("median_rel_pct"), F.max("rel").alias("max_rel_pct"),
                 F.coalesce(F.sum(F.when(F.col("rel") > tol, F.col("n"))), F.lit(0)).alias("n_above_tol"),
                 F.sum("zero").alias("n_zero"))
