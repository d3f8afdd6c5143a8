"""Distance transforms of cell masks and order-dependent spatial duplicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, partitions
from .grid import GridSpec


def _row_minimum(g2: np.ndarray, at: np.ndarray, width: int, dx: float) -> np.ndarray:
    """min over k of (dx * (c - at[k]))^2 + g2[k] for every column c of one row.

    The best k never moves left as c moves right. Columns are solved by halving:
    all columns of a level search at once between the answers of their neighbours.
    """
    best = np.full(width + 2, -1, dtype=np.int64)
    best[0], best[width + 1] = 0, len(at) - 1
    out = np.empty(width)
    step = 1 << width.bit_length()
    while step >= 2:
        step //= 2
        c = np.arange(step, width + 1, 2 * step)  # 1-based columns of this level
        lo = best[c - step]
        hi = best[np.minimum(c + step, width + 1)]
        size = hi - lo + 1
        head = np.concatenate([[0], np.cumsum(size)[:-1]])
        k = np.arange(size.sum()) - np.repeat(head - lo, size)
        d = g2[k] + ((np.repeat(c - 1, size) - at[k]) * dx) ** 2
        low = np.minimum.reduceat(d, head)
        hit = np.flatnonzero(d == np.repeat(low, size))
        best[c] = k[hit[np.searchsorted(hit, head)]]
        out[c - 1] = low
    return out


def distance_transform(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """Distance from every cell centre to the nearest mask cell centre.

    First pass: per column, nearest mask row above and below (window). Second
    pass: per row, the minimum over columns in one small array kernel. An empty
    mask is an error.
    """
    spark = mask.sparkSession
    marks = mask.select(F.col("r").cast("bigint"), F.col("c").cast("bigint")).distinct()
    if marks.isEmpty():
        raise ValueError("distance transform of an empty layer")
    full = grid.cells(spark).join(marks.withColumn("m", F.col("r")), ["r", "c"], "left")
    down = Window.partitionBy("c").orderBy("r")
    above = F.last("m", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    # the other direction runs on the reversed order: a frame that only grows costs one pass
    up = Window.partitionBy("c").orderBy(F.desc("r"))
    below = F.last("m", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.least(F.col("r") - above, below - F.col("r"))  # least skips NULL
    vertical = full.select("r", "c", (gap * F.lit(grid.dy)).alias("g"))
    width, dx = grid.width, grid.dx
    # rows travel in bands of bounded size, to pay the call overhead once per band
    band = F.expr(f"r div {max(1, min(32, 2_000_000 // width))}")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["g"]).sort_values(["r", "c"])
        r, c, g2 = pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["g"].to_numpy() ** 2
        rows, start = np.unique(r, return_index=True)
        ends = np.append(start[1:], len(r))
        d2 = [_row_minimum(g2[i:j], c[i:j], width, dx) for i, j in zip(start, ends)]
        return pd.DataFrame({"r": np.repeat(rows, width), "c": np.tile(np.arange(width), len(rows)),
                             "dist": np.sqrt(np.concatenate(d2))})

    # a fixed partition count: the work per byte is too high to let partitions be merged
    spread = vertical.withColumn("band", band).repartition(partitions(mask), "band")
    return spread.groupBy("band").applyInPandas(across, "r bigint, c bigint, dist double")


def _greedy_tile(pdf: pd.DataFrame, tol: float) -> pd.DataFrame:
    """Decisions of a tile's own records that nothing outside the tile or behind a square's horizon can change.

    Records come in key order. One is rejected by an earlier kept record in reach, kept if every earlier record in reach is
    surely rejected and all of them are here, and open else.
    """
    pdf = pdf.sort_values("k", kind="stable")
    horizon = pdf.groupby(["sx", "sy"])["horizon"].first().dropna().to_dict()
    kept: dict[tuple[int, int], tuple[float, float]] = {}
    unsure: dict[tuple[int, int], list[tuple[float, float]]] = {}
    reach = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    near = lambda p, x, y: math.sqrt((p[0] - x) ** 2 + (p[1] - y) ** 2) < tol
    out = []
    for k, x, y, sx, sy, core in zip(pdf["k"], pdf["x"], pdf["y"], pdf["sx"], pdf["sy"], pdf["core"]):
        squares = [(sx + i, sy + j) for i, j in reach]
        if any(s in kept and near(kept[s], x, y) for s in squares):
            state = "rejected"
        elif (not core or any(s in horizon and k > horizon[s] for s in squares)
              or any(near(p, x, y) for s in squares for p in unsure.get(s, ()))):
            state = "open"
            unsure.setdefault((sx, sy), []).append((x, y))
        else:
            state, kept[sx, sy] = "kept", (x, y)
        if core and state == "kept":
            out.append(k)
    return pdf.loc[pdf["core"] & pdf["k"].isin(out), ["k", "x", "y", "sx", "sy"]]


def spatial_duplicates(records: DataFrame, key: str, tol: float, x: str = "x", y: str = "y",
                       tile: int = 256, per_square: int = 16) -> DataFrame:
    """Later records within ``tol`` of an earlier kept one: ``(key, kept, dist)``.

    Records are visited in key order; a kept record rejects every later record
    closer than the tolerance. Records go into squares whose diagonal is below the
    tolerance, so a square keeps at most one. A round decides whole tiles of
    ``tile`` squares a side at once: of each square the first ``per_square``
    undecided records are looked at, so a task holds a bounded number, and what
    depends on records elsewhere stays open. Then the records that the kept ones
    cover are rejected everywhere. A chain of dependent records takes one round
    per tile that it crosses. A record meets at most one kept record per square in reach.
    """
    side = tol / math.sqrt(2.0) * (1.0 - 1e-9)
    reach = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    p = records.dropna(subset=[x, y]).select(
        F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    p = p.select("*", F.floor(F.col("x") / side).alias("sx"), F.floor(F.col("y") / side).alias("sy"))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in reach]))
    pending, kept = cut(p), None
    square = Window.partitionBy("sx", "sy").orderBy("k")
    tx, ty = [F.floor(F.col(s) / tile) for s in ("sx", "sy")]
    seen_by = F.explode(F.array_distinct(F.array(*[
        F.struct(F.floor((F.col("sx") + i) / tile).alias("tx"), F.floor((F.col("sy") + j) / tile).alias("ty"))
        for i in (-2, 0, 2) for j in (-2, 0, 2)])))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields)
    while not pending.isEmpty():
        # one more record than is sent tells whether a square goes on; its key is the square's horizon
        first = pending.withColumn("_rn", F.row_number().over(square)).where(F.col("_rn") <= per_square + 1)
        ends = first.where(F.col("_rn") > per_square).select("sx", "sy", F.col("k").alias("horizon"))
        sent = first.where(F.col("_rn") <= per_square).join(ends, ["sx", "sy"], "left")
        sent = sent.select("k", "x", "y", "sx", "sy", "horizon", seen_by.alias("t"), tx.alias("ox"), ty.alias("oy"))
        sent = sent.select("t.tx", "t.ty", "k", "x", "y", "sx", "sy", "horizon",
                           ((F.col("t.tx") == F.col("ox")) & (F.col("t.ty") == F.col("oy"))).alias("core"))
        chosen = cut(sent.groupBy("tx", "ty").applyInPandas(
            lambda pdf: _greedy_tile(pdf, tol), schema))
        kept = chosen if kept is None else kept.unionByName(chosen)
        around = chosen.select(F.col("k").alias("kk"), F.col("x").alias("kx"), F.col("y").alias("ky"),
                               offsets.alias("o"), "sx", "sy")
        around = around.select("kk", "kx", "ky", (F.col("sx") + F.col("o.i")).alias("sx"),
                               (F.col("sy") + F.col("o.j")).alias("sy"))
        d = F.sqrt((F.col("x") - F.col("kx")) ** 2 + (F.col("y") - F.col("ky")) ** 2)
        covered = pending.join(around, ["sx", "sy"]).where(d < tol).select("k").distinct()
        pending = cut(pending.join(covered, "k", "left_anti"))
    if kept is None:
        return p.select(F.col("k").alias(key), F.col("k").alias("kept"), F.col("x").alias("dist")).limit(0)
    around = kept.select(F.col("k").alias("kept"), F.col("x").alias("kx"), F.col("y").alias("ky"),
                         offsets.alias("o"), "sx", "sy")
    around = around.select("kept", "kx", "ky", (F.col("sx") + F.col("o.i")).alias("sx"),
                           (F.col("sy") + F.col("o.j")).alias("sy"))
    d = F.sqrt((F.col("x") - F.col("kx")) ** 2 + (F.col("y") - F.col("ky")) ** 2)
    hits = p.join(around, ["sx", "sy"]).where(F.col("kept") < F.col("k")).withColumn("dist", d).where(
        F.col("dist") < tol)
    return hits.groupBy(F.col("k").alias(key)).agg(F.min(F.struct("kept", "dist")).alias("w")).select(
        key, "w.kept", "w.dist")
