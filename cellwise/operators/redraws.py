"""Rank correlation of rows whose blocks are redrawn, for many replicates at once.

Rows are not repeated per replicate: a row carries how often every replicate draws its block, as one short array. For each of the two
values, the arrays of equal values are added up, sorted in ranges and summed along the range; the ranges before a range only shift its
ranks, so a range hands on its sums, and the shifts are applied to those: per range and replicate a few numbers reach the driver. Ranks
are doubled (twice the rows before, plus the own ones), so they are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, partitions
from .joins import dealt_join

#: Replicates whose draws travel with a row, and values whose ranks are broadcast.
REPLICATES, FEW = 64, 4096


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _groups(v: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array (not-a-numbers are one value, the last)."""
    same = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _added(parts: Iterator[pa.RecordBatch], width: int, shift: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sums per value of a batch: of the draws ``w`` and, with ``shift`` per range, of the draws times the ranks ``l`` in range ``p``."""
    for batch in parts:
        if not batch.num_rows:
            continue
        v = batch.column("v").to_numpy()
        order = np.argsort(v, kind="stable")
        w = _matrix(batch, "w", width).astype(np.int64) * batch.column("m").to_numpy()[:, None]
        sums = [w]
        if shift is not None:
            sums.append(w * (_matrix(batch, "l", width) + shift[batch.column("p").to_numpy()]))
        v = v[order]
        first = _groups(v)
        yield pa.record_batch([pa.array(v[first]), *[_lists(np.add.reduceat(s[order], first, axis=0)) for s in sums]], ["v", "w", "s"][:1 + len(sums)])


def _sorted_values(parts: Iterator[pa.RecordBatch], names: list[str], width: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Range, values and sums of a sorted range, every value whole; the last value of a batch waits for the next."""
    held = None
    for batch in parts:
        if not batch.num_rows:
            continue
        p, v, rows = batch.column("p")[0].as_py(), batch.column("v").to_numpy(), [_matrix(batch, n, width) for n in names]
        if held is not None:
            v, rows = np.concatenate([held[0], v]), [np.concatenate([a, b]) for a, b in zip(held[1], rows)]
        first = _groups(v)
        v, rows = v[first], [np.add.reduceat(r, first, axis=0) for r in rows]
        held = v[-1:], [r[-1:] for r in rows]
        if len(v) > 1:
            yield p, v[:-1], [r[:-1] for r in rows]
    if held is not None:
        yield p, *held


def _ranked(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Ranks in the range of every value, and a last row without one for the sums of the range."""
    before, one, two, p = np.zeros(width, np.int64), np.zeros(width), np.zeros(width), None
    for p, v, (w,) in _sorted_values(parts, ["w"], width):
        after = before + np.cumsum(w, axis=0)
        rank = 2 * after - w
        one, two, before = one + (w * rank.astype(float)).sum(0), two + (w * rank.astype(float) ** 2).sum(0), after[-1]
        yield pa.record_batch([pa.array(np.full(len(v), p)), pa.array(v), _lists(rank), pa.nulls(len(v), pa.list_(pa.float64()))], ["p", "v", "l", "sums"])
    if p is not None:
        sums = np.concatenate([before.astype(float), one, two])
        yield pa.record_batch([pa.array([p]), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.int64())), _lists(sums[None, :])], ["p", "v", "l", "sums"])


def _moments(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums of a range: draws, draws times ranks and squared ranks, and the sums of ``s`` plain and times ranks."""
    before, out, p = np.zeros(width, np.int64), np.zeros((5, width)), None
    for p, _, (w, s) in _sorted_values(parts, ["w", "s"], width):
        after = before + np.cumsum(w, axis=0)
        rank, other = (2 * after - w).astype(float), s.astype(float)
        out += [w.sum(0), (w * rank).sum(0), (w * rank ** 2).sum(0), other.sum(0), (other * rank).sum(0)]
        before = after[-1]
    if p is not None:
        yield pa.record_batch([pa.array([p]), _lists(out.reshape(1, -1))], ["p", "sums"])


def _per_range(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums by range, as (range, sum, replicate); ranges are as many as shuffle partitions."""
    found = {r["p"]: r["sums"] for r in df.select("p", "sums").collect()}
    out = np.zeros((max(found, default=0) + 1, *shape))
    for p, sums in found.items():
        out[p] = np.reshape(sums, shape)
    return out


def _shifts(draws: np.ndarray) -> np.ndarray:
    """What to add to the doubled ranks of every range to centre them on zero."""
    return 2 * (np.cumsum(draws, axis=0) - draws) - draws.sum(0)


def redrawn_correlations(rows: DataFrame, draws: DataFrame, block: str, a: str, b: str, n_boot: int) -> DataFrame:
    """``(rep, rho)`` of rows ``block, a, b`` under ``draws`` ``(rep, block, times)``; a replicate without rows is left out.

    Rows without a value take no part; values are compared as doubles. Replicates are taken ``REPLICATES`` at a time.
    """
    spark = rows.sparkSession
    merged = cut(rows.select(block, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(subset=["a", "b"])
                 .groupBy(block, "a", "b").agg(F.count(F.lit(1)).alias("m")))
    few = merged.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
    x, y = ("a", "b") if few["b"] <= few["a"] else ("b", "a")  # ranks of the value with fewer distinct ones travel
    draws, out = cut(draws), []
    for begin in range(0, n_boot, REPLICATES):
        out += _correlations(merged, draws.where(F.col("rep").between(begin, begin + REPLICATES - 1)), block, x, y, begin, min(REPLICATES, n_boot - begin))
    return spark.createDataFrame(out, "rep long, rho double")  # a number per replicate


def _correlations(merged: DataFrame, draws: DataFrame, block: str, x: str, y: str, begin: int, width: int) -> list[tuple[int, float | None]]:
    parts = max(1, partitions(merged))
    times = draws.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("rep", "times"))).alias("_t"))  # at most ``width`` entries
    row = F.transform(F.sequence(F.lit(begin).cast("long"), F.lit(begin + width - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("_t", i), F.lit(0)).cast("int"))
    placed = cut(dealt_join(merged, times.select(block, row.alias("w")), [block], F.struct("a", "b")).select(F.col(x).alias("x"), F.col(y).alias("y"), "m", "w")
                 .repartition(parts, F.xxhash64("x", "y", "m")))  # work grows with rows times replicates, not with their bytes

    def in_ranges(df: DataFrame, run: Callable, schema: str) -> DataFrame:
        ranges = df.repartitionByRange(parts, "v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id().cast("long"))
        return cut(ranges.mapInArrow(partial(run, width=width), schema))

    arrays = "v double, w array<bigint>"
    ranked = in_ranges(placed.select(F.col("y").alias("v"), "m", "w").mapInArrow(partial(_added, width=width), arrays), _ranked, "p long, v double, l array<bigint>, sums array<double>")
    y_sums = _per_range(ranked.where("v is null"), (3, width))
    y_shift = _shifts(y_sums[:, 0])
    ranks = ranked.where("v is not null").select(F.col("v").alias("y"), "p", "l")
    with_ranks = (placed.join(F.broadcast(ranks), "y") if ranks.count() <= FEW  # a few values
                  else dealt_join(placed, ranks, ["y"], F.struct("x", "m")))
    products = with_ranks.select(F.col("x").alias("v"), "m", "w", "p", "l").mapInArrow(
        partial(_added, width=width, shift=y_shift.astype(np.int64)), f"{arrays}, s array<bigint>")
    sums = _per_range(in_ranges(products, _moments, "p long, sums array<double>"), (5, width))
    n, one, two, s, s_rank = (sums[:, i] for i in range(5))
    shift = _shifts(n)
    both = (s_rank + shift * s).sum(0)
    x_square = (two + 2 * shift * one + shift ** 2 * n).sum(0)
    y_square = (y_sums[:, 2] + 2 * y_shift * y_sums[:, 1] + y_shift ** 2 * y_sums[:, 0]).sum(0)
    rho = [float(c) / math.sqrt(p * q) if p > 0 and q > 0 else None for c, p, q in zip(both, x_square, y_square)]
    return [(begin + i, r) for i, r in enumerate(rho) if n[:, i].sum() > 0]
