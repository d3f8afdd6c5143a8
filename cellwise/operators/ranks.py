"""Distributed order statistics.

Ranks, quantiles and threshold metrics all rest on one primitive: a table of
distinct values with the mass below each of them. Values are counted first (so a
value shared by a third of all rows is one row after the map-side combine), then
cut into ranges at approximate quantiles, summed inside each range by a window
and shifted by the totals of the ranges before. No task ever sees the whole
order, and no window runs without a range key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import add, col
from ..runtime import cut, partitions


@dataclass(frozen=True)
class Ranges:
    """Cut points of a column and the number of rows they were taken from."""

    points: tuple[float, ...]
    rows: int


def value_ranges(df: DataFrame, value: str, parts: int | None = None) -> Ranges:
    """Cut points at approximate quantiles; at most ``parts`` numbers come back."""
    parts = parts or partitions(df)
    probs = [i / parts for i in range(1, parts)] or [0.5]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 1000).alias("p"),
                 F.count(value).alias("n")).first()
    pts = sorted({float(p) for p in (row["p"] or []) if p is not None})
    return Ranges(tuple(pts), int(row["n"]))


def _bucket(df: DataFrame, value: str, ranges: Ranges, out: str) -> DataFrame:
    if not ranges.points:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *ranges.points, float("inf")]
    shadow = f"{out}_v"
    df = df.withColumn(shadow, F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol=shadow, outputCol=out,
                      handleInvalid="keep").transform(df).drop(shadow)


def cumulative(df: DataFrame, value: str, sums: Mapping[str, Column] | None = None,
               by: Sequence[str] = (), ranges: Ranges | None = None) -> DataFrame:
    """One row per distinct value (and group) with mass at, below and in total.

    For every named sum ``s`` the columns ``s``, ``s_before`` and ``s_total`` come
    back. The default sum is the row count ``n``. NULL values take no part.
    """
    sums = dict(sums or {"n": F.count(F.lit(1))})
    by = list(by)
    if value in sums or value in by:
        raise ValueError(f"column {value} is both the value and a sum or group")
    df = df.where(F.col(value).isNotNull())
    ranges = ranges or value_ranges(df, value)
    counts = df.groupBy(*by, value).agg(*[c.alias(s) for s, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = _bucket(counts, value, ranges, "_range")
    # At most one row per range and group; the constant key only names the
    # ungrouped case, where this window sees no more rows than there are ranges.
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    shift = shift.select(
        *by, "_range",
        *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums])
    inside = (Window.partitionBy(*by, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = counts.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_in") for s in sums])
    out = out.join(shift, [*by, "_range"])
    return out.select(
        *by, value, *sums,
        *[(F.col(f"_{s}_off") + F.col(f"_{s}_in")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums])


def _at(table: DataFrame, value: str, prob: float, n: str = "n") -> Column:
    """Linear-interpolation quantile as an aggregate over a cumulative table."""
    h = (F.col(f"{n}_total") - 1) * F.lit(float(prob))
    lo = F.max(F.when(F.col(f"{n}_before") <= F.floor(h), F.col(value)))
    hi = F.max(F.when(F.col(f"{n}_before") <= F.ceil(h), F.col(value)))
    frac = F.max(h - F.floor(h))
    return lo + (hi - lo) * frac


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
              by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Named quantiles of a column, one row per group.

    ``exact`` interpolates linearly between order statistics; ``approx`` uses the
    mergeable sketch of the engine.
    """
    by = list(by)
    if method == "approx":
        return df.groupBy(*by).agg(*[F.percentile_approx(value, float(p)).alias(k)
                                     for k, p in probs.items()])
    if method != "exact":
        raise ValueError(f"unknown quantile method: {method}")
    table = cumulative(df.select(*by, F.col(value).alias("_v")), "_v", by=by)
    return table.groupBy(*by).agg(*[_at(table, "_v", p).alias(k) for k, p in probs.items()])


def summary(df: DataFrame, value: str, by: Sequence[str] = (),
            probs: Mapping[str, float] | None = None, std: str | None = None) -> DataFrame:
    """Count, extremes, mean, chosen quantiles and deviation from one cumulative table."""
    by = list(by)
    probs = probs or {"p50": 0.5, "p90": 0.9}
    df = df.select(*by, F.col(value).alias("_v"))
    v, n = F.col("_v"), F.col("n")
    table = cumulative(df, "_v", by=by)
    aggs = [F.sum(n).alias("n"), F.min(v).alias("min"),
            (F.sum(v * n) / F.sum(n)).alias("mean"),
            *[_at(table, "_v", p).alias(k) for k, p in probs.items()],
            F.max(v).alias("max")]
    out = table.groupBy(*by).agg(*aggs)
    if std is not None:
        spread = {"sample": F.stddev_samp, "population": F.stddev_pop}[std]
        dev = df.where(v.isNotNull()).groupBy(*by).agg(spread(v).alias("std"))
        if by:
            out = out.join(dev, by)
        else:
            out = out.withColumn("std", dev.scalar())
    return out


# -- ranks ----------------------------------------------------------------------

def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (),
                  weight: Column | None = None, name: str = "rank",
                  ranges: Ranges | None = None) -> DataFrame:
    """Centred average rank of each distinct value: rank minus the mean rank."""
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    t = cumulative(df, value, {"_n": n}, by, ranges)
    centred = F.col("_n_before") + (F.col("_n") + 1) / 2.0 - (F.col("_n_total") + 1) / 2.0
    return t.select(*by, value, "_n", centred.alias(name))


def attach(big: DataFrame, lookup: DataFrame, keys: Sequence[str], payload: str,
           hot_rows: float) -> DataFrame:
    """Join a per-value payload back to the rows without gathering a hot value.

    Values above ``hot_rows`` rows number at most rows/hot_rows, so they are
    broadcast; their rows are scattered by a salt in the shuffled join.
    """
    keys = list(keys)
    hot = lookup.where(F.col("_n") > hot_rows).select(*keys, F.col(payload).alias("_hot"))
    cold = lookup.where(F.col("_n") <= hot_rows).select(
        *keys, F.lit(0).cast("bigint").alias("_salt"), F.col(payload).alias("_cold"))
    out = big.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*big.columns), F.lit(997)))
    out = out.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint")))
    out = out.join(cold, [*keys, "_salt"], "left")
    return out.select(*big.columns, F.coalesce("_hot", "_cold").alias(payload))


def with_ranks(df: DataFrame, values: Sequence[str], by: Sequence[str] = (),
               weight: Column | None = None) -> DataFrame:
    """Distinct value tuples with their ``_mass`` and a centred rank per value."""
    by, values = list(by), list(values)
    df = df.dropna(subset=values)
    w = F.sum(weight) if weight is not None else F.count(F.lit(1))
    pairs = df.groupBy(*by, *values).agg(w.alias("_mass"))
    out = pairs
    for v in values:
        ranges = value_ranges(df, v)
        table = average_ranks(df, v, by, weight, f"rank_{v}", ranges)
        hot_rows = max(1.0, ranges.rows / max(partitions(df), 1))
        if weight is None:
            out = attach(out, table, [*by, v], f"rank_{v}", hot_rows)
        else:  # masses are not row counts: the split of hot values is left to AQE
            out = out.join(table.drop("_n"), [*by, v])
    return out


def rank_correlation(ranked: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    da, db, w = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("_mass")
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(w * da * db), F.sqrt(F.sum(w * da * da) * F.sum(w * db * db))).alias("rho"),
        F.sum(w).alias("n"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (),
             weight: Column | None = None) -> DataFrame:
    """Spearman correlation with average ranks: ``rho`` and ``n`` per group."""
    return rank_correlation(with_ranks(df, [a, b], by, weight), a, b, by)


def spearman_matrix(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Long correlation matrix: one row per ordered pair of columns."""
    values = list(values)
    ranked = with_ranks(df, values)
    w = F.col("_mass")
    pairs = [(a, b) for a in values for b in values]
    cells = ranked.agg(*[
        F.try_divide(F.sum(w * F.col(f"rank_{a}") * F.col(f"rank_{b}")),
                     F.sqrt(F.sum(w * F.col(f"rank_{a}") ** 2) * F.sum(w * F.col(f"rank_{b}") ** 2)))
        .alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return cells.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(str(i)).alias("rho"))
        for i, (a, b) in enumerate(pairs)])).alias("m")).select("m.*")


# -- binary classification --------------------------------------------------------

def _class_sums(label: Column) -> dict[str, Column]:
    return {"pos": F.count_if(label == 1), "neg": F.count_if(label == 0)}


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank statistic; rows without score are left out."""
    t = cumulative(df, score, _class_sums(F.col(label)), by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return t.groupBy(*by).agg(
        F.try_divide(wins, F.max("pos_total") * F.max("neg_total").cast("double")).alias("auc"))


def brier(df: DataFrame, prob: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(prob) - F.col(label)) ** 2).alias("brier"))


def curve_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, one per distinct threshold."""
    t = cumulative(df, score, _class_sums(F.col(label)), by)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return t.select(
        *by, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp, F.col("pos_total")).alias("tpr"),
        F.try_divide(fp, F.col("neg_total")).alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(F.col("pos"), F.col("pos_total")).alias("recall_step"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall step over thresholds in falling order."""
    return curve_points(df, score, label, by).groupBy(*by).agg(
        F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


# -- cuts by rank -------------------------------------------------------------------

def take_ranked(df: DataFrame, key: str, tie: str, n: int, descending: bool = False) -> DataFrame:
    """The ``n`` rows with the smallest (or largest) key, ties by the tie column.

    The order columns are stored once; only two thresholds travel through the
    driver, and the rows are kept by a plain filter that reaches the scan.
    """
    order = -F.col(key) if descending else F.col(key)
    keyed = cut(df.select(*dict.fromkeys([key, tie])).withColumn("_key", order.cast("double")))
    edge = (cumulative(keyed, "_key").where(F.col("n_before") < n)
            .agg(F.max("_key").alias("key"), F.max("n_before").alias("before")).first())
    if edge["key"] is None or n <= 0:
        return df.limit(0)
    level = F.lit(-edge["key"] if descending else edge["key"])
    at_edge = keyed.where(F.col(key) == level)
    last = (cumulative(at_edge, tie).where(F.col("n_before") < n - edge["before"])
            .agg(F.max(tie).alias("t")).first()["t"])
    beyond = F.col(key) > level if descending else F.col(key) < level
    return df.where(beyond | ((F.col(key) == level) & (F.col(tie) <= F.lit(last))))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Dense global position (from 0) in a total order, without a one-task window.

    Range partitions are sorted and stored; their sizes give the offsets.
    """
    parts = partitions(df)
    keys = [col(c) for c in order]
    placed = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    chunk = F.shiftright(F.col("_mid"), 33)
    sizes = placed.groupBy(chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    # one row per range partition
    out = placed.withColumn("_chunk", chunk).join(F.broadcast(offsets), "_chunk")
    local = F.col("_mid") - F.shiftleft(F.col("_chunk"), 33)
    return out.withColumn(name, F.col("_off") + local).drop("_mid", "_chunk", "_off")


def overlap_of_tops(df: DataFrame, a: str, b: str, tie: str, share: float = 0.01) -> DataFrame:
    """Share of rows that two rankings put in their top ``share``."""
    df = cut(df.select(tie, a, b).dropna())  # read by several passes
    k = max(1, round(share * df.count()))
    left = take_ranked(df, a, tie, k, True).select(tie)
    right = take_ranked(df, b, tie, k, True).select(tie)
    return left.join(right, tie).agg(
        F.count(F.lit(1)).alias("n_common"), F.lit(k).cast("bigint").alias("k")).select(
        "k", "n_common", (100.0 * F.col("n_common") / F.col("k")).alias("overlap_pct"))


# -- small fixed-length statistics ------------------------------------------------------

def kendall_columns(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Kendall tau-b of two short vectors given as columns (one value per feature).

    The vectors are as long as the feature list, so the pairs are a fixed
    expression inside one row.
    """
    idx = [(i, j) for i in range(len(a)) for j in range(i)]
    sa = [F.signum(a[i] - a[j]) for i, j in idx]
    sb = [F.signum(b[i] - b[j]) for i, j in idx]
    score = add(x * y for x, y in zip(sa, sb))
    na, nb = add(x * x for x in sa), add(y * y for y in sb)
    return F.try_divide(score, F.sqrt(na * nb))
