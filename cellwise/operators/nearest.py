"""Exact nearest-feature search as a sequence of equi-joins.

Features go into a pyramid of grid cells. Each cell carries the tight box of what
it holds and one representative feature. From the top, every query point keeps
the cells whose box could still beat the best representative seen, and joins
their children. The number of cells a point keeps depends on the geometry around
it, not on how many features share a cell: a crowded place only makes the pyramid
deeper there. Visibility dates and "other than myself" rules work by choosing a
representative that the point may use. Features with whole numbers as order are searched in
tiles of median splits instead, if no attributes are asked for and groups and dates can be compared as numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import add, segment_distance
from ..runtime import cut, single
from .neighbours import nearest_in_tiles

LEAF_LIMIT = 64
MAX_SIDE_BITS = 40
TOP_LIMIT = 4096
WHOLE = {"byte", "short", "integer", "long"}


def _separate(p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    gaps = [F.greatest(F.lit(0.0), a - x, x - b) for x, a, b in zip(p, lo, hi)]
    return F.sqrt(add(g * g for g in gaps))


def nearest(points: DataFrame, features: DataFrame, key: str, order: str,
            dims: Sequence[str] = ("x", "y"), shape: str = "point",
            start: str | None = None, cutoff: str | None = None,
            group: str | None = None, attrs: Sequence[str] = (),
            max_dist: float | None = None, keep_all: bool = False) -> DataFrame:
    """For every point the nearest feature: ``key, dist, order, attrs...``.

    ``dims`` name the point coordinates; point features use the same names,
    segment features ``x1, y1, x2, y2``. With ``start``/``cutoff`` a feature counts
    only if its start is at or before the cutoff of the point. With ``group`` a
    feature counts only if its group differs from that of the point. Ties go to
    the smallest ``order``. ``keep_all`` returns points without a match as NULL.
    """
    dims = list(dims)
    nd = len(dims)
    base = 4 if nd <= 2 else 2
    feats = features
    if shape == "segment":
        geom = ["x1", "y1", "x2", "y2"]
        low = {d: F.least(f"{d}1", f"{d}2") for d in dims}
        high = {d: F.greatest(f"{d}1", f"{d}2") for d in dims}
    elif shape == "point":
        geom = dims
        low = high = {d: F.col(d) for d in dims}
    else:
        raise ValueError(f"unknown feature shape: {shape}")
    feats = feats.dropna(subset=geom + ([start] if start else []))
    box = single(feats.agg(*[F.min(low[d]).alias(f"lo_{d}") for d in dims],
                           *[F.max(high[d]).alias(f"hi_{d}") for d in dims],
                           F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n")),
                 "the feature layer is empty")
    span = {d: (box[f"hi_{d}"] - box[f"lo_{d}"]) or 1.0 for d in dims}

    # Feature table: geometry, identity and the box of the indexed piece.
    extra = ([F.col(start).alias("_start")] if start else []) + \
            ([F.col(group).alias("_group")] if group else [])
    feats = feats.select(F.col(order).alias("_order"), *[F.col(g).cast("double").alias(f"g_{g}") for g in geom],
                         *extra, F.struct(F.col(order), *[F.col(a) for a in attrs]).alias("_attrs"))
    feats = _one_place(feats, [f"g_{g}" for g in geom], bool(start), bool(group))
    if shape == "segment":
        feats = _pieces(feats, max(span.values()) / 64.0)
        lo = {d: F.least(f"a_{d}", f"b_{d}") for d in dims}
        hi = {d: F.greatest(f"a_{d}", f"b_{d}") for d in dims}
        drop = [f"{e}_{d}" for e in "ab" for d in dims]
    else:
        lo = hi = {d: F.col(f"g_{d}") for d in dims}
        drop = []
    rule = "group" if group else "start" if start else ""
    held = {"group": (group, group), "start": (start, cutoff), "": ()}[rule]
    kinds = {df.schema[c].dataType.typeName() for df, c in zip((features, points), held)}
    if not attrs and not (group and start) and features.schema[order].dataType.typeName() in WHOLE and (
            kinds <= WHOLE or rule == "start" and kinds == {"date"}):
        mark = (lambda c: F.unix_date(c)) if kinds == {"date"} else F.col
        rows = points.dropna(subset=[*dims, *held[1:]]).select(
            key, *[F.col(d).cast("double").alias(f"p_{d}") for d in dims], *[mark(c).alias("_mine") for c in held[1:]])
        feats = feats.select("_order", *[f"g_{g}" for g in geom], *[mark(f"_{rule}").alias("_mark") for _ in held[:1]],
                             *([lo[d].alias(f"lo_{d}") for d in dims] + [hi[d].alias(f"hi_{d}") for d in dims] if shape == "segment" else []))
        won = nearest_in_tiles(rows, feats, key, dims, geom, rule, math.inf if max_dist is None else max_dist).withColumnRenamed("_order", order)
        return points.select(key).join(won, key, "left") if keep_all else won
    depth = _depth(feats, {d: (lo[d] + hi[d]) / 2.0 for d in dims}, box, span, dims, base, int(box["n"]))
    side = base**depth

    def leaf(d: str) -> Column:
        unit = ((lo[d] + hi[d]) / 2.0 - F.lit(box[f"lo_{d}"])) / F.lit(span[d])
        return F.least(F.floor(unit * float(side)), F.lit(side - 1).cast("bigint"))

    keys = [f"k_{d}" for d in dims]
    # Stored once: every level and the last step read it.
    leaves = cut(feats.select("*", *[leaf(d).alias(f"k_{d}") for d in dims],
                              *[lo[d].alias(f"lo_{d}") for d in dims],
                              *[hi[d].alias(f"hi_{d}") for d in dims]).drop(*drop))

    level_aggs = [*[F.min(f"lo_{d}").alias(f"lo_{d}") for d in dims],
                  *[F.max(f"hi_{d}").alias(f"hi_{d}") for d in dims]]
    rep = F.struct(*[F.col(f"g_{g}").alias(g) for g in geom])
    if group:
        first = [F.min("_group").alias("g_lo"), F.max("_group").alias("g_hi"),
                 F.min_by(rep, "_group").alias("rep"), F.max_by(rep, "_group").alias("rep_hi")]
        again = [F.min("g_lo").alias("g_lo"), F.max("g_hi").alias("g_hi"),
                 F.min_by("rep", "g_lo").alias("rep"), F.max_by("rep_hi", "g_hi").alias("rep_hi")]
    elif start:
        first = [F.min("_start").alias("opened"), F.min_by(rep, F.struct("_start", "_order")).alias("rep")]
        again = [F.min("opened").alias("opened"), F.min_by("rep", "opened").alias("rep")]
    else:
        # plain numbers keep the hash aggregate; the order is unique, so the
        # coordinates picked one by one belong to the same feature
        first = [F.min("_order").alias("rk"),
                 *[F.min_by(f"g_{g}", "_order").alias(f"rep_{g}") for g in geom]]
        again = [F.min("rk").alias("rk"),
                 *[F.min_by(f"rep_{g}", "rk").alias(f"rep_{g}") for g in geom]]
    plain = not group and not start
    levels = {depth: leaves.groupBy(*keys).agg(*level_aggs, *first)}
    for lv in range(depth - 1, 0, -1):
        up = [F.expr(f"{k} div {base}").alias(k) for k in keys]
        levels[lv] = levels[lv + 1].groupBy(*up).agg(*level_aggs, *again)

    def exact(g) -> Column:
        p = [F.col(f"p_{d}") for d in dims]
        if shape == "segment":
            return segment_distance(p[0], p[1], g("x1"), g("y1"), g("x2"), g("y2"))
        return F.sqrt(add((a - g(d)) * (a - g(d)) for a, d in zip(p, dims)))

    # Query side: one row per point and surviving cell, co-located by point.
    pcols = [key, *[F.col(d).cast("double").alias(f"p_{d}") for d in dims]]
    carried = [key, *[f"p_{d}" for d in dims]]
    if cutoff:
        pcols.append(F.col(cutoff).alias("_cutoff"))
        carried.append("_cutoff")
    if group:
        pcols.append(F.col(group).alias("_mine"))
        carried.append("_mine")
    cand = points.dropna(subset=dims).select(*pcols).repartition(F.col(key))
    mine = Window.partitionBy(key)
    for lv in range(1, depth + 1):
        if lv == 1:
            # the top holds at most base^dims cells: one small array
            top = levels[1].agg(F.collect_list(F.struct("*"))).scalar()
            cand = cand.select(*carried, F.explode(top).alias("_t")).select(*carried, "_t.*")
        else:
            nodes = levels[lv].select("*", *[F.expr(f"{k} div {base}").alias(f"u_{k}") for k in keys])
            if base ** (nd * lv) <= TOP_LIMIT:  # this level cannot hold more cells than that
                nodes = F.broadcast(nodes)
            cand = cand.select(*carried, *[F.col(k).alias(f"u_{k}") for k in keys])
            cand = cand.join(nodes, [f"u_{k}" for k in keys])
        p = [F.col(f"p_{d}") for d in dims]
        near = _separate(p, [F.col(f"lo_{d}") for d in dims], [F.col(f"hi_{d}") for d in dims])
        if cutoff:
            cand = cand.where(F.col("opened") <= F.col("_cutoff"))
        if group:
            cand = cand.where((F.col("g_lo") != F.col("_mine")) | (F.col("g_hi") != F.col("_mine")))
            far = F.when(F.col("g_lo") != F.col("_mine"), exact(lambda n: F.col(f"rep.{n}"))).otherwise(
                exact(lambda n: F.col(f"rep_hi.{n}")))
        else:
            far = exact((lambda n: F.col(f"rep_{n}")) if plain else (lambda n: F.col(f"rep.{n}")))
        cand = cand.select(*carried, *keys, near.alias("_near"), far.alias("_far"))
        if max_dist is not None:
            cand = cand.where(F.col("_near") <= F.lit(max_dist * (1 + 1e-9)))
        best = F.min("_far").over(mine)
        cand = cand.withColumn("_best", best).where(
            F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-9)

    hits = cand.select(*carried, *keys, "_best").join(
        leaves.drop(*[f"{e}_{d}" for e in ("lo", "hi") for d in dims]), keys)
    if cutoff:
        hits = hits.where(F.col("_start") <= F.col("_cutoff"))
    if group:
        hits = hits.where(F.col("_group") != F.col("_mine"))
    hits = hits.select(key, "_order", "_attrs", exact(lambda n: F.col(f"g_{n}")).alias("dist"))
    if max_dist is not None:
        hits = hits.where(F.col("dist") <= max_dist)
    won = hits.groupBy(key).agg(
        F.min_by(F.struct("dist", "_attrs"), F.struct("dist", "_order")).alias("w"))
    won = won.select(key, F.col("w.dist").alias("dist"), "w._attrs.*")
    return points.select(key).join(won, key, "left") if keep_all else won


def _one_place(feats: DataFrame, geom: Sequence[str], dated: bool, grouped: bool) -> DataFrame:
    """Features that may be the answer of some point, among those with the same geometry.

    Without conditions that is the one of smallest order. With dates it is the skyline of (start, order): a feature
    counts if none of smaller order was there as early. With groups it is the smallest of two groups.
    All of it rests on minima per (geometry, start) or (geometry, group), which are combined before they are shuffled.
    """
    first = [F.min("_order").alias("_order"), F.min_by("_attrs", "_order").alias("_attrs")]
    if dated and grouped:
        return feats.groupBy(*geom, "_start", "_group").agg(*first)
    if dated:
        best = feats.groupBy(*geom, "_start").agg(*first)
        before = Window.partitionBy(*geom).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
        best = best.withColumn("_least", F.min("_order").over(before))
        return best.where(F.col("_least").isNull() | (F.col("_order") < F.col("_least"))).drop("_least")
    if grouped:
        best = feats.where(F.col("_group").isNotNull()).groupBy(*geom, "_group").agg(*first)
        place = F.row_number().over(Window.partitionBy(*geom).orderBy("_order"))
        return best.withColumn("_place", place).where("_place <= 2").drop("_place")
    return feats.groupBy(*geom).agg(*first)


def _pieces(feats: DataFrame, length: float) -> DataFrame:
    """Cut long segments for the index only; distances use the whole segment."""
    run = F.sqrt((F.col("g_x2") - F.col("g_x1")) ** 2 + (F.col("g_y2") - F.col("g_y1")) ** 2)
    n = F.greatest(F.lit(1), F.ceil(run / F.lit(length))).cast("int")
    cut = feats.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    for end, i in (("a", F.col("_i")), ("b", F.col("_i") + 1)):
        for d in ("x", "y"):
            cut = cut.withColumn(f"{end}_{d}", F.col(f"g_{d}1")
                                 + (F.col(f"g_{d}2") - F.col(f"g_{d}1")) * i / F.col("_n"))
    return cut.drop("_n", "_i")


def _depth(feats: DataFrame, mid: dict[str, Column], box, span, dims, base: int, n: int) -> int:
    """Levels needed until no cell holds more than ``LEAF_LIMIT`` features."""
    nd = len(dims)
    if n <= LEAF_LIMIT:
        return 1
    depth = max(1, math.ceil(math.log(max(n / 4.0, 1.0), base**nd)))
    limit = max(1, int(MAX_SIDE_BITS / math.log2(base)))
    while depth < limit:
        side = base**depth
        keys = [F.floor((mid[d] - F.lit(box[f"lo_{d}"])) / F.lit(span[d]) * float(side)).alias(f"k{i}")
                for i, d in enumerate(dims)]
        full = feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                        *[F.min(mid[d]).alias(f"a{i}") for i, d in enumerate(dims)],
                                        *[F.max(mid[d]).alias(f"b{i}") for i, d in enumerate(dims)])
        # coincident features cannot be told apart by going deeper
        apart = add(F.abs(F.col(f"b{i}") - F.col(f"a{i}")) for i in range(nd)) > 0
        crowd = full.where(apart).agg(F.max("n")).first()[0] or 0
        if crowd <= LEAF_LIMIT:
            break
        depth += max(1, math.ceil(math.log(crowd / LEAF_LIMIT, base**nd)))
    return min(depth, limit)


def nearest_distance(points: DataFrame, features: DataFrame, key: str, order: str,
                     name: str = "dist", on_empty: str = "error", **how) -> DataFrame:
    """Points with the distance to the nearest feature as a new column.

    ``on_empty`` says what an empty layer means: ``error``, ``zero`` or ``null``.
    """
    try:
        found = nearest(points, features, key, order, **how)
    except ValueError:
        if on_empty == "error":
            raise
        return points.withColumn(name, F.lit(0.0 if on_empty == "zero" else None).cast("double"))
    return points.join(found.select(key, F.col("dist").alias(name)), key, "left")


def within(points: DataFrame, features: DataFrame, key: str, order: str, radius: float,
           keep: bool = True, **how) -> DataFrame:
    """Points with (or, with ``keep=False``, without) a feature within the radius."""
    near = nearest(points, features, key, order, max_dist=radius, **how).select(key)
    return points.join(near, key, "left_semi" if keep else "left_anti")
