"""Connected zones of a cell mask.

Cells are labelled inside tiles of bounded size first; only labels that touch
across a tile side enter the iterative graph step, which is the alternating
star contraction of Kiveris et al. (2014).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .grid import GridSpec
from .joins import LEAST_CROWD, dealt_join


def graph_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable vertex of every vertex: ``(v, root)`` from ``(a, b)`` edges.

    The links of a vertex that holds a large share of them are dealt over salted copies of it in both steps of a round.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())
    n = e.count()
    if not n:
        return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if n > LEAST_CROWD:
            both = cut(both)  # read three times, as is e below
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = _with_low(both.where(F.col("v") > F.col("u")), low, n).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if n > LEAST_CROWD:
            e = cut(e)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        links = _with_low(e, low, n)
        e = cut(links.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("u", F.col("m").alias("v"))).distinct())
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40))).alias("h")).first()
        n, now = row["n"], (row["n"], row["h"])
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("component labelling did not settle")
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("v"), "root").distinct())


def _with_low(links: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Links with the smallest neighbour of their first end; ``n`` links cannot hold a crowd unless they are many."""
    return links.join(low, "u") if n <= LEAST_CROWD else dealt_join(links, low, ["u"], F.col("v"))


def _label_block(r: np.ndarray, c: np.ndarray, tile: int) -> np.ndarray:
    """Index of the first cell of each 8-connected component of one tile."""
    r, c = r - r.min(), c - c.min()
    slot = np.full((tile + 2, tile + 2), -1, dtype=np.int64)
    slot[r + 1, c + 1] = np.arange(len(r))
    pairs = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = slot[r + 1 + dr, c + 1 + dc]
        here = np.nonzero(other >= 0)[0]
        pairs.append(np.stack([here, other[here]]))
    a, b = np.concatenate(pairs, axis=1)
    lab = np.arange(len(r))
    while True:
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            return lab
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (lab != lab[lab]).any():
            lab = lab[lab]


def label_components(mask: DataFrame, grid: GridSpec, by: str | None = None, tile: int = 256) -> DataFrame:
    """8-connected zones: ``(by, r, c, zone)``, zone is its smallest cell id.

    ``by`` labels several masks (one per value) in the same pass.
    """
    layer = F.col(by).cast("bigint") if by else F.lit(0).cast("bigint")
    cells = mask.select(layer.alias("layer"), F.col("r").cast("bigint"), F.col("c").cast("bigint"))
    width, area = grid.width, grid.width * grid.height

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        lab = _label_block(r, c, tile)
        pdf["zone"] = key[0] * area + r[lab] * width + c[lab]
        return pdf

    labelled = cut(cells.groupBy("layer", F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"))
                   .applyInPandas(local, "layer bigint, r bigint, c bigint, zone bigint"))
    mr, mc = F.pmod("r", F.lit(tile)), F.pmod("c", F.lit(tile))
    rim = labelled.where((mr == 0) | (mr == tile - 1) | (mc == 0) | (mc == tile - 1))
    links = _rim_links(rim)
    roots = graph_components(links)
    out = labelled.join(roots.withColumnRenamed("v", "zone"), "zone", "left").select(
        "layer", "r", "c", (F.coalesce("root", "zone") - F.col("layer") * area).alias("zone"))
    return out.withColumnRenamed("layer", by) if by else out.drop("layer")


def _nested_tile(key: tuple, pdf: pd.DataFrame, tile: int, width: int, area: int, levels: int, sums: list[str]) -> pd.DataFrame:
    """Components of every level of one tile, and the labels of its rim cells. Levels only add cells and contacts, so the
    labels of one level are where the next one goes on."""
    pdf = pdf.sort_values(["r", "c"], ignore_index=True)
    r, c, level = (pdf[k].to_numpy() for k in ("r", "c", "level"))
    lr, lc = r % tile, c % tile
    slot = np.full((tile + 2, tile + 2), -1, dtype=np.int64)
    slot[lr + 1, lc + 1] = np.arange(len(r))
    pairs = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = slot[lr + 1 + dr, lc + 1 + dc]
        here = np.nonzero(other >= 0)[0]
        pairs.append(np.stack([here, other[here]]))
    a, b = np.concatenate(pairs, axis=1)
    meets = np.maximum(level[a], level[b])
    rim = (lr == 0) | (lr == tile - 1) | (lc == 0) | (lc == tile - 1)
    lab, out = np.arange(len(r)), []
    for i in range(int(level.min()), levels):
        x, y = a[meets == i], b[meets == i]
        while len(x):
            la, lb = lab[x], lab[y]
            if (la == lb).all():
                break
            np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
            while (lab != lab[lab]).any():
                lab = lab[lab]
        here = np.flatnonzero(level <= i)
        first, of = np.unique(lab[here], return_inverse=True)
        zone = i * area + r[first] * width + c[first]
        whole = {"level": i, "zone": zone, "r": -1, "c": -1, "n": np.bincount(of, minlength=len(first)),
                 **{s: np.bincount(of, pdf[s].to_numpy(float)[here], len(first)) for s in sums}}
        edge = np.flatnonzero(rim[here])
        out += [pd.DataFrame(whole), pd.DataFrame({"level": i, "zone": zone[of[edge]], "r": r[here[edge]], "c": c[here[edge]], "n": 0, **{s: 0.0 for s in sums}})]
    return pd.concat(out)


def nested_zones(cells: DataFrame, grid: GridSpec, levels: int, sums: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """8-connected zones of nested masks in one labelling: ``(level, zone, n, sums...)``.

    A cell carries the first ``level`` (0 up to ``levels`` - 1) whose mask holds it; it is in all later masks too.
    Tiles yield the sizes and sums of their components at every level; only labels that meet across tile sides are contracted, and no
    cell is joined again.
    """
    width, area = grid.width, grid.width * grid.height
    rows = cells.select(F.col("r").cast("bigint"), F.col("c").cast("bigint"), F.col("level").cast("bigint"),
                        *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums])
    schema = "level bigint, zone bigint, r bigint, c bigint, n bigint" + "".join(f", {s} double" for s in sums)
    local = partial(_nested_tile, tile=tile, width=width, area=area, levels=levels, sums=list(sums))
    out = cut(rows.groupBy(F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"))
              .applyInPandas(lambda key, pdf: local(key, pdf), schema))
    rim = out.where("r >= 0").select(F.col("level").alias("layer"), "zone", "r", "c")
    roots = graph_components(_rim_links(rim))
    parts = out.where("r < 0").join(roots.withColumnRenamed("v", "zone"), "zone", "left")
    return parts.groupBy("level", (F.coalesce("root", "zone") - F.col("level") * area).alias("zone")).agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])


def _rim_links(rim: DataFrame) -> DataFrame:
    """(a, b): labels of one layer that touch."""
    step = rim.select("layer", F.col("zone").alias("a"), "r", "c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
        for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s"))
    step = step.select("layer", "a", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    return step.join(rim.select("layer", "r", "c", F.col("zone").alias("b")), ["layer", "r", "c"]).where(
        F.col("a") != F.col("b")).select("a", "b").distinct()


def zones(mask: DataFrame, values: DataFrame, grid: GridSpec, prob: str, min_area_m2: float = 0.0,
          extra: tuple[str, ...] = ()) -> DataFrame:
    """Candidate zones: area, centroid, probability at the centroid cell, mean and maximum."""
    lab = label_components(mask, grid)
    cells = lab.join(values, ["r", "c"])
    z = cells.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * F.lit(grid.cell_area)).alias("area_m2"),
        F.avg(grid.x()).alias("x"), F.avg(grid.y()).alias("y"),
        F.avg(prob).alias("prob_mean"), F.max(prob).alias("prob_max"))
    z = z.where(F.col("area_m2") >= min_area_m2)
    at = z.withColumn("r", grid.row("y")).withColumn("c", grid.column("x"))
    at = at.join(values.select("r", "c", F.col(prob).alias("probabilidad"), *extra), ["r", "c"], "left")
    return at.drop("r", "c")


def with_site_ids(z: DataFrame) -> DataFrame:
    """Sequential site names in the order of the zones."""
    from .ranks import numbered

    return numbered(z, ["zone"]).withColumn(
        "site_id", F.format_string("SOLAR_SITE_%04d", F.col("position") + 1)).drop("position")
