"""Exact nearest feature without a candidate table per level: many dimensions, long segments, dates.

Grid pyramids need 2^dims children a cell, so beyond three dimensions they are either crowded or empty; pieces of long segments overlap
in them, and their representatives are poor bounds under dates. Here the features are dealt into tiles by median splits of a sample (the widest direction first). A point is searched in its own tile, which bounds its distance,
and then in those tiles only whose box is nearer than that. Every tile is searched by a task of its own; the driver and the tasks
share the splits and the boxes, a few numbers per tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

TILE_ROWS, MOST_TILES, SAMPLED = 4096, 8192, 64
LEAF_ROWS, CHUNK = 64, 2048
#: Points that are searched in a tile at a time; more of them are dealt over salts.
MOST_POINTS = 8192
SLACK = 1 + 1e-9
LAST = np.iinfo(np.int64).max


def splits(sample: np.ndarray, rows: int = SAMPLED) -> np.ndarray:
    """Binary splits as rows (dimension or -1, cut, low child or tile number, high child), down to ``rows`` rows of the sample."""
    tree, todo, tiles = [[-1, 0.0, 0, 0]], [(0, np.arange(len(sample)))], 0
    while todo:
        at, ids = todo.pop()
        spread = np.std(sample[ids], axis=0) if len(ids) > rows else np.zeros(1)
        if not spread.max() > 0:
            tree[at], tiles = [-1, 0.0, tiles, 0], tiles + 1
            continue
        d = int(spread.argmax())
        x = sample[ids, d]
        limit = np.partition(x, len(x) // 2)[len(x) // 2]
        if limit == x.min():
            limit = x[x > limit].min()
        tree[at] = [d, limit, len(tree), len(tree) + 1]
        todo += [(len(tree), ids[x < limit]), (len(tree) + 1, ids[x >= limit])]
        tree += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
    return np.array(tree, dtype=float)


def tile_of(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Tile number of every row."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        d = tree[node[rows], 0].astype(np.int64)
        rows, d = rows[d >= 0], d[d >= 0]
        n = node[rows]
        node[rows] = np.where(x[rows, d] < tree[n, 1], tree[n, 2], tree[n, 3]).astype(np.int64)
    return tree[node, 2].astype(np.int64)


def _to_boxes(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: bool = False) -> np.ndarray:
    """Distance of every point to the nearest (or ``far``: farthest) place of every box."""
    out = np.zeros((len(p), len(lo)))
    for d in range(p.shape[1]):
        x = p[:, d, None]
        gap = np.maximum(np.abs(x - lo[:, d]), np.abs(x - hi[:, d])) if far else np.maximum(np.maximum(lo[:, d] - x, x - hi[:, d]), 0.0)
        out += gap * gap
    return np.sqrt(out)


@dataclass(frozen=True)
class Tile:
    """Features of one tile: geometry, box, order and, if there is a rule, group or first day."""

    geom: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    order: np.ndarray
    mark: np.ndarray | None = None


def allowed(rule: str, mine: np.ndarray | None, low: np.ndarray | None, high: np.ndarray | None) -> np.ndarray | bool:
    """Which points (rows) may use some of the features whose marks lie between ``low`` and ``high`` (columns)."""
    if rule == "group":
        return (mine[:, None] != low) | (mine[:, None] != high)
    return low <= mine[:, None] if rule == "start" else True


def _distance(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Points against points or, with twice as many columns, segments (x1, y1, x2, y2)."""
    if g.shape[1] == p.shape[1]:
        out = np.zeros((len(p), len(g)))
        for d in range(p.shape[1]):
            gap = p[:, d, None] - g[:, d]
            out += gap * gap
        return np.sqrt(out)
    (px, py), (x1, y1, x2, y2) = p.T[:, :, None], g.T
    ax, ay = x2 - x1, y2 - y1
    size = ax * ax + ay * ay
    t = np.where(size == 0, 0.0, ((px - x1) * ax + (py - y1) * ay) / np.where(size == 0, 1.0, size)).clip(0.0, 1.0)
    ex, ey = px - (x1 + t * ax), py - (y1 + t * ay)
    return np.sqrt(ex * ex + ey * ey)


def _leaves(f: np.ndarray) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(f))]
    while todo:
        ids = todo.pop()
        if len(ids) <= LEAF_ROWS:
            out.append(ids)
            continue
        x = f[ids, int(np.ptp(f[ids], axis=0).argmax())]
        order, half = np.argpartition(x, len(x) // 2), len(x) // 2
        todo += [ids[order[:half]], ids[order[half:]]]
    return out


def search(p: np.ndarray, mine: np.ndarray | None, f: Tile, rule: str, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and order of the nearest feature of one tile that the rule allows, where it is within ``bound`` (else infinite)."""
    best, who = np.full(len(p), np.inf), np.full(len(p), LAST)
    if not len(f.order):
        return best, who
    leaves = _leaves((f.lo + f.hi) / 2.0)
    lo, hi = np.array([f.lo[i].min(0) for i in leaves]), np.array([f.hi[i].max(0) for i in leaves])
    low, high = (np.array([g(f.mark[i]) for i in leaves]) for g in (np.min, np.max)) if rule else (None, None)

    def visit(rows: np.ndarray, ids: np.ndarray) -> None:
        dist = _distance(p[rows], f.geom[ids])
        if rule:
            dist[~allowed(rule, mine[rows], f.mark[ids], f.mark[ids])] = np.inf
        least = dist.min(1)
        first = np.where(dist == least[:, None], f.order[ids], LAST).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < who[rows]))
        rows = rows[better]
        best[rows], who[rows] = least[better], first[better]

    for start in range(0, len(p), CHUNK):
        rows = np.arange(start, min(start + CHUNK, len(p)))
        near = _to_boxes(p[rows], lo, hi)
        if rule:
            near[~allowed(rule, mine[rows], low, high)] = np.inf
        home = near.argmin(1)
        for i in np.unique(home):
            visit(rows[home == i], leaves[i])
        near[np.arange(len(rows)), home] = np.inf
        open_ = (near <= (np.minimum(best[rows], bound[rows]) * SLACK)[:, None]) & np.isfinite(near)
        for i in np.flatnonzero(open_.any(0)):
            here = open_[:, i] & (near[:, i] <= np.minimum(best[rows], bound[rows]) * SLACK)  # what was found meanwhile
            if here.any():
                visit(rows[here], leaves[i])
    best[best > bound] = np.inf
    who[~np.isfinite(best)] = LAST
    return best, who


def nearest_in_tiles(points: DataFrame, feats: DataFrame, key: str, dims: Sequence[str], geom: Sequence[str], rule: str = "",
                     most: float = np.inf) -> DataFrame:
    """``(key, dist, _order)`` of points ``key, p_dims..., _mine`` among features ``_order, g_geom..., _mark`` not farther than ``most``.

    The rule ``group`` allows features whose mark differs from ``_mine``, ``start`` those with a mark not above it. Segments come in
    pieces with boxes ``lo_dims..., hi_dims...``; distances are to the whole segment. ``_order``, ``_mark`` and ``_mine`` are whole numbers without
    nulls. Equal distances go to the smallest order.
    """
    p_cols, g_cols = [f"p_{d}" for d in dims], [f"g_{g}" for g in geom]
    boxed = len(geom) > len(dims)
    l_cols, h_cols = ([f"lo_{d}" for d in dims], [f"hi_{d}" for d in dims]) if boxed else (g_cols, g_cols)
    mark, mine_col = (["_mark"], ["_mine"]) if rule else ([], [])
    feats = feats.select("_order", *g_cols, *(l_cols + h_cols if boxed else []), *mark)
    rows = feats.count()
    tiles = max(1, min(MOST_TILES, rows // TILE_ROWS))
    share = min(1.0, tiles * SAMPLED / max(rows, 1))
    middles = [((F.col(a) + F.col(b)) / 2.0).alias(f"m{i}") for i, (a, b) in enumerate(zip(l_cols, h_cols))]
    picked = feats.where(F.pmod(F.xxhash64(*l_cols, *h_cols), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(*middles)
    tree = splits(picked.toPandas().to_numpy(float).reshape(-1, len(dims)))  # a bounded number of rows per tile

    def route(low: list[str], high: list[str]):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield part.assign(_tile=tile_of((part[low].to_numpy(float) + part[high].to_numpy(float)) / 2.0, tree))
        return run

    stored = cut(feats.mapInPandas(route(l_cols, h_cols), f"{_ddl(feats)}, _tile bigint"))
    shape = stored.groupBy("_tile").agg(
        *[F.min(c).alias(f"low_{i}") for i, c in enumerate(l_cols)], *[F.max(c).alias(f"high_{i}") for i, c in enumerate(h_cols)],
        *[e for c in mark for e in (F.min(c).alias("m_lo"), F.max(c).alias("m_hi"))]).toPandas()  # one row per tile
    number = shape["_tile"].to_numpy()
    lo, hi = (shape[[f"{n}_{i}" for i in range(len(dims))]].to_numpy(float) for n in ("low", "high"))
    m_lo, m_hi = (shape[c].to_numpy() for c in ("m_lo", "m_hi")) if rule else (None, None)

    def usable(mine: np.ndarray | None, which: np.ndarray) -> np.ndarray | bool:
        return allowed(rule, mine, m_lo[which], m_hi[which]) if rule else True

    def found(pts: pd.DataFrame, fts: pd.DataFrame, bound: np.ndarray) -> tuple:
        p, mine = pts[p_cols].to_numpy(float), pts["_mine"].to_numpy() if rule else None
        tile = Tile(fts[g_cols].to_numpy(float), fts[l_cols].to_numpy(float), fts[h_cols].to_numpy(float),
                    fts["_order"].to_numpy(np.int64), fts["_mark"].to_numpy() if rule else None)
        return p, mine, *search(p, mine, tile, rule, bound)

    def at_home(pts: pd.DataFrame, fts: pd.DataFrame) -> pd.DataFrame:
        """What the own tile has, and a row for every other tile that may have something nearer."""
        p, mine, dist, who = found(pts, fts, np.full(len(pts), most))
        pts = pts.drop(columns="_salt").assign(dist=dist, _order=who, _found=True)
        every, home = np.arange(len(number)), pts["_tile"].to_numpy()
        out = [pts[np.isfinite(dist)]]
        for start in range(0, len(p), CHUNK // 8):
            s = slice(start, start + CHUNK // 8)
            q, own, bound = p[s], mine[s] if rule else None, dist[s].copy()
            none = ~np.isfinite(bound)
            if none.any():  # nothing usable at home: some usable tile lies wholly within this distance
                far = np.where(usable(own[none] if rule else None, every), _to_boxes(q[none], lo, hi, far=True), np.inf).min(1)
                bound[none] = np.where(np.isfinite(far), np.minimum(far, most), -1.0)
            gap = np.maximum(np.maximum(lo - q.max(0), q.min(0) - hi), 0.0)
            which = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= bound.max() * SLACK)
            go = (_to_boxes(q, lo[which], hi[which]) <= (bound * SLACK)[:, None]) & (number[which] != home[s, None]) & usable(own, which)
            row, tile = np.nonzero(go)
            out.append(pts.iloc[start + row].assign(_tile=number[which[tile]], dist=bound[row], _order=LAST, _found=False))
        return pd.concat(out)

    def elsewhere(pts: pd.DataFrame, fts: pd.DataFrame) -> pd.DataFrame:
        dist, who = found(pts, fts, np.minimum(pts["dist"].to_numpy() * SLACK, most))[2:]
        return pts[[key]].assign(dist=dist, _order=who)[np.isfinite(dist)]

    def searched(rows: DataFrame, run, schema: str) -> DataFrame:
        """``run`` on the points and features of every tile; many points of one tile are dealt over salts."""
        salts = F.broadcast(rows.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / MOST_POINTS).cast("int").alias("_n")))  # one row per tile
        a = rows.join(salts, "_tile").withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).select(*rows.columns, "_salt")
        b = stored.join(salts, "_tile").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(*stored.columns, "_salt")
        return a.groupBy("_tile", "_salt").cogroup(b.groupBy("_tile", "_salt")).applyInPandas(run, schema)

    kept = points.select(key, *p_cols, *mine_col)
    placed = cut(kept.mapInPandas(route(p_cols, p_cols), f"{_ddl(kept)}, _tile bigint"))
    first = cut(searched(placed, at_home, f"{_ddl(placed)}, dist double, _order bigint, _found boolean"))
    more = searched(first.where("not _found").drop("_order", "_found"), elsewhere, f"{_ddl(placed.select(key))}, dist double, _order bigint")
    return first.where("_found").select(key, "dist", "_order").unionByName(more).groupBy(key).agg(
        F.min(F.struct("dist", "_order")).alias("w")).select(key, "w.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
