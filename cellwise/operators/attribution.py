"""Additive contributions of features to the probability of a forest, by a path algorithm over flat trees.

The path-dependent Shapley value of a feature sums, over the leaves, ``v * (o - z) * mean over t of prod f(t)`` with
``f(t) = t o + (1 - t) z`` for every other feature on the path: ``o`` says whether the row meets the feature's conditions, ``z`` is the
share of the training weight that does. The product is a polynomial in t of lower degree than there are features on a path, so a
Gauss rule with half as many points is exact. Products run down a tree level by level, sums of leaves run up, and each
edge adds its own change of ``(o - z) / f``; work is linear in edges, with no table over feature subsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpoint_folder

#: Nodes that one broadcast holds (40 bytes each); larger forests are dealt into groups of trees, which add up.
NODES_HELD = 1_000_000
#: Numbers of one level that are worked on at a time, so that they stay near the processor.
HELD_NUMBERS = 1 << 17


@dataclass(frozen=True)
class Nodes:
    """Trees behind one another; ``child`` is the left child in the same tree (0 for a leaf), its sibling is ``other``."""
    begins: np.ndarray
    child: np.ndarray
    other: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray


def stored_nodes(model: RandomForestClassificationModel) -> DataFrame:
    """(tree, id, child, other, feature, cut, value, weight) of every node, as a table."""
    spark = SparkSession.builder.getOrCreate()
    path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    weight = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), F.greatest(n["leftChild"], F.lit(0)).alias("child"),
        F.greatest(n["rightChild"], F.lit(0)).alias("other"), F.greatest(n["split"]["featureIndex"], F.lit(0)).alias("feature"),
        F.coalesce(F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)), F.lit(0.0)).alias("cut"),
        (F.element_at(n["impurityStats"], 2) / weight).alias("value"), weight.alias("weight"))


def held_nodes(table: DataFrame, low: int, high: int) -> Nodes:
    """Nodes of the trees from ``low`` to ``high`` - 1."""
    got = table.where(F.col("tree").between(low, high - 1)).orderBy("tree", "id").toArrow()
    tree = got["tree"].to_numpy()
    begins = np.flatnonzero(np.diff(tree, prepend=tree[0] - 1, append=tree[-1] + 1))
    return Nodes(begins, *[got[c].to_numpy() for c in ("child", "other", "feature", "cut", "value", "weight")])


def groups(table: DataFrame, held: int) -> list[tuple[int, int]]:
    """Ranges of trees with about ``held`` nodes each; one row per tree is read."""
    out, low, size = [], 0, 0
    sizes = table.groupBy("tree").count().orderBy("tree").collect()
    for r in sizes:
        if size and size + r["count"] > held:
            out.append((low, r["tree"]))
            low, size = r["tree"], 0
        size += r["count"]
    return [*out, (low, len(sizes))]


class Level:
    """Edges into the nodes of one depth; the two children of the k-th inner node above are edges 2k and 2k + 1."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)


def levels(nodes: Nodes, tree: int, features: int, points: np.ndarray) -> tuple[list[Level], float]:
    """Levels of a tree with the factors of every edge at every point, and the mean value of its leaves."""
    begin = nodes.begins[tree]
    at = np.array([begin])
    last = np.full((1, features), -1)  # edge that tested a feature last
    zs, edges, out = np.empty(0), 0, []
    base = 0.0 if nodes.child[begin] else float(nodes.value[begin])
    while len(inner := np.flatnonzero(nodes.child[at])):
        up = at[inner]
        feature = np.repeat(nodes.feature[up], 2)
        at = np.stack([begin + nodes.child[up], begin + nodes.other[up]], axis=1).ravel()
        parent = np.repeat(inner, 2)
        before = last[parent, feature]
        z = nodes.weight[at] / nodes.weight[np.repeat(up, 2)]
        share = np.where(before >= 0, zs[before] if len(zs) else 1.0, 1.0)
        z_before, z = share, z * share
        last = last[parent]
        last[np.arange(len(at)), feature] = edges + np.arange(len(at))
        # factor and slope for (not met), (met before, not now), (met); an edge without an earlier one was met before
        t, fresh = points[:, None, None], (before < 0)[None, None, :]
        o_now, o_before = np.array([0.0, 0.0, 1.0])[None, :, None], np.array([0.0, 1.0, 1.0])[None, :, None]
        f_now, f_before = t * o_now + (1 - t) * z, t * o_before + (1 - t) * z_before
        ratio = f_now / np.where(fresh, 1.0, f_before)
        slope = (o_now - z) / f_now - np.where(fresh, 0.0, (o_before - z_before) / f_before)
        leaf = np.flatnonzero(nodes.child[at] == 0)
        out.append(Level(parent=parent, feature=feature, cut=np.repeat(nodes.cut[up], 2), before=before, start=edges,
                         ratio=_steps(ratio), slope=_steps(slope), leaf=leaf, inner=np.flatnonzero(nodes.child[at]),
                         value=nodes.value[at[leaf]], onehot=(np.arange(features)[:, None] == feature).astype(float)))
        base += float(nodes.value[at[leaf]] @ (nodes.weight[at[leaf]] / nodes.weight[begin]))
        zs, edges = np.concatenate([zs, z]), edges + len(at)
    return out, base


def _steps(states: np.ndarray) -> np.ndarray:
    """Value of the first state, and what being met before, and now, adds to it."""
    return np.stack([states[:, 0], states[:, 1] - states[:, 0], states[:, 2] - states[:, 1]], axis=1)[..., None]


def tree_contributions(tree: list[Level], x: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of one tree to ``out`` (features x rows) for rows ``x`` (features x rows)."""
    if not tree:
        return
    rows, points = x.shape[1], len(weights)
    met = np.empty((tree[-1].start + len(tree[-1].feature), rows), bool)
    paths, flags = [np.ones((points, 1, rows))], []
    for level in tree:
        now = x[level.feature] <= level.cut[:, None]
        now[1::2] = ~now[1::2]
        old = np.where((level.before >= 0)[:, None], met[level.before], True)
        now &= old
        met[level.start:level.start + len(now)] = now
        now, old = now.astype(float), old.astype(float)
        flags.append((old, now))
        r = level.ratio
        paths.append(paths[-1][:, level.parent] * (r[:, 0] + r[:, 1] * old + r[:, 2] * now))
    below = None
    for level, path, (old, now) in zip(reversed(tree), reversed(paths), reversed(flags)):
        total = np.empty_like(path)
        total[:, level.leaf] = path[:, level.leaf] * level.value[:, None]
        if len(level.inner):
            total[:, level.inner] = below
        s = level.slope
        gain = np.einsum("q,qer->er", weights, total * (s[:, 0] + s[:, 1] * old + s[:, 2] * now))
        out += level.onehot @ gain
        below = total[:, 0::2] + total[:, 1::2]


def forest_contributions(nodes: Nodes, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (rows x features), summed over trees, and the sum of the trees' means."""
    rows, features = x.shape
    points, weights = np.polynomial.legendre.leggauss((features + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    flat, phi, base = np.ascontiguousarray(x.T), np.zeros((features, rows)), 0.0
    for k in range(len(nodes.begins) - 1):
        tree, mean = levels(nodes, k, features, points)
        base += mean
        block = max(16, HELD_NUMBERS // (len(weights) * max([len(lv.feature) for lv in tree], default=1)))
        for at in range(0, rows, block):
            tree_contributions(tree, flat[:, at:at + block], weights, phi[:, at:at + block])
    return phi.T, base


def contributions(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str], keep: Sequence[str],
                  held: int = NODES_HELD) -> DataFrame:
    """Additive contribution of every feature to each row's probability.

    Output: ``keep``, one ``phi_<feature>`` per feature and ``base``; base plus the sum of contributions is the
    probability of the positive class. Rows with a missing feature are left out.
    """
    features, keep, context = list(features), list(keep), df.sparkSession.sparkContext
    table = stored_nodes(model)
    parts, base, trees = [], 0.0, 0
    row = F.array(*[F.col(f).cast("double") for f in features])
    for low, high in groups(table, held):
        nodes = held_nodes(table, low, high)
        base += forest_contributions(nodes, np.empty((0, len(features))))[1]
        trees += high - low
        parts.append(_explainer(context.broadcast(nodes))(row))
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    out = df.dropna(subset=features).select(*keep, total.alias("_phi"))
    return out.select(*keep, *[(F.col("_phi")[i] / F.lit(float(trees))).alias(f"phi_{f}") for i, f in enumerate(features)],
                      F.lit(base / trees).alias("base"))


def _explainer(shared):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def explain(rows: pa.Array) -> pa.Array:
        width = len(rows[0]) if len(rows) else 1
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        phi = forest_contributions(shared.value, x)[0] if len(rows) else x
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(phi).ravel()))
    return explain
