"""Random forests on Spark ML: training, spatial validation, search, contributions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..runtime import cut, together
from .attribution import contributions
from .ranks import auc, brier
from .sampling import group_folds

# Feature sets of the ablation study.
ABLATIONS = {
    "completo": ["slope", "ghi", "elev", "northness", "dist_transmision", "dist_almacen", "dist_subestaciones"],
    "sin_subest": ["slope", "ghi", "elev", "northness", "dist_transmision", "dist_almacen"],
    "sin_trans": ["slope", "ghi", "elev", "northness", "dist_almacen", "dist_subestaciones"],
    "minimo": ["slope", "ghi", "elev", "northness", "dist_subestaciones"],
}
DEFAULTS = {"n_estimators": 500, "max_depth": 7, "min_samples_leaf": 4}
# Search space (low, high, step).
SEARCH_SPACE = {"n_estimators": (100, 1000, 100), "max_depth": (3, 15, 1), "min_samples_leaf": (2, 10, 1)}


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Rows with weight n / (2 n_class)."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    n = row["p"] + row["q"]
    if not row["p"] or not row["q"]:
        raise ValueError("training data needs both classes")
    w = F.when(F.col(label) == 1, n / (2.0 * row["p"])).otherwise(n / (2.0 * row["q"]))
    return df.withColumn("_weight", w)


def train(df: DataFrame, features: Sequence[str], label: str = "clase",
          params: Mapping[str, int] | None = None, seed: int = 42, max_bins: int = 64) -> RandomForestClassificationModel:
    """Forest with balanced class weights; parameters follow the usual names. Trees are at most 30 levels deep."""
    p = {**DEFAULTS, **(params or {})}
    if int(p["max_depth"]) > 30:
        raise ValueError(f"max_depth {p['max_depth']} exceeds 30, the deepest tree that can be built")
    data = balanced(df.dropna(subset=[*features, label]).withColumn(label, F.col(label).cast("double")), label)
    rf = RandomForestClassifier(
        featuresCol="_x", labelCol=label, weightCol="_weight", numTrees=int(p["n_estimators"]),
        maxDepth=int(p["max_depth"]), minInstancesPerNode=int(p["min_samples_leaf"]),
        featureSubsetStrategy="sqrt", maxBins=max_bins, seed=seed)
    return rf.fit(_vectors(data, features).select("_x", label, "_weight"))


def score(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str],
          name: str = "prob") -> DataFrame:
    """Probability of the positive class for every complete row."""
    out = model.transform(_vectors(df, features))
    drop = ["_x", model.getRawPredictionCol(), model.getProbabilityCol(), model.getPredictionCol()]
    return out.withColumn(name, vector_to_array(model.getProbabilityCol())[1]).drop(*drop)


def spatial_cv(df: DataFrame, features: Sequence[str], block: str, label: str = "clase",
               params: Mapping[str, int] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """One row per fold: sizes, AUC, Brier and importances; blocks never straddle folds."""
    return _union(together(df.sparkSession, _fold_tasks(_folded(df, features, block, label, k), features, label, params, k, seed)))


def _folded(df: DataFrame, features: Sequence[str], block: str, label: str, k: int) -> DataFrame:
    return cut(group_folds(df.dropna(subset=[*features, label, block]), block, label, k))


def _fold_tasks(rows: DataFrame, features: Sequence[str], label: str, params: Mapping[str, int] | None, k: int,
                seed: int) -> list[Callable[[], DataFrame]]:
    """A fit and its scores for each fold."""
    def task(f: int) -> DataFrame:
        model = train(rows.where(F.col("fold") != f), features, label, params, seed)
        held = score(model, rows.where(F.col("fold") == f), features)
        return _fold_row(held, label, F.lit(f).alias("fold"), model, features)
    return [partial(task, f) for f in range(k)]


def _fold_row(held: DataFrame, label: str, name, model, features) -> DataFrame:
    held = cut(held.select(label, "prob"))
    imp = F.map_from_arrays(F.array(*[F.lit(f) for f in features]),
                            F.array(*[F.lit(float(v)) for v in model.featureImportances.toArray()]))
    return held.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col(label) == 1).alias("n_pos")).select(
        name, "n_test", "n_pos", auc(held, "prob", label).scalar().alias("auc"),
        brier(held, "prob", label).scalar().alias("brier"), imp.alias("importances"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
                     F.avg("brier").alias("brier_mean"), F.stddev_pop("brier").alias("brier_std"))


def importance_summary(folds: DataFrame) -> DataFrame:
    return folds.select("fold", F.explode("importances").alias("feature", "v")).groupBy("feature").agg(
        F.avg("v").alias("importance_mean"), F.stddev_pop("v").alias("importance_std")).orderBy(
        F.desc("importance_mean"))


def leave_one_region_out(df: DataFrame, features: Sequence[str], region: str, label: str = "clase",
                         params: Mapping[str, int] | None = None, seed: int = 42) -> DataFrame:
    """One row per region held out; regions without both classes are left out.

    The regions are the zones of the study, so their list is short by nature.
    """
    data = cut(df.dropna(subset=[*features, label, region]))
    both = data.groupBy(region).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    names = [r[0] for r in both.where((F.col("p") > 0) & (F.col("q") > 0)).select(region).orderBy(region).collect()]
    if len(names) < 2:
        raise ValueError("leave-one-region-out needs two regions with both classes")

    def task(name) -> DataFrame:
        model = train(data.where(F.col(region) != F.lit(name)), features, label, params, seed)
        held = score(model, data.where(F.col(region) == F.lit(name)), features)
        return _fold_row(held, label, F.lit(name).alias(region), model, features)

    return _union(together(df.sparkSession, [partial(task, n) for n in names]))


def region_gap(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("auc").alias("auc_mean"), (F.max("auc") - F.min("auc")).alias("gap"))


def search(df: DataFrame, features: Sequence[str], block: str, trials: int, label: str = "clase",
           space: Mapping[str, tuple[int, int, int]] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Seeded random search: every trial with its mean spatial Brier, best first."""
    space = space or SEARCH_SPACE
    spark = df.sparkSession
    grid = list(itertools.product(*[range(lo, hi + 1, st) for lo, hi, st in space.values()]))
    picks = spark.range(trials).select(F.pmod(draw("id", seed), F.lit(len(grid))).alias("i")).collect()
    tried = sorted({p["i"] for p in picks})
    rows = _folded(df, features, block, label, k)  # every trial has the same folds
    chosen = [dict(zip(space, grid[t])) for t in tried]
    folds = together(spark, [t for params in chosen for t in _fold_tasks(rows, features, label, params, k, seed)])
    parts = [cv_summary(_union(folds[i * k:i * k + k])).select(*[F.lit(v).alias(n) for n, v in params.items()], "auc_mean", "brier_mean")
             for i, params in enumerate(chosen)]
    return _union(parts).orderBy("brier_mean", *space)


def ablation(df: DataFrame, block: str, sets: Mapping[str, Sequence[str]] | None = None, label: str = "clase",
             params: Mapping[str, int] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Spatial validation per feature set and the AUC difference from the first one."""
    sets = sets or ABLATIONS
    def task(name: str, features: Sequence[str]) -> DataFrame:
        return cv_summary(spatial_cv(df, features, block, label, params, k, seed)).withColumn("modelo", F.lit(name))

    out = _union(together(df.sparkSession, [partial(task, n, fs) for n, fs in sets.items()]))
    out = cut(out)
    base = out.where(F.col("modelo") == next(iter(sets))).select("auc_mean").scalar()
    return out.select("modelo", "auc_mean", "auc_std", "brier_mean", "brier_std",
                      (F.col("auc_mean") - base).alias("delta_auc"))


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


# -- additive contributions --------------------------------------------------------

def contribution_shares(phi: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature as a share, with its mean direction and place."""
    row = phi.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f"a_{f}") for f in features],
                  *[F.avg(f"phi_{f}").alias(f"d_{f}") for f in features])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("mean_abs"), F.col(f"d_{f}").alias("direction"))
        for f in features])).alias("s")).select("s.*")
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))  # one row per feature
    return long.select("*", (100.0 * F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(every))).alias("pct"),
                       F.row_number().over(every.orderBy(F.desc("mean_abs"), "feature")).alias("place"))


def dominant(phi: DataFrame, features: Sequence[str]) -> DataFrame:
    """Index of the strongest feature per row (the first on ties)."""
    arr = F.array(*[F.abs(f"phi_{f}") for f in features])
    return phi.withColumn("dominante", F.array_position(arr, F.array_max(arr)) - 1)


def dominant_summary(phi: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    signed = F.array(*[F.col(f"phi_{f}") for f in features])
    d = dominant(phi, features).select(
        F.element_at(names, (F.col("dominante") + 1).cast("int")).alias("feature"),
        F.element_at(signed, (F.col("dominante") + 1).cast("int")).alias("v"))
    n = F.count(F.lit(1))
    from pyspark.sql import Window

    return d.groupBy("feature").agg(n.alias("n_cells"), F.avg("v").alias("mean_signed")).withColumn(
        "pct", 100.0 * F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(0))))
