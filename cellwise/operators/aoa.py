"""Area of applicability: dissimilarity to the training data in weighted feature space."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .nearest import nearest
from .ranks import quantiles, summary


@dataclass(frozen=True)
class ApplicabilityFit:
    """Scalars of the fitted space and its weighted training rows."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    weights: tuple[float, ...]
    mean_distance: float
    threshold: float
    train: DataFrame
    stats: DataFrame

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return _project(df, self.features, self.means, self.sds, self.weights, keep)


def _project(df, features, means, sds, weights, keep) -> DataFrame:
    return df.select(*keep, *[
        ((F.col(f).cast("double") - F.lit(m)) / F.lit(s) * F.lit(math.sqrt(w))).alias(f"_w_{f}")
        for f, m, s, w in zip(features, means, sds, weights)])


def fit(train: DataFrame, features: Sequence[str], key: str,
        weights: Mapping[str, float] | None = None, group: str | None = None) -> ApplicabilityFit:
    """Standardise, weight, and derive the threshold Q3 + 1.5 IQR of the training index.

    With ``group`` a training row is measured against other groups only (spatial
    cross-validation), else, and if there is one group only, against every other row.
    """
    features = tuple(features)
    train = train.dropna(subset=list(features))
    raw = [float((weights or {}).get(f, 0.0)) if weights else 1.0 / len(features) for f in features]
    total = sum(raw)
    w = tuple(v / total if total > 0 else v for v in raw)
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                    *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    means = tuple(float(row[f"m_{f}"]) for f in features)
    sds = tuple(float(row[f"s_{f}"]) or 1.0 for f in features)
    keep = [key] + ([group] if group else [])
    space = cut(_project(train, features, means, sds, w, keep))
    dims = [f"_w_{f}" for f in features]
    other = space.withColumnRenamed(key, "_ref")
    if group and space.select(group).distinct().limit(2).count() > 1:
        mine, theirs, grp = space, other, group
    else:
        mine, theirs, grp = space.withColumn("_self", F.col(key)), other.withColumn("_self", F.col("_ref")), "_self"
    d = cut(nearest(mine, theirs, key, "_ref", dims=dims, group=grp).select(key, "dist"))
    mean = d.agg(F.avg("dist")).first()[0] or 1.0
    di = d.select(key, (F.col("dist") / F.lit(mean)).alias("di"))
    q = quantiles(di, "di", {"q25": 0.25, "q75": 0.75}).first()
    threshold = q["q75"] + 1.5 * (q["q75"] - q["q25"])
    stats = summary(di, "di", probs={"di_q25": 0.25, "di_mediana": 0.5, "di_q75": 0.75})
    return ApplicabilityFit(features, means, sds, w, float(mean), float(threshold), other, stats)


def dissimilarity(model: ApplicabilityFit, zone: DataFrame, key: str) -> DataFrame:
    """``(key, di, inside)`` for every complete zone row."""
    dims = [f"_w_{f}" for f in model.features]
    space = model.project(zone.dropna(subset=list(model.features)), [key])
    near = nearest(space, model.train, key, "_ref", dims=dims)
    di = F.col("dist") / F.lit(model.mean_distance)
    return near.select(key, di.alias("di"), (di <= F.lit(model.threshold)).alias("inside"))


def zone_report(scored: DataFrame) -> DataFrame:
    """Counts and shares inside, and the spread of the index (population deviation)."""
    n, n_in = F.count(F.lit(1)), F.count_if("inside")
    counts = scored.agg(n.alias("n_cells"), n_in.alias("n_inside"), (n - n_in).alias("n_outside"),
                        (100.0 * n_in / n).alias("pct_inside"),
                        (100.0 * (n - n_in) / n).alias("pct_outside"))
    spread = summary(scored, "di", probs={"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95},
                     std="population").drop("n")
    pack = spread.select(F.struct("*")).scalar()
    return counts.select("*", pack.alias("di")).select("*", "di.*").drop("di")
