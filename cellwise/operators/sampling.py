"""Reproducible draws, pseudo-absence designs, splits, folds and bootstraps.

Every random choice is integer arithmetic on a key and a seed, so a lost task
recomputes the same draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw, technical, uniform
from .joins import dealt_join
from .polygons import memberships
from .ranks import cumulative, numbered, spearman, take_ranked
from .redraws import redrawn_correlations

# Pseudo-absence designs, and a retired name of one of them.
STRATEGIES = ("ahp_filtrado", "fondo_aleatorio", "sin_filtros_geofisicos", "grupo_objetivo")
RETIRED_STRATEGIES = {"fondo_objetivo": "sin_filtros_geofisicos"}


def score(key: Column | str, seed: int) -> Column:
    """Unique draw order: a 31-bit draw followed by the key itself."""
    k = F.col(key) if isinstance(key, str) else key
    return draw(k, seed) * F.lit(2**31).cast("bigint") + F.pmod(k.cast("bigint"), F.lit(2**31))


def random_points(spark: SparkSession, edges: DataFrame, polygon: str,
                  bounds: tuple[float, float, float, float], wanted: int,
                  max_attempts: int, seed: int, accept=None) -> DataFrame:
    """The first ``wanted`` uniform points of a counter sequence that fall in the domain.

    ``accept`` is an optional extra ``DataFrame -> DataFrame`` filter of the
    candidates. The sequence stops at ``max_attempts``; too few hits by then are an error.
    """
    x0, y0, x1, y1 = bounds
    tries = min(max_attempts, max(64, 2 * wanted))
    while True:
        ids = spark.range(tries).withColumnRenamed("id", "point_id")
        pts = ids.select("point_id",
                         (F.lit(x0) + uniform(F.col("point_id") * 2, seed) * (x1 - x0)).alias("x"),
                         (F.lit(y0) + uniform(F.col("point_id") * 2 + 1, seed) * (y1 - y0)).alias("y"))
        hit = pts.join(memberships(pts, edges, "point_id", polygon).select("point_id").distinct(),
                       "point_id", "left_semi")
        hit = accept(hit) if accept else hit
        found = hit.count()
        if found >= wanted or tries >= max_attempts:
            break
        tries = min(max_attempts, int(tries * max(2.0, 1.2 * wanted / max(found, 1))))
    if found < wanted:
        raise ValueError(f"only {found} of {wanted} points fall in the domain after {tries} attempts")
    return hit if found == wanted else take_ranked(hit, "point_id", "point_id", wanted)


def strategy_name(strategy: str) -> str:
    name = RETIRED_STRATEGIES.get(strategy, strategy)
    if name not in STRATEGIES:
        raise ValueError(f"unknown pseudo-absence design: {strategy}; one of {STRATEGIES}")
    return name


def strategy_filter(strategy: str, criteria: dict[str, float], dist: str | None) -> Column:
    """Which candidates a design keeps; ``dist`` is the criterion distance column."""
    name = strategy_name(strategy)
    limit = criteria.get("dist_max", 20000.0)
    if name == "ahp_filtrado":
        return technical(criteria["ghi_min"], criteria["slope_max"], criteria["elev_max"], dist, limit)
    if name == "sin_filtros_geofisicos" and dist is not None:
        return F.col(dist) <= limit
    return F.lit(True)


def negatives(candidates: DataFrame, strategy: str, criteria: dict[str, float],
              dist: str | None = "dist_transmision", required: Sequence[str] = ()) -> DataFrame:
    """Eligible pseudo-absences of a design among complete candidates."""
    kept = candidates.dropna(subset=list(required)) if required else candidates
    return kept.where(strategy_filter(strategy, criteria, dist)).withColumn("clase", F.lit(0))


def draw_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows at random (all rows when there are fewer)."""
    return take_ranked(df.withColumn("_draw", score(key, seed)), "_draw", key, n).drop("_draw")


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """Flag ``is_test`` for a share of each class."""
    drawn = df.withColumn("_draw", score(key, seed))
    cuts = (cumulative(drawn.select(label, "_draw"), "_draw", by=[label])
            .where(F.col("n_before") < F.floor(F.col("n_total") * share + 0.5))
            .groupBy(label).agg(F.max("_draw").alias("_cut")))
    return (drawn.join(F.broadcast(cuts), label, "left")  # one row per class
            .withColumn("is_test", F.coalesce(F.col("_draw") <= F.col("_cut"), F.lit(False)))
            .drop("_draw", "_cut"))


def group_folds(df: DataFrame, block: str, label: str, k: int = 5) -> DataFrame:
    """Block-disjoint, class-balanced folds.

    Blocks are ordered by positives, then size, and dealt back and forth over the
    folds, so that each fold gets its share of every kind of block.
    """
    blocks = df.groupBy(block).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
    turn = numbered(blocks, [F.desc("_p"), F.desc("_n"), F.asc(block)])
    step = F.pmod("position", F.lit(2 * k))
    fold = F.when(step < k, step).otherwise(2 * k - 1 - step)
    return dealt_join(df, turn.select(block, fold.alias("fold")), [block], F.struct(*df.columns))


def impute_dates(df: DataFrame, key: str, date: str, seed: int) -> DataFrame:
    """Fill missing dates from the empirical distribution; flag the imputed rows."""
    known = numbered(df.where(F.col(date).isNotNull()).select(key, date), [date, key]).select(
        "position", F.col(date).alias("_drawn"))
    n = known.count()
    if n == 0:
        raise ValueError("no row has a date to draw from")
    pick = F.when(F.col(date).isNull(), F.pmod(draw(key, seed), F.lit(n)))
    # rows with a date look nothing up: they get keys of their own so that they spread
    out = df.withColumn("position", F.coalesce(pick, -1 - F.col(key).cast("bigint")))
    return (out.join(known, "position", "left")
            .withColumn("fecha_imputada", F.col(date).isNull())
            .withColumn(date, F.coalesce(date, "_drawn")).drop("position", "_drawn"))


# -- bootstraps ------------------------------------------------------------------

def _multiplicity(blocks: DataFrame, block: str, n_boot: int, seed: int) -> DataFrame:
    """How often each replicate draws each block: ``(rep, block, times)``."""
    named = numbered(blocks.select(block).distinct(), [block])
    n = named.count()
    if n < 2:
        raise ValueError("a block bootstrap needs at least two blocks")
    ids = blocks.sparkSession.range(n_boot * n)
    picks = ids.select(F.expr(f"id div {n}").alias("rep"), F.pmod(draw("id", seed), F.lit(n)).alias("position"))
    times = picks.groupBy("rep", "position").agg(F.count(F.lit(1)).alias("times"))
    return times.join(named, "position").select("rep", block, "times")


def block_bootstrap(blocks: DataFrame, block: str, a: str, b: str, n_boot: int, seed: int) -> DataFrame:
    """Rank correlation of block values for each replicate: ``(rep, rho)``."""
    drawn = _multiplicity(blocks, block, n_boot, seed).join(blocks, block)
    return spearman(drawn, a, b, by=["rep"], weight=F.col("times")).select("rep", "rho")


def cluster_bootstrap(cells: DataFrame, block: str, a: str, b: str, n_boot: int, seed: int) -> DataFrame:
    """Cell-level rank correlation when whole blocks are redrawn."""
    return redrawn_correlations(cells, _multiplicity(cells, block, n_boot, seed), block, a, b, n_boot)


def interval(reps: DataFrame) -> DataFrame:
    """95 % percentile interval and standard error over the replicates (a fixed, small number)."""
    q = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(q.alias("q"), F.stddev_pop("rho").alias("se"), F.count("rho").alias("n_boot")).select(
        F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "se", "n_boot")
