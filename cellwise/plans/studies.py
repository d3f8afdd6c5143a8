"""Studies on aligned cell tables: cross, consensus, mounts, decoupling, top-K, transfer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions.pvalue import p_correlation
from ..operators.components import nested_zones
from ..operators.grid import GridSpec
from ..operators.quality import require_rows
from ..operators.ranks import (
    _at, cumulative, overlap_of_tops, quantiles, rank_correlation, spearman, summary, with_ranks)
from ..operators.sampling import block_bootstrap, cluster_bootstrap, interval
from ..runtime import cut, together

# K percentages of the ranking curves, target figures, reference gain.
KS = (0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0)
TARGET_RECALL_K3, TARGET_PRECISION_K1 = 0.85, 0.15
REFERENCE_GAIN_PCT, REFERENCE_TOLERANCE_PP = 36.0, 5.0


def one(df: DataFrame) -> Column:
    """A one-row table as a struct column."""
    return df.select(F.struct("*")).scalar()


# -- cross of suitability and yield ----------------------------------------------------

def with_status(cells: DataFrame, prob: str = "prob", yld: str = "yld",
                excluded: Column | None = None) -> DataFrame:
    return cells.withColumn("status", K.cell_status(prob, yld, excluded))


def cross_layers(cells: DataFrame, threshold: float, prob: str = "prob", yld: str = "yld") -> DataFrame:
    """Valid cells with the yield of the suitable ones and both combined rankings."""
    valid = with_status(cells, prob, yld).where(F.col("status") == "valida").drop("status")
    lim = one(quantiles(valid, yld, {"p1": 0.01, "p99": 0.99}))
    out = valid.withColumn("_l", lim).withColumn("yield_norm", K.robust(yld, F.col("_l.p1"), F.col("_l.p99")))
    return out.drop("_l").withColumn("en_aptas", K.only_suitable(yld, prob, threshold)).withColumn(
        "ranking", F.col(prob) * F.col("yield_norm")).withColumn(
        "ranking_media", 0.5 * F.col(prob) + 0.5 * F.col("yield_norm"))


def cross_study(cells: DataFrame, threshold: float, key: str, prob: str = "prob", yld: str = "yld") -> DataFrame:
    """Counts, yield in the zone and in suitable cells, gain, and sensitivity of the formula."""
    layers = cut(require_rows(cross_layers(cells, threshold, prob, yld), "no valid common cells"))
    suitable = layers.where(F.col(prob) >= threshold)
    dead = with_status(cells, prob, yld).agg(F.count_if(F.col("status") == "sin_ghi")).scalar()
    tops = overlap_of_tops(layers, "ranking", "ranking_media", key)
    parts = layers.sparkSession.range(1).select(
        one(summary(layers, yld)).alias("region"), one(summary(suitable, yld)).alias("aptas"),
        spearman(layers, "ranking", "ranking_media").select("rho").scalar().alias("rho"),
        one(tops).alias("tops"), dead.alias("sin_ghi"))
    return parts.select(
        F.col("region.n").alias("celdas_validas"), F.col("sin_ghi").alias("celdas_sin_ghi"),
        F.coalesce("aptas.n", F.lit(0)).alias("celdas_aptas"),
        (100.0 * F.coalesce("aptas.n", F.lit(0)) / F.col("region.n")).alias("pct_aptas"),
        F.col("region.mean").alias("region_media"), F.col("region.p50").alias("region_p50"),
        F.col("region.p90").alias("region_p90"), F.col("aptas.mean").alias("aptas_media"),
        F.col("aptas.p50").alias("aptas_p50"), F.col("aptas.p90").alias("aptas_p90"),
        K.gain_pct("aptas.mean", "region.mean").alias("ganancia_pct"),
        F.col("rho").alias("rho_formula"), F.col("tops.overlap_pct").alias("overlap_top1_pct"))


def correlation_guarded(cells: DataFrame, a: str, b: str, min_n: int = 10) -> DataFrame:
    """Rank correlation and p value; too few rows give NULL."""
    r = spearman(cells, a, b)
    rho = F.when(F.col("n") >= min_n, F.col("rho"))
    return r.select(F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho")).select(
        "n", "rho", p_correlation(F.col("rho"), F.col("n").cast("double")).alias("p"))


def score_yield_rows(cells: DataFrame, prob: str, yld: str, ghi: str, threshold: float) -> DataFrame:
    """Score against yield over all cells and over the suitable ones, and irradiance against yield, each with its reading."""
    cells = cut(cells.where(F.col(yld) > 0).select(prob, yld, ghi))
    parts = [("todas", cells, prob), ("aptas", cells.where(F.col(prob) >= threshold), prob), ("irradiancia", cells, ghi)]
    rows = [correlation_guarded(df, a, yld).withColumn("ambito", F.lit(name)) for name, df, a in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("lectura", correlation_reading(F.col("rho")))


# -- agreement of profiles ---------------------------------------------------------------

def consensus_cells(cells: DataFrame, profiles: Sequence[str], percentile: float) -> DataFrame:
    """Cells with a flag per profile (value at or above its percentile) and their sum."""
    valid = require_rows(cells.dropna(subset=list(profiles)), "the profiles share no valid cell")
    out = valid
    for p in profiles:
        limit = quantiles(valid, p, {"t": percentile / 100.0}).scalar()
        out = out.withColumn(f"apto_{p}", (F.col(p) >= limit).cast("int"))
    return out.withColumn("consenso", K.add(F.col(f"apto_{p}") for p in profiles))


def consensus_counts(flagged: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Cells by the number of profiles that find them suitable, with the numbers that no cell has."""
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("consenso") == i).alias(f"n{i}") for i in range(len(profiles) + 1)]
    rows = flagged.agg(n.alias("total"), *counts).select("total", F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(profiles) + 1)])).alias("consenso", "celdas"))
    return rows.select("consenso", "celdas", (100.0 * F.try_divide(F.col("celdas"), F.col("total"))).alias("pct"))


def consensus_profiles(flagged: DataFrame, profiles: Sequence[str], percentile: float) -> DataFrame:
    """Per profile its limit and the cells at or above it."""
    limits = [quantiles(flagged, p, {"t": percentile / 100.0}).scalar() for p in profiles]
    rows = flagged.agg(F.count(F.lit(1)).alias("celdas_validas"), *[F.sum(f"apto_{p}").alias(p) for p in profiles])
    return rows.select("celdas_validas", F.explode(F.array(*[
        F.struct(F.lit(p).alias("perfil"), t.alias("umbral"), F.col(p).alias("celdas_aptas")) for p, t in zip(profiles, limits)])).alias("s")).select(
        "s.perfil", "s.umbral", "s.celdas_aptas", "celdas_validas")


def consensus_reading(counts: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """One sentence: how much of the valid zone all profiles agree on, and how much only some."""
    share = lambda c: F.round(F.sum(F.when(c, F.col("celdas")).otherwise(0)) * 100.0 / F.sum("celdas"), 2)
    k, n = F.col("consenso"), len(profiles)
    row = counts.agg(share(k == n).alias("todos"), share((k > 0) & (k < n)).alias("algunos"))
    return row.select(F.format_string(f"%.2f%% apta en los {n} perfiles (consenso); %.2f%% solo en algunos (divergencia)", "todos", "algunos").alias("lectura"))


def profile_correlations(cells: DataFrame, profiles: Sequence[str]) -> DataFrame:
    ranked = cut(with_ranks(cells, list(profiles)))
    out = None
    for i, a in enumerate(profiles):
        for b in profiles[i + 1:]:
            r = rank_correlation(ranked, a, b).select(F.lit(f"{a}_vs_{b}").alias("par"), "rho")
            out = r if out is None else out.unionByName(r)
    return out


# -- mounts ----------------------------------------------------------------------------------

def mount_cells(cells: DataFrame, threshold: float, fixed: str, tracker: str, flat: str | None = None,
                prob: str = "prob") -> DataFrame:
    live = (F.col(fixed) > 0) & (F.col(tracker) > 0)
    live = live & (F.col(flat) > 0) if flat else live
    out = cells.where(live & (F.col(prob) >= threshold))
    return out.withColumn("gain", F.try_divide(F.col(tracker), F.col(fixed)) - 1.0)


def mount_study(cells: DataFrame, grid: GridSpec, threshold: float, fixed: str, tracker: str,
                flat: str | None = None, prob: str = "prob", block_m: float = 30000.0) -> DataFrame:
    """Gain of a tracker: of means, median over cells, median over spatial blocks."""
    apt = cut(require_rows(mount_cells(cells, threshold, fixed, tracker, flat, prob),
                           "no suitable cells common to the mounts"))
    blocks = apt.groupBy(K.block_number(grid.x(), grid.y(), block_m).alias("block")).agg(F.avg("gain").alias("gain"))
    means = apt.agg(F.count(F.lit(1)).alias("n"), F.avg(fixed).alias("fijo"), F.avg(tracker).alias("seguidor"),
                    (F.avg(flat) if flat else F.lit(None).cast("double")).alias("plano"))
    by_cell = quantiles(apt, "gain", {"m": 0.5}).scalar()
    by_block = one(summary(blocks, "gain", probs={"m": 0.5}))
    out = means.select(
        F.col("n").alias("celdas_aptas"), F.col("fijo").alias("media_fijo"), F.col("seguidor").alias("media_seguidor"),
        K.gain_pct("seguidor", "fijo").alias("ganancia_media_pct"), (100.0 * by_cell).alias("ganancia_mediana_celda_pct"),
        by_block.alias("_b"), K.gain_pct("fijo", "plano").alias("ganancia_fijo_vs_plano_pct"),
        K.gain_pct("seguidor", "plano").alias("ganancia_seguidor_vs_plano_pct"))
    return out.select("*", (100.0 * F.col("_b.m")).alias("ganancia_mediana_bloque_pct"),
                      F.col("_b.n").alias("n_bloques")).drop("_b").withColumn("lectura", mount_reading())


def mount_reading() -> Column:
    """Sentence about the gain against the published reference."""
    diff = F.col("ganancia_seguidor_vs_plano_pct") - REFERENCE_GAIN_PCT
    verdict = (F.when(diff.isNull(), "sin referencia horizontal")
               .when(F.abs(diff) <= REFERENCE_TOLERANCE_PP, "concuerda con la referencia")
               .when(diff < 0, "por debajo de la referencia").otherwise("por encima de la referencia"))
    return F.format_string("seguidor %+.1f%% sobre fijo; %s; %d bloques", F.col("ganancia_media_pct"), verdict,
                           F.col("n_bloques"))


# -- decoupling ----------------------------------------------------------------------------------

def decoupling_scope(cells: DataFrame, grid: GridSpec, block_m: float, n_boot: int, seed: int, prob: str, yld: str) -> DataFrame:
    """Cell and block rank correlations with bootstrap intervals for one set of cells."""
    placed = cut(cells.select("r", "c", prob, yld, K.block_number(grid.x(), grid.y(), block_m).alias("block")))
    blocks = cut(placed.groupBy("block").agg(F.avg(prob).alias("pa"), F.avg(yld).alias("ya")))
    parts = placed.sparkSession.range(1).select(
        one(spearman(placed, prob, yld)).alias("cell"), one(spearman(blocks, "pa", "ya")).alias("block"),
        one(interval(block_bootstrap(blocks, "block", "pa", "ya", n_boot, seed))).alias("bb"),
        one(interval(cluster_bootstrap(placed, "block", prob, yld, n_boot, seed + 1))).alias("cb"))
    return parts.select(
        F.col("cell.n").alias("n_celdas"), F.col("cell.rho").alias("rho_celda"),
        F.col("block.n").alias("n_bloques"), F.col("block.rho").alias("rho_bloque"),
        p_correlation(F.col("block.rho"), F.col("block.n").cast("double")).alias("p_bloque"),
        F.col("bb.ci_low").alias("bloque_ic_inf"), F.col("bb.ci_high").alias("bloque_ic_sup"), F.col("bb.se").alias("bloque_se"),
        F.col("cb.ci_low").alias("celda_ic_inf"), F.col("cb.ci_high").alias("celda_ic_sup"), F.col("cb.se").alias("celda_se"))


def yield_contrast(valid: DataFrame, threshold: float, prob: str = "prob", yld: str = "yld") -> DataFrame:
    """Mean, median and range of the yield in the zone and in suitable cells, with gains."""
    apt = F.col(prob) >= threshold
    t = cumulative(valid, yld, {"n": F.count(F.lit(1)), "k": F.count_if(apt)})
    y = F.col(yld)
    in_apt = F.col("k") > 0

    def middle(n: str) -> Column:
        return _at(t, yld, 0.5, n) if n == "n" else _median_of(t, yld, n)

    return t.agg(F.sum("n").alias("celdas_validas"), F.sum("k").alias("celdas_aptas"),
                 (F.sum(y * F.col("n")) / F.sum("n")).alias("media_region"), middle("n").alias("mediana_region"),
                 F.min(y).alias("min_region"), F.max(y).alias("max_region"),
                 F.try_divide(F.sum(y * F.col("k")), F.sum("k")).alias("media_aptas"), middle("k").alias("mediana_aptas"),
                 F.min(F.when(in_apt, y)).alias("min_aptas"), F.max(F.when(in_apt, y)).alias("max_aptas")).select(
        "*", K.gain_pct("media_aptas", "media_region").alias("ganancia_media_pct"),
        K.gain_pct("mediana_aptas", "mediana_region").alias("ganancia_mediana_pct"))


def _median_of(t: DataFrame, value: str, n: str) -> Column:
    """Median of a sub-population counted in column ``n`` of a cumulative table."""
    h = (F.col(f"{n}_total") - 1) * 0.5
    has = F.col(n) > 0
    lo = F.max(F.when(has & (F.col(f"{n}_before") <= F.floor(h)), F.col(value)))
    hi = F.max(F.when(has & (F.col(f"{n}_before") <= F.ceil(h)), F.col(value)))
    return lo + (hi - lo) * F.max(h - F.floor(h))


def decoupling_study(cells: DataFrame, grid: GridSpec, threshold: float, n_boot: int, seed: int = 42,
                     block_m: float = 30000.0, prob: str = "prob", yld: str = "yld") -> DataFrame:
    """Both scopes (zone and suitable cells), one row each."""
    valid = with_status(cells, prob, yld).where(F.col("status") == "valida")
    apt = valid.where(F.col(prob) >= threshold)
    if len(apt.limit(3).collect()) < 3:
        raise ValueError("fewer than three suitable cells: decoupling cannot be measured")
    scopes = [("region", valid), ("aptas", apt)]
    run = lambda name, df: decoupling_scope(df, grid, block_m, n_boot, seed, prob, yld).withColumn("ambito", F.lit(name))
    return reduce(DataFrame.unionByName, together(cells.sparkSession, [partial(run, *scope) for scope in scopes]))


# -- top-K -------------------------------------------------------------------------------------------

def topk_cells(cells: DataFrame, prob: str, ks: Sequence[float] = KS, plants: DataFrame | None = None,
               footprint: DataFrame | None = None) -> DataFrame:
    """Valid cells with plant counts and footprint flags attached."""
    out = cells.where(F.col(prob).isNotNull())
    if plants is not None:
        n = plants.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n_plants"))
        out = out.join(n, ["r", "c"], "left").withColumn("n_plants", F.coalesce("n_plants", F.lit(0)))
    if footprint is not None:
        f = footprint.select("r", "c").distinct().withColumn("in_foot", F.lit(True))
        out = out.join(f, ["r", "c"], "left").withColumn("in_foot", F.coalesce("in_foot", F.lit(False)))
    return out


def _require_topk(row) -> None:
    if not row["n"]:
        raise ValueError("top-K needs at least one cell with a score")
    if not row["p"]:
        raise ValueError("top-K needs at least one plant on a cell with a score")


def topk_metrics(valid: DataFrame, prob: str, ks: Sequence[float] = KS) -> DataFrame:
    """Per K: threshold, selected area, recall, and area precision with its ceiling.

    All thresholds and all sums come from one cumulative table of the scores.
    """
    has_foot = "in_foot" in valid.columns
    sums = {"_n": F.count(F.lit(1)), "_p": F.sum("n_plants"),
            "_f": F.count_if("in_foot") if has_foot else F.count_if(F.lit(False))}
    t = cut(cumulative(valid, prob, sums))
    _require_topk(t.agg(F.sum("_n").alias("n"), F.sum("_p").alias("p")).first())
    names = {f"t{i}": 1.0 - k / 100.0 for i, k in enumerate(ks)}
    lim = one(t.agg(*[_at(t, prob, q, "_n").alias(n) for n, q in names.items()]))
    s = t.withColumn("_l", lim)
    rows = s.agg(*[e for i, _ in enumerate(ks) for e in (
        F.max(F.col(f"_l.t{i}")).alias(f"t{i}"),
        *[F.sum(F.when(F.col(prob) >= F.col(f"_l.t{i}"), F.col(c)).otherwise(0)).alias(f"{c}{i}")
          for c in ("_n", "_p", "_f")])],
        F.max("_n_total").alias("n_valid"), F.max("_p_total").alias("n_plants"), F.max("_f_total").alias("n_foot"))
    out = rows.select("n_valid", "n_plants", "n_foot", F.explode(F.array(*[
        F.struct(F.lit(float(k)).alias("k"), F.col(f"t{i}").alias("threshold"), F.col(f"_n{i}").alias("n_top"),
                 F.col(f"_p{i}").alias("captured"), F.col(f"_f{i}").alias("foot_hit"))
        for i, k in enumerate(ks)])).alias("m")).select("n_valid", "n_plants", "n_foot", "m.*")
    ceiling = F.try_divide(F.col("n_foot"), F.col("n_top"))
    precision = F.try_divide(F.col("foot_hit"), F.col("n_top"))
    out = out.withColumn("pct_area", 100.0 * F.col("n_top") / F.col("n_valid")).withColumn(
        "recall", F.try_divide(F.col("captured"), F.col("n_plants")))
    if has_foot:
        base = F.try_divide(F.col("n_foot"), F.col("n_valid"))
        out = out.withColumn("area_precision", precision).withColumn("area_base", base).withColumn(
            "area_ceiling", F.least(ceiling, F.lit(1.0))).withColumn(
            "pct_ceiling", 100.0 * F.try_divide(precision, ceiling)).withColumn(
            "area_enrichment", F.try_divide(precision, base))
    return out


def topk_zones(valid: DataFrame, prob: str, grid: GridSpec, ks: Sequence[float] = KS) -> DataFrame:
    """Per K: candidate zones, those with a plant, and the size-aware random baseline."""
    names = {f"t{i}": 1.0 - k / 100.0 for i, k in enumerate(ks)}
    valid = cut(valid.select("r", "c", "n_plants", prob))
    table = cut(cumulative(valid, prob, {"_n": F.count(F.lit(1)), "_p": F.sum("n_plants")}))
    lim = one(table.agg(*[_at(table, prob, q, "_n").alias(n) for n, q in names.items()]))
    whole = table.agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"))
    _require_topk(whole.first())
    totals = one(whole)
    order = sorted(range(len(ks)), key=lambda i: ks[i])  # masks grow with K, so a cell of one is in all later ones
    level = K.add(F.when(F.col(prob) < F.col(f"_l.t{i}"), 1).otherwise(0) for i in order)
    top = valid.withColumn("_l", lim).select("r", "c", "n_plants", level.alias("level")).where(F.col("level") < len(ks))
    z = nested_zones(top, grid, len(ks), ("n_plants",)).select(
        F.element_at(F.array(*[F.lit(i) for i in order]), (F.col("level") + 1).cast("int")).alias("ki"), F.col("n").alias("a"),
        F.col("n_plants").alias("p"))
    z = cut(z.withColumn("_t", totals).withColumn(
        "luck", 1.0 - F.pow(1.0 - F.col("a") / F.col("_t.n"), F.col("_t.p"))).drop("_t"))
    med = quantiles(z, "a", {"median_cells": 0.5}, by=["ki"])
    kmap = F.element_at(F.array(*[F.lit(float(k)) for k in ks]), (F.col("ki") + 1).cast("int"))
    out = z.groupBy("ki").agg(F.count(F.lit(1)).alias("n_zones"), F.count_if(F.col("p") > 0).alias("n_hit"),
                              F.avg("luck").alias("base"), F.max("a").alias("max_cells")).join(med, "ki")
    km2 = grid.cell_area / 1e6
    return out.select(kmap.alias("k"), "n_zones", "n_hit", (F.col("n_hit") / F.col("n_zones")).alias("precision"),
                      F.col("base").alias("random_base"),
                      F.try_divide(F.col("n_hit") / F.col("n_zones"), F.col("base")).alias("enrichment"),
                      (F.col("median_cells") * km2).alias("median_km2"), (F.col("max_cells") * km2).alias("max_km2"))


def combine_regions(per_region: DataFrame) -> DataFrame:
    """Sum the numerators of per-region metrics; the baseline is weighted by zones."""
    s = F.sum
    return per_region.groupBy("k").agg(
        F.try_divide(s("captured"), s("n_plants")).alias("recall"), s("captured").alias("captured"),
        F.try_divide(s("n_hit"), s("n_zones")).alias("zone_precision"),
        F.try_divide(s(F.col("random_base") * F.col("n_zones")), s("n_zones")).alias("random_base"),
        s("n_zones").alias("n_zones"), s("n_hit").alias("n_hit"),
        F.try_divide(s("foot_hit"), s("n_top")).alias("area_precision"),
        F.least(F.try_divide(s(F.least("n_foot", "n_top")), s("n_top")), F.lit(1.0)).alias("area_ceiling")).withColumn(
        "enrichment", F.try_divide(F.col("zone_precision"), F.col("random_base")))


def target_contrast(combined: DataFrame) -> DataFrame:
    """Committed targets against the metrics, and whether they could be reached at all."""
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    m = combined.agg(at(3.0, "recall").alias("recall"), at(1.0, "area_precision").alias("precision"),
                     at(1.0, "area_ceiling").alias("ceiling"))
    return m.select(F.explode(F.array(
        F.struct(F.lit("recall_k3").alias("meta"), F.col("recall").alias("valor"), F.lit(TARGET_RECALL_K3).alias("umbral"),
                 F.coalesce(F.col("recall") >= TARGET_RECALL_K3, F.lit(False)).alias("cumple"), F.lit(True).alias("alcanzable")),
        F.struct(F.lit("precision_k1").alias("meta"), F.col("precision").alias("valor"), F.lit(TARGET_PRECISION_K1).alias("umbral"),
                 F.coalesce(F.col("precision") >= TARGET_PRECISION_K1, F.lit(False)).alias("cumple"),
                 F.coalesce(F.col("ceiling") >= TARGET_PRECISION_K1, F.lit(False)).alias("alcanzable")))).alias("t")).select("t.*")


def footprint_ceilings(plants: DataFrame, mw: str, area_km2: float, ha_per_mw: Sequence[float], k: float = 1.0) -> DataFrame:
    """Precision ceiling in the top K % under several land assumptions."""
    total = plants.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(mw, F.lit(0.0))).alias("mw"))
    return total.select("n", "mw", F.explode(F.array(*[F.lit(float(h)) for h in ha_per_mw])).alias("ha_mw")).select(
        "n", "mw", "ha_mw", (F.col("mw") * F.col("ha_mw") / 100.0).alias("huella_km2"),
        F.least(F.lit(100.0), 100.0 * F.col("mw") * F.col("ha_mw") / 100.0 / (area_km2 * k / 100.0)).alias("techo_pct"))


# -- transfer ------------------------------------------------------------------------------------------

def covariate_shift(train: DataFrame, zone: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: both quartile profiles, share outside the training range, mean shift."""
    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).select(
            "e.*").where(F.col("v").isNotNull() & ~F.isnan("v"))

    q = {"p25": 0.25, "mediana": 0.5, "p75": 0.75}
    tr, zo = long(train), long(zone)
    a = summary(tr, "v", by=["feature"], probs=q, std="population")
    a = a.select("feature", *[F.col(c).alias(f"train_{c}") for c in a.columns if c != "feature"])
    b = summary(zo, "v", by=["feature"], probs=q)
    b = b.select("feature", *[F.col(c).alias(f"zone_{c}") for c in b.columns if c != "feature"])
    limits = a.select("feature", "train_min", "train_max")
    # one row per feature
    out = zo.join(F.broadcast(limits), "feature").groupBy("feature").agg(
        (100.0 * F.avg((F.col("v") < F.col("train_min")).cast("double"))).alias("pct_below"),
        (100.0 * F.avg((F.col("v") > F.col("train_max")).cast("double"))).alias("pct_above"))
    return a.join(b, "feature").join(out, "feature").select(
        "*", (F.col("pct_below") + F.col("pct_above")).alias("pct_outside"),
        F.try_divide(F.col("zone_mean") - F.col("train_mean"),
                     F.nullif("train_std", F.lit(0.0))).alias("shift_sd"))


def zone_attributes(plants: DataFrame, valid: DataFrame, mw: str, grid: GridSpec) -> DataFrame:
    area = valid.agg(F.count(F.lit(1)) * F.lit(grid.cell_area / 1e6)).scalar()
    return plants.agg(F.count(F.lit(1)).alias("n_plantas"), F.sum(mw).alias("mw_total")).withColumn("area_km2", area)


def gradient(steps: Mapping[str, DataFrame], k: float = 1.0) -> DataFrame:
    """Recall at K along ordered evaluations with the step in percentage points."""
    from pyspark.sql import Window

    out = None
    for i, (name, df) in enumerate(steps.items()):
        row = df.where(F.col("k") == k).select(F.lit(i).alias("paso"), F.lit(name).alias("nombre"), "recall")
        out = row if out is None else out.unionByName(row)
    order = Window.partitionBy(F.lit(0)).orderBy("paso")  # one row per evaluation
    return out.withColumn("delta_pp", 100.0 * (F.col("recall") - F.lag("recall").over(order)))


def share_comparison(a: DataFrame, b: DataFrame, key: str = "feature", share: str = "pct") -> DataFrame:
    return a.select(key, F.col(share).alias("pct_a")).join(b.select(key, F.col(share).alias("pct_b")), key, "full").select(
        key, F.coalesce("pct_a", F.lit(0.0)).alias("pct_a"), F.coalesce("pct_b", F.lit(0.0)).alias("pct_b")).withColumn(
        "delta_pp", F.col("pct_b") - F.col("pct_a"))


def family_shares(shares: DataFrame, families: Mapping[str, Sequence[str]], by: Sequence[str] = (),
                  share: str = "pct") -> DataFrame:
    """Subtotals per family and the ratio of the first to the second (NULL over zero)."""
    names = list(families)
    out = shares.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(F.col("feature").isin(list(fs)), F.col(share))), F.lit(0.0)).alias(n)
        for n, fs in families.items()])
    return out.withColumn("ratio", F.try_divide(F.col(names[0]), F.nullif(names[1], F.lit(0.0))))


# -- readings -----------------------------------------------------------------------------------------

def gap_reading(gap: Column) -> Column:
    return (F.when(gap < 0.05, "transferencia alta").when(gap < 0.10, "transferencia moderada")
            .otherwise("transferencia baja"))


def correlation_reading(rho: Column) -> Column:
    return F.when(rho.isNull(), "sin datos").when(F.abs(rho) < 0.3, "criterios casi independientes").otherwise(
        "criterios asociados")


def ratio_reading(delta_auc: Column) -> Column:
    return F.when(F.abs(delta_auc) < 0.02, "robusto al ratio").otherwise("sensible al ratio")
