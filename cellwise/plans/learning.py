"""Model studies: training report, sampling designs, leak audit, transfer, applicability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FEATURES
from ..functions.pvalue import p_correlation, p_kendall
from ..operators import aoa as A
from ..operators import forest as FO
from ..operators import sampling as S
from ..operators.grid import GridSpec
from ..operators.infrastructure import EXPERIMENTS, has_map
from ..operators.ranks import auc, average_precision, brier, curve_points, kendall_columns, spearman_matrix, summary
from ..runtime import cut, together
from ..sources.sinks import compare_reports, write_report, write_samples
from .studies import KS, covariate_shift, ratio_reading, topk_metrics, topk_zones

# Macro families of the features.
FAMILY_NETWORK = ("dist_transmision", "dist_subestaciones", "dist_almacen")
FAMILY_RESOURCE = ("ghi", "slope", "northness", "elev")


def assemble(positives: DataFrame, pool: DataFrame, key: str, ratio: int, seed: int) -> DataFrame:
    """Positives and ``ratio`` times as many drawn negatives (fewer if the pool is short)."""
    n = positives.count() * ratio
    drawn = S.draw_rows(pool, key, n, seed)
    return positives.withColumn("clase", F.lit(1)).unionByName(
        drawn.withColumn("clase", F.lit(0)), allowMissingColumns=True)


def holdout_scores(df: DataFrame, key: str, features: Sequence[str], params: Mapping[str, int], seed: int) -> DataFrame:
    """AUC and Brier of a stratified random 70/30 split (context only: it ignores space)."""
    held = held_out(df, key, features, params, seed)[1]
    return held.sparkSession.range(1).select(auc(held, "prob", "clase").scalar().alias("auc"),
                                             brier(held, "prob", "clase").scalar().alias("brier"))


def training_report(positives: DataFrame, pool: DataFrame, key: str, block: str, ratio: int = 3, ratio_alt: int = 10,
                    params: Mapping[str, int] | None = None, features: Sequence[str] = FEATURES, k: int = 5,
                    seed: int = 42) -> DataFrame:
    """One row: class counts, random-split scores at two ratios, spatial validation."""
    params = {**FO.DEFAULTS, **(params or {})}
    data = cut(assemble(positives, pool, key, ratio, seed))
    wide = cut(assemble(positives, pool, key, ratio_alt, seed))
    main = holdout_scores(data, key, features, params, seed)
    alt = holdout_scores(wide, key, features, params, seed)
    cv = FO.cv_summary(FO.spatial_cv(data, features, block, "clase", params, k, seed))
    counts = data.agg(F.count_if(F.col("clase") == 1).alias("n_pos"), F.count_if(F.col("clase") == 0).alias("n_neg"))
    return counts.select("n_pos", "n_neg", main.select(F.struct("*")).scalar().alias("m"),
                         alt.select(F.struct("*")).scalar().alias("a"), cv.select(F.struct("*")).scalar().alias("c")).select(
        "n_pos", "n_neg", F.col("m.auc").alias("auc_split"), F.col("m.brier").alias("brier_split"),
        F.col("a.auc").alias("auc_alt"), F.col("a.brier").alias("brier_alt"), "c.*")


def held_out(df: DataFrame, key: str, features: Sequence[str], params: Mapping[str, int], seed: int) -> tuple:
    """A model of seven tenths of the rows, and ``(clase, prob)`` of the other, stratified three tenths."""
    split = cut(S.stratified_split(df.dropna(subset=list(features)), key, "clase", 0.3, seed))
    model = FO.train(split.where("not is_test"), features, "clase", params, seed)
    return model, cut(FO.score(model, split.where("is_test"), features).select("clase", "prob"))


def train_study(positives: DataFrame, pool: DataFrame, key: str, block: str, ratio: int = 3, ratio_alt: int | None = 10,
                trials: int = 20, space: Mapping[str, tuple[int, int, int]] | None = None, trees: int | None = None,
                features: Sequence[str] = FEATURES, k: int = 5, seed: int = 42, path: str | None = None) -> dict:
    """The whole training run: correlations, search, model of the best parameters, scores of record, another ratio.

    The search and the scores of record (spatial folds) keep blocks whole; the scores of the random split are context only, and the
    model is fitted again on all rows. The model of the other ratio takes the depth and leaf size found, with ``trees`` trees (by default the usual number); it is left out
    without ``ratio_alt``, or if the pool holds no more negatives than the first ratio takes. Returns ``data``, ``correlations``, ``search``,
    ``params``, ``model``, ``importances``, ``folds``, ``curves`` (points of ROC and precision-recall per ratio) and ``metrics`` (one row).
    With ``path`` the samples, model, metrics, importances, curves and correlations are written there; ``tuned_parameters`` reads the
    metrics.
    """
    spark = positives.sparkSession
    data = cut(assemble(positives, pool, key, ratio, seed))
    sizes = data.agg(F.count_if(F.col("clase") == 1).alias("n_pos"), F.count_if(F.col("clase") == 0).alias("n_neg"))
    first = sizes.first()
    if not first["n_pos"] or not first["n_neg"]:
        raise ValueError("training needs positive and negative rows")
    tried = cut(FO.search(data, features, block, trials, "clase", space, k, seed))
    names = list(space or FO.SEARCH_SPACE)
    best = tried.orderBy("brier_mean", *names).first()  # one row per trial
    params = {**FO.DEFAULTS, **{n: int(best[n]) for n in names}}
    other = {**params, "n_estimators": int(trees or FO.DEFAULTS["n_estimators"])}
    wide = cut(assemble(positives, pool, key, ratio_alt, seed)) if ratio_alt not in (None, ratio) else None
    if wide is not None and wide.where("clase = 0").count() <= first["n_neg"]:
        wide = None
    fits = [partial(held_out, data, key, features, params, seed)]
    if wide is not None:
        fits.append(partial(held_out, wide, key, features, other, seed))
    model, (_, held), *alt = together(spark, [partial(FO.train, data, features, "clase", params, seed), *fits])
    folds = cut(FO.spatial_cv(data, features, block, "clase", params, k, seed))
    scores = lambda df: df.sparkSession.range(1).select(F.struct(
        auc(df, "prob", "clase").scalar().alias("auc"), brier(df, "prob", "clase").scalar().alias("brier"),
        average_precision(df, "prob", "clase").scalar().alias("ap"))).scalar()
    nothing = F.lit(None).cast("struct<auc:double,brier:double,ap:double>")
    row = sizes.select("n_pos", "n_neg", FO.cv_summary(folds).select(F.struct("*")).scalar().alias("c"), scores(held).alias("m"),
                       (scores(alt[0][1]) if alt else nothing).alias("a"))
    metrics = cut(row.select(
        "n_pos", "n_neg", F.lit(ratio).alias("ratio"), F.col("c.auc_mean").alias("auc_sbcv"), F.col("c.auc_std").alias("auc_sbcv_std"),
        F.col("c.brier_mean").alias("brier_sbcv"), F.col("m.auc").alias("auc_split"), F.col("m.brier").alias("brier_split"),
        F.col("m.ap").alias("ap_split"), F.lit(ratio_alt if alt else None).cast("int").alias("ratio_alt"), F.col("a.auc").alias("auc_alt"),
        F.col("a.brier").alias("brier_alt"), F.col("a.ap").alias("ap_alt"),
        F.when(F.col("a.auc").isNotNull(), ratio_reading(F.col("a.auc") - F.col("m.auc"))).alias("lectura"),
        F.struct(*[F.lit(v).alias(n) for n, v in params.items()]).alias("best_params")))
    importances = spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())],
                                        "feature string, importance double").orderBy(F.desc("importance"), "feature")
    curves = reduce(DataFrame.unionByName, [curve_points(df, "prob", "clase").select(F.lit(r).alias("ratio"), "threshold", "tpr", "fpr", "precision")
                                            for r, df in [(ratio, held), *((ratio_alt, h) for _, h in alt)]])
    out = {"data": data, "correlations": feature_correlations(data, features), "search": tried, "params": params, "model": model,
           "importances": importances, "folds": folds, "curves": curves, "metrics": metrics}
    if path is not None:
        write_samples(data, f"{path}/samples")
        FO.save(model, f"{path}/model")
        for name in ("metrics", "importances", "correlations"):
            write_report(out[name], f"{path}/{name}")
        curves.write.mode("overwrite").parquet(f"{path}/curves")
    return out


def feature_correlations(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return spearman_matrix(df, list(features))


def design_row(data: DataFrame, key: str, block: str, features: Sequence[str], params: Mapping[str, int], k: int, seed: int) -> DataFrame:
    """Spatial validation and contribution shares of one labelled data set."""
    data = cut(data)
    cv = FO.cv_summary(FO.spatial_cv(data, features, block, "clase", params, k, seed))
    model = FO.train(data, features, "clase", params, seed)
    shares = cut(FO.contribution_shares(FO.contributions(model, data, features, [key]), features))
    net = shares.where(F.col("feature").isin(*FAMILY_NETWORK)).agg(F.sum("pct")).scalar()
    res = shares.where(F.col("feature").isin(*FAMILY_RESOURCE)).agg(F.sum("pct")).scalar()
    vec = shares.agg(F.map_from_entries(F.collect_list(F.struct("feature", "pct")))).scalar()  # one entry per feature
    top = shares.where("place = 1").select("feature").scalar()
    return cv.select("*", net.alias("pct_red"), res.alias("pct_recurso"), F.try_divide(net, F.nullif(res, F.lit(0.0))).alias("ratio"),
                     top.alias("dominante"), vec.alias("shares"))


def design_sensitivity(positives: DataFrame, pools: Mapping[str, DataFrame], key: str, block: str, ratio: int = 3,
                       params: Mapping[str, int] | None = None, features: Sequence[str] = FEATURES, k: int = 5,
                       seed: int = 42) -> DataFrame:
    """One row per pseudo-absence design."""
    params = {**FO.DEFAULTS, **(params or {})}
    def run(name: str) -> DataFrame:
        row = design_row(assemble(positives, pools[name], key, ratio, seed), key, block, features, params, k, seed)
        return cut(row.withColumn("estrategia", F.lit(S.strategy_name(name))))

    return cut(reduce(DataFrame.unionByName, together(positives.sparkSession, [partial(run, n) for n in pools])))


def design_pools(pools: Mapping[str, DataFrame], key: str, n: int, seed: int = 42, features: Sequence[str] = FEATURES) -> DataFrame:
    """Size of each design's pool, and the spread of every feature over the ``n`` negatives drawn from it:
    (estrategia, n_pool, feature, n, min, p25, mediana, p75, max, mean, std)."""
    out = None
    for name, pool in pools.items():
        pool = cut(pool)
        drawn = cut(S.draw_rows(pool, key, n, seed))
        long = drawn.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("s"))
        spread = summary(long.select("s.*").dropna(), "v", ["feature"], {"p25": 0.25, "mediana": 0.5, "p75": 0.75}, "sample")
        row = spread.select(F.lit(S.strategy_name(name)).alias("estrategia"), F.lit(pool.count()).alias("n_pool"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def design_agreement(designs: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rank agreement of contribution shares between every two designs.

    The vectors hold one number per feature, so each pair is one row of fixed width.
    """
    names = [r[0] for r in designs.select("estrategia").orderBy("estrategia").collect()]  # one per design
    later = F.explode(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: n > F.col("a")))
    left = designs.select(F.col("estrategia").alias("a"), F.col("shares").alias("sa"), F.col("dominante").alias("da"))
    right = designs.select(F.col("estrategia").alias("b"), F.col("shares").alias("sb"), F.col("dominante").alias("db"))
    pairs = left.select("*", later.alias("b")).join(right, "b")
    n = len(features)
    va, vb = [F.col("sa")[f] for f in features], [F.col("sb")[f] for f in features]
    pairs = pairs.withColumn("tau", kendall_columns(va, vb))

    def ranks(v):
        return [sum(((o < x).cast("double") + (o == x).cast("double") / 2.0 for o in v), F.lit(0.5)) for x in v]

    mid = (n + 1) / 2.0
    ra, rb = ranks(va), ranks(vb)
    dot = sum(((p - mid) * (q - mid) for p, q in zip(ra, rb)), F.lit(0.0))
    na = sum(((p - mid) * (p - mid) for p in ra), F.lit(0.0))
    nb = sum(((q - mid) * (q - mid) for q in rb), F.lit(0.0))
    pairs = pairs.withColumn("rho", F.try_divide(dot, F.sqrt(na * nb)))
    return pairs.select("a", "b", "tau", p_kendall(F.array(*va), F.array(*vb)).alias("p_tau"), "rho",
                        F.when(F.col("rho").isNotNull(), p_correlation("rho", F.lit(float(n)))).alias("p_rho"),
                        (F.col("da") == F.col("db")).alias("misma_dominante"))


def leak_audit(samples: DataFrame, wide: DataFrame, key: str, block: str, region: str,
               experiments: Sequence[str] = tuple(EXPERIMENTS), params: Mapping[str, int] | None = None, k: int = 5,
               seed: int = 42) -> DataFrame:
    """Per audit experiment: spatial validation, leave-one-region-out, single-distance AUC, and what the model rests on.

    ``shares`` and ``places`` map each feature to its share of the contributions and its place, ``importances`` to its mean
    importance over the folds, ``loro`` each region held out to its AUC; ``has_map`` says whether the experiment has one map. ``wide``
    holds ``(experiment, key, dist_...)``; the other features come from ``samples``. Experiments are fitted side by side.
    """
    params = {**FO.DEFAULTS, **(params or {})}
    dists = ["dist_subestaciones", "dist_transmision", "dist_almacen"]
    base, wide = samples.drop(*dists), cut(wide)

    def run(name: str) -> DataFrame:
        data = cut(base.join(wide.where(F.col("experiment") == name).drop("experiment"), key))
        folds = FO.spatial_cv(data, FEATURES, block, "clase", params, k, seed)
        regions = cut(FO.leave_one_region_out(data, FEATURES, region, "clase", params, seed))
        model = FO.train(data, FEATURES, "clase", params, seed)
        shares = cut(FO.contribution_shares(FO.contributions(model, data, FEATURES, [key]), FEATURES))
        family = lambda names: shares.where(F.col("feature").isin(*names)).agg(F.sum("pct")).scalar()
        entries = lambda df, a, b: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(a, b))))).scalar()
        infra = [f for f in FEATURES if f in dists]
        row = FO.cv_summary(folds).select(
            F.lit(name).alias("experimento"), F.lit(has_map(name)).alias("has_map"), F.lit(data.count()).alias("n"), "auc_mean", "auc_std", "brier_mean",
            FO.region_gap(regions).select(F.struct("*")).scalar().alias("l"),
            entries(regions.withColumn(region, F.col(region).cast("string")), region, "auc").alias("loro"),
            *[auc(data.withColumn("_near", -F.col(d)), "_near", "clase").scalar().alias(f"auc_{d}") for d in dists],
            entries(FO.importance_summary(folds), "feature", "importance_mean").alias("importances"),
            entries(shares, "feature", "pct").alias("shares"), entries(shares, "feature", "place").alias("places"),
            family(infra).alias("pct_infraestructura"), family(FAMILY_NETWORK).alias("pct_red"), family(FAMILY_RESOURCE).alias("pct_recurso"))
        return cut(row.select("experimento", "has_map", "n", "auc_mean", "auc_std", "brier_mean", F.col("l.auc_mean").alias("loro_auc"),
                              F.col("l.gap").alias("loro_gap"), *row.columns[7:]))

    rows = together(samples.sparkSession, [partial(run, name) for name in experiments])
    return reduce(DataFrame.unionByName, rows)


def audit_maps(samples: DataFrame, wide: DataFrame, cells: DataFrame, cell_features: Mapping[str, DataFrame], key: str,
               params: Mapping[str, int] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Score maps ``(r, c, prob)`` of the experiments that have one (dated variants depend on each sample).

    ``cell_features`` gives, per experiment, the distances ``(r, c, dist_...)`` of the cells; the other features come from ``cells``.
    """
    params = {**FO.DEFAULTS, **(params or {})}
    dists = ["dist_subestaciones", "dist_transmision", "dist_almacen"]
    names = [n for n in cell_features if has_map(n)]
    wide = cut(wide.where(F.col("experiment").isin(*names)))  # a fit passes over its rows several times

    def run(name: str) -> DataFrame:
        data = cut(samples.drop(*dists).join(wide.where(F.col("experiment") == name).drop("experiment"), key))
        model = FO.train(data, FEATURES, "clase", params, seed)
        return cut(FO.score(model, cells.drop(*dists).join(cell_features[name], ["r", "c"]), FEATURES).select("r", "c", "prob"))

    return dict(zip(names, together(samples.sparkSession, [partial(run, n) for n in names])))


def region_maps(cells: DataFrame, train_rows: DataFrame, grid: GridSpec, region: str, regions: Sequence, features: Sequence[str],
                params: Mapping[str, int], ks: Sequence[float] = KS, hold_out: bool = True, seed: int = 42) -> DataFrame:
    """Top-K metrics of every region's own map, from a model trained without it.

    ``cells`` carry ``region, n_plants, in_foot`` and the features; with
    ``hold_out=False`` one model on all rows is used (in-sample map).
    """
    out = None
    shared = None if hold_out else FO.train(train_rows, features, "clase", params, seed)
    for name in regions:
        model = shared or FO.train(train_rows.where(F.col(region) != F.lit(name)), features, "clase", params, seed)
        scored = cut(FO.score(model, cells.where(F.col(region) == F.lit(name)), features, "p").select(
            "r", "c", "n_plants", "in_foot", "p"))
        m = topk_metrics(scored, "p", ks).join(
            topk_zones(scored, "p", grid, ks).select("k", "n_zones", "n_hit", "random_base"), "k")
        m = m.withColumn(region, F.lit(name))
        out = m if out is None else out.unionByName(m)
    return cut(out)


def transfer(model, train_rows: DataFrame, zone_cells: DataFrame, grid: GridSpec, key: str, features: Sequence[str],
             ks: Sequence[float] = KS) -> dict[str, DataFrame]:
    """Another zone scored without refit: top-K, covariate shift, applicability."""
    scored = cut(FO.score(model, zone_cells, features, "p"))
    weights = dict(zip(features, (float(v) for v in model.featureImportances.toArray())))
    space = A.fit(train_rows, features, key, weights)
    di = cut(A.dissimilarity(space, zone_cells, key))
    flagged = scored.join(di, key).where(F.col("n_plants") > 0)
    plants = flagged.agg(F.coalesce(F.sum("n_plants"), F.lit(0)).alias("n_plantas"),
                         F.coalesce(F.sum(F.when(F.col("inside"), F.col("n_plants"))), F.lit(0)).alias("n_dentro"))
    return {"topk": topk_metrics(scored, "p", ks), "zones": topk_zones(scored, "p", grid, ks),
            "shift": covariate_shift(train_rows, zone_cells, list(features)), "aoa": A.zone_report(di), "plants": plants}


def transfer_sensitivity(model, train_rows: DataFrame, exact: DataFrame, compound: DataFrame, grid: GridSpec, key: str,
                         features: Sequence[str], ks: Sequence[float] = KS) -> dict[str, DataFrame]:
    """A zone evaluated with features from the exact region filter and again from the compound one, and what changes.

    ``delta`` holds a row per K and metric: both values and the difference.
    """
    first, second = together(train_rows.sparkSession, [partial(transfer, model, train_rows, zone, grid, key, features, ks) for zone in (exact, compound)])
    metrics = ["threshold", "n_top", "captured", "recall", "n_zones", "n_hit", "precision", "random_base"]

    def long(part: dict[str, DataFrame]) -> DataFrame:
        both = part["topk"].join(part["zones"], "k")
        return both.select("k", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("k", "m.*")

    return {"exact": first, "compound": second, "delta": compare_reports(long(first), long(second), ["k", "metric"])}


def spatial_scenarios(train_rows: DataFrame, zone_cells: DataFrame, other_cells: DataFrame, region: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(train, zone) pairs of the applicability study: all rows against the zone's own cells, each region's cells against rows of the
    other regions, and another zone. Regions are few by nature."""
    names = [r[0] for r in train_rows.select(region).distinct().orderBy(region).collect()]
    return {"in_sample": (train_rows, zone_cells),
            **{f"loro_{n}": (train_rows.where(F.col(region) != F.lit(n)), zone_cells.where(F.col(region) == F.lit(n))) for n in names},
            "transferencia": (train_rows, other_cells)}


def applicability_scenarios(scenarios: Mapping[str, tuple[DataFrame, DataFrame]], key: str, features: Sequence[str],
                            weights: Mapping[str, float] | None = None, group: str | None = None) -> DataFrame:
    """Share inside the area of applicability for (train, zone) pairs. Pairs with the same training table share its fit."""
    tables = {id(tr): tr for tr, _ in scenarios.values()}
    spark = next(iter(tables.values())).sparkSession
    fits = dict(zip(tables, together(spark, [partial(A.fit, tr, features, key, weights, group) for tr in tables.values()])))

    def run(name: str) -> DataFrame:
        tr, zone = scenarios[name]
        fit = fits[id(tr)]
        scored = cut(A.dissimilarity(fit, zone, key))  # read by counts and order statistics
        return cut(A.zone_report(scored).select(
            F.lit(name).alias("escenario"), F.lit(fit.threshold).alias("umbral"), "n_cells", "n_inside", "pct_inside"))

    return reduce(DataFrame.unionByName, together(spark, [partial(run, n) for n in scenarios]))
