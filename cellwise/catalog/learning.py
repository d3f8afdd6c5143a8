"""Forests, applicability, contributions and judgement weights."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import ahp as H
from ..operators import aoa as A
from ..operators import forest as FO
from ..operators import infrastructure as I
from ..operators import sampling as S
from ..plans import learning as L
from ..plans import studies as P
from .base import M, Inputs, query, rounded
from .statistics import DESIGN_VECTORS, design_vectors

PARAMS = {"n_estimators": 8, "max_depth": 5, "min_samples_leaf": 4}
FEATURES = K.FEATURES


def samples(t: Inputs):
    """Cells with the seven features, a noisy siting label, a block and a region."""
    cid = F.col("r") * 100 + F.col("c")
    good = (F.col("ghi") >= 220) & (F.col("slope") < 18) & (F.col("elev") < 3500)
    noise = K.draw(cid, 5) % 12 == 0
    away = lambda r, c: F.sqrt((F.col("r") - r) ** 2 + (F.col("c") - c) ** 2) * 1000.0
    return t.centred.select(
        cid.alias("cell"), "r", "c", "x", "y", "ghi", "slope", "elev", K.northness("aspect").alias("northness"),
        (F.abs(F.col("c") - 37) * 1000.0).alias("dist_transmision"), away(20, 70).alias("dist_almacen"), away(5, 15).alias("dist_subestaciones"),
        (good != noise).cast("int").alias("clase"), F.expr("c div 34").alias("region"), "yld",
        K.block_number("x", "y", 15000.0).alias("block"))


SAMPLES = f""", smp AS (SELECT r*100+c AS cell, r, c, c//34 AS region, (floor(x/15000.0)*1000003+floor(y/15000.0))::BIGINT AS block,
 ((ghi>=220 AND slope<18 AND elev<3500) <> ({K.draw_sql('r*100+c', 5)} % 12 = 0))::INT AS clase FROM centred)"""


# -- applicability ------------------------------------------------------------------------

W = {"f1": 0.3, "f2": 0.2, "f3": 0.15, "f4": 0.1, "f5": 0.1, "f6": 0.1, "f7": 0.05}
SPACE = list(W)


def _aoa_sql(sets: str, other: str) -> str:
    """Applicability of every scenario s, from training rows tr(s, vec_id, label, f...) and zone rows zo(s, vec_id, f...)."""
    far = "min(sqrt(" + "+".join(f"(p.{f}-q.{f})**2" for f in SPACE) + "))"
    scaled = ", ".join(f"(r.{f}-st.m_{f})/st.s_{f}*sqrt({W[f]}::DOUBLE) AS {f}" for f in SPACE)
    return f""", {sets},
st AS (SELECT s, {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in SPACE)} FROM tr GROUP BY s),
wt AS (SELECT r.s, r.vec_id, r.label, {scaled} FROM tr r JOIN st USING (s)), wz AS (SELECT r.s, r.vec_id, {scaled} FROM zo r JOIN st USING (s)),
d AS (SELECT p.s, p.vec_id, {far} AS d FROM wt p JOIN wt q ON p.s=q.s AND {other} GROUP BY ALL),
mus AS (SELECT s, avg(d) AS mu FROM d GROUP BY s), dis AS (SELECT d.s, d/mu AS di FROM d JOIN mus USING (s)),
ths AS (SELECT s, quantile_cont(di,0.75)+1.5*(quantile_cont(di,0.75)-quantile_cont(di,0.25)) AS t FROM dis GROUP BY s),
zs AS (SELECT p.s, p.vec_id, {far}/any_value(mu) AS di FROM wz p JOIN wt q ON p.s=q.s JOIN mus ON mus.s=p.s GROUP BY ALL),
mu AS (SELECT mu FROM mus WHERE s=''), di AS (SELECT di FROM dis WHERE s=''), th AS (SELECT t FROM ths WHERE s=''), z AS (SELECT vec_id, di FROM zs WHERE s='')"""


_ROWS = f"vec_id, label, {', '.join(SPACE)} FROM space"
ONE = f"tr AS (SELECT '' AS s, {_ROWS} WHERE is_train), zo AS (SELECT '' AS s, {_ROWS} WHERE NOT is_train)"
FIT = f""" SELECT (SELECT {M('mu')} FROM mu) AS mean_distance, (SELECT {M('t')} FROM th) AS threshold, count(*) AS n, {M('min(di)')} AS min, {M('avg(di)')} AS mean,
 {M('quantile_cont(di,0.25)')} AS di_q25, {M('quantile_cont(di,0.5)')} AS di_mediana, {M('quantile_cont(di,0.75)')} AS di_q75, {M('max(di)')} AS max FROM di"""
SCENARIOS = f"""l AS (SELECT DISTINCT label AS h FROM space WHERE is_train),
tr AS (SELECT unnest(['in_sample', 'transferencia']) AS s, {_ROWS} WHERE is_train UNION ALL SELECT 'loro_'||h, {_ROWS}, l WHERE is_train AND label<>h),
zo AS (SELECT 'in_sample' AS s, {_ROWS} UNION ALL SELECT 'transferencia', {_ROWS} WHERE NOT is_train UNION ALL SELECT 'loro_'||h, {_ROWS}, l WHERE label=h)"""


def _fit(t: Inputs, group=None):
    return A.fit(t.space.where("is_train"), SPACE, "vec_id", W, group)


def _fit_row(f):
    return rounded(f.stats.select(F.lit(f.mean_distance).alias("mean_distance"), F.lit(f.threshold).alias("threshold"), "*"))


@query("aoa_fit", _aoa_sql(ONE, "p.vec_id<>q.vec_id") + FIT)
def aoa_fit(t: Inputs):
    return _fit_row(_fit(t))


@query("aoa_fit_blocks", _aoa_sql(ONE, "p.label<>q.label") + FIT)
def aoa_fit_blocks(t: Inputs):
    return _fit_row(_fit(t, "label"))


@query("aoa_score", _aoa_sql(ONE, "p.vec_id<>q.vec_id") + f" SELECT vec_id, {M('di')} AS di, di <= t AS inside FROM z, th")
def aoa_score(t: Inputs):
    return rounded(A.dissimilarity(_fit(t), t.space.where("not is_train"), "vec_id"))


@query("aoa_zone", _aoa_sql(ONE, "p.vec_id<>q.vec_id") + f""" SELECT count(*) AS n_cells, count(*) FILTER (di<=t) AS n_inside, count(*) FILTER (di>t) AS n_outside,
 {M('100.0*count(*) FILTER (di<=t)/count(*)')} AS pct_inside, {M('100.0*count(*) FILTER (di>t)/count(*)')} AS pct_outside, {M('min(di)')} AS min, {M('avg(di)')} AS mean,
 {M('quantile_cont(di,0.25)')} AS p25, {M('quantile_cont(di,0.5)')} AS p50, {M('quantile_cont(di,0.75)')} AS p75, {M('quantile_cont(di,0.95)')} AS p95, {M('max(di)')} AS max, {M('stddev_pop(di)')} AS std FROM z, th""")
def aoa_zone(t: Inputs):
    from ..runtime import cut

    return rounded(A.zone_report(cut(A.dissimilarity(_fit(t), t.space.where("not is_train"), "vec_id"))))


@query("aoa_scenarios", _aoa_sql(SCENARIOS, "p.vec_id<>q.vec_id") + f""" SELECT s AS escenario, {M('any_value(t)')} AS umbral, count(*) AS n_cells, count(*) FILTER (di<=t) AS n_inside,
 {M('100.0*count(*) FILTER (di<=t)/count(*)')} AS pct_inside FROM zs JOIN ths USING (s) GROUP BY s""")
def aoa_scenarios(t: Inputs):
    # the zone grid is the whole table: all rows in the model's own zone, each label against the others, and other labels
    pairs = L.spatial_scenarios(t.space.where("is_train"), t.space, t.space.where("not is_train"), "label")
    return rounded(L.applicability_scenarios(pairs, "vec_id", SPACE, W))


# -- judgement matrices ----------------------------------------------------------------------

AHPQ = """, w AS (SELECT region_id%5 AS prof, region_id//5 AS i, sum(mw) AS s FROM sites GROUP BY 1,2)"""


@query("ahp_weights", AHPQ + f""" SELECT 'p'||prof AS profile, i::INT AS i, {M('s/sum(s) OVER (PARTITION BY prof)')} AS weight, {M('count(*) OVER (PARTITION BY prof)')} AS lambda_max,
 0.0::DOUBLE AS cr, true AS consistent FROM w""")
def ahp_weights(t: Inputs):
    w = t.sites.groupBy((F.col("region_id") % 5).alias("prof"), F.expr("region_id div 5").cast("int").alias("i")).agg(F.sum("mw").alias("s"))
    # consistent judgements: the ratio of the criteria's totals, five criteria per profile
    j = w.join(w.select("prof", F.col("i").alias("j"), F.col("s").alias("t")), "prof").select(
        F.concat(F.lit("p"), F.col("prof").cast("string")).alias("profile"), "i", "j", (F.col("s") / F.col("t")).alias("value"))
    out = rounded(H.ahp_weights(j).drop("ci", "ri"), "weight", "lambda_max", "cr")
    return out.withColumn("cr", F.abs("cr") + 0.0)


_JUDGED = """, m AS (SELECT n_nationkey AS z, 1.0::DOUBLE + n_nationkey % 5 AS a, 1.0::DOUBLE/(1 + n_nationkey % 4) AS b, 2.0::DOUBLE + n_nationkey % 3 AS g FROM nation),
it AS (SELECT z, 0 AS k, 1/3.0::DOUBLE AS u, 1/3.0::DOUBLE AS v, 1/3.0::DOUBLE AS w FROM m UNION ALL
 SELECT z, k+1, (u+a*v+b*w)/s, (u/a+v+g*w)/s, (u/b+v/g+w)/s FROM (SELECT *, u+a*v+b*w+u/a+v+g*w+u/b+v/g+w AS s FROM it JOIN m USING (z) WHERE k<200)),
e AS (SELECT *, (u+a*v+b*w)/u AS lam FROM it JOIN m USING (z) WHERE k=200)"""


@query("ahp_inconsistent", _JUDGED + f""" SELECT z AS zone_id, {M('u')} AS w0, {M('v')} AS w1, {M('w')} AS w2, {M('lam')} AS lambda_max, {M('(lam-3)/2/0.58')} AS cr,
 (lam-3)/2/0.58 < 0.1 AS consistent FROM e""", recursive=True)
def ahp_inconsistent(t: Inputs):
    k = F.col("n_nationkey")
    a, b, g, one = F.lit(1.0) + k % 5, F.lit(1.0) / (1 + k % 4), F.lit(2.0) + k % 3, F.lit(1.0)
    m = [[one, a, b], [1 / a, one, g], [1 / b, 1 / g, one]]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), m[i][j].alias("value")) for i in range(3) for j in range(3)]))
    got = H.ahp_weights(t.table("nation").select(k.cast("string").alias("profile"), cells.alias("s")).select("profile", "s.*"))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("weight"))).alias(f"w{i}")
    return rounded(got.groupBy(F.col("profile").cast("int").alias("zone_id")).agg(
        at(0), at(1), at(2), F.max("lambda_max").alias("lambda_max"), F.max("cr").alias("cr"), F.every("consistent").alias("consistent")))


@query("ahp_or_direct_weights", AHPQ + f""", a AS (SELECT 'p'||prof AS profile, 'c'||i AS criterion, s/sum(s) OVER (PARTITION BY prof) AS weight FROM w WHERE prof<3),
d AS (SELECT DISTINCT 'p'||prof AS profile, 'c'||i AS criterion, 0.2::DOUBLE AS weight FROM w)
SELECT d.profile, d.criterion, {M('coalesce(a.weight, d.weight)')} AS weight FROM d LEFT JOIN a USING (profile, criterion)""")
def ahp_or_direct_weights(t: Inputs):
    from pyspark.sql import Window

    w = t.sites.groupBy((F.col("region_id") % 5).alias("prof"), F.expr("region_id div 5").alias("i")).agg(F.sum("mw").alias("s"))
    named = w.select("prof", F.concat(F.lit("p"), F.col("prof").cast("string")).alias("profile"), F.concat(F.lit("c"), F.col("i").cast("string")).alias("criterion"),
                     (F.col("s") / F.sum("s").over(Window.partitionBy("prof"))).alias("weight"))
    return rounded(H.resolve_weights(named.where("prof < 3").drop("prof"), named.select("profile", "criterion", F.lit(0.2).alias("weight"))))


# -- forests -----------------------------------------------------------------------------------

@query("rf_score")
def rf_score(t: Inputs):
    s = samples(t)
    return FO.score(FO.train(s, FEATURES, "clase", PARAMS), s, FEATURES).select("cell", "clase", "prob")


@query("rf_score_range", SAMPLES + " SELECT count(*) AS n, 0::BIGINT AS out_of_range, true AS better_than_chance FROM smp")
def rf_score_range(t: Inputs):
    from ..operators.ranks import auc
    from ..runtime import cut

    p = cut(rf_score(t))
    a = auc(p, "prob", "clase").scalar()
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("prob").between(0, 1)).alias("out_of_range")).withColumn(
        "better_than_chance", a > 0.6)


_FOLDS = SAMPLES + """, b AS (SELECT block, count(*) FILTER (clase=1) AS p, count(*) AS n FROM smp GROUP BY 1),
o AS (SELECT block, p, n, (row_number() OVER (ORDER BY p DESC, n DESC, block)-1)%6 AS st FROM b)
SELECT (CASE WHEN st<3 THEN st ELSE 5-st END)::INT AS fold, sum(n)::BIGINT AS n_test, sum(p)::BIGINT AS n_pos FROM o GROUP BY 1"""


@query("sbcv")
def sbcv(t: Inputs):
    return FO.spatial_cv(samples(t), FEATURES, "block", "clase", PARAMS, 3).drop("importances")


@query("sbcv_folds", _FOLDS)
def sbcv_folds(t: Inputs):
    return S.group_folds(samples(t), "block", "clase", 3).groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("clase").alias("n_pos"))


@query("sbcv_importances")
def sbcv_importances(t: Inputs):
    return FO.importance_summary(FO.spatial_cv(samples(t), FEATURES, "block", "clase", PARAMS, 2))


@query("lorocv")
def lorocv(t: Inputs):
    return FO.leave_one_region_out(samples(t), FEATURES, "region", "clase", PARAMS).drop("importances")


@query("hyper_search")
def hyper_search(t: Inputs):
    space = {"n_estimators": (4, 8, 4), "max_depth": (3, 5, 2), "min_samples_leaf": (2, 6, 4)}
    return FO.search(samples(t), FEATURES, "block", 3, "clase", space, 2)


@query("ablation")
def ablation(t: Inputs):
    return FO.ablation(samples(t), "block", None, "clase", PARAMS, 2)


_SEVEN = SAMPLES.replace(", smp AS (SELECT ", """, smp AS (SELECT ghi, slope, elev, cos(radians(aspect)) AS northness, abs(c-37)*1000.0::DOUBLE AS dist_transmision,
 sqrt((r-20)**2+(c-70)**2)*1000.0::DOUBLE AS dist_almacen, sqrt((r-5)**2+(c-15)**2)*1000.0::DOUBLE AS dist_subestaciones, """)


@query("feature_correlations", _SEVEN + ", k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {v})+(count(*) OVER (PARTITION BY {v})-1)/2.0 AS {v}" for v in FEATURES) + " FROM smp) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, floor(corr({a},{b})*1e3+0.5)/1e3 AS rho FROM k" for a in FEATURES for b in FEATURES))
def feature_correlations(t: Inputs):
    # three decimals: equal cosines of different angles may differ in the last bit between engines
    c = L.feature_correlations(samples(t), FEATURES)
    return c.withColumn("rho", F.floor(F.col("rho") * 1e3 + 0.5) / F.lit(1e3))


@query("contributions")
def contributions(t: Inputs):
    s = samples(t)
    return FO.contributions(FO.train(s, FEATURES, "clase", PARAMS), s, FEATURES, ["cell"])


@query("contributions_add_up", SAMPLES + " SELECT count(*) AS n, 0::BIGINT AS n_off FROM smp")
def contributions_add_up(t: Inputs):
    s = samples(t)
    m = FO.train(s, FEATURES, "clase", PARAMS)
    phi = FO.contributions(m, FO.score(m, s, FEATURES), FEATURES, ["cell", "prob"])
    off = F.abs(F.col("prob") - F.col("base") - K.add(F.col(f"phi_{f}") for f in FEATURES)) > 1e-9
    return phi.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("n_off"))


@query("contribution_shares")
def contribution_shares(t: Inputs):
    return FO.contribution_shares(contributions(t), FEATURES)


@query("dominant_feature_map")
def dominant_feature_map(t: Inputs):
    return FO.dominant(contributions(t), FEATURES).select("cell", "dominante")


@query("dominant_summary")
def dominant_summary(t: Inputs):
    return FO.dominant_summary(contributions(t), FEATURES)


@query("score_yield_correlation")
def score_yield_correlation(t: Inputs):
    s = samples(t)
    return P.score_yield_rows(FO.score(FO.train(s, FEATURES, "clase", PARAMS), s, FEATURES), "prob", "yld", "ghi", 0.7)


@query("irradiance_yield_correlation", f""", k AS (SELECT rank() OVER (ORDER BY ghi)+(count(*) OVER (PARTITION BY ghi)-1)/2.0 AS a,
 rank() OVER (ORDER BY yld)+(count(*) OVER (PARTITION BY yld)-1)/2.0 AS b FROM cells WHERE yld>0), r AS (SELECT count(*) AS n, corr(a,b) AS rho FROM k)
SELECT n, {M('rho')} AS rho, CASE WHEN abs(rho)<0.3 THEN 'criterios casi independientes' ELSE 'criterios asociados' END AS lectura FROM r""")
def irradiance_yield_correlation(t: Inputs):
    rows = P.score_yield_rows(t.cells, "prob", "yld", "ghi", 0.7).where("ambito = 'irradiancia'")
    return rounded(rows.select("n", "rho", "lectura"))


# -- studies --------------------------------------------------------------------------------------

@query("training_report")
def training_report(t: Inputs):
    s = samples(t)
    pos = s.where("clase = 1").drop("clase")
    return L.training_report(pos, s.where("clase = 0").drop("clase"), "cell", "block", 3, 5, PARAMS, k=2)


def _train_study(t: Inputs):
    s = samples(t)
    space = {"n_estimators": (4, 8, 4), "max_depth": (3, 5, 2), "min_samples_leaf": (2, 6, 4)}
    return L.train_study(s.where("clase = 1").drop("clase"), s.where("clase = 0").drop("clase"), "cell", "block", 1, 2, 3, space, 8, k=2)


@query("train_study")
def train_study(t: Inputs):
    return _train_study(t)["metrics"]


@query("train_study_checks", SAMPLES + """, n AS (SELECT count(*) FILTER (clase=1) AS p, count(*) FILTER (clase=0) AS q FROM smp)
SELECT p AS n_pos, least(p, q) AS n_neg, 49::BIGINT AS n_pairs, 7::BIGINT AS n_features, true AS best_first, true AS rates_in_range, true AS reading_fits,
 true AS curve_gives_auc FROM n""")
def train_study_checks(t: Inputs):
    out = _train_study(t)
    m = out["metrics"]
    rates = [c for c in m.columns if c.startswith(("auc", "brier", "ap"))]
    inside = F.forall(F.filter(F.array(*rates), lambda v: v.isNotNull()), lambda v: v.between(0, 1))
    fits = F.coalesce((F.col("lectura") == "robusto al ratio") == (F.abs(F.col("auc_alt") - F.col("auc_split")) < 0.02), F.col("auc_alt").isNull())
    by_area = Window.partitionBy("ratio").orderBy(F.desc("threshold"))  # one row per distinct score of a few trees
    before = lambda c: F.coalesce(F.lag(c).over(by_area), F.lit(0.0))
    area = out["curves"].where("ratio = 1").select(((F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2).alias("a")).agg(F.sum("a")).scalar()
    best = out["search"].agg(F.min("brier_mean")).scalar()
    chosen = out["search"].where(reduce(and_, [F.col(n) == v for n, v in out["params"].items()])).select("brier_mean").scalar()
    return m.select("n_pos", "n_neg", out["correlations"].agg(F.count(F.lit(1))).scalar().alias("n_pairs"),
                    out["importances"].agg(F.count(F.lit(1))).scalar().alias("n_features"), (best == chosen).alias("best_first"),
                    inside.alias("rates_in_range"), fits.alias("reading_fits"), (F.abs(area - F.col("auc_split")) < 1e-9).alias("curve_gives_auc"))


def _design_pools(t: Inputs):
    s = samples(t).where("clase = 0").drop("clase").withColumn("crit", F.col("dist_subestaciones"))
    crit = {"ghi_min": 160.0, "slope_max": 25.0, "elev_max": 3900.0, "dist_max": 60000.0}
    return {n: S.negatives(s.where("crit <= 30000") if n == "grupo_objetivo" else s, n, crit, "crit").drop("crit", "clase")
            for n in S.STRATEGIES}


def _designs(t: Inputs):
    pos = samples(t).where("clase = 1").drop("clase")
    return L.design_sensitivity(pos, _design_pools(t), "cell", "block", 3, PARAMS, k=2)


@query("design_sensitivity")
def design_sensitivity(t: Inputs):
    return _designs(t).drop("shares")


_POOL = """, cand AS (SELECT * FROM smp WHERE clase=0), pools AS (SELECT 'ahp_filtrado' AS estrategia, * FROM cand WHERE ghi>=160 AND slope<=25 AND elev<=3900 AND dist_subestaciones<=60000
 UNION ALL SELECT 'fondo_aleatorio', * FROM cand UNION ALL SELECT 'sin_filtros_geofisicos', * FROM cand WHERE dist_subestaciones<=60000
 UNION ALL SELECT 'grupo_objetivo', * FROM cand WHERE dist_subestaciones<=30000)"""


@query("design_pool_sizes", _SEVEN + _POOL + """ SELECT estrategia, count(*) AS n_pool, 7::BIGINT AS n_features FROM pools GROUP BY 1""")
def design_pool_sizes(t: Inputs):
    rows = L.design_pools(_design_pools(t), "cell", 100)
    return rows.groupBy("estrategia").agg(F.max("n_pool").alias("n_pool"), F.count_distinct("feature").alias("n_features"))


@query("design_negatives")
def design_negatives(t: Inputs):
    pos = samples(t).where("clase = 1").count()
    return L.design_pools(_design_pools(t), "cell", 3 * pos)


@query("design_negatives_whole", _SEVEN + _POOL + ", long AS (" + " UNION ALL ".join(f"SELECT estrategia, '{f}' AS feature, {f}::DOUBLE AS v FROM pools" for f in FEATURES) + f""")
SELECT estrategia, feature, count(*) AS n, {M('min(v)')} AS min, {M('quantile_cont(v,0.25)')} AS p25, {M('quantile_cont(v,0.5)')} AS mediana,
 {M('quantile_cont(v,0.75)')} AS p75, {M('max(v)')} AS max, floor(avg(v)*1e3+0.5)/1e3 AS mean, floor(stddev_samp(v)*1e3+0.5)/1e3 AS std FROM long GROUP BY 1,2""")
def design_negatives_whole(t: Inputs):
    # as many negatives as the pools hold: the draw is the pool, so the spread is known
    rows = L.design_pools(_design_pools(t), "cell", t.cells.count()).drop("n_pool")
    return rounded(rows, "min", "p25", "mediana", "p75", "max").withColumns(
        {c: F.floor(F.col(c) * 1e3 + 0.5) / F.lit(1e3) for c in ("mean", "std")})


_P_SQL = DESIGN_VECTORS + f""", orders AS (SELECT m % 2 + m//2 % 3 + m//6 % 4 + m//24 % 5 + m//120 % 6 + m//720 % 7 AS inversions FROM range(5040) t(m)),
z AS (SELECT d1, d2, sum(p*q) AS score, sum(p*q)/sqrt(sum(p*p)*sum(q*q)) AS tau FROM s GROUP BY 1,2),
k AS (SELECT d1, d2, list_transform(wa, lambda x: len(list_filter(wa, lambda y: y < x))) AS ra, list_transform(wb, lambda x: len(list_filter(wb, lambda y: y < x))) AS rb,
 list_position(wa, list_max(wa)) = list_position(wb, list_max(wb)) AS misma_dominante FROM pairs),
h AS (SELECT d1, d2, misma_dominante, 1 - 6.0*list_sum(list_transform(range(1,8), lambda i: (ra[i]-rb[i])**2))/336 AS rho FROM k),
g AS (SELECT *, atan(rho/sqrt(1-rho*rho)) AS angle FROM h)
SELECT d1::VARCHAR AS a, d2::VARCHAR AS b, {M('tau')} AS tau, {M('least(1.0, 2.0*(SELECT count(*) FROM orders WHERE 2*inversions <= 21-abs(score))/5040)')} AS p_tau, {M('rho')} AS rho,
 {M('CASE WHEN abs(rho)=1 THEN 0.0 ELSE 1-2/pi()*(abs(angle)+sin(abs(angle))*(cos(angle)+2.0/3*cos(angle)**3)) END')} AS p_rho, misma_dominante
FROM z JOIN g USING (d1, d2)"""


@query("design_agreement_p", _P_SQL)
def design_agreement_p(t: Inputs):
    # seven distinct numbers per design: both p values have a closed form to hold them against
    return rounded(L.design_agreement(design_vectors(t), [f"w{i}" for i in range(7)]))


@query("design_agreement")
def design_agreement(t: Inputs):
    return L.design_agreement(_designs(t))


def _audit(t: Inputs):
    k = F.col("site_id")
    s = t.sites.select(
        k, "x", "y", "f_ref", (F.lit(140.0) + (k * 29) % 160).alias("ghi"), (((k * 31) % 300) / 10.0).alias("slope"),
        (F.lit(100.0) + (k * 211) % 4200).alias("elev"), K.northness((k * 37) % 360).alias("northness"),
        F.col("is_pos").cast("int").alias("clase"), (F.col("region_id") % 2).alias("region"), K.block_number("x", "y", 60000.0).alias("block"))
    layers = {"subestaciones": (t.infra, "infra_id", "point"), "lineas": (t.lines, "line_id", "segment"),
              "almacenamiento": (t.infra.where("tipo <> 'ZONAL'"), "infra_id", "point")}
    return s, I.experiment_features(I.distance_table(s, layers, "site_id", "f_ref"), "site_id")


@query("leak_audit")
def leak_audit(t: Inputs):
    s, wide = _audit(t)
    return L.leak_audit(s, wide, "site_id", "block", "region", params=PARAMS, k=2)


@query("leak_audit_checks", " SELECT unnest([" + ", ".join(f"'{e}'" for e in I.EXPERIMENTS) + "]) AS experimento, unnest([" + ", ".join(
    str(I.has_map(e)).lower() for e in I.EXPERIMENTS) + """]) AS has_map, (SELECT count(*) FROM sites) AS n, 100.0::DOUBLE AS pct_total, 1::BIGINT AS first_place, 7::BIGINT AS last_place,
 2::BIGINT AS n_regions, true AS families_add_up, true AS rates_in_range""")
def leak_audit_checks(t: Inputs):
    r = leak_audit(t)
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda x, y: x + y)
    inside = K.add(F.col(c).between(0, 1).cast("int") for c in ("auc_mean", "brier_mean", "loro_auc", "loro_gap")) == 4
    return r.select("experimento", "has_map", "n", F.round(total("shares"), 6).alias("pct_total"), F.array_min(F.map_values("places")).cast("bigint").alias("first_place"),
                    F.array_max(F.map_values("places")).cast("bigint").alias("last_place"), F.size("loro").cast("bigint").alias("n_regions"),
                    (F.abs(F.col("pct_red") + F.col("pct_recurso") - 100.0) < 1e-6).alias("families_add_up"), inside.alias("rates_in_range"))


@query("audit_maps")
def audit_maps(t: Inputs):
    s, wide = _audit(t)
    m = samples(t).drop("clase", "region", "block")
    dist = m.select("r", "c", "dist_subestaciones", "dist_transmision", "dist_almacen")
    maps = L.audit_maps(s, wide, m, {n: dist for n in ("linea_base", "tres_sin_dedicadas", "tres_previas")}, "site_id", PARAMS)
    both = [df.select("r", "c", F.lit(n).alias("experimento"), "prob") for n, df in maps.items()]
    return both[0].unionByName(both[1])


def _mapped(t: Inputs):
    return samples(t).withColumn("n_plants", (F.col("cell") % 41 == 3).cast("int")).withColumn("in_foot", F.col("cell") % 29 == 4)


@query("loro_maps")
def loro_maps(t: Inputs):
    m = _mapped(t)
    return P.combine_regions(L.region_maps(m, m, t.grid, "region", [0, 1, 2], FEATURES, PARAMS, (1.0, 3.0, 10.0)))


@query("in_sample_maps")
def in_sample_maps(t: Inputs):
    m = _mapped(t)
    return P.combine_regions(L.region_maps(m, m, t.grid, "region", [0, 1, 2], FEATURES, PARAMS, (1.0, 10.0), hold_out=False))


@query("transfer_topk")
def transfer_topk(t: Inputs):
    m = _mapped(t)
    tr = m.where("c < 50")
    return L.transfer(FO.train(tr, FEATURES, "clase", PARAMS), tr, m.where("c >= 50"), t.grid, "cell", FEATURES, (1.0, 5.0, 10.0))["topk"]


@query("transfer_applicability")
def transfer_applicability(t: Inputs):
    m = _mapped(t)
    tr = m.where("c < 50")
    out = L.transfer(FO.train(tr, FEATURES, "clase", PARAMS), tr, m.where("c >= 50"), t.grid, "cell", FEATURES, (1.0,))
    return out["aoa"].withColumn("_p", out["plants"].select(F.struct("*")).scalar()).select("*", "_p.*").drop("_p")


@query("transfer_sensitivity")
def transfer_sensitivity(t: Inputs):
    m = _mapped(t)
    tr, zone = m.where("c < 50"), m.where("c >= 50")
    # a line along column 80 carries a compound region code: only the compound filter keeps it
    wide = zone.withColumn("dist_transmision", F.least(F.col("dist_transmision"), F.abs(F.col("c") - 80) * 1000.0))
    model = FO.train(tr, FEATURES, "clase", PARAMS)
    return L.transfer_sensitivity(model, tr, zone, wide, t.grid, "cell", FEATURES, (1.0, 5.0, 10.0))["delta"]
