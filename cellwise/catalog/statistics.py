"""Order statistics, classification metrics, top-K, shift, bootstraps, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import ranks as R
from ..operators import sampling as S
from ..plans import studies as P
from ..runtime import cut
from ..sources import sinks
from .base import M, Inputs, query, rounded

RANKED = """, k AS (SELECT region_id, is_pos, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob)-1)/2.0 AS a,
 rank() OVER (ORDER BY mw) + (count(*) OVER (PARTITION BY mw)-1)/2.0 AS b FROM sites)"""


@query("spearman", RANKED + f" SELECT {M('corr(a,b)')} AS rho, count(*) AS n FROM k")
def spearman(t: Inputs):
    return rounded(R.spearman(t.sites, "prob", "mw"))


@query("spearman_by_group", f""", k AS (SELECT region_id, rank() OVER (PARTITION BY region_id ORDER BY prob) + (count(*) OVER (PARTITION BY region_id, prob)-1)/2.0 AS a,
 rank() OVER (PARTITION BY region_id ORDER BY mw) + (count(*) OVER (PARTITION BY region_id, mw)-1)/2.0 AS b FROM sites)
SELECT region_id, {M('corr(a,b)')} AS rho, count(*) AS n FROM k GROUP BY 1""")
def spearman_by_group(t: Inputs):
    return rounded(R.spearman(t.sites, "prob", "mw", by=["region_id"]))


_MATRIX = ["ghi", "slope", "elev", "prob"]


@query("spearman_matrix", ", k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {v})+(count(*) OVER (PARTITION BY {v})-1)/2.0 AS {v}" for v in _MATRIX) + " FROM cells) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {M(f'corr({a},{b})')} AS rho FROM k" for a in _MATRIX for b in _MATRIX))
def spearman_matrix(t: Inputs):
    return rounded(R.spearman_matrix(t.cells, _MATRIX))


DESIGN_VECTORS = """, v AS (SELECT region_id % 4 AS d, [avg(prob), avg(mw)/250.0, avg(x)/900000.0, avg(y)/8500000.0, avg(is_pos::INT), stddev_pop(prob), stddev_pop(mw)/250.0] AS w FROM sites GROUP BY 1),
pairs AS (SELECT a.d AS d1, b.d AS d2, a.w AS wa, b.w AS wb FROM v a JOIN v b ON a.d < b.d),
ij AS (SELECT i, j FROM range(1,8) t(i), range(1,8) u(j) WHERE i > j),
s AS (SELECT d1, d2, sign(wa[i]-wa[j]) AS p, sign(wb[i]-wb[j]) AS q FROM pairs, ij)"""


def _region_vectors(t: Inputs):
    return t.sites.groupBy((F.col("region_id") % 4).alias("d")).agg(
        F.avg("prob").alias("w0"), (F.avg("mw") / 250.0).alias("w1"), (F.avg("x") / 900000.0).alias("w2"),
        (F.avg("y") / 8500000.0).alias("w3"), F.avg(F.col("is_pos").cast("int")).alias("w4"),
        F.stddev_pop("prob").alias("w5"), (F.stddev_pop("mw") / 250.0).alias("w6"))


def design_vectors(t: Inputs):
    """Seven numbers per group of regions as shares of a design, with the largest one's name."""
    w = _region_vectors(t)
    names = [f"w{i}" for i in range(7)]
    top = F.array_position(F.array(*names), F.array_max(F.array(*names)))
    return w.select(F.col("d").cast("string").alias("estrategia"), F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("shares"),
                    F.element_at(F.array(*[F.lit(n) for n in names]), top.cast("int")).alias("dominante"))


@query("kendall", DESIGN_VECTORS + f" SELECT d1, d2, {M('sum(p*q)/sqrt(sum(p*p)*sum(q*q))')} AS tau FROM s GROUP BY 1,2")
def kendall(t: Inputs):
    w = _region_vectors(t)
    later = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    a = w.select(F.col("d").alias("d1"), *[F.col(f"w{i}").alias(f"a{i}") for i in range(7)], later.alias("d2"))
    b = w.select(F.col("d").alias("d2"), *[F.col(f"w{i}").alias(f"b{i}") for i in range(7)])
    pairs = a.where(F.col("d2") > F.col("d1")).join(b, "d2")  # four designs, six pairs
    tau = R.kendall_columns([F.col(f"a{i}") for i in range(7)], [F.col(f"b{i}") for i in range(7)])
    return rounded(pairs.select("d1", "d2", tau.alias("tau")))


AUC_SQL = """, d AS (SELECT site_id, is_pos::INT AS clase, (SELECT min(sqrt((s.x-i.x)**2+(s.y-i.y)**2)) FROM infra i) AS dist FROM sites s),
k AS (SELECT clase, rank() OVER (ORDER BY -dist) + (count(*) OVER (PARTITION BY dist)-1)/2.0 AS rk FROM d)"""


@query("auc_univariate", AUC_SQL + f""" SELECT {M('(sum(rk) FILTER (clase=1) - count(*) FILTER (clase=1)*(count(*) FILTER (clase=1)+1)/2.0)/(count(*) FILTER (clase=1)*count(*) FILTER (clase=0))')} AS auc FROM k""")
def auc_univariate(t: Inputs):
    from ..operators.nearest import nearest_distance

    d = cut(nearest_distance(t.sites.select("site_id", "x", "y", F.col("is_pos").cast("int").alias("clase")), t.infra, "site_id", "infra_id"))
    return rounded(R.auc(d.withColumn("closeness", -F.col("dist")), "closeness", "clase"))


def _labelled(t: Inputs):
    return t.sites.select("site_id", "region_id", F.floor(F.col("prob") * 50).alias("score"), "prob",
                          F.col("is_pos").cast("int").alias("clase"))


@query("brier", f"SELECT region_id, {M('avg((prob-is_pos::INT)**2)')} AS brier FROM sites GROUP BY 1")
def brier(t: Inputs):
    return rounded(R.brier(_labelled(t), "prob", "clase", by=["region_id"]))


CURVE = """, d AS (SELECT floor(prob*50)::BIGINT AS score, is_pos::INT AS clase FROM sites),
g AS (SELECT score, count(*) FILTER (clase=1) AS p, count(*) FILTER (clase=0) AS q FROM d GROUP BY 1),
c AS (SELECT score AS threshold, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS tot_p, sum(q) OVER () AS tot_q FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("roc_points", CURVE + f"""SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, {M('tp/tot_p')} AS tpr, {M('fp/tot_q')} AS fpr,
 {M('tp/(tp+fp)')} AS precision, {M('p/tot_p')} AS recall_step FROM c""")
def roc_points(t: Inputs):
    return rounded(R.curve_points(_labelled(t), "score", "clase"))


@query("average_precision", CURVE + f"SELECT {M('sum(p/tot_p*tp/(tp+fp))')} AS average_precision FROM c")
def average_precision(t: Inputs):
    return rounded(R.average_precision(_labelled(t), "score", "clase"))


@query("describe_sample", f"""SELECT region_id, count(*) AS n, {M('min(prob)')} AS min, {M('avg(prob)')} AS mean, {M('quantile_cont(prob,0.25)')} AS p25, {M('quantile_cont(prob,0.5)')} AS mediana,
 {M('quantile_cont(prob,0.75)')} AS p75, {M('max(prob)')} AS max, {M('stddev_samp(prob)')} AS std FROM sites GROUP BY 1""")
def describe_sample(t: Inputs):
    return rounded(R.summary(t.sites, "prob", by=["region_id"], probs={"p25": .25, "mediana": .5, "p75": .75}, std="sample"))


@query("describe_population", f"""SELECT count(*) AS n, {M('min(elev)')} AS min, {M('avg(elev)')} AS mean, {M('quantile_cont(elev,0.25)')} AS p25, {M('quantile_cont(elev,0.5)')} AS p50,
 {M('quantile_cont(elev,0.75)')} AS p75, {M('quantile_cont(elev,0.95)')} AS p95, {M('max(elev)')} AS max, {M('stddev_pop(elev)')} AS std FROM cells""")
def describe_population(t: Inputs):
    return rounded(R.summary(t.cells, "elev", probs={"p25": .25, "p50": .5, "p75": .75, "p95": .95}, std="population"))


@query("yield_contrast", f""", v AS (SELECT * FROM cells WHERE yld>0) SELECT count(*) AS celdas_validas, count(*) FILTER (prob>=0.5) AS celdas_aptas,
 {M('avg(yld)')} AS media_region, {M('quantile_cont(yld,0.5)')} AS mediana_region, min(yld) AS min_region, max(yld) AS max_region,
 {M('avg(yld) FILTER (prob>=0.5)')} AS media_aptas, {M('quantile_cont(yld,0.5) FILTER (prob>=0.5)')} AS mediana_aptas,
 min(yld) FILTER (prob>=0.5) AS min_aptas, max(yld) FILTER (prob>=0.5) AS max_aptas,
 {M('100.0*(avg(yld) FILTER (prob>=0.5)/avg(yld)-1)')} AS ganancia_media_pct,
 {M('100.0*(quantile_cont(yld,0.5) FILTER (prob>=0.5)/quantile_cont(yld,0.5)-1)')} AS ganancia_mediana_pct FROM v""")
def yield_contrast(t: Inputs):
    v = P.with_status(t.cells).where(F.col("status") == "valida")
    return rounded(P.yield_contrast(v, 0.5))


@query("tukey_fence", f"SELECT region_id, {M('quantile_cont(mw,0.75)+1.5*(quantile_cont(mw,0.75)-quantile_cont(mw,0.25))')} AS cerca FROM sites GROUP BY 1")
def tukey_fence(t: Inputs):
    q = R.quantiles(t.sites, "mw", {"q1": .25, "q3": .75}, by=["region_id"])
    return rounded(q.select("region_id", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("cerca")))


@query("top_sites", f"SELECT r, c, {M('prob')} AS prob FROM cells ORDER BY cells.prob DESC, cells.r, cells.c LIMIT 25")
def top_sites(t: Inputs):
    return rounded(t.cells.select("r", "c", "prob").orderBy(F.desc("prob"), "r", "c").limit(25))


# -- top-K ---------------------------------------------------------------------------------

TOPK = ", th AS (" + " UNION ALL ".join(
    f"SELECT {k!r}::DOUBLE AS k, quantile_cont(prob,{1.0 - k / 100.0!r}) AS t FROM cells" for k in P.KS) + """),
plants AS (SELECT floor((7000000.0-y)/1000.0)::BIGINT AS r, floor((x-300000.0)/1000.0)::BIGINT AS c FROM (
  SELECT 300000.0 + (site_id*7919) % 100000 AS x, 7000000.0 - (site_id*10473) % 150000 AS y FROM sites WHERE is_pos)),
valid AS (SELECT cells.*, coalesce(n,0) AS n_plants, (cells.r*100+cells.c) % 7 = 0 AS foot FROM cells LEFT JOIN (SELECT r,c,count(*) n FROM plants GROUP BY 1,2) p USING (r,c)),
top AS (SELECT k, t, v.* FROM th JOIN valid v ON prob >= t)"""


def _valid(t: Inputs):
    k = F.col("site_id")
    pts = t.sites.where("is_pos").select((F.lit(300000.0) + (k * 7919) % 100000).alias("x"), (F.lit(7000000.0) - (k * 10473) % 150000).alias("y"))
    plants = pts.select(t.grid.row("y").alias("r"), t.grid.column("x").alias("c"))
    foot = t.cells.where((F.col("r") * 100 + F.col("c")) % 7 == 0).select("r", "c")
    return P.topk_cells(t.cells.select("r", "c", "prob"), "prob", plants=plants, footprint=foot)


@query("topk_recall", TOPK + f""" SELECT k, {M('t')} AS threshold, count(*) AS n_top, {M('100.0*count(*)/(SELECT count(*) FROM valid)')} AS pct_area,
 sum(n_plants)::BIGINT AS captured, {M('sum(n_plants)/(SELECT sum(n_plants) FROM valid)')} AS recall FROM top GROUP BY k, t""")
def topk_recall(t: Inputs):
    return rounded(P.topk_metrics(_valid(t), "prob").select("k", "threshold", "n_top", "pct_area", "captured", "recall"),
                   "threshold", "pct_area", "recall")


@query("topk_area_precision", TOPK + f""" SELECT k, count(*) AS n_top, count(*) FILTER (foot) AS foot_hit,
 {M('count(*) FILTER (foot)/count(*)')} AS area_precision, {M('(SELECT count(*) FILTER (foot)/count(*) FROM valid)')} AS area_base,
 {M('least(1.0,(SELECT count(*) FILTER (foot) FROM valid)/count(*))')} AS area_ceiling,
 {M('100.0*count(*) FILTER (foot)/(SELECT count(*) FILTER (foot) FROM valid)')} AS pct_ceiling FROM top GROUP BY k""")
def topk_area_precision(t: Inputs):
    return rounded(P.topk_metrics(_valid(t), "prob").select(
        "k", "n_top", "foot_hit", "area_precision", "area_base", "area_ceiling", "pct_ceiling"),
        "area_precision", "area_base", "area_ceiling", "pct_ceiling")


ZONES = TOPK + """, e AS (SELECT a.k, a.r*100+a.c AS a, b.r*100+b.c AS b FROM top a JOIN top b ON a.k=b.k AND b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1),
w AS (SELECT k, r*100+c AS id, r*100+c AS root FROM top UNION SELECT w.k, w.id, e.b FROM w JOIN e ON w.k=e.k AND w.root=e.a),
lab AS (SELECT k, id, min(root) AS zone FROM w GROUP BY 1,2),
z AS (SELECT lab.k, zone, count(*) AS a, sum(n_plants) AS p FROM lab JOIN valid ON lab.id = valid.r*100+valid.c GROUP BY 1,2),
tot AS (SELECT count(*) AS n, sum(n_plants) AS p FROM valid)"""


@query("topk_zone_precision", ZONES + f""" SELECT z.k, count(*) AS n_zones, count(*) FILTER (z.p>0) AS n_hit, {M('count(*) FILTER (z.p>0)/count(*)')} AS precision,
 {M('avg(1.0-pow(1.0-a/tot.n, tot.p))')} AS random_base, {M('(count(*) FILTER (z.p>0)/count(*))/avg(1.0-pow(1.0-a/tot.n, tot.p))')} AS enrichment,
 {M('quantile_cont(a,0.5)')} AS median_km2, max(a)::DOUBLE AS max_km2 FROM z, tot GROUP BY z.k""", recursive=True)
def topk_zone_precision(t: Inputs):
    return rounded(P.topk_zones(_valid(t), "prob", t.grid), "precision", "random_base", "enrichment", "median_km2")


REGIONAL = """, reg AS (SELECT region_id % 3 AS g, k, count(*) FILTER (prob >= 1-k/10.0) AS n_top, count(*) FILTER (prob >= 1-k/10.0 AND is_pos) AS captured,
 count(*) FILTER (is_pos) AS n_plants, count(*) FILTER (prob >= 1-k/10.0 AND site_id%5=0) AS foot_hit, count(*) FILTER (site_id%5=0) AS n_foot,
 count(DISTINCT floor(x/50000)) AS n_zones, count(DISTINCT CASE WHEN is_pos AND site_id%8=0 THEN floor(x/50000) END) AS n_hit, avg(prob)/10.0 AS random_base
 FROM sites, (SELECT unnest([1.0,3.0,5.0])::DOUBLE AS k) GROUP BY 1,2),
comb AS (SELECT k, sum(captured)/sum(n_plants) AS recall, sum(captured)::BIGINT AS captured, sum(n_hit)/sum(n_zones) AS zone_precision,
 sum(random_base*n_zones)/sum(n_zones) AS random_base, sum(n_zones)::BIGINT AS n_zones, sum(n_hit)::BIGINT AS n_hit, sum(foot_hit)/sum(n_top) AS area_precision,
 least(1.0,sum(least(n_foot,n_top))/sum(n_top)) AS area_ceiling FROM reg GROUP BY k)"""


def _regional(t: Inputs):
    x = t.sites.select("*", F.explode(F.array(*[F.lit(k) for k in (1.0, 3.0, 5.0)])).alias("k"))
    top, foot = F.col("prob") >= 1 - F.col("k") / 10.0, F.col("site_id") % 5 == 0
    col = F.floor(F.col("x") / 50000)
    return P.combine_regions(x.groupBy((F.col("region_id") % 3).alias("g"), "k").agg(
        F.count_if(top).alias("n_top"), F.count_if(top & F.col("is_pos")).alias("captured"), F.count_if("is_pos").alias("n_plants"),
        F.count_if(top & foot).alias("foot_hit"), F.count_if(foot).alias("n_foot"), F.countDistinct(col).alias("n_zones"),
        F.countDistinct(F.when(F.col("is_pos") & (F.col("site_id") % 8 == 0), col)).alias("n_hit"),
        (F.avg("prob") / 10.0).alias("random_base")))


@query("combined_regions", REGIONAL + f""" SELECT k, {M('recall')} AS recall, captured, {M('zone_precision')} AS zone_precision, {M('random_base')} AS random_base, n_zones, n_hit,
 {M('area_precision')} AS area_precision, {M('area_ceiling')} AS area_ceiling, {M('zone_precision/random_base')} AS enrichment FROM comb""")
def combined_regions(t: Inputs):
    return rounded(_regional(t))


@query("target_contrast", REGIONAL + f""" SELECT 'recall_k3' AS meta, {M('recall')} AS valor, 0.85::DOUBLE AS umbral, recall>=0.85 AS cumple, true AS alcanzable FROM comb WHERE k=3
UNION ALL SELECT 'precision_k1', {M('area_precision')}, 0.15::DOUBLE, area_precision>=0.15, area_ceiling>=0.15 FROM comb WHERE k=1""")
def target_contrast(t: Inputs):
    return rounded(P.target_contrast(_regional(t)))


@query("generalisation_gradient", REGIONAL + f""", s AS (SELECT 0 AS paso, 'A' AS nombre, recall FROM comb WHERE k=3 UNION ALL SELECT 1, 'B', recall*0.9 FROM comb WHERE k=3 UNION ALL SELECT 2, 'C', recall*0.5 FROM comb WHERE k=3)
SELECT paso, nombre, {M('recall')} AS recall, {M('100.0*(recall-lag(recall) OVER (ORDER BY paso))')} AS delta_pp FROM s""")
def generalisation_gradient(t: Inputs):
    c = _regional(t)
    return rounded(P.gradient({"A": c, "B": c.withColumn("recall", F.col("recall") * 0.9),
                               "C": c.withColumn("recall", F.col("recall") * 0.5)}, 3.0))


# -- covariate shift, shares --------------------------------------------------------------------

SHIFT_FEATURES = ["ghi", "slope", "elev"]


@query("covariate_shift", ", u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, r < 60 AS tr, {f}::DOUBLE AS v FROM cells" for f in SHIFT_FEATURES) + f"""),
a AS (SELECT feature, count(*) AS train_n, min(v) AS train_min, avg(v) AS train_mean, quantile_cont(v,0.25) AS train_p25, quantile_cont(v,0.5) AS train_mediana, quantile_cont(v,0.75) AS train_p75, max(v) AS train_max, stddev_pop(v) AS train_std FROM u WHERE tr GROUP BY 1),
b AS (SELECT feature, count(*) AS zone_n, min(v) AS zone_min, avg(v) AS zone_mean, quantile_cont(v,0.25) AS zone_p25, quantile_cont(v,0.5) AS zone_mediana, quantile_cont(v,0.75) AS zone_p75, max(v) AS zone_max FROM u WHERE NOT tr GROUP BY 1),
o AS (SELECT feature, 100.0*avg((v<train_min)::INT) AS pct_below, 100.0*avg((v>train_max)::INT) AS pct_above FROM u JOIN a USING (feature) WHERE NOT tr GROUP BY 1)
SELECT feature, train_n, {', '.join(f"{M('train_'+c)} AS train_{c}" for c in ('min','mean','p25','mediana','p75','max','std'))}, zone_n,
 {', '.join(f"{M('zone_'+c)} AS zone_{c}" for c in ('min','mean','p25','mediana','p75','max'))}, {M('pct_below')} AS pct_below, {M('pct_above')} AS pct_above,
 {M('pct_below+pct_above')} AS pct_outside, {M('(zone_mean-train_mean)/train_std')} AS shift_sd FROM a JOIN b USING (feature) JOIN o USING (feature)""")
def covariate_shift(t: Inputs):
    return rounded(P.covariate_shift(t.cells.where("r < 60"), t.cells.where("r >= 60"), SHIFT_FEATURES))


@query("zone_attributes", f"SELECT count(*) AS n_plantas, sum(mw) AS mw_total, (SELECT count(*)*1.0::DOUBLE FROM cells WHERE prob>=0.2) AS area_km2 FROM sites WHERE is_pos")
def zone_attributes(t: Inputs):
    return P.zone_attributes(t.sites.where("is_pos"), t.cells.where("prob >= 0.2"), "mw", t.grid)


SHARES = """, sh AS (SELECT region_id % 2 AS g, 'f'||(site_id%7) AS feature, sum(abs(prob)) AS a FROM sites GROUP BY 1,2),
pc AS (SELECT g, feature, 100.0*a/sum(a) OVER (PARTITION BY g) AS pct FROM sh)"""


def _shares(t: Inputs):
    from pyspark.sql import Window

    s = t.sites.groupBy((F.col("region_id") % 2).alias("g"), F.concat(F.lit("f"), (F.col("site_id") % 7).cast("string")).alias("feature")).agg(
        F.sum(F.abs("prob")).alias("a"))
    return s.select("g", "feature", (100.0 * F.col("a") / F.sum("a").over(Window.partitionBy("g"))).alias("pct"))


@query("dominance_comparison", SHARES + f""" SELECT feature, {M('a.pct')} AS pct_a, {M('b.pct')} AS pct_b, {M('b.pct-a.pct')} AS delta_pp
FROM (SELECT * FROM pc WHERE g=0) a JOIN (SELECT * FROM pc WHERE g=1) b USING (feature)""")
def dominance_comparison(t: Inputs):
    s = _shares(t)
    return rounded(P.share_comparison(s.where("g = 0"), s.where("g = 1")))


@query("family_shares", SHARES + f""" SELECT g, {M("sum(pct) FILTER (feature IN ('f0','f1','f2'))")} AS acceso_red, {M("sum(pct) FILTER (feature NOT IN ('f0','f1','f2'))")} AS recurso,
 {M("sum(pct) FILTER (feature IN ('f0','f1','f2'))/sum(pct) FILTER (feature NOT IN ('f0','f1','f2'))")} AS ratio FROM pc GROUP BY 1""")
def family_shares(t: Inputs):
    return rounded(P.family_shares(_shares(t), {"acceso_red": ["f0", "f1", "f2"], "recurso": ["f3", "f4", "f5", "f6"]}, by=["g"]))


@query("ranking_position", SHARES + " SELECT g, feature, row_number() OVER (PARTITION BY g ORDER BY pct DESC, feature)::INT AS place FROM pc")
def ranking_position(t: Inputs):
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy(F.desc("pct"), "feature")  # seven features per design
    return _shares(t).select("g", "feature", F.row_number().over(w).alias("place"))


@query("fold_means", f""", f AS (SELECT region_id % 5 AS fold, avg(prob) AS auc, avg((prob-is_pos::INT)**2) AS brier FROM sites GROUP BY 1)
SELECT count(*) AS n_folds, {M('avg(auc)')} AS auc_mean, {M('stddev_pop(auc)')} AS auc_std, {M('avg(brier)')} AS brier_mean, {M('stddev_pop(brier)')} AS brier_std FROM f""")
def fold_means(t: Inputs):
    from ..operators.forest import cv_summary

    f = t.sites.groupBy((F.col("region_id") % 5).alias("fold")).agg(
        F.avg("prob").alias("auc"), F.avg((F.col("prob") - F.col("is_pos").cast("int")) ** 2).alias("brier"))
    return rounded(cv_summary(f))


@query("region_gap", f""", f AS (SELECT region_id AS g, avg(prob) AS auc FROM sites GROUP BY 1), q AS (SELECT avg(auc) AS a, max(auc)-min(auc) AS gap FROM f)
SELECT {M('a')} AS auc_mean, {M('gap')} AS gap, CASE WHEN gap<0.05 THEN 'transferencia alta' WHEN gap<0.1 THEN 'transferencia moderada' ELSE 'transferencia baja' END AS lectura FROM q""")
def region_gap(t: Inputs):
    from ..operators.forest import region_gap as gap

    g = gap(t.sites.groupBy("region_id").agg(F.avg("prob").alias("auc")))
    return rounded(g.withColumn("lectura", P.gap_reading(F.col("gap"))))


# -- draws ---------------------------------------------------------------------------------------

_D = K.draw_sql("site_id", 42)


@query("draw_negatives", f" SELECT site_id FROM sites WHERE NOT is_pos ORDER BY {_D}, site_id LIMIT (SELECT 2*count(*)//4 FROM sites WHERE is_pos)")
def draw_negatives(t: Inputs):
    n = t.sites.where("is_pos").count() * 2 // 4
    return S.draw_rows(t.sites.where("not is_pos"), "site_id", n, 42).select("site_id")


@query("stratified_split", f""", d AS (SELECT site_id, is_pos::INT AS clase, row_number() OVER (PARTITION BY is_pos ORDER BY {_D}, site_id) AS n,
 floor(count(*) OVER (PARTITION BY is_pos)*0.3+0.5) AS cut FROM sites) SELECT site_id, clase, n <= cut AS is_test FROM d""")
def stratified_split(t: Inputs):
    x = t.sites.select("site_id", F.col("is_pos").cast("int").alias("clase"))
    return S.stratified_split(x, "site_id", "clase", 0.3, 42)


@query("group_folds", """, s AS (SELECT site_id, is_pos, (floor(x/60000.0)*1000003+floor(y/60000.0))::BIGINT AS block FROM sites),
b AS (SELECT block, count(*) FILTER (is_pos) AS p, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT block, (row_number() OVER (ORDER BY p DESC, n DESC, block) - 1) % 10 AS st FROM b)
SELECT site_id, s.block, (CASE WHEN st<5 THEN st ELSE 9-st END)::BIGINT AS fold FROM s JOIN o ON s.block=o.block""")
def group_folds(t: Inputs):
    x = t.sites.select("site_id", F.col("is_pos").cast("int").alias("clase"), K.block_number("x", "y", 60000.0).alias("block"))
    return S.group_folds(x, "block", "clase", 5).select("site_id", "block", "fold")


@query("impute_dates", f""", k AS (SELECT f_op AS d, row_number() OVER (ORDER BY f_op, infra_id)-1 AS pos FROM infra WHERE f_op IS NOT NULL)
SELECT infra_id, coalesce(f_op, k.d)::VARCHAR AS f_op, f_op IS NULL AS fecha_imputada FROM infra LEFT JOIN k ON f_op IS NULL AND k.pos = {K.draw_sql('infra_id', 7)} % (SELECT count(*) FROM k)""")
def impute_dates(t: Inputs):
    return S.impute_dates(t.infra.select("infra_id", "f_op"), "infra_id", "f_op", 7).select(
        "infra_id", F.col("f_op").cast("string").alias("f_op"), "fecha_imputada")


_B = """, c2 AS (SELECT (floor(x/15000.0)*1000003+floor(y/15000.0))::BIGINT AS block, prob, yld FROM centred WHERE yld>0),
bl AS (SELECT block, avg(prob) AS a, avg(yld) AS b FROM c2 GROUP BY 1), nb AS (SELECT count(*) AS n FROM bl),
nm AS (SELECT block, row_number() OVER (ORDER BY block)-1 AS pos FROM bl),
pick AS (SELECT id // n AS rep, {d} % n AS pos FROM nb, range(0, {boot}*(SELECT n FROM nb)) t(id)),
mult AS (SELECT rep, block, count(*) AS times FROM pick JOIN nm USING (pos) GROUP BY 1,2),
rows AS (SELECT rep, {cols} FROM mult JOIN {src} USING (block), range(0, times) u(i)),
rk AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY a)+(count(*) OVER (PARTITION BY rep,a)-1)/2.0 AS ra,
 rank() OVER (PARTITION BY rep ORDER BY b)+(count(*) OVER (PARTITION BY rep,b)-1)/2.0 AS rb FROM rows),
rho AS (SELECT rep, corr(ra,rb) AS rho FROM rk GROUP BY 1)
SELECT {q1} AS ci_low, {q2} AS ci_high, {se} AS se, count(*) AS n_boot FROM rho"""


def _boot(cols: str, src: str, boot: int, seed: int) -> str:
    return _B.format(d=K.draw_sql("id", seed), boot=boot, cols=cols, src=src, q1=M("quantile_cont(rho,0.025)"),
                     q2=M("quantile_cont(rho,0.975)"), se=M("stddev_pop(rho)"))


def _blocked(t: Inputs):
    return t.cells.where("yld > 0").select("r", "c", K.block_number(t.grid.x(), t.grid.y(), 15000.0).alias("block"), "prob", "yld")


@query("block_bootstrap_ci", _boot("a, b", "bl", 200, 42))
def block_bootstrap_ci(t: Inputs):
    b = _blocked(t).groupBy("block").agg(F.avg("prob").alias("a"), F.avg("yld").alias("b"))
    return rounded(S.interval(S.block_bootstrap(b, "block", "a", "b", 200, 42)))


@query("cluster_bootstrap_ci", _boot("prob AS a, yld AS b", "c2", 20, 43))
def cluster_bootstrap_ci(t: Inputs):
    return rounded(S.interval(S.cluster_bootstrap(_blocked(t), "block", "prob", "yld", 20, 43)))


@query("decoupling_study")
def decoupling_study(t: Inputs):
    return P.decoupling_study(t.cells, t.grid, 0.4, 50, 42, 15000.0)


def _scope_sql(s: str, where: str, n_boot: int, seed: int) -> str:
    """CTEs of one scope: cells, blocks, their rank correlations and both bootstraps, under names that end in ``s``."""
    ranks = lambda by: ", ".join(
        f"rank() OVER ({p} ORDER BY {v})+(count(*) OVER (PARTITION BY {by + ',' if by else ''}{v})-1)/2.0 AS r{v}"
        for v in "ab" for p in [f"PARTITION BY {by}" if by else ""])
    def boot(kind: str, src: str, seed: int) -> str:
        return f""", pick{kind}{s} AS (SELECT id // n AS rep, {K.draw_sql("id", seed)} % n AS pos FROM nb{s}, range(0, {n_boot}*(SELECT n FROM nb{s})) t(id)),
mult{kind}{s} AS (SELECT rep, block, count(*) AS times FROM pick{kind}{s} JOIN nm{s} USING (pos) GROUP BY 1,2),
rows{kind}{s} AS (SELECT rep, a, b FROM mult{kind}{s} JOIN {src} USING (block), range(0, times) u(i)),
rho{kind}{s} AS (SELECT rep, corr(ra,rb) AS rho FROM (SELECT rep, {ranks("rep")} FROM rows{kind}{s}) GROUP BY 1),
ci{kind}{s} AS (SELECT quantile_cont(rho,0.025) AS lo, quantile_cont(rho,0.975) AS hi, stddev_pop(rho) AS se FROM rho{kind}{s})"""
    return f""", cl{s} AS (SELECT (floor(x/15000.0)*1000003+floor(y/15000.0))::BIGINT AS block, prob AS a, yld AS b FROM centred WHERE {where}),
bl{s} AS (SELECT block, avg(a) AS a, avg(b) AS b FROM cl{s} GROUP BY 1), nb{s} AS (SELECT count(*) AS n FROM bl{s}),
nm{s} AS (SELECT block, row_number() OVER (ORDER BY block)-1 AS pos FROM bl{s}),
rc{s} AS (SELECT count(*) AS n, corr(ra,rb) AS rho FROM (SELECT {ranks("")} FROM cl{s})),
rb{s} AS (SELECT count(*) AS n, corr(ra,rb) AS rho FROM (SELECT {ranks("")} FROM bl{s}))""" + boot("b", f"bl{s}", seed) + boot("c", f"cl{s}", seed + 1)


def _scope_row(s: str, name: str) -> str:
    return f"""SELECT '{name}' AS ambito, rc{s}.n AS n_celdas, {M(f"rc{s}.rho")} AS rho_celda, rb{s}.n AS n_bloques, {M(f"rb{s}.rho")} AS rho_bloque,
 {M(f"cib{s}.lo")} AS bloque_ic_inf, {M(f"cib{s}.hi")} AS bloque_ic_sup, {M(f"cib{s}.se")} AS bloque_se,
 {M(f"cic{s}.lo")} AS celda_ic_inf, {M(f"cic{s}.hi")} AS celda_ic_sup, {M(f"cic{s}.se")} AS celda_se FROM rc{s}, rb{s}, cib{s}, cic{s}"""


@query("decoupling_intervals", _scope_sql("1", "yld>0 AND prob IS NOT NULL", 50, 42) + _scope_sql("2", "yld>0 AND prob>=0.4", 50, 42)
       + " " + _scope_row("1", "region") + " UNION ALL " + _scope_row("2", "aptas"))
def decoupling_intervals(t: Inputs):
    """The decoupling study without its p value, which SQL has no function for."""
    return rounded(P.decoupling_study(t.cells, t.grid, 0.4, 50, 42, 15000.0).drop("p_bloque"))


@query("metrics_long", f""", v AS (SELECT avg(yld) m, quantile_cont(yld,0.5) p FROM cells WHERE yld>0)
SELECT 'Rendimiento' AS categoria, 'media' AS metrica, 'region' AS ambito, {M('m')} AS valor, 'kWh/kWp' AS unidad, NULL::DOUBLE AS ic_95_inferior, NULL::DOUBLE AS ic_95_superior, NULL::DOUBLE AS p_valor, 'media regional' AS descripcion FROM v
UNION ALL SELECT 'Rendimiento', 'mediana', 'region', {M('p')}, 'kWh/kWp', NULL, NULL, NULL, 'mediana regional' FROM v""")
def metrics_long(t: Inputs):
    s = R.summary(t.cells.where("yld > 0"), "yld")
    return rounded(sinks.metrics_long(s, [("Rendimiento", "media", "region", "mean", "kWh/kWp", "media regional"),
                                          ("Rendimiento", "mediana", "region", "p50", "kWh/kWp", "mediana regional")]))


METRICS = """, m AS (SELECT 'e'||(region_id%3) AS exp, 'auc' AS metric, avg(prob) AS value FROM sites GROUP BY 1
 UNION ALL SELECT 'e'||(region_id%3), 'brier', avg((prob-is_pos::INT)**2) FROM sites GROUP BY 1)"""


def _metrics(t: Inputs):
    e = F.concat(F.lit("e"), (F.col("region_id") % 3).cast("string"))
    g = t.sites.groupBy(e.alias("exp")).agg(F.avg("prob").alias("auc"), F.avg((F.col("prob") - F.col("is_pos").cast("int")) ** 2).alias("brier"))
    return g.unpivot(["exp"], ["auc", "brier"], "metric", "value")


@query("comparison_wide", METRICS + f" SELECT exp, {M('max(value) FILTER (metric=$$auc$$)')} AS auc, {M('max(value) FILTER (metric=$$brier$$)')} AS brier FROM m GROUP BY 1")
def comparison_wide(t: Inputs):
    return rounded(sinks.comparison_wide(_metrics(t), "exp", "metric", "value", ["auc", "brier"]))


@query("compare_reports", METRICS + f" SELECT exp, metric, {M('value')} AS value_a, {M('value*1.1')} AS value_b, {M('value*1.1-value')} AS delta FROM m")
def compare_reports(t: Inputs):
    m = _metrics(t)
    return rounded(sinks.compare_reports(m, m.withColumn("value", F.col("value") * 1.1), ["exp", "metric"]))
