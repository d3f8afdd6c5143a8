"""Projections, predicates, map algebra and cell studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import infrastructure as I
from ..operators import ranks as R
from ..operators import sampling as S
from ..plans import studies as P
from ..plans import suitability as U
from .base import M, Inputs, query, rounded

VALID = ", valid AS (SELECT *, r*100+c AS cell FROM cells WHERE prob IS NOT NULL AND yld > 0)"
RANKING = VALID + """, lim AS (SELECT quantile_cont(yld,0.01) AS p1, quantile_cont(yld,0.99) AS p99 FROM valid),
ranked AS (SELECT valid.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (yld-p1)/greatest(p99-p1,1e-6))) AS yn FROM valid, lim),
combined AS (SELECT *, prob*yn AS prod, 0.5*prob+0.5*yn AS mean2 FROM ranked)"""


@query("cross_status_summary", f"""
SELECT CASE WHEN prob IS NULL OR yld IS NULL THEN 'sin_dato' WHEN yld <= 0 THEN 'sin_ghi' ELSE 'valida' END AS status,
  count(*) AS n, min(yld) AS min, {M('avg(yld)')} AS mean, {M('quantile_cont(yld,0.5)')} AS p50,
  {M('quantile_cont(yld,0.9)')} AS p90, max(yld) AS max FROM cells GROUP BY 1""")
def cross_status_summary(t: Inputs):
    return rounded(R.summary(P.with_status(t.cells), "yld", by=["status"]), "mean", "p50", "p90")


@query("cross_ranking", RANKING + f"""
SELECT r, c, {M('yn')} AS yield_norm, {M('prod')} AS ranking, {M('mean2')} AS ranking_media,
  CASE WHEN prob >= 0.7 THEN yld END AS en_aptas FROM combined""")
def cross_ranking(t: Inputs):
    x = P.cross_layers(t.cells, 0.7)
    return rounded(x.select("r", "c", "yield_norm", "ranking", "ranking_media", "en_aptas"),
                   "yield_norm", "ranking", "ranking_media")


TOPS = """, k AS (SELECT greatest(1, CAST(round_even(0.01*count(*),0) AS BIGINT)) AS k FROM combined),
a AS (SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY prod DESC, cell) AS n FROM combined), k WHERE n <= k.k),
b AS (SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY mean2 DESC, cell) AS n FROM combined), k WHERE n <= k.k)"""


@query("cross_top_overlap", RANKING + TOPS + f"""
SELECT (SELECT k FROM k) AS k, count(*) AS n_common, {M('100.0*count(*)/(SELECT k FROM k)')} AS overlap_pct
FROM a JOIN b USING (cell)""")
def cross_top_overlap(t: Inputs):
    x = P.cross_layers(t.cells.withColumn("cell", F.col("r") * 100 + F.col("c")), 0.7)
    return rounded(R.overlap_of_tops(x, "ranking", "ranking_media", "cell"))


@query("cross_study", RANKING + TOPS + f""", rk AS (SELECT
  rank() OVER (ORDER BY prod) + (count(*) OVER (PARTITION BY prod)-1)/2.0 AS ra,
  rank() OVER (ORDER BY mean2) + (count(*) OVER (PARTITION BY mean2)-1)/2.0 AS rb FROM combined)
SELECT count(*) AS celdas_validas, (SELECT count(*) FROM cells WHERE prob IS NOT NULL AND yld <= 0) AS celdas_sin_ghi,
  count(*) FILTER (prob>=0.5) AS celdas_aptas, {M('100.0*count(*) FILTER (prob>=0.5)/count(*)')} AS pct_aptas,
  {M('avg(yld)')} AS region_media, {M('quantile_cont(yld,0.5)')} AS region_p50, {M('quantile_cont(yld,0.9)')} AS region_p90,
  {M('avg(yld) FILTER (prob>=0.5)')} AS aptas_media, {M('quantile_cont(yld,0.5) FILTER (prob>=0.5)')} AS aptas_p50,
  {M('quantile_cont(yld,0.9) FILTER (prob>=0.5)')} AS aptas_p90,
  {M('100.0*(avg(yld) FILTER (prob>=0.5)/avg(yld)-1.0)')} AS ganancia_pct, (SELECT {M('corr(ra,rb)')} FROM rk) AS rho_formula,
  (SELECT {M('100.0*count(*)/(SELECT k FROM k)')} FROM a JOIN b USING (cell)) AS overlap_top1_pct FROM combined""")
def cross_study(t: Inputs):
    return rounded(P.cross_study(t.cells.withColumn("cell", F.col("r") * 100 + F.col("c")), 0.5, "cell"))


@query("cross_guarded_correlation", """, rk AS (SELECT
  rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob)-1)/2.0 AS ra,
  rank() OVER (ORDER BY yld) + (count(*) OVER (PARTITION BY yld)-1)/2.0 AS rb FROM cells WHERE prob>=0.5 AND yld>0)
""" + f"SELECT count(*) AS n, {M('corr(ra,rb)')} AS rho FROM rk")
def cross_guarded_correlation(t: Inputs):
    x = t.cells.where((F.col("prob") >= 0.5) & (F.col("yld") > 0))
    return rounded(P.correlation_guarded(x, "prob", "yld").drop("p"))


# -- profiles -----------------------------------------------------------------------

BENEFIT = {"ghi": True, "slope": False, "elev": False}
WEIGHTS = {"ghi": 0.5, "slope": 0.3, "elev": 0.2}
NORMS = """, lim AS (SELECT min(ghi) g0, max(ghi) g1, min(slope) s0, max(slope) s1, min(elev) e0, max(elev) e1 FROM cells),
norms AS (SELECT cells.*, (ghi-g0)/(g1-g0) AS n_ghi, (s1-slope)/(s1-s0) AS n_slope, (e1-elev)/(e1-e0) AS n_elev FROM cells, lim)"""


@query("minmax_cost_benefit", NORMS + f"SELECT r, c, {M('n_ghi')} AS n_ghi, {M('n_slope')} AS n_slope, {M('n_elev')} AS n_elev FROM norms")
def minmax_cost_benefit(t: Inputs):
    return rounded(U.normalised(t.cells, BENEFIT).select("r", "c", "n_ghi", "n_slope", "n_elev"))


@query("wlc_profile", NORMS + f"""
SELECT r, c, {M('CASE WHEN (r*100+c) % 13 = 0 THEN 0.0 ELSE 0.5*n_ghi+0.3*n_slope+0.2*n_elev END')} AS perfil FROM norms""")
def wlc_profile(t: Inputs):
    gone = t.cells.where((F.col("r") * 100 + F.col("c")) % 13 == 0)
    return rounded(U.profile(t.cells, BENEFIT, WEIGHTS, "perfil", gone).select("r", "c", "perfil"))


PROFILES = """, q AS (SELECT r, c, prob AS conservador, (ghi-slope)/300.0 AS balanceado, 1.0-elev/5000.0 AS agresivo FROM cells)"""


def _profiles(t: Inputs):
    return t.cells.select("r", "c", F.col("prob").alias("conservador"),
                          ((F.col("ghi") - F.col("slope")) / 300.0).alias("balanceado"),
                          (1.0 - F.col("elev") / 5000.0).alias("agresivo"))


NAMES = ("conservador", "balanceado", "agresivo")


FLAGGED = PROFILES + """, th AS (SELECT quantile_cont(conservador,0.9) a, quantile_cont(balanceado,0.9) b, quantile_cont(agresivo,0.9) g FROM q),
f AS (SELECT (conservador>=a)::INT AS x, (balanceado>=b)::INT AS y, (agresivo>=g)::INT AS z FROM q, th),
n AS (SELECT k AS consenso, count(f.x) AS celdas, 100.0*count(f.x)/(SELECT count(*) FROM q) AS pct FROM (SELECT unnest([0,1,2,3]) AS k) LEFT JOIN f ON x+y+z=k GROUP BY k)"""


@query("consensus_counts", FLAGGED + f" SELECT consenso, celdas, {M('pct')} AS pct FROM n")
def consensus_counts(t: Inputs):
    return rounded(P.consensus_counts(P.consensus_cells(_profiles(t), NAMES, 90.0), NAMES))


@query("consensus_profiles", FLAGGED + f""" SELECT unnest(['conservador','balanceado','agresivo']) AS perfil, unnest([{M('any_value(a)')},{M('any_value(b)')},{M('any_value(g)')}]) AS umbral,
 unnest([sum(x),sum(y),sum(z)])::BIGINT AS celdas_aptas, (SELECT count(*) FROM q) AS celdas_validas FROM f, th""")
def consensus_profiles(t: Inputs):
    return rounded(P.consensus_profiles(P.consensus_cells(_profiles(t), NAMES, 90.0), NAMES, 90.0))


@query("consensus_reading", FLAGGED + """ SELECT printf('%.2f%% apta en los 3 perfiles (consenso); %.2f%% solo en algunos (divergencia)',
 round(sum(CASE WHEN consenso=3 THEN celdas ELSE 0 END)*100.0/sum(celdas),2), round(sum(CASE WHEN consenso IN (1,2) THEN celdas ELSE 0 END)*100.0/sum(celdas),2)) AS lectura FROM n""")
def consensus_reading(t: Inputs):
    return P.consensus_reading(P.consensus_counts(P.consensus_cells(_profiles(t), NAMES, 90.0), NAMES), NAMES)


@query("consensus_rank_corr", PROFILES + f""", k AS (SELECT
  rank() OVER (ORDER BY conservador)+(count(*) OVER (PARTITION BY conservador)-1)/2.0 AS a,
  rank() OVER (ORDER BY balanceado)+(count(*) OVER (PARTITION BY balanceado)-1)/2.0 AS b,
  rank() OVER (ORDER BY agresivo)+(count(*) OVER (PARTITION BY agresivo)-1)/2.0 AS g FROM q)
SELECT 'conservador_vs_balanceado' AS par, {M('corr(a,b)')} AS rho FROM k UNION ALL
SELECT 'conservador_vs_agresivo', {M('corr(a,g)')} FROM k UNION ALL SELECT 'balanceado_vs_agresivo', {M('corr(b,g)')} FROM k""")
def consensus_rank_corr(t: Inputs):
    return rounded(P.profile_correlations(_profiles(t), NAMES))


# -- mounts ---------------------------------------------------------------------------

MOUNT = """, m AS (SELECT *, yld_tracker/yld-1.0 AS gain,
  floor(x/30000.0)*1000003+floor(y/30000.0) AS block, 1200.0::DOUBLE + c AS flat FROM centred WHERE yld>0 AND yld_tracker>0 AND prob>=0.4)"""


@query("mount_gain", MOUNT + f"""SELECT r, c, {M('100.0*gain')} AS gain_pct FROM m""")
def mount_gain(t: Inputs):
    x = P.mount_cells(t.cells, 0.4, "yld", "yld_tracker")
    return rounded(x.select("r", "c", (100.0 * F.col("gain")).alias("gain_pct")))


@query("mount_block_median", MOUNT + f""", b AS (SELECT block, avg(gain) g FROM m GROUP BY 1)
SELECT count(*) AS n_bloques, {M('100.0*quantile_cont(g,0.5)')} AS mediana_pct FROM b""")
def mount_block_median(t: Inputs):
    x = P.mount_cells(t.cells, 0.4, "yld", "yld_tracker")
    b = x.groupBy(K.block_number(t.grid.x(), t.grid.y(), 30000.0).alias("block")).agg(F.avg("gain").alias("g"))
    return rounded(R.summary(b, "g", probs={"m": 0.5}).select(
        F.col("n").alias("n_bloques"), (100.0 * F.col("m")).alias("mediana_pct")))


@query("mount_study", MOUNT + f""", b AS (SELECT block, avg(gain) g FROM m GROUP BY 1)
SELECT count(*) AS celdas_aptas, {M('avg(yld)')} AS media_fijo, {M('avg(yld_tracker)')} AS media_seguidor,
  {M('100.0*(avg(yld_tracker)/avg(yld)-1)')} AS ganancia_media_pct, {M('100.0*quantile_cont(gain,0.5)')} AS ganancia_mediana_celda_pct,
  {M('100.0*(avg(yld)/avg(flat)-1)')} AS ganancia_fijo_vs_plano_pct, {M('100.0*(avg(yld_tracker)/avg(flat)-1)')} AS ganancia_seguidor_vs_plano_pct,
  (SELECT {M('100.0*quantile_cont(g,0.5)')} FROM b) AS ganancia_mediana_bloque_pct, (SELECT count(*) FROM b) AS n_bloques,
  format('seguidor {{:+.1f}}% sobre fijo; {{}}; {{}} bloques', 100.0*(avg(yld_tracker)/avg(yld)-1),
    CASE WHEN abs(100.0*(avg(yld_tracker)/avg(flat)-1)-36.0)<=5.0 THEN 'concuerda con la referencia'
         WHEN 100.0*(avg(yld_tracker)/avg(flat)-1)<36.0 THEN 'por debajo de la referencia' ELSE 'por encima de la referencia' END,
    (SELECT count(*) FROM b)) AS lectura FROM m""")
def mount_study(t: Inputs):
    x = t.cells.withColumn("flat", F.lit(1200.0) + F.col("c"))
    return rounded(P.mount_study(x, t.grid, 0.4, "yld", "yld_tracker", "flat"))


# -- regions, infrastructure text ---------------------------------------------------------

REGION_SQL = ", a AS (SELECT n_nationkey, ' ' || lower(r_name) || ' ' AS single, n_name || ';' || lower(r_name) AS both_names FROM nation JOIN region ON n_regionkey=r_regionkey)"


def _codes(t: Inputs):
    return t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat(F.lit(" "), F.lower("r_name"), F.lit(" ")).alias("single"),
        F.concat("n_name", F.lit(";"), F.lower("r_name")).alias("both_names"))


@query("region_exact", REGION_SQL + " SELECT n_nationkey, single FROM a WHERE upper(trim(single)) IN ('ASIA','EUROPE')")
def region_exact(t: Inputs):
    return _codes(t).where(K.region_exact("single", ["ASIA", "EUROPE"])).select("n_nationkey", "single")


@query("region_compound", REGION_SQL + """ SELECT n_nationkey, both_names FROM a
WHERE list_has_any(list_transform(string_split(both_names,';'), lambda s: upper(trim(s))), ['ASIA','EUROPE'])""")
def region_compound(t: Inputs):
    return _codes(t).where(K.region_compound("both_names", ["ASIA", "EUROPE"])).select("n_nationkey", "both_names")


@query("region_filter_loss", REGION_SQL + """ SELECT count(*) FILTER (upper(trim(both_names)) IN ('ASIA','EUROPE')) AS n_exact,
 count(*) FILTER (list_has_any(list_transform(string_split(both_names,';'), lambda s: upper(trim(s))), ['ASIA','EUROPE'])) AS n_compound FROM a""")
def region_filter_loss(t: Inputs):
    return _codes(t).agg(F.count_if(K.region_exact("both_names", ["ASIA", "EUROPE"])).alias("n_exact"),
                         F.count_if(K.region_compound("both_names", ["ASIA", "EUROPE"])).alias("n_compound"))


@query("inherit_type", """, sto AS (SELECT c_custkey AS sto_id, ' se_' || (c_custkey % 300) || ' ' AS nombre_se FROM customer)
SELECT sto_id, coalesce(i.tipo,'S/I') AS tipo FROM sto LEFT JOIN
 (SELECT upper(trim(nombre)) k, arg_min(tipo, infra_id) tipo FROM infra GROUP BY 1) i ON i.k = upper(trim(nombre_se))""")
def inherit_type(t: Inputs):
    sto = t.table("customer").select(F.col("c_custkey").alias("sto_id"), F.concat(
        F.lit(" se_"), (F.col("c_custkey") % 300).cast("string"), F.lit(" ")).alias("nombre_se"))
    return I.inherit_type(sto, t.infra, "nombre_se", "nombre", "infra_id").select("sto_id", "tipo")


@query("exclude_dedicated", "SELECT infra_id, tipo FROM infra WHERE upper(trim(coalesce(tipo,''))) <> 'DEDICADO'")
def exclude_dedicated(t: Inputs):
    return I.exclude_dedicated(t.infra).select("infra_id", "tipo")


@query("visibility_variants", """SELECT 'todas' AS variante, count(*) AS n FROM infra UNION ALL
SELECT 'sin_dedicadas', count(*) FROM infra WHERE tipo<>'DEDICADO' UNION ALL
SELECT 'previas', count(*) FROM infra WHERE f_op <= DATE '1999-06-30' - INTERVAL 12 MONTH""")
def visibility_variants(t: Inputs):
    ref = F.to_date(F.lit("1999-06-30"))
    return t.infra.agg(*[F.count_if(K.visible(v, "tipo", "f_op", ref)).alias(v)
                         for v in ("todas", "sin_dedicadas", "previas")]).unpivot(
        [], ["todas", "sin_dedicadas", "previas"], "variante", "n")


@query("leak_controlled_layers", """SELECT 'subestaciones' AS capa, count(*) AS n FROM infra WHERE tipo<>'DEDICADO' UNION ALL
SELECT 'lineas', count(*) FROM lines WHERE tipo<>'DEDICADO' UNION ALL
SELECT 'almacenamiento', count(*) FROM customer WHERE coalesce((SELECT tipo FROM infra WHERE infra_id = c_custkey % 300),'S/I')<>'DEDICADO'""")
def leak_controlled_layers(t: Inputs):
    sto = t.table("customer").select(F.col("c_custkey").alias("sto_id"), F.concat(
        F.lit("SE_"), (F.col("c_custkey") % 300).cast("string")).alias("nombre_se"))
    out = I.leak_controlled({"subestaciones": t.infra, "lineas": t.lines, "almacenamiento": sto},
                            {"subestaciones": "infra_id"})
    parts = [df.agg(F.lit(k).alias("capa"), F.count(F.lit(1)).alias("n")) for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("parse_dates", """, d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S')||'-03:00'
 WHEN 1 THEN strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S')||'Z' WHEN 2 THEN strftime(o_orderdate,'%Y-%m-%d') ELSE 'sin fecha' END AS s FROM orders)
SELECT o_orderkey, strftime(CASE WHEN o_orderkey%4=3 THEN NULL WHEN o_orderkey%4=0 THEN strptime(s[1:19],'%Y-%m-%dT%H:%M:%S') + INTERVAL 3 HOUR
 WHEN o_orderkey%4=1 THEN strptime(s[1:19],'%Y-%m-%dT%H:%M:%S') ELSE strptime(s,'%Y-%m-%d') END, '%Y-%m-%d %H:%M:%S') AS f_utc FROM d""")
def parse_dates(t: Inputs):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    s = (F.when(k % 4 == 0, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00")))
         .when(k % 4 == 1, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
         .when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("sin fecha"))
    return t.table("orders").select("o_orderkey", F.date_format(K.parse_date(s), "yyyy-MM-dd HH:mm:ss").alias("f_utc"))


# -- filters, designs ------------------------------------------------------------------

@query("technical_filter", "SELECT r, c FROM cells WHERE ghi>=160 AND slope<=15 AND elev<=3500")
def technical_filter(t: Inputs):
    return t.cells.where(K.technical(160.0, 15.0, 3500.0)).select("r", "c")


CRITERIA = {"ghi_min": 160.0, "slope_max": 15.0, "elev_max": 3500.0, "dist_max": 60000.0}
CANDIDATES = """, cand AS (SELECT site_id, x, y, 140.0::DOUBLE+(site_id*29)%160 AS ghi, ((site_id*31)%300)/10.0::DOUBLE AS slope,
  100.0::DOUBLE+(site_id*211)%4200 AS elev FROM sites WHERE NOT is_pos),
full_net AS (SELECT site_id, min(sqrt((c.x-i.x)**2+(c.y-i.y)**2)) AS d FROM cand c, infra i GROUP BY 1),
free_net AS (SELECT site_id, min(sqrt((c.x-i.x)**2+(c.y-i.y)**2)) AS d FROM cand c, infra i WHERE tipo<>'DEDICADO' GROUP BY 1),
known AS (SELECT cand.*, full_net.d AS dist_criterion, free_net.d AS dist_transmision FROM cand JOIN full_net USING(site_id) JOIN free_net USING(site_id))"""


def _candidates(t: Inputs):
    from ..operators.nearest import nearest

    k = F.col("site_id")
    cand = t.sites.where(~F.col("is_pos")).select(
        k, "x", "y", (F.lit(140.0) + (k * 29) % 160).alias("ghi"), (((k * 31) % 300) / 10.0).alias("slope"),
        (F.lit(100.0) + (k * 211) % 4200).alias("elev"))
    full = nearest(cand, t.infra, "site_id", "infra_id").select("site_id", F.col("dist").alias("dist_criterion"))
    free = nearest(cand, I.exclude_dedicated(t.infra), "site_id", "infra_id").select(
        "site_id", F.col("dist").alias("dist_transmision"))
    return cand.join(full, "site_id").join(free, "site_id")


_DESIGN_SQL = {
    "ahp_filtrado": "ghi>=160 AND slope<=15 AND elev<=3500 AND dist_criterion<=60000",
    "fondo_aleatorio": "true",
    "sin_filtros_geofisicos": "dist_criterion<=60000",
    "grupo_objetivo": "dist_criterion<=20000",
}


def _design(name: str):
    sql = CANDIDATES + f" SELECT site_id, {M('dist_transmision')} AS dist_transmision FROM known WHERE {_DESIGN_SQL[name]}"

    @query(f"negatives_{name}", sql)
    def run(t: Inputs):
        c = _candidates(t)
        if name == "grupo_objetivo":  # the domain: within the target-group radius of the network
            c = c.where(F.col("dist_criterion") <= 20000.0)
        kept = S.negatives(c, name, CRITERIA, "dist_criterion")
        return rounded(kept.select("site_id", "dist_transmision"))


for _name in S.STRATEGIES:
    _design(_name)


# -- units, display, compliance -----------------------------------------------------------

@query("irradiance_units", f"SELECT r, c, CASE WHEN yld>0 THEN {M('yld/365.0')} END AS ghi_dia FROM cells")
def irradiance_units(t: Inputs):
    live = t.cells.select("r", "c", K.missing_if_no_signal("yld").alias("v"))
    med = R.quantiles(live, "v", {"m": 0.5}).scalar()
    return rounded(live.select("r", "c", K.daily_unit("v", med).alias("ghi_dia")))


@query("display_stretch", f""", lim AS (SELECT quantile_cont(yld,0.02) lo, quantile_cont(yld,0.98) hi FROM cells)
SELECT r, c, CASE WHEN yld>=1600 THEN {M('greatest(0,least(1,(yld-lo)/(hi-lo)))')} END AS shade FROM cells, lim""")
def display_stretch(t: Inputs):
    return rounded(U.stretched(t.cells, "yld", "percentile", 1600.0).select("r", "c", "shade"))


@query("shared_limits", f"""SELECT {M('quantile_cont(v,0.02)')} AS lo, {M('quantile_cont(v,0.98)')} AS hi
FROM (SELECT yld AS v FROM cells UNION ALL SELECT yld_tracker FROM cells)""")
def shared_limits(t: Inputs):
    return rounded(U.shared_limits([t.cells.select(F.col("yld").alias("v")),
                                    t.cells.select(F.col("yld_tracker").alias("v"))], "v"))


@query("compliance_ratio", f"""SELECT site_id, {M("CASE WHEN site_id%2=0 THEN prob/0.7 ELSE least(coalesce(0.15/nullif(prob,0),8.0),8.0) END")} AS ratio FROM sites""")
def compliance_ratio(t: Inputs):
    even = F.col("site_id") % 2 == 0
    way = F.when(even, "mayor").otherwise("menor")
    return rounded(t.sites.select("site_id", K.compliance("prob", F.when(even, 0.7).otherwise(0.15), way).alias("ratio")))


@query("northness", f"SELECT r, c, {M('cos(radians(aspect))')} AS northness FROM cells")
def northness(t: Inputs):
    return rounded(t.cells.select("r", "c", K.northness("aspect").alias("northness")))


@query("footprint_radius", f"SELECT site_id, {M('sqrt(greatest(coalesce(mw,0),0)*2.0*1e4/pi())')} AS radius FROM sites")
def footprint_radius(t: Inputs):
    return rounded(t.sites.select("site_id", K.footprint_radius("mw", 2.0).alias("radius")))


@query("footprint_ceilings", f""", h AS (SELECT unnest([1.45,2.0,2.25,2.95,3.6])::DOUBLE AS ha_mw), m AS (SELECT count(*) n, sum(mw) mw FROM sites)
SELECT n, mw, ha_mw, {M('mw*ha_mw/100.0')} AS huella_km2, {M('least(100.0,100.0*mw*ha_mw/100.0/(203000.0*1.0/100.0))')} AS techo_pct FROM m, h""")
def footprint_ceilings(t: Inputs):
    return rounded(P.footprint_ceilings(t.sites, "mw", 203000.0, [1.45, 2.0, 2.25, 2.95, 3.6]), "huella_km2", "techo_pct")


# -- blocks and coordinates ----------------------------------------------------------------

@query("block_ids", """SELECT site_id, concat_ws('_', region_id::VARCHAR, floor(x/30000.0)::BIGINT::VARCHAR, floor(y/30000.0)::BIGINT::VARCHAR) AS block_label,
 (floor(x/30000.0)*1000003+floor(y/30000.0))::BIGINT AS block_number FROM sites""")
def block_ids(t: Inputs):
    return t.sites.select("site_id", K.block_label("region_id", "x", "y", 30000.0).alias("block_label"),
                          K.block_number("x", "y", 30000.0).alias("block_number"))


@query("block_means", f"""SELECT (floor(x/15000.0)*1000003+floor(y/15000.0))::BIGINT AS block, count(*) AS n, {M('avg(prob)')} AS prob, {M('avg(yld)')} AS yld
FROM centred GROUP BY 1""")
def block_means(t: Inputs):
    return rounded(t.cells.groupBy(K.block_number(t.grid.x(), t.grid.y(), 15000.0).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("prob"), F.avg("yld").alias("yld")))


LONLAT = ", g AS (SELECT site_id, -72.0::DOUBLE + (site_id % 6000)/1000.0::DOUBLE AS lon, -29.5::DOUBLE + (site_id*7 % 12000)/1000.0::DOUBLE AS lat FROM sites)"


def _lonlat(t: Inputs):
    k = F.col("site_id")
    return t.sites.select("site_id", (F.lit(-72.0) + (k % 6000) / 1000.0).alias("lon"),
                          (F.lit(-29.5) + (k * 7 % 12000) / 1000.0).alias("lat"))


def _utm_sql() -> str:
    a = K.ALPHA
    e = " + ".join(f"({a[j]!r})*cos({2*(j+1)}*xi)*(exp({2*(j+1)}*eta)-exp(-{2*(j+1)}*eta))/2.0" for j in range(3))
    n = " + ".join(f"({a[j]!r})*sin({2*(j+1)}*xi)*(exp({2*(j+1)}*eta)+exp(-{2*(j+1)}*eta))/2.0" for j in range(3))
    at = lambda v: f"0.5*ln((1+({v}))/(1-({v})))"
    ecc = 2 * (K._N ** 0.5) / (1 + K._N)
    return LONLAT + f""", s AS (SELECT site_id, radians(lon-(-69.0)) AS l, sin(radians(lat)) AS sp FROM g),
u AS (SELECT site_id, l, {at('sp')} - {ecc!r}*{at(f'{ecc!r}*sp')} AS q FROM s),
w AS (SELECT site_id, l, (exp(q)-exp(-q))/2.0 AS t FROM u),
v AS (SELECT site_id, atan2(t, cos(l)) AS xi, {at('sin(l)/sqrt(1+t*t)')} AS eta FROM w)
SELECT site_id, floor((500000.0+{K.UTM_K0*K._BIG_A!r}*(eta + {e}))*1e3+0.5)/1e3 AS x,
 floor((1e7+{K.UTM_K0*K._BIG_A!r}*(xi + {n}))*1e3+0.5)/1e3 AS y FROM v"""


@query("utm_project", _utm_sql())
def utm_project(t: Inputs):
    x, y = K.utm_xy("lon", "lat", 19, True)
    mm = lambda c: F.floor(c * 1e3 + 0.5) / F.lit(1e3)
    return _lonlat(t).select("site_id", mm(x).alias("x"), mm(y).alias("y"))


@query("mercator_project", LONLAT + """ SELECT site_id, floor(6378137.0*radians(lon)*1e3+0.5)/1e3 AS x,
 floor(6378137.0*ln(tan(pi()/4+radians(lat)/2))*1e3+0.5)/1e3 AS y FROM g""")
def mercator_project(t: Inputs):
    x, y = K.mercator_xy("lon", "lat")
    mm = lambda c: F.floor(c * 1e3 + 0.5) / F.lit(1e3)
    return _lonlat(t).select("site_id", mm(x).alias("x"), mm(y).alias("y"))


# -- set operations ---------------------------------------------------------------------------

@query("mask_sets", """, a AS (SELECT r,c FROM cells WHERE prob>=0.5), b AS (SELECT r,c FROM cells WHERE ghi>=220),
u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
SELECT 'union' AS op, count(*) AS n, sum(r*100+c)::BIGINT AS s FROM u UNION ALL SELECT 'interseccion', count(*), sum(r*100+c)::BIGINT FROM i
UNION ALL SELECT 'diferencia', count(*), sum(r*100+c)::BIGINT FROM d""")
def mask_sets(t: Inputs):
    a = t.cells.where("prob >= 0.5").select("r", "c")
    b = t.cells.where("ghi >= 220").select("r", "c")
    row = lambda n, d: d.agg(F.lit(n).alias("op"), F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * 100 + F.col("c")).alias("s"))
    return row("union", a.union(b).distinct()).union(row("interseccion", a.intersect(b))).union(
        row("diferencia", a.join(b, ["r", "c"], "left_anti")))


@query("sample_union", """SELECT clase, count(*) AS n, sum(site_id)::BIGINT AS s FROM (SELECT site_id, 1 AS clase FROM sites WHERE is_pos
UNION ALL SELECT site_id, 0 FROM sites WHERE NOT is_pos) GROUP BY 1""")
def sample_union(t: Inputs):
    pos = t.sites.where("is_pos").select("site_id", F.lit(1).alias("clase"))
    neg = t.sites.where("not is_pos").select("site_id", F.lit(0).alias("clase"))
    return pos.unionByName(neg, allowMissingColumns=True).groupBy("clase").agg(
        F.count(F.lit(1)).alias("n"), F.sum("site_id").alias("s"))


@query("layer_extent", """SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM (SELECT x,y FROM sites UNION ALL SELECT x,y FROM infra)""")
def layer_extent(t: Inputs):
    return U.extent([t.sites, t.infra])


@query("low_values_masked", "SELECT r, c, CASE WHEN slope>10 THEN slope END AS slope FROM cells WHERE r BETWEEN 2 AND 40 AND c BETWEEN 5 AND 60")
def low_values_masked(t: Inputs):
    return t.cells.where(F.col("r").between(2, 40) & F.col("c").between(5, 60)).select(
        "r", "c", F.when(F.col("slope") > 10, F.col("slope")).alias("slope"))
