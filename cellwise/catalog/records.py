"""Validation of records, audit, exports and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import quality as Q
from ..operators import ranks as R
from ..sources import sinks
from .base import M, Inputs, query, rounded
from .spatial import GREEDY

RULES = Q.Rules(bounds_utm=(150000.0, 850000.0, 6100000.0, 8400000.0), slope_max=25.0, prob_min=0.3, duplicate_m=20000.0)

REC = """, rec AS (SELECT site_id, CASE WHEN site_id%97=5 THEN NULL ELSE x END AS x, CASE WHEN site_id%89=7 THEN 'inf'::DOUBLE ELSE y END AS y,
 ((site_id*31)%300)/10.0::DOUBLE AS slope, 100.0::DOUBLE+(site_id*211)%4200 AS elev, CASE WHEN site_id%11=3 THEN NULL ELSE 140.0::DOUBLE+(site_id*29)%160 END AS ghi, prob AS probabilidad FROM sites),
sitesx AS (SELECT site_id, x, y FROM rec WHERE x IS NOT NULL)"""
# the greedy pass visits every record with a point, whatever its other reasons
GREEDY_REC = GREEDY.replace("FROM step JOIN sites ON sites.site_id = step.i", "FROM step JOIN recx ON recx.pos = step.i")
GREEDY_REC = (REC + ", recx AS (SELECT *, row_number() OVER (ORDER BY site_id)-1 AS pos FROM sitesx)" + GREEDY_REC).replace(
    "CASE WHEN len(near)>0 THEN near[1].k ELSE -1 END", "CASE WHEN len(near)>0 THEN near[1].k ELSE -1 END").replace(
    "dup AS (SELECT i-1 AS site_id, dead AS kept FROM step WHERE dead >= 0)",
    "dup AS (SELECT recx.site_id, dead AS kept FROM step JOIN recx ON recx.pos = i-1 WHERE dead >= 0)")

VALIDATED = GREEDY_REC + """, inz AS (SELECT site_id, zone_id FROM rec, zone_edges WHERE (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY ALL HAVING count(*)%2=1),
dist AS (SELECT d.site_id, d.kept, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM dup d JOIN rec a ON a.site_id=d.site_id JOIN rec b ON b.site_id=d.kept),
val AS (SELECT r.site_id, list_filter([
 CASE WHEN x IS NULL OR y IS NULL THEN 'GEOMETRIA_NULA_O_VACIA' END,
 CASE WHEN x IS NOT NULL AND isinf(y) THEN 'COORDENADAS_NAN_O_INF' END,
 CASE WHEN x IS NOT NULL AND NOT isinf(y) AND NOT x BETWEEN 150000.0 AND 850000.0 THEN printf('EASTING_UTM_FUERA_DE_RANGO (%.1f no en [150000.0, 850000.0])', x) END,
 CASE WHEN x IS NOT NULL AND NOT isinf(y) AND NOT y BETWEEN 6100000.0 AND 8400000.0 THEN printf('NORTHING_UTM_FUERA_DE_RANGO (%.1f no en [6100000.0, 8400000.0])', y) END,
 CASE WHEN x IS NOT NULL AND r.site_id NOT IN (SELECT site_id FROM inz WHERE zone_id < 20) THEN 'FUERA_DE_REGION_DE_ESTUDIO' END,
 CASE WHEN r.site_id IN (SELECT site_id FROM inz WHERE zone_id%6=1) THEN 'INTERSECTA_ZONA_EXCLUSION_SNAP' END,
 CASE WHEN r.site_id IN (SELECT site_id FROM inz WHERE zone_id%7=2) THEN 'INTERSECTA_ZONA_EXCLUSION_LAGOS' END,
 CASE WHEN slope > 25 THEN printf('PENDIENTE_EXCEDE_MAXIMA (%.1f° > 25.0°)', slope) END,
 CASE WHEN elev > 3500 THEN printf('ELEVACION_EXCEDE_MAXIMA (%.0fm > 3500.0m)', elev) END,
 CASE WHEN ghi < 160 THEN printf('GHI_BAJO_MINIMO (%.1f < 160.0)', ghi) END,
 CASE WHEN probabilidad < 0.3 THEN 'APTITUD_BAJO_UMBRAL' END,
 CASE WHEN kept IS NOT NULL THEN printf('DUPLICADO_ESPACIAL (a %.1fm del objeto index=%d)', floor(d*10+0.5)/10, kept) END], lambda v: v IS NOT NULL) AS reasons
 FROM rec r LEFT JOIN dist ON dist.site_id=r.site_id)"""


def _records(t: Inputs):
    k = F.col("site_id")
    return t.sites.select(
        k, F.when(k % 97 != 5, F.col("x")).alias("x"), F.when(k % 89 == 7, F.lit(float("inf"))).otherwise(F.col("y")).alias("y"),
        (((k * 31) % 300) / 10.0).alias("slope"), (F.lit(100.0) + (k * 211) % 4200).alias("elev"),
        F.when(k % 11 != 3, F.lit(140.0) + (k * 29) % 160).alias("ghi"), F.col("prob").alias("probabilidad"))


def _validated(t: Inputs):
    z = t.zone_edges
    return Q.validate_sites(_records(t), "site_id", RULES, z.where("zone_id < 20"),
                            {"snap": z.where("zone_id % 6 = 1"), "lagos": z.where("zone_id % 7 = 2")})


@query("validate_sites", VALIDATED + """ SELECT site_id, len(reasons)=0 AS es_valido,
 CASE WHEN len(reasons)=0 THEN 'OK' ELSE array_to_string(reasons,'; ') END AS motivos FROM val""", recursive=True)
def validate_sites(t: Inputs):
    # two-decimal detail is left out: the engines round ties of binary fractions differently
    m = F.regexp_replace("motivos_rechazo", r"APTITUD_BAJO_UMBRAL \([^)]*\)", "APTITUD_BAJO_UMBRAL")
    return _validated(t).select("site_id", "es_valido", m.alias("motivos"))


@query("reason_histogram", VALIDATED + " SELECT split_part(m,' (',1) AS motivo, count(*) AS n FROM (SELECT unnest(reasons) AS m FROM val) GROUP BY 1", recursive=True)
def reason_histogram(t: Inputs):
    return Q.reason_histogram(_validated(t))


@query("audit_report", VALIDATED + f""" SELECT count(*) AS total, count(*) FILTER (len(reasons)=0) AS validos, count(*) FILTER (len(reasons)>0) AS rechazados,
 {M('100.0*count(*) FILTER (len(reasons)=0)/count(*)')} AS pct_aprobacion FROM val""", recursive=True)
def audit_report(t: Inputs):
    return rounded(Q.audit(_validated(t)))


@query("valid_split", VALIDATED + """ SELECT 'valid' AS part, count(*) AS n, sum(site_id)::BIGINT AS s FROM val WHERE len(reasons)=0 UNION ALL SELECT 'invalid', count(*), sum(site_id)::BIGINT FROM val WHERE len(reasons)>0""", recursive=True)
def valid_split(t: Inputs):
    ok, bad = sinks.split_valid(_validated(t))
    row = lambda n, d: d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("site_id").alias("s"))
    return row("valid", ok).union(row("invalid", bad))


@query("geographic_rules", """, g AS (SELECT site_id, -74.0::DOUBLE + (site_id % 9000)/1000.0::DOUBLE AS lon, -31.0::DOUBLE + (site_id*7 % 15000)/1000.0::DOUBLE AS lat FROM sites)
SELECT site_id, concat_ws('; ', CASE WHEN NOT lon BETWEEN -72.5 AND -66.5 THEN printf('LONGITUD_FUERA_DE_RANGO (%.4f no en [-72.5, -66.5])', lon) END,
 CASE WHEN NOT lat BETWEEN -30.0 AND -17.0 THEN printf('LATITUD_FUERA_DE_RANGO (%.4f no en [-30.0, -17.0])', lat) END) AS motivos FROM g""")
def geographic_rules(t: Inputs):
    k = F.col("site_id")
    g = t.sites.select(k, (F.lit(-74.0) + (k % 9000) / 1000.0).alias("x"), (F.lit(-31.0) + (k * 7 % 15000) / 1000.0).alias("y"))
    return Q.validate_rows(g, Q.Rules(geographic=True)).select("site_id", F.array_join("reasons", "; ").alias("motivos"))


@query("ring_check", """, p AS (SELECT n_nationkey AS id, n_nationkey%3 AS kind, n_nationkey*1000.0 AS x FROM nation)
SELECT id, kind=0 AS usable, CASE kind WHEN 0 THEN 10000.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS area FROM p""")
def ring_check(t: Inputs):
    from ..operators.polygons import ring_area, ring_ok

    n = F.col("n_nationkey")
    x = n * F.lit(1000.0)
    pt = lambda dx, dy: F.struct((x + dx).alias("x"), F.lit(float(dy)).alias("y"))
    square = F.array(pt(0, 0), pt(100, 0), pt(100, 100), pt(0, 100), pt(0, 0))
    flat = F.array(pt(0, 0), pt(100, 0), pt(50, 0), pt(0, 0))
    short = F.array(pt(0, 0), pt(100, 0), pt(0, 0))
    ring = F.when(n % 3 == 0, square).when(n % 3 == 1, flat).otherwise(short)
    return t.table("nation").select(n.alias("id"), ring_ok(ring).alias("usable"), F.abs(ring_area(ring)).alias("area"))


_TABLE = "public.instalaciones_solares_optimas"


@query("insert_sql", f"""SELECT 1 AS part, lpad(site_id::VARCHAR, 8, '0') AS line, 'INSERT INTO {_TABLE} (site_id, probabilidad, area_m2, ghi, slope, elev, es_valido, fecha_validacion, geom) VALUES (''S' || site_id ||
 ''', ' || CASE WHEN site_id%2=0 THEN '0.5000' ELSE '0.7500' END || ', 15000.00, ' || CASE WHEN site_id%3=0 THEN 'NULL' ELSE printf('%.2f', 140.0+(site_id*29)%160) END || ', NULL, NULL, TRUE, ''2024-01-01T00:00:00'', ST_SetSRID(ST_GeomFromText(''POINT (' ||
 x::BIGINT || ' ' || y::BIGINT || ')''), 32719));' AS value FROM sites""")
def insert_sql(t: Inputs):
    k = F.col("site_id")
    df = t.sites.select(
        F.concat(F.lit("S"), k.cast("string")).alias("site_id"), F.lpad(k.cast("string"), 8, "0").alias("ord"),
        F.when(k % 2 == 0, 0.5).otherwise(0.75).alias("probabilidad"), F.lit(15000.0).alias("area_m2"),
        F.when(k % 3 != 0, F.lit(140.0) + (k * 29) % 160).alias("ghi"), F.lit(True).alias("es_valido"),
        F.lit("2024-01-01T00:00:00").alias("fecha_validacion"), "x", "y")
    return sinks.to_insert_sql(df, order="ord").where("part = 1")


@query("reconcile", "SELECT count(DISTINCT region_id) AS n, 0::BIGINT AS n_unmatched, 0.0::DOUBLE AS max_diff FROM sites")
def reconcile(t: Inputs):
    control = t.table("customer").groupBy(F.col("c_nationkey").alias("region_id")).agg(F.sum(F.lit(1) + F.col("c_custkey") % 250).cast("double").alias("mw"))
    return Q.reconcile(t.sites.groupBy("region_id").agg(F.sum("mw").alias("mw")), control, ["region_id"], "mw", 1e-6)


@query("layer_in_system", f"""SELECT site_id, {M('-70.0 + (x-500000.0)/1e6')} AS lon0, true AS same_place, true AS moved_back FROM sites""")
def layer_in_system(t: Inputs):
    # degrees to zone 19 and from zone 18 to zone 19 meet in the same place; a layer without a system stays as it is
    lon, lat = F.lit(-70.0) + (F.col("x") - 500000.0) / 1e6, F.lit(-25.0) + (F.col("y") - 7000000.0) / 1e6
    s = t.sites.select("site_id", lon.alias("lon"), lat.alias("lat"), lon.alias("x"), lat.alias("y"))
    east = Q.in_system(s, 4326, 32719)
    zone18 = Q.in_system(s, 4326, 32718).select("site_id", "x", "y")
    again = Q.in_system(zone18, 32718, 32719).select("site_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    same = Q.in_system(Q.in_system(east, None, 32719), 32719, 32719).select("site_id", F.col("x").alias("x3"))
    both = east.join(again, "site_id").join(same, "site_id")
    near = (F.abs(F.col("x") - F.col("x2")) < 0.05) & (F.abs(F.col("y") - F.col("y2")) < 0.05)
    return both.select("site_id", K.micro(F.col("lon")).alias("lon0"), near.alias("same_place"), (F.col("x") == F.col("x3")).alias("moved_back"))


@query("report_json", """SELECT '{"region_id":' || region_id || ',"n":' || count(*) || ',"mw":' || sum(mw)::BIGINT || '}' AS value FROM sites GROUP BY region_id""")
def report_json(t: Inputs):
    return sinks.to_report(t.sites.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mw").cast("bigint").alias("mw")))


@query("bundle_json", """SELECT '{"sitios":{"n":' || (SELECT count(*) FROM sites) || '},"red":{"n":' || (SELECT count(*) FROM infra) || ',"tipos":' || (SELECT count(DISTINCT tipo) FROM infra) || '}}' AS value""")
def bundle_json(t: Inputs):
    return sinks.bundle({"sitios": t.sites.agg(F.count(F.lit(1)).alias("n")),
                         "red": t.infra.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tipo").alias("tipos"))})


@query("clean_bands", "SELECT r, c, CASE WHEN (r*100+c)%9 IN (0,1) THEN NULL ELSE elev END AS elev FROM cells")
def clean_bands(t: Inputs):
    k = (F.col("r") * 100 + F.col("c")) % 9
    raw = F.when(k == 0, -9999.0).when(k == 1, float("nan")).otherwise(F.col("elev"))
    return t.cells.select("r", "c", K.clean_band(raw).alias("elev"))


@query("range_check", f"""SELECT count(*) FILTER (x BETWEEN 100000 AND 900000 AND y BETWEEN 6000000 AND 8500000) AS n_in, count(*) AS n, {M('quantile_cont(x,0.5)')} AS mid FROM sites""")
def range_check(t: Inputs):
    ok = Q.validate_rows(t.sites.select("site_id", "x", "y")).agg(
        F.count_if(F.size("reasons") == 0).alias("n_in"), F.count(F.lit(1)).alias("n"))
    return rounded(ok.withColumn("mid", R.quantiles(t.sites, "x", {"m": 0.5}).scalar()))
