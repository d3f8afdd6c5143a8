"""Point, line and polygon joins; infrastructure distances; duplicates; sampling domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import infrastructure as I
from ..operators import polygons as P
from ..operators import proximity as X
from ..operators import sampling as S
from ..operators.nearest import nearest, nearest_distance, within
from ..operators.ranks import summary
from ..runtime import cut
from ..sources import readers
from .base import M, Inputs, query, rounded

D_POINT = "sqrt((s.x-i.x)*(s.x-i.x)+(s.y-i.y)*(s.y-i.y))"
BEST_POINT = f""", near AS (SELECT site_id, s.region_id AS site_region, i.region_id AS infra_region, infra_id, tipo, f_op, f_ref, is_pos, {D_POINT} AS dist FROM sites s, infra i
 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {D_POINT}, infra_id) = 1)"""


@query("nearest_point", BEST_POINT + f" SELECT site_id, {M('dist')} AS dist FROM near")
def nearest_point(t: Inputs):
    return rounded(nearest(t.sites, t.infra, "site_id", "infra_id").select("site_id", "dist"))


@query("nearest_join_attrs", BEST_POINT + f" SELECT site_id, infra_id, tipo, {M('dist')} AS dist FROM near")
def nearest_join_attrs(t: Inputs):
    return rounded(nearest(t.sites, t.infra, "site_id", "infra_id", attrs=["tipo"]).select("site_id", "infra_id", "tipo", "dist"))


@query("nearest_describe", BEST_POINT + f""" SELECT count(*) AS n, {M('min(dist)/1000')} AS min_km, {M('avg(dist)/1000')} AS mean_km, {M('quantile_cont(dist,0.5)/1000')} AS p50_km, {M('max(dist)/1000')} AS max_km FROM near""")
def nearest_describe(t: Inputs):
    d = cut(nearest(t.sites, t.infra, "site_id", "infra_id"))
    s = summary(d, "dist", probs={"p50": 0.5})
    return rounded(s.select("n", *[(F.col(c) / 1000).alias(f"{c}_km") for c in ("min", "mean", "p50", "max")]))


LINE = """, tt AS (SELECT s.*, l.line_id, x1, y1, x2, y2, l.f_op, l.tipo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t FROM sites s, lines l),
ld AS (SELECT *, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))) AS dist FROM tt)"""


@query("nearest_line", LINE + f" SELECT site_id, {M('min(dist)')} AS dist FROM ld GROUP BY 1")
def nearest_line(t: Inputs):
    return rounded(nearest(t.sites, t.lines, "site_id", "line_id", shape="segment").select("site_id", "dist"))


@query("visible_before_nearest", f""", v AS (SELECT site_id, min({D_POINT}) AS dist FROM sites s JOIN infra i ON i.f_op <= s.f_ref - INTERVAL 36 MONTH GROUP BY 1)
SELECT site_id, {M('dist')} AS dist FROM sites LEFT JOIN v USING (site_id)""")
def visible_before_nearest(t: Inputs):
    return rounded(I.visible_distance(t.sites, t.infra, "site_id", "infra_id", "previas", "f_ref", 36))


@query("visible_before_line", LINE + f""", v AS (SELECT site_id, min(dist) AS dist FROM ld WHERE f_op <= f_ref - INTERVAL 12 MONTH GROUP BY 1)
SELECT site_id, {M('dist')} AS dist FROM sites LEFT JOIN v USING (site_id)""")
def visible_before_line(t: Inputs):
    return rounded(I.visible_distance(t.sites, t.lines, "site_id", "line_id", "previas", "f_ref", 12, "segment"))


def _layers(t: Inputs):
    return {"subestaciones": (t.infra, "infra_id", "point"), "lineas": (t.lines, "line_id", "segment"),
            "almacenamiento": (t.infra.where("infra_id % 2 = 0"), "infra_id", "point")}


_V = {"todas": "true", "sin_dedicadas": "tipo<>'DEDICADO'", "previas": "f_op <= f_ref - INTERVAL 12 MONTH"}
DIST_LONG = LINE + f""", pd AS (SELECT site_id, infra_id, tipo, f_op, f_ref, {D_POINT} AS dist FROM sites s, infra i),
dl AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{v}' AS variant, site_id, min(dist) AS dist FROM {src} WHERE {cond} AND {extra} GROUP BY 3"
    for f, src, extra in (("dist_subestaciones", "pd", "true"), ("dist_transmision", "ld", "true"), ("dist_almacen", "pd", "infra_id%2=0"))
    for v, cond in _V.items()) + ")"


@query("distance_table", DIST_LONG + f" SELECT site_id, f.feature, v.variant, {M('dist')} AS dist FROM sites CROSS JOIN (SELECT unnest(['dist_subestaciones','dist_transmision','dist_almacen']) AS feature) f CROSS JOIN (SELECT unnest(['todas','sin_dedicadas','previas']) AS variant) v LEFT JOIN dl USING (site_id, feature, variant)")
def distance_table(t: Inputs):
    return rounded(I.distance_table(t.sites, _layers(t), "site_id", "f_ref"))


@query("experiment_features", DIST_LONG + ", ex(experiment, feature, variant) AS (VALUES " + ", ".join(
    f"('{e}','{f}','{v}')" for e in I.EXPERIMENTS for f, v in I.experiment_variants(e).items()) + f""")
SELECT experiment, site_id, {M("max(dist) FILTER (feature='dist_subestaciones')")} AS dist_subestaciones, {M("max(dist) FILTER (feature='dist_transmision')")} AS dist_transmision,
 {M("max(dist) FILTER (feature='dist_almacen')")} AS dist_almacen FROM sites CROSS JOIN ex LEFT JOIN dl USING (site_id, feature, variant) GROUP BY 1,2""")
def experiment_features(t: Inputs):
    return rounded(I.experiment_features(I.distance_table(t.sites, _layers(t), "site_id", "f_ref"), "site_id"))


@query("leak_diagnosis", BEST_POINT + f""" SELECT count(*) AS n, {M("100.0*avg((tipo='DEDICADO')::INT)")} AS pct_dedicada,
 {M("100.0*avg((f_op IS NULL OR f_op > f_ref - INTERVAL 12 MONTH)::INT)")} AS pct_no_previa, {M("100.0*avg((site_region=infra_region)::INT)")} AS pct_mismo_dueno FROM near WHERE is_pos""")
def leak_diagnosis(t: Inputs):
    pos = t.sites.where("is_pos").withColumn("dueno", F.col("region_id").cast("string"))
    inf = t.infra.withColumn("propiedad", F.col("region_id").cast("string"))
    return rounded(I.leak_diagnosis(pos, inf, "site_id", "infra_id", "f_ref", "dueno", "propiedad"))


@query("nearest_types", BEST_POINT + " SELECT tipo, count(*) AS n FROM near WHERE is_pos GROUP BY 1")
def nearest_types(t: Inputs):
    return I.nearest_types(t.sites.where("is_pos"), t.infra, "site_id", "infra_id")


@query("distance_by_class", f""", v AS (SELECT site_id, min({D_POINT}) AS dist FROM sites s JOIN infra i ON i.f_op <= s.f_ref - INTERVAL 36 MONTH GROUP BY 1)
SELECT is_pos, count(*) - count(dist) AS n_missing, count(*) AS n, {M('quantile_cont(dist,0.5)')} AS mediana FROM sites LEFT JOIN v USING (site_id) GROUP BY 1""")
def distance_by_class(t: Inputs):
    d = I.visible_distance(t.sites, t.infra, "site_id", "infra_id", "previas", "f_ref", 36)
    return rounded(I.distance_by_class(cut(t.sites.select("site_id", "is_pos").join(d, "site_id")), "is_pos"))


# -- buffers and domains -------------------------------------------------------------------

@query("buffer_anti", """ SELECT site_id FROM sites a WHERE NOT is_pos AND NOT EXISTS (SELECT 1 FROM sites p WHERE p.is_pos AND (a.x-p.x)**2+(a.y-p.y)**2 <= 5000.0**2)""")
def buffer_anti(t: Inputs):
    pos = t.sites.where("is_pos").withColumnRenamed("site_id", "plant_id")
    return within(t.sites.where("not is_pos"), pos, "site_id", "plant_id", 5000.0, keep=False).select("site_id")


INSIDE = """, pip AS (SELECT site_id, zone_id FROM sites, zone_edges WHERE (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY ALL HAVING count(*)%2=1)"""


@query("assign_region", INSIDE + " SELECT site_id, min(zone_id) AS zone_id FROM pip GROUP BY 1")
def assign_region(t: Inputs):
    return P.assign_polygon(t.sites, t.zone_edges, "site_id", "zone_id").select("site_id", "zone_id")


@query("clip_points", INSIDE + " SELECT DISTINCT site_id FROM pip WHERE zone_id < 7")
def clip_points(t: Inputs):
    return P.inside(t.sites, t.zone_edges.where("zone_id < 7"), "site_id", "zone_id").select("site_id")


@query("exclusion_anti", INSIDE + " SELECT site_id FROM sites WHERE site_id NOT IN (SELECT site_id FROM pip WHERE zone_id % 6 = 1 OR zone_id % 7 = 2)")
def exclusion_anti(t: Inputs):
    zones = t.zone_edges.where("zone_id % 6 = 1").union(t.zone_edges.where("zone_id % 7 = 2 and zone_id % 6 <> 1"))
    return P.inside(t.sites, zones, "site_id", "zone_id", keep=False).select("site_id")


@query("region_by_location", INSIDE + " SELECT infra_id FROM infra i WHERE EXISTS (SELECT 1 FROM zone_edges e WHERE zone_id IN (3,8,12) AND (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY zone_id HAVING count(*)%2=1)")
def region_by_location(t: Inputs):
    zones = t.zone_edges.where("zone_id in (3, 8, 12)")
    return readers.in_region(t.infra, ["3"], "infra_id", zones, "zone_id").select("infra_id")


@query("target_group_domain", INSIDE + f""" SELECT site_id FROM sites s WHERE NOT is_pos AND site_id IN (SELECT site_id FROM pip) AND EXISTS (SELECT 1 FROM infra i WHERE {D_POINT} <= 20000.0)""")
def target_group_domain(t: Inputs):
    near = within(t.sites.where("not is_pos"), t.infra, "site_id", "infra_id", 20000.0)
    return P.inside(near, t.zone_edges, "site_id", "zone_id").select("site_id")


@query("load_plants", INSIDE + f""" SELECT site_id, {M('sqrt(mw*2.0*1e4/pi())')} AS radius FROM sites WHERE is_pos AND site_id IN (SELECT site_id FROM pip WHERE zone_id < 12)""")
def load_plants(t: Inputs):
    p = readers.load_plants(t.sites.where("is_pos"), "site_id", t.zone_edges.where("zone_id < 12"), "zone_id", "mw", 2.0)
    return rounded(p.select("site_id", "radius"))


_PX = f"(100000.0 + ({K.draw_sql('id*2', 11)})/2147483647.0*800000.0)"
_PY = f"(6000000.0 + ({K.draw_sql('id*2+1', 11)})/2147483647.0*2500000.0)"


@query("random_points", f""", want AS (SELECT count(*) AS n FROM sites WHERE is_pos), p AS (SELECT id, {_PX} AS x, {_PY} AS y FROM range(0, 150*(SELECT n FROM want)) t(id)),
hit AS (SELECT id, x, y FROM p, zone_edges WHERE zone_id < 10 AND (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY id, x, y, zone_id HAVING count(*)%2=1),
one AS (SELECT DISTINCT id, x, y FROM hit)
SELECT id AS point_id, {M('x')} AS x, {M('y')} AS y FROM one ORDER BY id LIMIT (SELECT n FROM want)""")
def random_points(t: Inputs):
    n = t.sites.where("is_pos").count()
    pts = S.random_points(t.spark, t.zone_edges.where("zone_id < 10"), "zone_id", (100000.0, 6000000.0, 900000.0, 8500000.0), n, 150 * n, 11)
    return rounded(pts)


# -- duplicates, clipping ---------------------------------------------------------------------

GREEDY = """, step(i, kept, dead) AS (SELECT 0::BIGINT, [{'k':-1::BIGINT,'x':-1e12::DOUBLE,'y':-1e12::DOUBLE}], -1::BIGINT
 UNION ALL SELECT s.i+1, CASE WHEN len(near)=0 THEN list_append(kept, {'k':site_id,'x':x,'y':y}) ELSE kept END, CASE WHEN len(near)>0 THEN near[1].k ELSE -1 END
 FROM (SELECT step.i, kept, site_id, x, y, list_filter(kept, lambda q: sqrt((q.x-x)**2+(q.y-y)**2) < 20000.0) AS near FROM step JOIN sites ON sites.site_id = step.i) s),
dup AS (SELECT i-1 AS site_id, dead AS kept FROM step WHERE dead >= 0)"""


@query("spatial_duplicates", GREEDY + f""" SELECT d.site_id, d.kept, {M('sqrt((a.x-b.x)**2+(a.y-b.y)**2)')} AS dist FROM dup d JOIN sites a ON a.site_id=d.site_id JOIN sites b ON b.site_id=d.kept""", recursive=True)
def spatial_duplicates(t: Inputs):
    return rounded(X.spatial_duplicates(t.sites, "site_id", 20000.0))


@query("clip_lines_box", f""", p AS (SELECT *, x2-x1 AS ax, y2-y1 AS ay FROM lines),
q AS (SELECT line_id, x1, y1, ax, ay, greatest(0, CASE WHEN ax>0 THEN (250000.0-x1)/ax WHEN ax<0 THEN (600000.0-x1)/ax ELSE 0 END, CASE WHEN ay>0 THEN (6500000.0-y1)/ay WHEN ay<0 THEN (7800000.0-y1)/ay ELSE 0 END) AS t0,
 least(1, CASE WHEN ax>0 THEN (600000.0-x1)/ax WHEN ax<0 THEN (250000.0-x1)/ax ELSE 1 END, CASE WHEN ay>0 THEN (7800000.0-y1)/ay WHEN ay<0 THEN (6500000.0-y1)/ay ELSE 1 END) AS t1 FROM p)
SELECT line_id, {M('x1+t0*ax')} AS x1, {M('y1+t0*ay')} AS y1, {M('x1+t1*ax')} AS x2, {M('y1+t1*ay')} AS y2 FROM q WHERE t0<=t1""")
def clip_lines_box(t: Inputs):
    c = K.clip_segment(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(250000.0), F.lit(6500000.0), F.lit(600000.0), F.lit(7800000.0))
    return rounded(t.lines.select("line_id", c.alias("s")).where(F.col("s").isNotNull()).select("line_id", "s.*"))


@query("clip_lines_midpoint", f""", m AS (SELECT line_id, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM lines)
SELECT DISTINCT line_id FROM (SELECT line_id FROM m, zone_edges e WHERE e.zone_id IN (6,7,8) AND (e.y1>y)<>(e.y2>y) AND x < (e.x2-e.x1)*(y-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY line_id, e.zone_id HAVING count(*)%2=1)""")
def clip_lines_midpoint(t: Inputs):
    mid = t.lines.select("line_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return P.inside(mid, t.zone_edges.where("zone_id in (6, 7, 8)"), "line_id", "zone_id").select("line_id")


@query("clip_lines_polygon", f""", met AS (SELECT line_id, ((e.x1-l.x1)*(e.y2-e.y1)-(e.y1-l.y1)*(e.x2-e.x1))/((l.x2-l.x1)*(e.y2-e.y1)-(l.y2-l.y1)*(e.x2-e.x1)) AS t,
  ((e.x1-l.x1)*(l.y2-l.y1)-(e.y1-l.y1)*(l.x2-l.x1))/((l.x2-l.x1)*(e.y2-e.y1)-(l.y2-l.y1)*(e.x2-e.x1)) AS u FROM lines l, zone_edges e
  WHERE (l.x2-l.x1)*(e.y2-e.y1)-(l.y2-l.y1)*(e.x2-e.x1) <> 0),
ts AS (SELECT line_id, t FROM met WHERE u BETWEEN 0 AND 1 AND t>0 AND t<1 UNION SELECT line_id, 0.0::DOUBLE FROM lines UNION SELECT line_id, 1.0::DOUBLE FROM lines),
iv AS (SELECT line_id, t, lead(t) OVER (PARTITION BY line_id ORDER BY t) AS t1 FROM ts),
m AS (SELECT line_id, t, t1, x1+(x2-x1)*(t+t1)/2 AS x, y1+(y2-y1)*(t+t1)/2 AS y, sqrt((x2-x1)**2+(y2-y1)**2)*(t1-t) AS length FROM iv JOIN lines USING (line_id) WHERE t1 IS NOT NULL),
i AS (SELECT line_id, zone_id, t, length FROM m, zone_edges e WHERE (e.y1>y)<>(e.y2>y) AND x < (e.x2-e.x1)*(y-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY ALL HAVING count(*)%2=1)
SELECT line_id, zone_id, floor(sum(length)*1e3+0.5)/1e3 AS length FROM i GROUP BY 1,2""")
def clip_lines_polygon(t: Inputs):
    inside = P.cut_lines(t.lines, t.zone_edges, "line_id", "zone_id").groupBy("line_id", "zone_id").agg(F.sum("length").alias("length"))
    return inside.withColumn("length", F.floor(F.col("length") * 1e3 + 0.5) / F.lit(1e3))


@query("criterion_distance", LINE + f" SELECT site_id, {M('min(dist)')} AS dist_criterion, {M('min(dist) FILTER (tipo<>$$DEDICADO$$)')} AS dist_transmision FROM ld GROUP BY 1")
def criterion_distance(t: Inputs):
    full = nearest_distance(t.sites.select("site_id", "x", "y"), t.lines, "site_id", "line_id", "dist_criterion", shape="segment")
    free = nearest_distance(full, I.exclude_dedicated(t.lines), "site_id", "line_id", "dist_transmision", shape="segment")
    return rounded(free.drop("x", "y"))
