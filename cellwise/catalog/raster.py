"""Grid operators on the cell view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import components as C
from ..operators import grid as G
from ..operators import polygons as P
from ..operators import proximity as X
from ..plans import suitability as U
from .base import M, Inputs, query, rounded

_AT = """, pt AS (SELECT site_id, floor((7000000.0-y)/1000.0)::BIGINT AS r, floor((x-300000.0)/1000.0)::BIGINT AS c FROM
 (SELECT site_id, 300000.0 + (site_id*7919) % 100000 AS x, 7000000.0 - (site_id*10473) % 150000 AS y FROM sites)),
band AS (SELECT r, c, yld_tracker AS v FROM cells WHERE yld_tracker IS NOT NULL AND (r*100+c)%5<>0)"""


def _in_grid(t: Inputs):
    k = F.col("site_id")
    return t.sites.select(k, (F.lit(300000.0) + (k * 7919) % 100000).alias("x"), (F.lit(7000000.0) - (k * 10473) % 150000).alias("y"))


def _holed(t: Inputs):
    return t.cells.where((F.col("r") * 100 + F.col("c")) % 5 != 0).select("r", "c", F.col("yld_tracker").alias("v"))


SAMPLED = _AT + """, w AS (SELECT a.site_id, avg(b.v) AS m FROM pt a JOIN band b ON abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 WHERE a.r BETWEEN 0 AND (SELECT max(r) FROM cells) GROUP BY 1),
s AS (SELECT site_id, coalesce(b.v, w.m) AS v FROM pt LEFT JOIN band b USING (r,c) LEFT JOIN w USING (site_id))"""


@query("sample_raster_fallback", SAMPLED + f" SELECT site_id, {M('v')} AS v FROM s")
def sample_raster_fallback(t: Inputs):
    return rounded(G.sample_at(_in_grid(t), "site_id", _holed(t), "v", t.grid).select("site_id", "v"))


@query("sample_or_mean", SAMPLED + f" SELECT site_id, {M('coalesce(v,(SELECT avg(v) FROM band))')} AS v FROM s")
def sample_or_mean(t: Inputs):
    return rounded(G.sample_or_mean(_in_grid(t), "site_id", _holed(t), "v", t.grid).select("site_id", "v"))


DST = """, dst AS (SELECT r, c, 300300.0::DOUBLE+(c+0.5)*700.0 AS x, 6999600.0::DOUBLE-(r+0.5)*900.0 AS y FROM range(0,{h}) t(r), range(0,130) u(c)),
src AS (SELECT r, c, {v} AS v FROM cells WHERE (r*100+c)%11<>0),
uw AS (SELECT r, c, (x-300000.0)/1000.0-0.5 AS u, (7000000.0-y)/1000.0-0.5 AS w FROM dst),
nb AS (SELECT uw.r, uw.c, (CASE WHEN i=0 THEN 1-(w-floor(w)) ELSE w-floor(w) END)*(CASE WHEN j=0 THEN 1-(u-floor(u)) ELSE u-floor(u) END) AS wt, floor(w)+i AS sr, floor(u)+j AS sc
 FROM uw, range(0,2) a(i), range(0,2) b(j)),
bil AS (SELECT nb.r, nb.c, CASE WHEN sum(wt) FILTER (v IS NOT NULL)>0 THEN sum(wt*v)/sum(wt) FILTER (v IS NOT NULL) END AS v FROM nb LEFT JOIN src s ON s.r=sr AND s.c=sc GROUP BY 1,2)"""
_H = "(SELECT 1+max(r) FROM cells)"


def _dst(t: Inputs):
    g = G.GridSpec(300300.0, 6999600.0, 700.0, 900.0, 130, t.grid.height, 32719)
    return g, g.cells(t.spark)


def _src(t: Inputs, v):
    return t.cells.where((F.col("r") * 100 + F.col("c")) % 11 != 0).select("r", "c", v.alias("v"))


@query("resample_bilinear", DST.format(h=_H, v="elev") + f" SELECT r, c, {M('v')} AS v FROM bil")
def resample_bilinear(t: Inputs):
    g, d = _dst(t)
    return rounded(G.resample(_src(t, F.col("elev")), "v", t.grid, d, g))


@query("resample_nearest", DST.format(h=_H, v="aspect") + " SELECT d.r, d.c, s.v FROM dst d LEFT JOIN src s ON s.r=floor((7000000.0-y)/1000.0) AND s.c=floor((x-300000.0)/1000.0)")
def resample_nearest(t: Inputs):
    g, d = _dst(t)
    return G.resample(_src(t, F.col("aspect")), "v", t.grid, d, g, "nearest")


@query("resample_restore_zero", DST.format(h=_H, v="nullif(yld,0)") + f""", raw AS (SELECT r,c,yld FROM cells WHERE (r*100+c)%11<>0)
SELECT d.r, d.c, CASE WHEN z.yld<=0 THEN 0.0::DOUBLE ELSE {M('b.v')} END AS v FROM dst d JOIN bil b ON b.r=d.r AND b.c=d.c
LEFT JOIN raw z ON z.r=floor((7000000.0-y)/1000.0) AND z.c=floor((x-300000.0)/1000.0)""")
def resample_restore_zero(t: Inputs):
    g, d = _dst(t)
    return rounded(G.resample_keep_zero(_src(t, F.col("yld")), "v", t.grid, d, g))


@query("align_irradiance", DST.format(h=_H, v="nullif(yld,0)") + f" SELECT r, c, {M('v/365.0')} AS v FROM bil")
def align_irradiance(t: Inputs):
    g, d = _dst(t)
    return rounded(U.align_irradiance(_src(t, F.col("yld")), "v", t.grid, d, g))


_N = {(i, j): f"n{'mzp'[i+1]}{'mzp'[j+1]}" for i in (-1, 0, 1) for j in (-1, 0, 1)}
HORN = ", m AS (SELECT r, c, elev AS z FROM cells), nn AS (SELECT m.r, m.c, " + ", ".join(
    f"{n}.z AS {n}" for n in _N.values()) + " FROM m " + " ".join(
    f"LEFT JOIN m {n} ON {n}.r=m.r+({i}) AND {n}.c=m.c+({j})" for (i, j), n in _N.items()) + """),
g AS (SELECT r, c, ((nmp+2*nzp+npp)-(nmm+2*nzm+npm))/8000.0 AS p, ((npm+2*npz+npp)-(nmm+2*nmz+nmp))/8000.0 AS s FROM nn)"""


@query("slope_horn", HORN + f" SELECT r, c, {M('degrees(atan(sqrt(p*p+s*s)))')} AS slope FROM g")
def slope_horn(t: Inputs):
    return rounded(G.terrain(t.cells, "elev", t.grid).select("r", "c", "slope"))


@query("aspect_horn", HORN + f""", a AS (SELECT r, c, p, s, degrees(atan2(-p, s)) AS d FROM g)
SELECT r, c, CASE WHEN p<>0 OR s<>0 THEN {M('CASE WHEN d<0 THEN d+360.0 ELSE d END')} END AS aspect FROM a""")
def aspect_horn(t: Inputs):
    return rounded(G.terrain(t.cells, "elev", t.grid).select("r", "c", "aspect"))


@query("distance_transform", f""", m AS (SELECT r, c FROM cells WHERE prob >= 0.93)
SELECT a.r, a.c, {M('sqrt(min((1000.0*(a.c-m.c))**2+(1000.0*(a.r-m.r))**2))')} AS dist FROM cells a, m GROUP BY 1,2""")
def distance_transform(t: Inputs):
    return rounded(X.distance_transform(t.cells.where("prob >= 0.93"), t.grid))


POLY = """, tri AS (SELECT n_nationkey AS zone_id, 300000.0::DOUBLE + (n_nationkey*3571)%70000 AS px, 7000000.0::DOUBLE - (n_nationkey*7321)%110000 AS py FROM nation),
ed AS (SELECT zone_id, px AS x1, py AS y1, px+31000.0 AS x2, py-9000.0 AS y2 FROM tri UNION ALL SELECT zone_id, px+31000.0, py-9000.0, px+8000.0, py-33000.0 FROM tri UNION ALL SELECT zone_id, px+8000.0, py-33000.0, px, py FROM tri)"""


def _triangles(t: Inputs):
    n = F.col("n_nationkey")
    px, py = F.lit(300000.0) + (n * 3571) % 70000, F.lit(7000000.0) - (n * 7321) % 110000
    rings = t.table("nation").select(n.alias("zone_id"), F.array(*[
        F.struct(x.alias("x"), y.alias("y")) for x, y in ((px, py), (px + 31000.0, py - 9000.0), (px + 8000.0, py - 33000.0), (px, py))]).alias("ring"))
    return P.ring_edges(rings, "zone_id", "ring")


CENTRE = "SELECT zone_id, r, c FROM centred, ed WHERE (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY ALL HAVING count(*)%2=1"
# a segment meets a cell box when its parametric clip to the box is not empty
TOUCH = """SELECT DISTINCT zone_id, r, c FROM (SELECT zone_id, r, c,
 greatest(0, least((x-500-x1)/(x2-x1),(x+500-x1)/(x2-x1)), least((y-500-y1)/(y2-y1),(y+500-y1)/(y2-y1))) AS t0,
 least(1, greatest((x-500-x1)/(x2-x1),(x+500-x1)/(x2-x1)), greatest((y-500-y1)/(y2-y1),(y+500-y1)/(y2-y1))) AS t1
 FROM centred JOIN ed ON x+500>=least(x1,x2) AND x-500<=greatest(x1,x2) AND y+500>=least(y1,y2) AND y-500<=greatest(y1,y2)) WHERE t0 < t1"""


def _data_rows(df, t: Inputs):
    return df.join(t.cells.select("r", "c"), ["r", "c"], "left_semi")


@query("rasterize_center", POLY + " " + CENTRE)
def rasterize_center(t: Inputs):
    return _data_rows(P.rasterize(_triangles(t), "zone_id", t.grid), t).select("zone_id", "r", "c")


@query("rasterize_all_touched", POLY + f" SELECT zone_id, count(*) AS n FROM ({CENTRE} UNION {TOUCH}) GROUP BY 1")
def rasterize_all_touched(t: Inputs):
    x = _data_rows(P.rasterize(_triangles(t), "zone_id", t.grid, True), t)
    return x.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


@query("mask_outside", POLY + f" SELECT r, c, prob FROM cells WHERE (r,c) IN (SELECT (r,c) FROM ({CENTRE}))")
def mask_outside(t: Inputs):
    return t.cells.join(P.rasterize(_triangles(t), "zone_id", t.grid), ["r", "c"], "left_semi").select("r", "c", "prob")


@query("footprint_cells", """, pl AS (SELECT site_id, 300000.0 + (site_id*7919) % 100000 AS px, 7000000.0 - (site_id*10473) % 150000 AS py, sqrt(mw*6.0*1e4/pi()) AS rad FROM sites WHERE is_pos)
SELECT DISTINCT site_id, r, c FROM centred, pl WHERE sqrt((x-px)*(x-px)+(y-py)*(y-py)) <= rad""")
def footprint_cells(t: Inputs):
    k = F.col("site_id")
    p = t.sites.where("is_pos").select(k, (F.lit(300000.0) + (k * 7919) % 100000).alias("x"), (F.lit(7000000.0) - (k * 10473) % 150000).alias("y"),
                                       K.footprint_radius("mw", 6.0).alias("radius"))
    return _data_rows(P.rasterize_discs(p, "site_id", "radius", t.grid), t).select("site_id", "r", "c")


# label propagation keyed by cell: a cell is visited again only when its label falls
COMP = """, m AS (SELECT r, c, r*100+c AS id FROM cells WHERE prob >= 0.55), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1),
w(id, root) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.a, min(w.root) FROM w JOIN e ON e.b=w.id JOIN recurring.w AS cur ON cur.id=e.a WHERE w.root < cur.root GROUP BY e.a),
lab AS (SELECT id//100 AS r, id%100 AS c, root AS zone FROM w)"""


@query("components_8", COMP + " SELECT r, c, zone FROM lab", recursive=True)
def components_8(t: Inputs):
    return C.label_components(t.cells.where("prob >= 0.55"), t.grid).select("r", "c", "zone")


@query("zones", COMP + f""", z AS (SELECT zone, count(*) AS n_cells, count(*)*1e6::DOUBLE AS area_m2, avg(k.x) AS x, avg(k.y) AS y, avg(prob) AS pm, max(prob) AS px FROM lab JOIN centred k USING (r,c) GROUP BY 1 HAVING count(*)>=2)
SELECT printf('SOLAR_SITE_%04d', row_number() OVER (ORDER BY zone)) AS site_id, zone, n_cells, area_m2, {M('z.x')} AS x, {M('z.y')} AS y, {M('pm')} AS prob_mean, {M('px')} AS prob_max, {M('k.prob')} AS probabilidad, k.ghi
FROM z LEFT JOIN cells k ON k.r=floor((7000000.0-z.y)/1000.0) AND k.c=floor((z.x-300000.0)/1000.0)""", recursive=True)
def zones(t: Inputs):
    z = C.zones(t.cells.where("prob >= 0.55"), t.cells, t.grid, "prob", 2e6, ("ghi",))
    return rounded(C.with_site_ids(z), "x", "y", "prob_mean", "prob_max", "probabilidad")


@query("overview_nearest", "SELECT r//4 AS r, c//4 AS c, prob FROM cells WHERE r%4=2 AND c%4=2")
def overview_nearest(t: Inputs):
    side = -(-max(t.grid.width, t.grid.height) // 4)
    return G.overview(t.cells, t.grid, "prob", side)[0]


@query("overview_mean", f"SELECT r//4 AS r, c//4 AS c, {M('avg(prob)')} AS prob FROM cells GROUP BY 1,2")
def overview_mean(t: Inputs):
    side = -(-max(t.grid.width, t.grid.height) // 4)
    return rounded(G.overview(t.cells, t.grid, "prob", side, "mean")[0])


@query("crop", "SELECT r-10 AS r, c-20 AS c, prob FROM cells WHERE r BETWEEN 10 AND 49 AND c BETWEEN 20 AND 69")
def crop(t: Inputs):
    return G.crop(t.cells.select("r", "c", "prob"), t.grid, 10, 20, 40, 50)[0]


TILES = """, tiles AS (SELECT 'T'||(r//20) AS tile_name, c%3 AS prio, r%20 AS r, c//3 AS c, CASE WHEN (r*100+c)%4=0 THEN NULL ELSE elev END AS v FROM cells),
kept AS (SELECT t.* FROM tiles t JOIN (SELECT tile_name, min(prio) AS prio FROM tiles GROUP BY 1) f ON t.tile_name=f.tile_name AND t.prio=f.prio WHERE v IS NOT NULL)"""


@query("mosaic", TILES + " SELECT r, c, arg_min(v, tile_name) AS v FROM kept GROUP BY 1,2")
def mosaic(t: Inputs):
    r, c = F.col("r"), F.col("c")
    tiles = t.cells.select(
        F.concat(F.lit("T"), F.expr("r div 20").cast("string")).alias("tile_name"), (c % 3).alias("prio"),
        (r % 20).alias("r2"), F.expr("c div 3").alias("c2"), F.when((r * 100 + c) % 4 != 0, F.col("elev")).alias("v"))
    return G.mosaic(tiles.withColumnsRenamed({"r2": "r", "c2": "c"}))


@query("compare_cells", f""", ab AS (SELECT yld AS a, CASE WHEN (r*100+c)%3=0 THEN yld ELSE yld*1.01 END AS b FROM cells),
d AS (SELECT *, CASE WHEN a=0 THEN CASE WHEN b=0 THEN 0.0 ELSE 100.0 END ELSE 100.0*abs(b-a)/abs(a) END AS rel FROM ab)
SELECT count(*) AS n, {M('100.0*count(*) FILTER (a=b)/count(*)')} AS pct_identical, {M('quantile_cont(rel,0.5)')} AS median_rel_pct, {M('max(rel)')} AS max_rel_pct,
 count(*) FILTER (rel>0.5) AS n_above_tol, count(*) FILTER (b=0) AS n_zero FROM d""")
def compare_cells(t: Inputs):
    a = t.cells.select("r", "c", "yld")
    b = a.withColumn("yld", F.when((F.col("r") * 100 + F.col("c")) % 3 == 0, F.col("yld")).otherwise(F.col("yld") * 1.01))
    return rounded(G.compare_cells(a, b, "yld", 0.5))


@query("to_full_grid", "SELECT r, c, CASE WHEN prob>=0.3 THEN prob ELSE -9999.0::DOUBLE END AS prob FROM cells")
def to_full_grid(t: Inputs):
    return G.to_full_grid(t.cells.where("prob >= 0.3"), t.grid, "prob")


def _box_mean(a, r0, c0):
    """Mean of the valid 3x3 values around each cell."""
    import numpy as np

    p = np.pad(a, 1, constant_values=np.nan)
    stack = np.stack([p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(3) for j in range(3)])
    live = ~np.isnan(stack)
    out = np.where(live, stack, 0.0).sum(axis=0) / np.maximum(live.sum(axis=0), 1)
    return np.where(np.isnan(a), np.nan, out)


@query("apply_tiled", f"""SELECT a.r, a.c, {M('avg(b.elev)')} AS elev FROM cells a JOIN cells b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1,2""")
def apply_tiled(t: Inputs):
    return rounded(G.apply_tiled(t.cells.select("r", "c", "elev"), "elev", 32, 1, _box_mean))


@query("grid_overlay", "SELECT a.r, a.c, a.prob, b.yld FROM cells a JOIN cells b USING (r,c) WHERE a.ghi>200 AND b.yld>0")
def grid_overlay(t: Inputs):
    return G.overlay([t.cells.where("ghi > 200").select("r", "c", "prob"), t.cells.where("yld > 0").select("r", "c", "yld")])


FEATS = """, sub(r,c) AS (SELECT DISTINCT r, c FROM cells WHERE (r*100+c)%613=7), alm(r,c) AS (SELECT DISTINCT r, c FROM cells WHERE (r*100+c)%971=11), lin(r,c) AS (SELECT DISTINCT r, c FROM cells WHERE c=37)"""


@query("build_features", FEATS + f""" SELECT r, c, ghi, slope, elev, {M('cos(radians(aspect))')} AS northness,
 {M('abs(c-37)*1000.0::DOUBLE')} AS dist_transmision,
 (SELECT {M('sqrt(min((1000.0*(k.c-m.c))**2+(1000.0*(k.r-m.r))**2))')} FROM alm m) AS dist_almacen,
 (SELECT {M('sqrt(min((1000.0*(k.c-m.c))**2+(1000.0*(k.r-m.r))**2))')} FROM sub m) AS dist_subestaciones FROM cells k""")
def build_features(t: Inputs):
    cid = F.col("r") * 100 + F.col("c")
    at = t.centred.select(cid.alias("id"), "x", "y")
    bands = {b: (t.cells.select("r", "c", b), t.grid) for b in ("ghi", "slope", "elev", "aspect")}
    b = t.grid.bounds
    # a line down the middle of column 37, inside the grid
    line = t.table("region").where("r_regionkey = 0").select(
        F.col("r_regionkey").alias("id"), F.lit(337500.0).alias("x1"), F.lit(b[3] - 1.0).alias("y1"), F.lit(337500.0).alias("x2"), F.lit(b[1] + 1.0).alias("y2"))
    layers = {"dist_transmision": (line, "id", "segment"), "dist_almacen": (at.where("id % 971 = 11"), "id", "point"),
              "dist_subestaciones": (at.where("id % 613 = 7"), "id", "point")}
    return rounded(U.build_features(t.spark, t.grid, bands, layers), "northness", "dist_transmision", "dist_almacen", "dist_subestaciones")
