"""Record validation with reason codes, audit counts and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import utm_lonlat, utm_xy
from .polygons import memberships
from .proximity import spatial_duplicates


@dataclass(frozen=True)
class Rules:
    """Limits of the validation; the defaults are the study's published ones."""

    bounds_utm: tuple[float, float, float, float] = (100000.0, 900000.0, 6000000.0, 8500000.0)
    bounds_geo: tuple[float, float, float, float] = (-72.5, -66.5, -30.0, -17.0)
    ghi_min: float = 160.0
    slope_max: float = 15.0
    elev_max: float = 3500.0
    prob_min: float = 0.70
    duplicate_m: float = 50.0
    geographic: bool = False
    columns: Mapping[str, str] = field(default_factory=dict)


def _range(c: Column, name: str, lo: float, hi: float, digits: int) -> Column:
    text = F.format_string(f"{name} (%.{digits}f no en [{lo}, {hi}])", c)
    return F.when(~c.between(lo, hi), text)


def geometry_reasons(rules: Rules, x: str = "x", y: str = "y", ring_valid: str | None = None) -> list[Column]:
    """Reasons about the geometry; each later check needs the earlier ones to pass."""
    px, py = F.col(x), F.col(y)
    empty = px.isNull() | py.isNull()
    broken = F.lit(False) if ring_valid is None else ~F.coalesce(F.col(ring_valid), F.lit(False))
    inf = F.lit(float("inf"))
    wild = F.isnan(px) | F.isnan(py) | (F.abs(px) == inf) | (F.abs(py) == inf)
    b = rules.bounds_geo if rules.geographic else rules.bounds_utm
    names, digits = (("LONGITUD_FUERA_DE_RANGO", "LATITUD_FUERA_DE_RANGO"), 4) if rules.geographic else (
        ("EASTING_UTM_FUERA_DE_RANGO", "NORTHING_UTM_FUERA_DE_RANGO"), 1)
    fine = ~empty & ~broken & ~wild
    return [
        F.when(empty, "GEOMETRIA_NULA_O_VACIA"),
        F.when(~empty & broken, "GEOMETRIA_INVALIDA"),
        F.when(~empty & ~broken & wild, "COORDENADAS_NAN_O_INF"),
        F.when(fine, _range(px, names[0], b[0], b[1], digits)),
        F.when(fine, _range(py, names[1], b[2], b[3], digits)),
    ]


def technical_reasons(rules: Rules, present: Sequence[str]) -> list[Column]:
    """Reasons about attributes; a missing attribute passes."""
    out = []
    if "slope" in present:
        c = F.col("slope")
        out.append(F.when(c > rules.slope_max, F.format_string(
            f"PENDIENTE_EXCEDE_MAXIMA (%.1f° > {rules.slope_max}°)", c)))
    if "elev" in present:
        c = F.col("elev")
        out.append(F.when(c > rules.elev_max, F.format_string(
            f"ELEVACION_EXCEDE_MAXIMA (%.0fm > {rules.elev_max}m)", c)))
    if "ghi" in present:
        c = F.col("ghi")
        out.append(F.when(c < rules.ghi_min, F.format_string(f"GHI_BAJO_MINIMO (%.1f < {rules.ghi_min})", c)))
    scores = [F.col(k) for k in ("probabilidad", "aptitud") if k in present]
    if scores:
        c = F.coalesce(*scores)
        out.append(F.when(c < rules.prob_min, F.format_string(
            f"APTITUD_BAJO_UMBRAL (%.2f < {rules.prob_min:.2f})", c)))
    return out


def validate_rows(df: DataFrame, rules: Rules = Rules(), ring_valid: str | None = None) -> DataFrame:
    """Row-local reasons only; also usable on a stream."""
    reasons = geometry_reasons(rules, ring_valid=ring_valid) + technical_reasons(rules, df.columns)
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def validate_sites(df: DataFrame, key: str, rules: Rules = Rules(), region: DataFrame | None = None,
                   exclusions: Mapping[str, DataFrame] | None = None, polygon: str = "zone_id",
                   ring_valid: str | None = None) -> DataFrame:
    """Every record with its reasons, verdict and joined text.

    ``region`` and each exclusion layer are edge tables; the duplicates check looks
    at all records, rejected ones too, in key order.
    """
    out = df
    layers = dict(exclusions or {})
    named = [(f"_zone_{name.upper()}", edges) for name, edges in layers.items()]
    if region is not None:
        named.append(("_region", region))
    if named:
        # all layers share one index; the polygon key carries the layer
        edges = None
        for name, e in named:
            tagged = e.select(F.concat_ws("|", F.lit(name), F.col(polygon).cast("string")).alias("_poly"),
                              "x1", "y1", "x2", "y2")
            edges = tagged if edges is None else edges.unionByName(tagged)
        hits = memberships(df, edges, key, "_poly").groupBy(key).agg(
            F.collect_set(F.substring_index("_poly", "|", 1)).alias("_layers"))
        out = out.join(hits, key, "left")
    dup = spatial_duplicates(df, key, rules.duplicate_m)
    out = out.join(dup.select(key, F.col("kept").alias("_kept"), F.col("dist").alias("_gap")), key, "left")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    parts = geometry_reasons(rules, ring_valid=ring_valid)
    if region is not None:
        parts.append(F.when(
            placed & ~F.coalesce(F.array_contains("_layers", "_region"), F.lit(False)), "FUERA_DE_REGION_DE_ESTUDIO"))
    for name in layers:
        parts.append(F.when(F.array_contains("_layers", f"_zone_{name.upper()}"),
                            f"INTERSECTA_ZONA_EXCLUSION_{name.upper()}"))
    parts += technical_reasons(rules, df.columns)
    parts.append(F.when(F.col("_kept").isNotNull(), F.format_string(
        "DUPLICADO_ESPACIAL (a %.1fm del objeto index=%d)", F.col("_gap"), F.col("_kept").cast("bigint"))))
    out = out.withColumn("reasons", F.array_compact(F.array(*parts)))
    ok = F.size("reasons") == 0
    return out.withColumn("es_valido", ok).withColumn(
        "motivos_rechazo", F.when(ok, "OK").otherwise(F.array_join("reasons", "; "))).drop(
        "_layers", "_kept", "_gap")


def reason_histogram(validated: DataFrame) -> DataFrame:
    """Records per reason, without the detail in brackets."""
    return validated.select(F.explode("reasons").alias("r")).groupBy(
        F.substring_index("r", " (", 1).alias("motivo")).agg(F.count(F.lit(1)).alias("n"))


def audit(validated: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("es_valido")
    return validated.agg(n.alias("total"), ok.alias("validos"), (n - ok).alias("rechazados"),
                         F.coalesce(100.0 * F.try_divide(ok, n), F.lit(0.0)).alias("pct_aprobacion"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Largest difference and unmatched rows of two tables; raises above the tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    one_sided = F.col("_a").isNull() != F.col("_b").isNull()
    res = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(one_sided).alias("n_unmatched"),
                   F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))
    row = res.first()
    if row["n_unmatched"] or (row["max_diff"] or 0.0) > tol:
        raise ValueError(f"tables differ: {row['n_unmatched']} unmatched rows, max {row['max_diff']}")
    return res


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Loud failure when a step leaves nothing to work on."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def in_system(layer: DataFrame, srid: int | None, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """Point layer in the target UTM system: taken as it is when the layer names no system or the same one, else reprojected.

    Systems are 4326 (degrees) and UTM, 326zz north and 327zz south; others raise.
    """
    if srid in (None, target):
        return layer
    zone, south = _utm(target)
    if srid == 4326:
        lon, lat = F.col(x), F.col(y)
    else:
        lon, lat = utm_lonlat(x, y, *_utm(srid))
    east, north = utm_xy(lon, lat, zone, south)
    return layer.withColumns({x: east, y: north})


def _utm(srid: int) -> tuple[int, bool]:
    if srid // 100 not in (326, 327) or not 1 <= srid % 100 <= 60:
        raise ValueError(f"unknown reference system: {srid}")
    return srid % 100, srid // 100 == 327
