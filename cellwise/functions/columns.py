"""Column expressions: predicates, map algebra, affine and map projections.

Everything here is a pure ``Column -> Column`` function, so it stays inside
whole-stage code generation and works on batch and streaming frames alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model features in contract order.
FEATURES = [
    "slope", "ghi", "elev", "northness",
    "dist_transmision", "dist_almacen", "dist_subestaciones",
]
NODATA = -9999.0
BLOCK_KEY_FACTOR = 1_000_003


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def micro(c: Column | str) -> Column:
    """Round half up at six decimals with plain arithmetic."""
    return F.floor(col(c) * 1e6 + 0.5) / F.lit(1e6)


# -- text, regions, infrastructure ------------------------------------------

def norm_text(c: Column | str) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def region_exact(c: Column | str, codes: Sequence[str]) -> Column:
    """Region code equals one of ``codes`` after trimming and upper-casing."""
    return F.coalesce(norm_text(c).isin([str(k) for k in codes]), F.lit(False))


def region_compound(c: Column | str, codes: Sequence[str]) -> Column:
    """At least one ``;``-separated token of the region field is in ``codes``."""
    tokens = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), ";"),
                         lambda t: F.upper(F.trim(t)))
    return F.arrays_overlap(tokens, F.array(*[F.lit(str(k)) for k in codes]))


def region_filter(c: Column | str, codes: Sequence[str], mode: str = "exact") -> Column:
    if mode == "exact":
        return region_exact(c, codes)
    if mode == "compound":
        return region_compound(c, codes)
    raise ValueError(f"unknown region filter mode: {mode}")


def not_dedicated(tipo: Column | str) -> Column:
    """True unless the type is the dedicated one; a missing type is kept."""
    return F.coalesce(norm_text(tipo), F.lit("")) != "DEDICADO"


def months_before(ts: Column | str, months: int) -> Column:
    """Calendar month offset that keeps the type of ``ts``."""
    return col(ts) - F.make_ym_interval(F.lit(0), F.lit(months))


def visible(variant: str, tipo: Column | str, f_op: Column | str,
            ref: Column | str | None = None, months: int = 12) -> Column:
    """Which infrastructure a sample may see under an audit variant."""
    if variant == "todas":
        return F.lit(True)
    if variant == "sin_dedicadas":
        return not_dedicated(tipo)
    if variant == "previas":
        if ref is None:
            raise ValueError("the 'previas' variant needs a reference date")
        return F.coalesce(col(f_op) <= months_before(ref, months), F.lit(False))
    raise ValueError(f"unknown visibility variant: {variant}")


def parse_date(c: Column | str) -> Column:
    """Mixed-offset date text to UTC wall-clock time; unparsable text is NULL."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                             F.try_to_timestamp(col(c)).cast("timestamp_ntz"))
    return utc


def has_point(x: Column | str, y: Column | str) -> Column:
    return col(x).isNotNull() & col(y).isNotNull() & ~F.isnan(col(x)) & ~F.isnan(col(y))


# -- map algebra --------------------------------------------------------------

def northness(aspect: Column | str) -> Column:
    return F.cos(F.radians(col(aspect)))


def technical(ghi_min: float, slope_max: float, elev_max: float,
              dist: Column | str | None = None, dist_max: float = 20000.0,
              ghi: str = "ghi", slope: str = "slope", elev: str = "elev") -> Column:
    """Siting filter; the distance term applies only when a network exists."""
    ok = (col(ghi) >= ghi_min) & (col(slope) <= slope_max) & (col(elev) <= elev_max)
    return ok if dist is None else ok & (col(dist) <= dist_max)


def minmax(v: Column | str, lo: Column, hi: Column, benefit: bool = True) -> Column:
    """Min-max scaling; a constant layer becomes zero."""
    v = col(v)
    top = (v - lo) if benefit else (hi - v)
    return F.when(hi == lo, F.when(v.isNotNull(), 0.0)).otherwise(top / F.nullif(hi - lo, F.lit(0.0)))


def weighted(norms: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted linear combination; a criterion without weight counts zero."""
    return add(F.lit(float(weights.get(k, 0.0))) * c for k, c in norms.items())


def force_zero(v: Column | str, excluded: Column | str) -> Column:
    """Valid cells inside an exclusion become zero, missing cells stay missing."""
    return F.when(col(excluded) & col(v).isNotNull(), F.lit(0.0)).otherwise(col(v))


def robust(v: Column | str, p_lo: Column, p_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (col(v) - p_lo) / F.greatest(p_hi - p_lo, F.lit(1e-6))))


def cell_status(prob: Column | str, yld: Column | str,
                excluded: Column | None = None) -> Column:
    """``sin_dato``, ``sin_ghi``, ``excluida`` or ``valida`` for one cell."""
    c = F.when(col(prob).isNull() | col(yld).isNull(), "sin_dato").when(col(yld) <= 0, "sin_ghi")
    if excluded is not None:
        c = c.when(excluded, "excluida")
    return c.otherwise("valida")


def only_suitable(v: Column | str, prob: Column | str, threshold: float) -> Column:
    return F.when(col(prob) >= threshold, col(v))


def footprint_radius(mw: Column | str, ha_per_mw: float) -> Column:
    mw = F.greatest(F.coalesce(col(mw).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.sqrt(mw * (ha_per_mw * 1e4) / F.pi())


def gain_pct(a: Column | str, b: Column | str) -> Column:
    return 100.0 * (F.try_divide(col(a), col(b)) - 1.0)


def missing_if_no_signal(v: Column | str) -> Column:
    return F.when(col(v) > 0, col(v))


def clean_band(v: Column | str, nodata: float = NODATA) -> Column:
    """NaN and the nodata sentinel become NULL."""
    v = col(v).cast("double")
    return F.when(F.isnan(v) | (v == nodata), None).otherwise(v)


def daily_unit(v: Column | str, median: Column) -> Column:
    """Irradiance in daily units, judged by the layer median; else an error."""
    return (F.when(median.between(1.0, 12.0), col(v))
            .when(median.between(365.0, 4400.0), col(v) / 365.0)
            .otherwise(F.raise_error(F.lit("irradiance unit not recognised")).cast("double")))


def compliance(value: Column | str, target: Column | str, direction: Column | str) -> Column:
    """Value over target, inverted and capped at eight when lower is better."""
    v, t = col(value), col(target)
    return F.when(col(direction) == "mayor", F.try_divide(v, t)).otherwise(
        F.least(F.coalesce(F.try_divide(t, v), F.lit(8.0)), F.lit(8.0)))


def stretch(v: Column | str, lo: Column | float = 0.0, hi: Column | float = 1.0,
            hide_below: float | None = None) -> Column:
    """Display value in 0..1 between two limits; values below a floor hide."""
    v, lo, hi = col(v), F.lit(lo) if not isinstance(lo, Column) else lo, \
        F.lit(hi) if not isinstance(hi, Column) else hi
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - lo, hi - lo)))
    return s if hide_below is None else F.when(v >= hide_below, s)


# -- affine, blocks -----------------------------------------------------------

def block_index(v: Column | str, size_m: float) -> Column:
    return F.floor(col(v) / F.lit(float(size_m)))


def block_label(region: Column | str, x: Column | str, y: Column | str, size_m: float) -> Column:
    return F.concat_ws("_", col(region).cast("string"),
                       block_index(x, size_m).cast("string"),
                       block_index(y, size_m).cast("string"))


def block_number(x: Column | str, y: Column | str, size_m: float) -> Column:
    return block_index(x, size_m) * F.lit(BLOCK_KEY_FACTOR) + block_index(y, size_m)


# -- segment geometry ---------------------------------------------------------

def segment_distance(px: Column, py: Column, x1: Column, y1: Column,
                     x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment (a zero-length segment is a point)."""
    ax, ay = x2 - x1, y2 - y1
    len2 = ax * ax + ay * ay
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        ((px - x1) * ax + (py - y1) * ay) / F.nullif(len2, F.lit(0.0)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * ax), py - (y1 + t * ay)
    return F.sqrt(ex * ex + ey * ey)


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column,
                 bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Parametric clip of a segment to a box: struct of the kept end points or NULL."""
    ax, ay = x2 - x1, y2 - y1

    def limits(p: Column, q: Column) -> tuple[Column, Column, Column]:
        r = q / F.nullif(p, F.lit(0.0))
        enter = F.when(p < 0, r).otherwise(F.lit(0.0))
        leave = F.when(p > 0, r).otherwise(F.lit(1.0))
        outside = (p == 0) & (q < 0)
        return enter, leave, outside

    sides = [limits(-ax, x1 - bx0), limits(ax, bx1 - x1),
             limits(-ay, y1 - by0), limits(ay, by1 - y1)]
    t0 = F.greatest(F.lit(0.0), *[s[0] for s in sides])
    t1 = F.least(F.lit(1.0), *[s[1] for s in sides])
    out = reduce(lambda a, b: a | b, [s[2] for s in sides])
    return F.when(~out & (t0 <= t1), F.struct(
        (x1 + t0 * ax).alias("x1"), (y1 + t0 * ay).alias("y1"),
        (x1 + t1 * ax).alias("x2"), (y1 + t1 * ay).alias("y2")))


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column,
                x2: Column, y2: Column) -> Column:
    """Does the eastward ray from the point cross the edge (half-open rule)?"""
    return ((y1 > py) != (y2 > py)) & (
        px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


# -- map projections ----------------------------------------------------------
# WGS84 ellipsoid and UTM parameters.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996

_N = WGS84_F / (2.0 - WGS84_F)
_BIG_A = WGS84_A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
         13 * _N**2 / 48 - 3 * _N**3 / 5,
         61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
        _N**2 / 48 + _N**3 / 15,
        17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
         7 * _N**2 / 3 - 8 * _N**3 / 5,
         56 * _N**3 / 15)
_ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)


def utm_xy(lon: Column | str, lat: Column | str, zone: int, south: bool) -> tuple[Column, Column]:
    """Geographic degrees to UTM metres by the third-order Krueger series."""
    phi = F.radians(col(lat))
    lam = F.radians(col(lon) - F.lit(zone * 6.0 - 183.0))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    scale = F.lit(UTM_K0 * _BIG_A)
    east = F.lit(500000.0) + scale * (eta + add(
        F.lit(a) * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta)
        for j, a in enumerate(ALPHA)))
    north = F.lit(1e7 if south else 0.0) + scale * (xi + add(
        F.lit(a) * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta)
        for j, a in enumerate(ALPHA)))
    return east, north


def utm_lonlat(x: Column | str, y: Column | str, zone: int, south: bool) -> tuple[Column, Column]:
    """UTM metres back to geographic degrees."""
    scale = F.lit(UTM_K0 * _BIG_A)
    xi = (col(y) - F.lit(1e7 if south else 0.0)) / scale
    eta = (col(x) - 500000.0) / scale
    xi_p = xi - add(F.lit(b) * F.sin(2.0 * (j + 1) * xi) * F.cosh(2.0 * (j + 1) * eta)
                    for j, b in enumerate(BETA))
    eta_p = eta - add(F.lit(b) * F.cos(2.0 * (j + 1) * xi) * F.sinh(2.0 * (j + 1) * eta)
                      for j, b in enumerate(BETA))
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi + add(F.lit(d) * F.sin(2.0 * (j + 1) * chi) for j, d in enumerate(DELTA))
    lam = F.atan2(F.sinh(eta_p), F.cos(xi_p))
    return F.degrees(lam) + F.lit(zone * 6.0 - 183.0), F.degrees(phi)


def mercator_xy(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Geographic degrees to spherical web-mercator metres."""
    phi = F.radians(col(lat))
    return (F.lit(WGS84_A) * F.radians(col(lon)),
            F.lit(WGS84_A) * F.log(F.tan(F.lit(math.pi / 4) + phi / 2.0)))


# -- reproducible draws -------------------------------------------------------
# Multipliers of the counter-based generator and its modulus.
DRAW_A, DRAW_B, DRAW_C, DRAW_M = 1_103_515_245, 69_621, 12_345, 2_147_483_647


def draw(counter: Column | str, seed: Column | int = 0) -> Column:
    """Integer in [0, 2^31-1) from a counter and a seed; same in any SQL engine.

    Two rounds of a multiplicative step on values below 2^31, so that products
    stay inside 64-bit integers.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    m = F.lit(DRAW_M).cast("bigint")
    k = F.pmod(col(counter).cast("bigint"), m)
    s = F.pmod(seed.cast("bigint") * DRAW_B + DRAW_C, m)
    z = F.pmod((k + s) * F.lit(DRAW_A).cast("bigint") + DRAW_C, m)
    z = F.pmod(z * F.lit(DRAW_B).cast("bigint") + s, m)
    return F.pmod(z * F.lit(DRAW_A).cast("bigint") + k, m)


def draw_sql(counter: str, seed: str | int = 0) -> str:
    """The same draw as DuckDB text, for the oracle queries."""
    m, a, b, c = DRAW_M, DRAW_A, DRAW_B, DRAW_C
    k = f"(({counter})::BIGINT % {m})"
    s = f"((({seed})::BIGINT * {b} + {c}) % {m})"
    z = f"((({k} + {s}) * {a} + {c}) % {m})"
    z = f"(({z} * {b} + {s}) % {m})"
    return f"(({z} * {a} + {k}) % {m})"


def uniform(counter: Column | str, seed: Column | int = 0) -> Column:
    return draw(counter, seed) / F.lit(float(DRAW_M))
