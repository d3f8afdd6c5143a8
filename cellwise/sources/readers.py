"""Readers of cell tables, feature layers, models' parameters and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NODATA, clean_band, footprint_radius, has_point, region_filter
from ..operators.polygons import inside, ring_edges
from ..operators.quality import require_rows

# Ten-character interchange names of long columns.
SHORT_NAMES = {"dist_transmision": "dist_trans", "dist_almacen": "dist_almac", "dist_subestaciones": "dist_subs"}


def read_cells(spark: SparkSession, path: str, bands: Sequence[str], nodata: float = NODATA,
               fmt: str = "parquet") -> DataFrame:
    """Cell table with explicit schema; the sentinel and NaN become NULL."""
    schema = T.StructType([T.StructField("r", T.LongType()), T.StructField("c", T.LongType()),
                           *[T.StructField(b, T.DoubleType()) for b in bands]])
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.select("r", "c", *[clean_band(b, nodata).alias(b) for b in bands])


def read_geojson(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Feature collection as a decomposed layer.

    Points give ``x, y``; lines one row per segment; polygons one row per edge.
    ``feature_id`` numbers the features by their id property or content hash.
    A whole document is read by one task. With ``lines`` every feature stands on a
    line of its own (bare, or in a collection with commas behind the features), and
    files are read in as many byte ranges as their size asks for.
    """
    if lines:
        row = F.regexp_replace(F.trim("value"), r",\s*$", "")
        text = spark.read.text(path).select(F.from_json(row, f"struct<{_fields(kind)}>").alias("f")).where("f.type = 'Feature'")
        f = text.select("f.*")
    else:
        doc = spark.read.option("multiLine", True).schema(f"features array<struct<{_fields(kind)}>>").json(path)
        f = doc.select(F.explode("features").alias("f")).select("f.*")
    ident = F.coalesce(F.col("properties")["id"], F.hex(F.xxhash64(F.to_json("geometry"), F.to_json("properties"))))
    f = f.withColumn("feature_id", ident)
    pts = F.col("geometry.coordinates")
    if kind == "point":
        return f.select("feature_id", pts[0].alias("x"), pts[1].alias("y"), "properties")
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    if kind == "line":
        rings = f.select("feature_id", "properties", F.transform(pts, pair).alias("ring"))
    else:
        rings = f.select("feature_id", "properties", F.explode(pts).alias("_r")).select(
            "feature_id", "properties", F.transform("_r", pair).alias("ring"))
    return ring_edges(rings.select("feature_id", "ring"), "feature_id", "ring").join(
        f.select("feature_id", "properties"), "feature_id")


def _fields(kind: str) -> str:
    depths = {"point": "array<double>", "line": "array<array<double>>",
              "polygon": "array<array<array<double>>>"}
    if kind not in depths:
        raise ValueError(f"unknown geometry kind: {kind}")
    return f"type:string, geometry:struct<type:string, coordinates:{depths[kind]}>, properties:map<string,string>"


def read_layers(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Named layers stored as tables."""
    return {name: spark.read.format(fmt).load(p) for name, p in paths.items()}


def regions_of(regions: DataFrame, code: str, codes: Sequence[str], mode: str = "exact") -> DataFrame:
    """Regions of a study zone; an error if none matches."""
    return require_rows(regions.where(region_filter(code, codes, mode)), f"no region matches {list(codes)}")


def in_region(layer: DataFrame, codes: Sequence[str], key: str, region_edges: DataFrame, polygon: str,
              code: str = "REGION", mode: str = "exact") -> DataFrame:
    """Features of a region by code, or by location when the layer carries no code."""
    if code in layer.columns:
        return layer.where(region_filter(code, codes, mode))
    return inside(layer, region_edges, key, polygon)


def load_plants(plants: DataFrame, key: str, region_edges: DataFrame, polygon: str, mw: str,
                ha_per_mw: float | None = None) -> DataFrame:
    """Plants with a usable point inside the zone, with a footprint radius if asked for."""
    kept = inside(plants.where(has_point("x", "y")), region_edges, key, polygon)
    return kept if ha_per_mw is None else kept.withColumn("radius", footprint_radius(mw, ha_per_mw))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples with the short interchange names put back."""
    df = spark.read.parquet(path)
    return df.withColumnsRenamed({s: n for n, s in SHORT_NAMES.items() if s in df.columns})


def tuned_parameters(spark: SparkSession, report: str, override: Mapping[str, float] | None = None) -> dict:
    """Tuned parameters from a JSON report; a fixed set overrides, absence is an error."""
    if override:
        return dict(override)
    df = spark.read.option("multiLine", True).json(report)
    if "best_params" not in df.columns:
        raise ValueError(f"{report} holds no tuned parameters")
    return df.select("best_params.*").first().asDict()


def first_available(spark: SparkSession, choices: Sequence[tuple[str, str]]) -> tuple[str, DataFrame]:
    """The first readable input of ``(name, path)`` choices, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, path in choices:
        p = hadoop.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return name, spark.read.parquet(path)
    raise ValueError("no input is available: " + ", ".join(n for n, _ in choices))
