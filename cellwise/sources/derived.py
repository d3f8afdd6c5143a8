"""Spatial views over the star-schema tables, in DataFrame form and as SQL text.

Sites come from customers, infrastructure from suppliers, polygons from nations,
raster cells from orders and a feature space from embeddings. The SQL text is
the same arithmetic for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridSpec

CELL_M = 1000.0
X0, Y0, WIDTH = 300000.0, 7000000.0, 100
#: Values of an embedding that serve as features, as many as the study has.
SPACE = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("site_id"), F.col("c_nationkey").alias("region_id"),
        (F.lit(100000.0) + (k * 7919) % 800000).alias("x"),
        (F.lit(6000000.0) + (k * 104729) % 2500000).alias("y"),
        ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("prob"),
        (k % 4 == 0).alias("is_pos"),
        (F.lit(1.0) + k % 250).alias("mw"),
        F.date_add(F.to_date(F.lit("1998-01-01")), (k % 1000).cast("int")).alias("f_ref"))


def infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("infra_id"), F.col("s_nationkey").alias("region_id"),
        (F.lit(100000.0) + (k * 6101) % 800000).alias("x"),
        (F.lit(6000000.0) + (k * 88001) % 2500000).alias("y"),
        F.when(k % 3 == 0, "DEDICADO").when(k % 3 == 1, "ZONAL").otherwise("NACIONAL").alias("tipo"),
        F.concat(F.lit("SE_"), k.cast("string")).alias("nombre"),
        F.when(k % 10 != 9, F.date_add(F.to_date(F.lit("1995-01-01")),
                                       ((k * 37) % 2400).cast("int"))).alias("f_op"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between consecutive supplier keys (the keys are consecutive)."""
    a = infra(spark, sf_dir)
    b = a.select((F.col("infra_id") - 1).alias("line_id"),
                 F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.select(F.col("infra_id").alias("line_id"), "tipo", F.col("x").alias("x1"),
                    F.col("y").alias("y1"), "f_op").join(b, "line_id")


def zone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    left = F.lit(100000.0) + (n % 5) * 160000
    base = F.lit(6000000.0) + F.floor(n / 5.0) * 500000
    e = F.col("edge")
    return (table(spark, sf_dir, "nation")
            .select(n, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("edge"))
            .select(n.alias("zone_id"), "edge",
                    F.when(e.isin(0, 3), left).otherwise(left + 160000).alias("x1"),
                    F.when(e.isin(0, 1), base).otherwise(base + 500000).alias("y1"),
                    F.when(e.isin(2, 3), left).otherwise(left + 160000).alias("x2"),
                    F.when(e.isin(0, 3), base).otherwise(base + 500000).alias("y2")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.floor(k / 100.0).alias("r"), (k % 100).alias("c"),
        (F.lit(140.0) + (k * 29) % 160).alias("ghi"),
        (((k * 31) % 300) / 10.0).alias("slope"),
        ((F.col("o_custkey") * 37) % 360).cast("double").alias("aspect"),
        (F.lit(100.0) + (k * 211) % 4200).alias("elev"),
        (F.col("o_totalprice") / 500000.0).alias("prob"),
        F.when(k % 17 == 0, 0.0).otherwise(F.lit(1500.0) + (k * 13) % 700).alias("yld"),
        F.when(k % 23 != 0, F.lit(1900.0) + (k * 11) % 900).alias("yld_tracker"))


def grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return GridSpec(X0, Y0, CELL_M, CELL_M, WIDTH, last // WIDTH + 1, 32719)


def centred(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.lit(X0) + (F.col("c") + 0.5) * CELL_M).withColumn(
        "y", F.lit(Y0) - (F.col("r") + 0.5) * CELL_M)


def feature_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") < 5).alias("is_train"), "label",
        *[F.element_at(e, i).cast("double").alias(f"f{i}") for i in range(1, SPACE + 1)])


SQL = f"""
sites AS (SELECT c_custkey AS site_id, c_nationkey AS region_id,
  100000.0::DOUBLE + (c_custkey*7919) % 800000 AS x,
  6000000.0::DOUBLE + (c_custkey*104729) % 2500000 AS y,
  (c_acctbal+1000.0::DOUBLE)/11000.0::DOUBLE AS prob, c_custkey % 4 = 0 AS is_pos,
  1.0::DOUBLE + c_custkey % 250 AS mw,
  DATE '1998-01-01' + CAST(c_custkey % 1000 AS INT) AS f_ref FROM customer),
infra AS (SELECT s_suppkey AS infra_id, s_nationkey AS region_id,
  100000.0::DOUBLE + (s_suppkey*6101) % 800000 AS x,
  6000000.0::DOUBLE + (s_suppkey*88001) % 2500000 AS y,
  CASE s_suppkey % 3 WHEN 0 THEN 'DEDICADO' WHEN 1 THEN 'ZONAL' ELSE 'NACIONAL' END AS tipo,
  concat('SE_', CAST(s_suppkey AS VARCHAR)) AS nombre,
  CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE DATE '1995-01-01' + CAST((s_suppkey*37) % 2400 AS INT) END AS f_op
  FROM supplier),
lines AS (SELECT * FROM (SELECT infra_id AS line_id, tipo, f_op, x AS x1, y AS y1,
  lead(x) OVER (ORDER BY infra_id) AS x2, lead(y) OVER (ORDER BY infra_id) AS y2 FROM infra)
  WHERE x2 IS NOT NULL),
zone_edges AS (SELECT n_nationkey AS zone_id, e AS edge,
  100000.0::DOUBLE + (n_nationkey % 5 + CASE WHEN e IN (0,3) THEN 0 ELSE 1 END)*160000 AS x1,
  6000000.0::DOUBLE + (floor(n_nationkey/5.0) + CASE WHEN e IN (0,1) THEN 0 ELSE 1 END)*500000 AS y1,
  100000.0::DOUBLE + (n_nationkey % 5 + CASE WHEN e IN (2,3) THEN 0 ELSE 1 END)*160000 AS x2,
  6000000.0::DOUBLE + (floor(n_nationkey/5.0) + CASE WHEN e IN (0,3) THEN 0 ELSE 1 END)*500000 AS y2
  FROM nation CROSS JOIN (SELECT unnest([0,1,2,3]) AS e) q),
cells AS (SELECT CAST(floor(o_orderkey/100.0) AS BIGINT) AS r, o_orderkey % 100 AS c,
  140.0::DOUBLE + (o_orderkey*29) % 160 AS ghi, ((o_orderkey*31) % 300)/10.0::DOUBLE AS slope,
  CAST((o_custkey*37) % 360 AS DOUBLE) AS aspect, 100.0::DOUBLE + (o_orderkey*211) % 4200 AS elev,
  o_totalprice/500000.0::DOUBLE AS prob,
  CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE 1500.0::DOUBLE + (o_orderkey*13) % 700 END AS yld,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 1900.0::DOUBLE + (o_orderkey*11) % 900 END AS yld_tracker
  FROM orders),
centred AS (SELECT *, 300000.0::DOUBLE + (c+0.5::DOUBLE)*1000.0::DOUBLE AS x,
  7000000.0::DOUBLE - (r+0.5::DOUBLE)*1000.0::DOUBLE AS y FROM cells),
space AS (SELECT vec_id, label < 5 AS is_train, label,
  {", ".join(f"embedding[{i}]::DOUBLE AS f{i}" for i in range(1, SPACE + 1))} FROM embeddings)
"""


def with_views(sql: str, recursive: bool = False) -> str:
    """Prefix an oracle query (which may start with more CTEs after a comma)."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {SQL.strip()}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
