"""Writers: cell tables, samples, reports, long metrics, SQL scripts, databases."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NODATA
from ..operators.grid import GridSpec, to_full_grid
from .readers import SHORT_NAMES

METRIC_FIELDS = ["categoria", "metrica", "ambito", "valor", "unidad", "ic_95_inferior", "ic_95_superior",
                 "p_valor", "descripcion"]


def write_cells(df: DataFrame, grid: GridSpec, value: str, path: str, nodata: float = NODATA,
                tile: int = 1024) -> None:
    """Full raster with nodata in the invalid cells, one folder per band of rows."""
    full = to_full_grid(df, grid, value, nodata).withColumn("tile", F.expr(f"r div {tile}"))
    full.repartition("tile", F.expr(f"c div {tile}")).write.mode("overwrite").partitionBy("tile").parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    df.withColumnsRenamed({n: s for n, s in SHORT_NAMES.items() if n in df.columns}).write.mode(
        "overwrite").parquet(path)


def to_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def bundle(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Several one-row results as one document with a field per report."""
    spark = next(iter(reports.values())).sparkSession
    one = spark.range(1)
    return one.select(F.to_json(F.struct(*[
        df.select(F.struct("*")).scalar().alias(name) for name, df in reports.items()])).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """Result tables (one row or a few) as JSON lines."""
    to_report(df).coalesce(1).write.mode("overwrite").text(path)


def metrics_long(stats: DataFrame, rows: Sequence[tuple[str, str, str, str, str, str]],
                 intervals: Mapping[str, tuple[str, str]] | None = None,
                 p_values: Mapping[str, str] | None = None) -> DataFrame:
    """One metric per row from a one-row wide result.

    ``rows`` are (category, metric, scope, column, unit, description).
    """
    intervals, p_values = intervals or {}, p_values or {}

    def text(c: str | None) -> Column:
        return F.col(c).cast("double") if c else F.lit(None).cast("double")

    items = [F.struct(F.lit(cat).alias("categoria"), F.lit(m).alias("metrica"), F.lit(scope).alias("ambito"),
                      text(c).alias("valor"), F.lit(unit).alias("unidad"),
                      text(intervals.get(m, (None, None))[0]).alias("ic_95_inferior"),
                      text(intervals.get(m, (None, None))[1]).alias("ic_95_superior"),
                      text(p_values.get(m)).alias("p_valor"), F.lit(d).alias("descripcion"))
             for cat, m, scope, c, unit, d in rows]
    return stats.select(F.explode(F.array(*items)).alias("m")).select("m.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def comparison_wide(metrics: DataFrame, experiment: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per experiment, one column per metric."""
    return metrics.groupBy(experiment).pivot(metric, list(names)).agg(F.first(value))


def compare_reports(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Two metric tables side by side with the difference."""
    left = a.select(*keys, F.col(value).alias("value_a"))
    right = b.select(*keys, F.col(value).alias("value_b"))
    return left.join(right, list(keys)).withColumn("delta", F.col("value_b") - F.col("value_a"))


def to_insert_sql(df: DataFrame, table: str = "instalaciones_solares_optimas", schema: str = "public",
                  srid: int = 32719, order: str = "site_id") -> DataFrame:
    """Script lines ``(part, line, value)`` that create and fill a spatial table."""
    full = f"{schema}.{table}"
    ddl = [
        "CREATE EXTENSION IF NOT EXISTS postgis;",
        f"CREATE SCHEMA IF NOT EXISTS {schema};",
        f"DROP TABLE IF EXISTS {full};",
        f"CREATE TABLE {full} (id SERIAL PRIMARY KEY, site_id VARCHAR(50), probabilidad FLOAT, area_m2 FLOAT, "
        f"ghi FLOAT, slope FLOAT, elev FLOAT, es_valido BOOLEAN, fecha_validacion TIMESTAMP, "
        f"geom geometry(Point, {srid}));",
        f"CREATE INDEX idx_{table}_geom ON {full} USING GIST (geom);",
    ]
    head = df.sparkSession.createDataFrame([(0, str(i).zfill(4), t) for i, t in enumerate(ddl)],
                                           "part int, line string, value string")

    def number(name: str, digits: int, default: str) -> Column:
        if name not in df.columns:
            return F.lit(default)
        c = F.col(name).cast("double")
        return F.coalesce(F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}f", c)), F.lit(default))

    plain = lambda c: F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    point = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(
        F.lit("ST_SetSRID(ST_GeomFromText('POINT ("), plain(F.col("x")), F.lit(" "), plain(F.col("y")),
        F.lit(f")'), {srid})"))).otherwise("NULL")
    ident = F.replace(F.col("site_id").cast("string"), F.lit("'"), F.lit("''"))
    valid = F.when(F.coalesce(F.col("es_valido"), F.lit(True)), "TRUE").otherwise("FALSE") \
        if "es_valido" in df.columns else F.lit("TRUE")
    stamp = F.concat(F.lit("'"), F.col("fecha_validacion").cast("string"), F.lit("'")) \
        if "fecha_validacion" in df.columns else F.lit("NULL")
    value = F.concat(
        F.lit(f"INSERT INTO {full} (site_id, probabilidad, area_m2, ghi, slope, elev, es_valido, "
              "fecha_validacion, geom) VALUES ('"), ident, F.lit("', "), number("probabilidad", 4, "0.0000"),
        F.lit(", "), number("area_m2", 2, "0.00"), F.lit(", "), number("ghi", 2, "NULL"), F.lit(", "),
        number("slope", 2, "NULL"), F.lit(", "), number("elev", 2, "NULL"), F.lit(", "), valid, F.lit(", "),
        F.coalesce(stamp, F.lit("NULL")), F.lit(", "), point, F.lit(");"))
    return head.unionByName(df.select(F.lit(1).alias("part"), F.col(order).cast("string").alias("line"),
                                      value.alias("value")))


def write_sql(script: DataFrame, path: str) -> None:
    script.sort("part", "line").select("value").write.mode("overwrite").text(path)


def write_database(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
                   mode: str = "overwrite", password_env: str = "PGPASSWORD") -> None:
    """Load a table over JDBC; the password comes from the environment."""
    props = {"driver": "org.postgresql.Driver", **(properties or {})}
    if password_env in os.environ:
        props["password"] = os.environ[password_env]
    df.write.jdbc(url, table, mode=mode, properties=props)


def split_valid(validated: DataFrame, drop: Sequence[str] = ("reasons",)) -> tuple[DataFrame, DataFrame]:
    """Approved and rejected records without the complex columns."""
    return (validated.where("es_valido").drop(*drop), validated.where(~F.col("es_valido")).drop(*drop))
