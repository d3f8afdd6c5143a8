"""Equi-joins whose left side may hold a large share of its rows in a few keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions

#: Fewer rows of one key than this are never split.
LEAST_CROWD = 4096


def crowd_limit(rows: int, parts: int, least: int = LEAST_CROWD) -> int:
    """Rows of one key that stay together: a quarter of a partition's share."""
    return max(least, -(-rows // (4 * parts)))


def dealt(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, least: int = LEAST_CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys to join them on.

    Keys above the limit, at most four per partition, are found first. Their left rows are dealt over salts by a hash of
    ``spread``, their right rows are repeated once per salt; rows with a null key, which match nothing, are dealt too. ``left`` is read
    once more, and twice if it holds a crowd.
    """
    on, parts = list(on), max(partitions(left), 1)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    counts = left.groupBy(*on).count()
    whole = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    limit = crowd_limit(whole["rows"] or 0, parts, least)
    if (whole["most"] or 0) <= limit:
        return left, right, on
    crowds = counts.where(known & (F.col("count") > limit))
    found = crowds.select(*on, F.ceil(F.col("count") / limit).cast("int").alias("_salts")).collect()  # at most 4 * parts rows
    schema = crowds.select(*on, F.lit(0).alias("_salts")).schema
    hot = F.broadcast(left.sparkSession.createDataFrame(found, schema))
    salts = F.coalesce("_salts", F.when(known, 1).otherwise(4 * parts))
    a = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a, b, [*on, "_salt"]


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", least: int = LEAST_CROWD) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` inner, left, left_semi or left_anti, with crowded keys of ``left`` split."""
    a, b, keys = dealt(left, right, on, spread, least)
    return a.join(b, keys, how).drop("_salt")
