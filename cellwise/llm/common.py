"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, partitions

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
Held = TypeVar("Held")
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], Held]) -> Held:
    """What this Python worker keeps for later tasks; it keeps one thing, so the tasks of other operators get its memory."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what the worker keeps for another operator, and Arrow's unused memory."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: cuts lineage, survives executors."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def attach(left: DataFrame, right: DataFrame, on: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join a skewed ``left`` with ``right`` (one row per key) on ``on``.

    Keys that hold more than a quarter of a partition's share of the rows are found first; there are at most four
    per partition, so their list is broadcast. Their left rows are dealt over salts, their right row is repeated
    once per salt. Every other key is joined as it is. Both sides should be stored tables.
    """
    parts = partitions(left)
    limit = max(64, left.count() // (4 * parts))
    hot = (left.groupBy(on).count().where(F.col("count") > limit)
           .select(on, F.ceil(F.col("count") / limit).cast("int").alias("_salts")))
    hot = F.broadcast(stored(hot))
    dealt = (left.join(hot, on, "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0)))
             .drop("_salts"))
    held = (right.join(hot, on, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
            .drop("_salts"))
    return dealt.join(held, [on, "_salt"], how).drop("_salt")


def running(df: DataFrame, group: list[str], pos: str, value: str, out: str, chunk: int = 1000) -> DataFrame:
    """Exclusive running total of ``value`` by integer ``pos`` inside ``group``, in two levels.

    Rows of ``chunk`` consecutive positions are summed first, so no window holds a whole group of rows.
    """
    from pyspark.sql import Window

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    tops = cut.groupBy(*group, "_chunk").agg(F.sum(value).alias("_sum"))
    tops = tops.select(*group, "_chunk", F.coalesce(
        F.sum("_sum").over(before(Window.partitionBy(*group).orderBy("_chunk"))), F.lit(0)).alias("_base"))
    inside = cut.withColumn("_part", F.coalesce(
        F.sum(value).over(before(Window.partitionBy(*group, "_chunk").orderBy(pos))), F.lit(0)))
    return (inside.join(tops, [*group, "_chunk"]).withColumn(out, F.col("_base") + F.col("_part"))
            .drop("_chunk", "_base", "_part"))
