"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles, ascending. Sketches of parts merge into the sketch of the
whole, and two sketches estimate resemblance, containment and distinct counts. Everything is a column expression.

A text with fewer words than a shingle is one shingle; null, empty and blank texts have the empty sketch, and two empty
sketches resemble each other fully. Long texts are hashed whole: hashes above a bound that surely exceeds the k
smallest are dropped before sorting, and where repeats leave fewer than k the sort takes all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import partitions
from .common import stored

K, WIDTH = 64, 3
NULL_ID = (1 << 63) - 1
BLANKS = r"[\x20\x09-\x0D]+"


def sketched(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of column ``text`` in ``out``; steps are columns so that each is computed once."""
    words, hashes, low = F.col("_words"), F.col("_hashes"), F.col("_low")
    n = F.size(words)
    shingle = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    bound = F.when(F.size(hashes) > 4 * k, F.lit(-2.0 ** 63) + F.lit(2.0 ** 65 * k) / F.size(hashes)).cast("long")
    steps = [
        ("_words", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), "")),
        ("_hashes", F.when(n == 0, F.array().cast("array<long>"))
         .when(n < width, F.array(F.xxhash64(F.concat_ws(" ", words))))
         .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), shingle))),
        ("_bound", bound),
        ("_low", F.array_distinct(F.when(F.col("_bound").isNull(), hashes)
                                  .otherwise(F.filter(hashes, lambda h: h <= F.col("_bound"))))),
        (out, F.slice(F.sort_array(F.when(F.col("_bound").isNull() | (F.size(low) >= k), low)
                                   .otherwise(F.array_distinct(hashes))), 1, k)),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop("_words", "_hashes", "_bound", "_low")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts: the k smallest distinct hashes, ranked in two rounds so that
    a key with many parts is not gathered in one task."""
    hashes = parts.select(*keys, F.explode(sketch).alias("h"), F.pmod(F.xxhash64(sketch), F.lit(64)).alias("salt"))
    kept = hashes.distinct()
    for by in ([*keys, "salt"], keys):
        w = Window.partitionBy(*by).orderBy("h")
        kept = kept.select(*dict.fromkeys([*by, *keys]), "h").distinct() if by == keys else kept
        kept = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles found in b; 1 for an empty a."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(sketch: Column) -> Column:
    """Hashes as 16 hexadecimal digits each, one after another."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, hash, before_id, before_hash, need) for distinct (id, hash, n), in order of id and hash, as a ring.

    ``before`` is the row that this one follows and ``need`` a quarter of its length. Rows are dealt in ranges and
    numbered by range and place; only the first and last row of each range are looked at together.
    """
    dealt = (ids.repartitionByRange(partitions(ids), "id", "hash").sortWithinPartitions("id", "hash")
             .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    dealt = stored(dealt)
    edges = dealt.groupBy("part").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    ring = Window.orderBy("part")  # one row per range
    firsts = edges.select(F.col("first").alias("row"), F.coalesce(
        F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(0, Window.unboundedFollowing))).alias("wrap"))
    linked = dealt.join(F.broadcast(stored(firsts)), "row", "left").withColumn("before", F.coalesce("wrap", F.col("row") - 1))
    other = dealt.select(F.col("row").alias("before"), F.col("id").alias("before_id"), F.col("hash").alias("before_hash"),
                         F.floor(F.col("n") / 4).alias("need"))
    return linked.join(other, "before").select("id", "hash", "before_id", "before_hash", "need")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of each text, of its edited text and of the next document, with the edited text.

    The edited text has the last quarter of its code points replaced by as many from the start of the next document in
    order of ``key`` (then text hash; null keys last; the first follows the last). Rows equal in key and text stand
    once in that order and get equal results. The text travels once: it is dealt by key with its sketch, and only
    the needed prefix and the sketch go on to the document before.
    """
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    links = stored(neighbours(source.select("id", "hash", F.char_length("text").alias("n")).distinct()))
    own = sketched(source, "text", "sketch", k, width).repartition("id", "hash")
    sent = own.join(links, ["id", "hash"]).select(
        F.col("before_id").alias("id"), F.col("before_hash").alias("hash"),
        F.expr("substring(text, 1, cast(need as int))").alias("prefix"), F.col("sketch").alias("next_sketch")).dropDuplicates(["id", "hash"])
    both = own.join(sent, ["id", "hash"]).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))")
    both = both.withColumn("edited", F.concat(kept, F.col("prefix")))
    return sketched(both, "edited", "edited_sketch", k, width)
