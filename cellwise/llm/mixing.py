"""Mixing sources to target weights.

Words of a source form one stream, cut into blocks of fixed length. A mixture is a list of slots dealt over output shards:

* the share of each source in a shard is drawn: every slot of a shard picks a source with the target probabilities (a
  multinomial count per shard); the last tenth of the shards evens out what the draws left, so that each
  source ends exactly at its target;
* the j-th slot of a source takes block p(j) of its stream, where p is a pseudorandom permutation of the source's block
  indices (swap-or-not rounds, computed per index, a new permutation per pass over the source);
* slots meet blocks by an equi-join on source and index.

Streams are laid out in buckets of documents, so that no window or group holds a whole source. Every choice is
arithmetic on keys and a seed: reruns and retried tasks agree.

Null and blank texts have no words and are never taken. Null sources form one source, ordered last. Rows equal in all
columns read are copies, each with its own words. Columns of the input with other names travel untouched inside a struct. Empty
tables give empty results. Tables with one row per source are assumed to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import partitions
from .common import n_words, running, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SHARD, EVEN, ROUNDS, SEED = 128, 1024, 0.1, 12, 20_261
STRETCH, SLOTS_PER_TASK = 256, 1_000_000
ROW = ["src", "bucket", "rn"]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, source_size, target) from (src, source_size): ``share`` of all words split by repeating weights in order of src.

    A target stops at ``most`` times its source; the excess is shared again by weight. With the sources in order of
    size per weight, the level at which the others settle is the first that its own source can hold.
    """
    whole, by_ratio = Window.partitionBy(), Window.orderBy("ratio", "src")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    place = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights)
    cap = F.col("source_size") * most
    t = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    t = t.withColumns({"cap": cap.cast("double"), "ratio": cap / F.col("w")})
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest))
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(whole)["level"]
    return t.select("src", "source_size", F.coalesce(F.least("cap", settled * F.col("w")), F.col("cap")).alias("target"))


def placed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: bool = True,
           per_bucket: int = 20_000) -> DataFrame:
    """Each document with its size and the place of its first word in its source's stream; ``keep`` carries the row."""
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    kept = [F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if keep else []
    rows = docs.select(src.alias("src"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"), n_words(F.col(text)).alias("size"), *kept)
    buckets = max(512, docs.count() // per_bucket)
    w = Window.partitionBy("src", "bucket").orderBy("id", "hash")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "hash"), F.lit(buckets)))
    rows = stored(rows.withColumns({
        "rn": F.row_number().over(w),
        "inside": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}))
    totals = stored(running(rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")), ["src"], "bucket", "words", "base"))
    return rows.join(totals.select("src", "bucket", "base"), ["src", "bucket"]).withColumn("start", F.col("base") + F.col("inside"))


def permuted(index: Column, size: Column, keys: Sequence[str], seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """Image of ``index`` in [0, size) under a permutation given by ``keys``: in each round an index and its mirror image
    about a pivot change places if a bit drawn for the larger of both says so."""
    n = F.greatest(size, F.lit(1))

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, F.lit(seed), r), n) - x, n)
        bit = F.xxhash64(*keys, F.lit(seed), r, F.greatest(x, mirror)).bitwiseAND(1)
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def _slots(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(src, shard, j) and the source's columns: the slots of every source, j counting them from 0."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    drawn = int(total * (1 - EVEN)) // shard
    closing = -(-(total - drawn * shard) // shard)
    cells = 4096
    line = sources.withColumn("hi", F.sum("slots").over(Window.orderBy("src"))).withColumn("lo", F.col("hi") - F.col("slots"))
    cell = lambda c: F.floor(c * cells / max(1, total)).cast("long")
    guide = line.where("slots > 0").select("src", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    draws = spark.range(drawn * shard).select(F.floor(F.col("id") / shard).alias("shard"),
                                              F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("pick"))
    counts = draws.withColumn("cell", cell(F.col("pick"))).join(guide, "cell").where("pick >= lo and pick < hi")
    counts = stored(counts.groupBy("src", "shard").agg(F.count("*").alias("c")))
    open_ = running(counts, ["src"], "shard", "c", "first").select("src", "shard", "first", "c")
    got = counts.groupBy("src").agg(F.sum("c").alias("got"))
    rest = sources.join(got, "src", "left").withColumn("got", F.least(F.coalesce("got", F.lit(0)), "slots"))
    # the closing shards are listed in stretches, so that no task lists them all for its sources
    tasks = max(partitions(sources), total // SLOTS_PER_TASK)
    stretches = rest.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(max(0, closing - 1)), F.lit(STRETCH)))).repartition(tasks, "src", "_from")
    last = F.least(F.col("_from") + (STRETCH - 1), F.lit(max(0, closing - 1)))
    rest = stretches.withColumn("g", F.explode(F.sequence("_from", last))).withColumn("left", F.col("slots") - F.col("got"))
    part = lambda g: F.floor(g * F.col("left") / max(1, closing)).cast("long")
    rest = rest.select("src", (F.col("g") + drawn).cast("long").alias("shard"), (F.col("got") + part(F.col("g"))).alias("first"),
                       (part(F.col("g") + 1) - part(F.col("g"))).alias("c"))
    both = open_.union(rest).join(sources, "src").where("c > 0 and first < slots")
    both = both.repartition(tasks, "src", "shard")  # these rows are few and small, their slots are not
    return both.withColumn("j", F.explode(F.sequence("first", F.least(F.col("first") + F.col("c"), F.col("slots")) - 1))).drop("first", "c")


def mixed(place: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **weights) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the pieces of the mixture.

    A piece is (shard, draw, src, epoch, block, bucket, rn, id, word, n): n words of a document from its ``word``-th on;
    inside a shard blocks stand in order of ``draw``.
    """
    sizes = place.groupBy("src").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, **weights))
    length, want = F.greatest("source_size", F.lit(1)), F.round("target").cast("long")
    plan = sources.withColumns({"full": F.floor(F.col("source_size") / block), "n": F.ceil(F.col("source_size") / block)})
    plan = plan.withColumns({"passes": F.floor(want / length), "over": F.pmod(want, length)})
    plan = plan.withColumn("slots", F.col("passes") * F.col("n") + F.ceil(F.col("over") / block))
    slots = _slots(plan.select("src", "source_size", "full", "n", "passes", "over", "slots"), shard, seed)
    slots = slots.withColumns({"epoch": F.floor(F.col("j") / F.col("n")), "k": F.pmod("j", "n")})
    slots = slots.withColumn("block", F.when(F.col("k") < F.col("full"), permuted(F.col("k"), F.col("full"), ["src", "epoch"], seed))
                             .otherwise(F.col("full")))
    take = F.when(F.col("epoch") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("over") - F.col("k") * block))
    slots = slots.select("shard", F.xxhash64("src", "j", F.lit(seed)).alias("draw"), "src", "epoch", "block", take.alias("take"))
    index = lambda c: F.floor(c / block)
    pieces = place.where("size > 0").select(*ROW, "id", "start", "size", F.explode(
        F.sequence(index(F.col("start")), index(F.col("start") + F.col("size") - 1))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.withColumns({"at": begin - F.col("block") * block, "word": begin - F.col("start"),
                                 "length": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin})
    out = slots.join(pieces, ["src", "block"]).withColumn("n", F.least(F.col("length"), F.col("take") - F.col("at"))).where("n > 0")
    return sources, out.select("shard", "draw", "src", "epoch", "block", "bucket", "rn", "id", "word", "n")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", n_chars: str | None = None,
                    **options) -> DataFrame:
    """The mixture as rows of ``docs``: one per document and pass over its source, with the words taken in that pass.

    A document taken whole keeps its text; else its taken words stand in their order with the blanks before them.
    """
    place = placed(docs, text, source, key)
    place = stored(place.select(*ROW, "id", "start", "size", "doc"))
    _, pieces = mixed(place, **options)
    runs = pieces.groupBy(*ROW, "epoch").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("runs"), F.sum("n").alias("taken"))
    both = runs.join(place.select(*ROW, "size", "doc"), ROW)
    whole = both.where("taken = size").select("doc.*")
    part = both.where("taken < size").withColumn("tokens", F.regexp_extract_all(F.col("doc")[text], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = F.flatten(F.transform("runs", lambda r: F.slice(F.col("tokens"), (r["word"] + 1).cast("int"), r["n"].cast("int"))))
    taken = F.regexp_replace(F.array_join(cut, ""), r"^[\x20\x09-\x0D]+", "")
    part = part.select(*[(taken if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
    if n_chars is not None:
        part = part.withColumn(n_chars, F.char_length(text).cast("long"))
    return whole.unionByName(part)


def summary(place: DataFrame, sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    taken = pieces.groupBy(*ROW).agg(F.sum("n").alias("taken"))
    return (place.join(taken, ROW, "left").join(sources, "src")
            .select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
