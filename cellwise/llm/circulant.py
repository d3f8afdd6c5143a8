"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a 32-bit universe make the whole signature: the first scatters the shingles, the second, shifted
circularly once per coordinate, ranks them; a coordinate is the smallest rank of a set. Bands of four coordinates give
candidates, and links are confirmed on full shingle sets.

* Documents with equal sets form one class by a pre-aggregated group-by, however many copies there are.
* Classes that share a band meet in a bucket; buckets with the same members count once. A bucket never emits its pairs: it is
  dealt into tiles of at most some ``TILE`` members a side, and a task compares the bitmaps of their shingles, which bound the
  similarity of two sets exactly. Only pairs that the bound allows and that are not yet known to be connected leave the task: a
  spanning forest of each part first, then, between tiles, the most similar ones of each member, eight times as many per round.
  Members of a bucket's largest component are compared with the others only. Every pair of a bucket is thus compared, already
  joined, or ruled out, so components are those of all links.
* A bitmap has ``BITS`` bits; it rules out nothing for sets far larger than that, which are compared in full.
* With 24 bands a pair of similarity 0.8 shares none with probability (1 - 0.8^4)^24 = 3e-6.
* Only sets of classes that met another one are ever stored.

Null text and text without words: no shingles, linked with nothing. A null id counts as larger than any other. Rows that
repeat a document are copies of it. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .common import attach, release, stored
from .links import components

WIDTH, SIMILARITY = 5, 80
BANDS, ROWS = 24, 4
BITS, TILE = 4096, 384
#: Buckets of up to so many classes emit all pairs that the bound allows.
SMALL = 4
NULL_ID = (1 << 63) - 1
MARKS = 1 << 24

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_hash", T.LongType()),
                       T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()),
                       T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()),
                     T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """In-place bijection of 32-bit words."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 text; a short text is one shingle."""
    words = text.lower().split() if text else []  # bytes: only A-Z change, only the six ASCII blanks divide
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    acc = np.full(len(h) - span + 1, span, np.uint64)
    for j in range(span):
        acc = acc * MULTIPLIER + h[j:len(h) - span + 1 + j]
    return np.unique(_mix64(acc))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS, block: int = 1024) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set that is not empty."""
    first = _mix64(shingles * MULTIPLIER).astype(np.uint32)  # the initial permutation scatters the universe
    shifts = np.arange(size, dtype=np.uint32) * np.uint32(0x9E3779B1)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), block):
        x = np.add.outer(shifts, first[at:at + block])
        np.minimum(low, _permute32(x, np.empty_like(x)).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    acc = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in low.reshape(BANDS, ROWS).T:
        acc = _mix64(acc * MULTIPLIER + row)
    return acc.view(np.int64)


def _node(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def bitmap(shingles: np.ndarray) -> bytes:
    """Which of ``BITS`` classes of shingles a set holds."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        counts, nodes, bands = [], [], []
        for value in batch.column(2).cast(pa.binary()):
            s = shingle_set(value.as_py(), width)
            counts.append(len(s))
            nodes.append(_node(s) if len(s) else None)
            bands.append(band_keys(signature(s)) if len(s) else None)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                               pa.array(bands, pa.list_(pa.int64()))], ["id", "text_hash", "n", "node", "bands"])


def _full(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        sets = [s for v in batch.column(0).cast(pa.binary()) if len(s := shingle_set(v.as_py(), width))]
        yield pa.record_batch([pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                               pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                               pa.array([bitmap(s) for s in sets], pa.binary())], ["node", "n", "shingles", "bits"])


def _most(n: np.ndarray, m: np.ndarray, held: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Upper bound of the common shingles of sets of ``n`` and ``m``, whose bitmaps have ``held`` and ``others`` bits."""
    return np.minimum(n - held + common, m - others + common)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix; well connected rows first."""
    first = np.argsort(-near.sum(1), kind="stable")
    open_, a, b = np.ones(len(near), bool), [], []
    for start in first:
        todo = [start] if open_[start] else []
        open_[start] = False
        for i in todo:
            found = first[(near[i] & open_)[first]]
            open_[found] = False
            a.append(np.full(len(found), i))
            b.append(found)
            todo.extend(found)
    return np.concatenate(a), np.concatenate(b)


def _in_tile(bits: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, inside: bool, partners: int,
             similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that may be links of different components; a row paired with itself says that some were held back."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    held = x.sum(1)
    most = _most(n[:, None], n, held[:, None], held, x @ x.T)
    near = ((100 + similarity) * most >= similarity * (n[:, None] + n)) & (comp[:, None] != comp)
    if not inside:
        near &= side[:, None] != side
    if not partners:
        return _forest(near)
    held_back = near.sum() > 2 * partners * len(near)
    if held_back:
        score = np.where(near, 2 * most / (n[:, None] + n), -1.0)
        at = np.argpartition(-score, min(partners, len(near)) - 1, axis=1)[:, :partners]
        chosen = np.zeros_like(near)
        np.put_along_axis(chosen, at, True, axis=1)
        near &= chosen | chosen.T
        near[0, 0] = True
    return np.nonzero(np.triu(near))


def _near(batches: Iterator[pa.RecordBatch], partners: int, similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may be links, from rows sorted by tile (bucket, kind, i, j)."""
    release()

    def pairs(rows: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        n, side = rows["n"].to_numpy(), rows["side"].to_numpy()
        comp = rows["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(n), -1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        sizes = np.diff(np.r_[starts, len(n)])
        group, few = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= SMALL, sizes) & (partners == 0)
        words, held, a, b = bits.view(np.uint64), np.bitwise_count(bits).sum(1, dtype=np.int64), [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]) & (comp[:-d] != comp[d:]))
            common = np.bitwise_count(words[i] & words[i + d]).sum(1, dtype=np.int64)
            i = i[(100 + similarity) * _most(n[i], n[i + d], held[i], held[i + d], common) >= similarity * (n[i] + n[i + d])]
            a.append(i)
            b.append(i + d)
        for g in np.flatnonzero(sizes > (1 if partners else SMALL)):
            at = slice(starts[g], starts[g] + sizes[g])
            inside = key[starts[g], 1] == 0 and key[starts[g], 2] == key[starts[g], 3]
            u, v = _in_tile(bits[at], n[at], comp[at], side[at], inside, partners, similarity)
            a.append(u + starts[g])
            b.append(v + starts[g])
        nodes = rows["node"].combine_chunks()
        return pa.record_batch([nodes.take(pa.array(np.concatenate(x).astype(np.int64))) for x in (a, b)], ["a", "b"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        key = np.stack([rows[c].to_numpy() for c in ("bucket", "kind", "i", "j")], axis=1)
        change = np.flatnonzero((key[1:] != key[:-1]).any(1))
        last = change[-1] + 1 if len(change) else 0  # the last tile may go on in the next batch
        if last:
            yield pairs(rows.slice(0, last), key[:last])
        rest = rows.slice(last)
    if rest is not None and len(rest):
        yield pairs(rest, np.stack([rest[c].to_numpy() for c in ("bucket", "kind", "i", "j")], axis=1))


def marked(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``chosen`` and few others: a bitmap of the hashes of its keys, ``MARKS`` bits at most, is broadcast, so that most
    rows that a join with ``chosen`` drops are not shuffled for it."""
    at = F.pmod(F.xxhash64(*on), F.lit(MARKS))
    bit = lambda h: F.expr(f"shiftleft(1L, cast({h} % 64 as int))")
    bits = chosen.select(at.alias("_h")).groupBy(F.expr("_h div 64").alias("_w")).agg(F.bit_or(bit("_h")).alias("_bits"))
    found = rows.withColumn("_h", at).withColumn("_w", F.expr("_h div 64")).join(F.broadcast(bits), "_w")
    return found.where(F.col("_bits").bitwiseAND(bit("_h")) != 0).select(*rows.columns)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (u, v) whose full sets have at least ``similarity`` percent in common."""
    of = lambda side: marked(sets, pairs.select(F.col(side).alias("node")), ["node"]).select("node", "n", "shingles")
    a = attach(pairs.withColumnRenamed("u", "node"), of("u"), "node", F.col("v"))
    a = a.select(F.col("node").alias("u"), "v", F.col("n").alias("nu"), F.col("shingles").alias("a"))
    both = a.join(of("v").select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= similarity * (F.col("nu") + F.col("nv") - common)).select("u", "v")


def _once(met: DataFrame) -> DataFrame:
    """(bucket, node) without buckets whose members are those of another one."""
    members = [F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(3)]]
    kept = met.groupBy("bucket").agg(*members).groupBy("c", "x0", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    return met.join(kept.select("bucket"), "bucket", "left_semi")


def _tiles(active: DataFrame, first: bool) -> DataFrame:
    """Rows of the open buckets, dealt into tiles (kind, i, j): 0 for parts of a bucket, 1 for a part and one of its largest component."""
    parts = lambda n: F.ceil(n / F.lit(TILE)).cast("long")
    hashed, zero = F.xxhash64("node"), F.lit(0).cast("long")
    if first:  # every class is a component of its own
        sizes = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
        part = F.pmod(hashed, parts(F.col("c")))
        return active.join(sizes, "bucket").select(*active.columns, zero.alias("kind"), part.alias("i"), part.alias("j"), zero.alias("side"))
    counts = active.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = counts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("c")).where("m.c < c")
    rows = active.join(open_.select("bucket", F.col("m.comp").alias("main"), parts(F.col("c") - F.col("m.c")).alias("rest"),
                                    parts(F.col("m.c")).alias("of_main")), "bucket")
    main = F.col("comp") == F.col("main")
    rows = rows.withColumn("own", F.pmod(hashed, F.when(main, F.col("of_main")).otherwise(F.col("rest"))))
    tile = lambda kind, i, j, side: F.struct(*[F.lit(v).cast("long").alias(n) if isinstance(v, int) else v.cast("long").alias(n)
                                               for n, v in (("kind", kind), ("i", i), ("j", j), ("side", side))])
    every = lambda n: F.sequence(zero, F.col(n) - 1)
    own = F.col("own")
    places = F.when(main, F.transform(every("rest"), lambda i: tile(1, i, own, 1))).otherwise(F.concat(
        F.transform(every("rest"), lambda o: tile(0, F.least(own, o), F.greatest(own, o), own)),
        F.transform(every("of_main"), lambda j: tile(1, own, j, 0))))
    return rows.select(*active.columns, F.explode(places).alias("t")).select(*active.columns, "t.*")


def class_links(classes: DataFrame, sets_of, similarity: int) -> DataFrame | None:
    """(node, label) for classes connected with another one; None if no two classes share a band."""
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    crowd = keys.groupBy("bucket").count().where("count > 1").select("bucket")
    met = stored(_once(stored(keys.join(crowd, "bucket", "left_semi"))))
    if met.isEmpty():
        return None
    sets = cut(sets_of(met.select("node").distinct()))  # large: goes with its last reader
    active = stored(met.join(sets.select("node", "n", "bits"), "node").withColumn("comp", F.col("node")))
    tested, links, labels, partners = None, None, None, 0
    while True:
        sorted_ = _tiles(active, not partners).repartition("bucket", "kind", "i", "j").sortWithinPartitions("bucket", "kind", "i", "j")
        near = sorted_.mapInArrow(partial(_near, partners=partners, similarity=similarity), PAIRS)
        got = stored(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        pairs = got.where("u <> v")
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stored(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        found = None if pairs.isEmpty() else stored(_verified(pairs, sets, similarity))
        if found is not None and not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
        if partners and got.where("u = v").isEmpty():  # no tile held back a pair
            return labels
        if not partners:
            large = active.groupBy("bucket").count().where(F.col("count") > SMALL).select("bucket")
            active = stored(active.join(large, "bucket", "left_semi"))
        if active.isEmpty():
            return labels
        if found is not None and labels is not None:
            active = stored(active.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"))
        partners = 8 * max(partners, 1)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                    similarity: int = SIMILARITY) -> DataFrame:
    """(id, text_hash, n, component_id, component_hash) of every document.

    A document stays if its (id, text_hash) are those of its component, which is the smallest of its members.
    """
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("text_hash"),
                         F.col(text).alias("text"))
    signed = stored(source.mapInArrow(partial(_sign, width=width), SIGNED))
    classes = stored(signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct("id", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        chosen = stored(classes.join(nodes, "node", "left_semi").select("first.id", "first.text_hash").distinct())
        # an inner join: a semi-join would be pushed below the bitmap, and every text shuffled
        rows = marked(source, chosen, ["id", "text_hash"]).join(chosen, ["id", "text_hash"]).select("text")
        return rows.mapInArrow(partial(_full, width=width), SETS).dropDuplicates(["node"])

    labels = class_links(classes, sets_of, similarity)
    if labels is None:
        member = classes.select("node", "first")
    else:
        linked = stored(classes.select("node", "first").join(labels, "node"))
        tops = linked.groupBy("label").agg(F.min("first").alias("top"))
        member = classes.select("node", "first").join(linked.join(tops, "label").select("node", "top"), "node", "left").select(
            "node", F.coalesce("top", "first").alias("first"))
    member = stored(member)
    some = attach(signed.where("node is not null").select("id", "text_hash", "n", "node"), member, "node", F.struct("id", "text_hash"))
    none = signed.where("node is null").select("id", "text_hash", "n", F.struct("id", "text_hash").alias("first"))
    out = some.select("id", "text_hash", "n", "first").union(none)
    return out.select("id", "text_hash", "n", F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                 similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, its columns unchanged."""
    found = near_duplicates(docs, key, text, width, similarity)
    stay = found.where((F.col("id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash")))
    stay = stay.select("id", "text_hash").distinct()
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), F.struct("*").alias("doc"))
    return rows.join(stay, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]).select("doc.*")


def oracle_sql(width: int, similarity: int) -> str:
    """Components over all pairs that share a shingle, as SQL over table ``documents``."""
    from .links import COMPONENT_SQL
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) end) as s from w),
size as (select doc_id, count(*) as n from sets group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from sets a join sets b using (s) where a.doc_id < b.doc_id group by 1, 2),
near as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * both_ >= {similarity} * (x.n + y.n - both_)),
link as (select a, b from near union all select b, a from near),
node as (select doc_id as id from documents),
{COMPONENT_SQL}
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents left join size using (doc_id) join component on component.id = doc_id
"""
