"""Ranked lexical search by Block-Max MaxScore over shards of documents.

* The corpus is counted first: documents with a term, all terms.
* Documents are dealt into shards of at most ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings as they are read.
  A shard keeps, for each term that some item asks for, blocks of ``BLOCK`` postings, compressed to the fewest bytes a gap and
  a count, and for every block its first document and its largest term score.
* Document frequencies, and with them weights and global bounds of the terms, are sums over the shards.
* Each shard answers every item. Terms are ordered by bound; those whose bounds together cannot reach the score of the
  k-th best so far are not essential. Essential lists are read whole. Their candidates then pass the other lists, largest bound
  first: a block whose maximum cannot lift a candidate above the k-th score rejects it before the block is decompressed.
  Bounds count as they are, so ties with the k-th score survive and the smaller id wins.
* A task carries the heap of each item from shard to shard; the heaps of the tasks are merged by a ranked window.

Items are answered in groups of about ``HELD`` distinct (item, term) pairs, so what the tasks hold is bounded however many items
there are. Null texts have no terms. Rows that repeat a document are documents of their own; rows of one item id make one item with the
terms of all of them. Null ids are ranked behind all others. Items without a hit, and empty tables, give no rows. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import partitions
from .common import lower_ascii, stored

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, BLOCK, SHARD_DOCS, SHARD_POSTINGS, HELD = 50, 128, 8192, 2_000_000, 500_000
#: Bytes of a text as blanks between terms, A-Z lower-cased.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

LISTS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.IntegerType()), T.StructField("count", T.LongType()),
                      T.StructField("most", T.LongType()), T.StructField("firsts", T.BinaryType()), T.StructField("maxima", T.BinaryType()),
                      T.StructField("places", T.BinaryType()), T.StructField("blocks", T.BinaryType())])
HITS = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
_WIDTHS = (np.uint8, np.uint16, np.uint32)
NO_DOC = np.iinfo(np.int64).max


def term_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of a term in a document before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """The fewest bytes that hold all values."""
    width = int(np.searchsorted([1 << 8, 1 << 16], int(values.max()), "right"))
    return width, values.astype(_WIDTHS[width]).tobytes()


def pack_block(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Gaps behind the first document and counts of one block."""
    (a, gaps), (b, counts) = _narrow(np.diff(docs, prepend=docs[:1])), _narrow(tf)
    return bytes((a * 4 + b,)) + gaps + counts


def unpack_block(block: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = divmod(block[0], 4)
    n = (len(block) - 1) // ((1 << a) + (1 << b))
    gaps = np.frombuffer(block, _WIDTHS[a], n, 1).astype(np.int64)
    return first + np.cumsum(gaps), np.frombuffer(block, _WIDTHS[b], n, 1 + (n << a)).astype(np.int64)


class Shard:
    """Documents of a shard while they are read."""

    def __init__(self):
        self.ids, self.null, self.m, self.terms, self.tf, self.postings = [], [], [], [], [], 0

    def add(self, doc_id: int | None, m: int, terms: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(NO_DOC if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.m.append(m)
        self.terms.append(terms)
        self.tf.append(tf)
        self.postings += len(terms)

    def rows(self, shard: int) -> pa.RecordBatch:
        """One row for the documents (term -1) and one per term."""
        m = np.array(self.m, np.int64)
        doc = np.repeat(np.arange(len(m)), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.tf)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        score = term_score(tf, m[doc])
        out = [(shard, -1, len(m), 0, np.array(self.ids, np.int64).tobytes(), m.tobytes(), np.array(self.null, bool).tobytes(), b"")]
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(term)]):
            at = np.arange(a, b, BLOCK)
            maxima = np.maximum.reduceat(score[a:b], at - a)
            blocks = [pack_block(doc[i:min(b, i + BLOCK)], tf[i:min(b, i + BLOCK)]) for i in at.tolist()]
            places = np.cumsum([0, *map(len, blocks)]).astype(np.int32)
            out.append((shard, int(term[a]), b - a, int(maxima.max()), doc[at].astype(np.int32).tobytes(), maxima.tobytes(),
                        places.tobytes(), b"".join(blocks)))
        return pa.RecordBatch.from_pylist([dict(zip(LISTS.names, r)) for r in out], pa.schema(
            [("shard", pa.int64()), ("term", pa.int32()), ("count", pa.int64()), ("most", pa.int64()), ("firsts", pa.binary()),
             ("maxima", pa.binary()), ("places", pa.binary()), ("blocks", pa.binary())]))


def _index(batches: Iterator[pa.RecordBatch], vocabulary, documents: int, length: int) -> Iterator[pa.RecordBatch]:
    find, shard, number = vocabulary.value.get, Shard(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = (value.as_py() or b"").translate(FOLD).split()
            found = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
            terms, tf = np.unique(found[found >= 0], return_counts=True)
            if not len(terms):
                continue
            shard.add(key, 100 - 50 + (50 * len(words) * documents) // length, terms, tf)
            if len(shard.m) >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                yield shard.rows(number)
                shard, number = Shard(), number + 1
    if shard.m:
        yield shard.rows(number)


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Lists:
    """Postings of one shard."""

    def __init__(self):
        self.ids = self.null = self.m = None
        self.raw: dict[int, tuple] = {}
        self.open: dict[tuple[int, int], tuple] = {}  # at most SHARD_POSTINGS postings, until the shard is done
        self.whole: dict[int, tuple] = {}

    def add(self, term: int, most: int, firsts: bytes, maxima: bytes, places: bytes, blocks: bytes) -> None:
        if term < 0:
            self.ids, self.m, self.null = np.frombuffer(firsts, np.int64), np.frombuffer(maxima, np.int64), np.frombuffer(places, bool)
        else:
            self.raw[term] = (most, np.frombuffer(firsts, np.int32), np.frombuffer(maxima, np.int64), np.frombuffer(places, np.int32), blocks)

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and term scores of a block."""
        got = self.open.get((term, b))
        if got is None:
            _, firsts, _, places, blocks = self.raw[term]
            docs, tf = unpack_block(blocks[places[b]:places[b + 1]], int(firsts[b]))
            got = self.open[term, b] = docs, term_score(tf, self.m[docs])
        return got

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and term scores of a whole list."""
        if term not in self.whole:
            parts = [self.block(term, b) for b in range(len(self.raw[term][1]))]
            self.whole[term] = parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))
        return self.whole[term]

    def search(self, terms: list[tuple[int, int, int]], least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of all that may be among the ``k`` best, given that ``k`` documents with
        ``least`` or more are known (0: none); ``terms`` are (term, weight, bound)."""
        here = sorted(((min(bound, w * self.raw[t][0]), t, w) for t, w, bound in terms if w > 0 and t in self.raw))
        if not here:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        below = np.cumsum([0, *[b for b, _, _ in here]])  # what the lists before can add together
        read, total, alone = 0, np.zeros(len(self.m), np.int64), not least
        first = len(here)
        while first and below[first] >= max(1, least):  # the lists from here on are essential
            first -= 1
            _, t, w = here[first]
            docs, score = self.list_of(t)
            total[docs] += w * score
            read += len(docs)
            if alone:
                least = max(least, _kth(total[total > 0], k))
        docs = np.flatnonzero(total)
        score = total[docs]
        for i in range(first - 1, -1, -1):
            keep = score + below[i + 1] >= least
            docs, score = docs[keep], score[keep]
            _, t, w = here[i]
            _, firsts, maxima, _, _ = self.raw[t]
            at = np.searchsorted(firsts, docs, "right") - 1
            top = np.where(at >= 0, w * maxima[np.maximum(at, 0)], 0)
            keep = score + top + below[i] >= least
            docs, score, at = docs[keep], score[keep], at[keep]
            for b in np.unique(at[at >= 0]).tolist():
                mine = np.flatnonzero(at == b)
                other, add = self.block(t, b)
                read += len(other)
                place = np.minimum(np.searchsorted(other, docs[mine]), len(other) - 1)
                hit = other[place] == docs[mine]
                score[mine[hit]] += w * add[place[hit]]
            if alone:
                least = max(least, _kth(score, k))
        keep = score >= max(1, least)
        return docs[keep], score[keep], read


class Heap:
    """The ``k`` best of one item: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.ids, self.null, self.score = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.k else 0

    def add(self, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        ids, null, score = (np.concatenate(p) for p in ((self.ids, ids), (self.null, null), (self.score, score)))
        best = np.lexsort((ids, null, -score))[:self.k]
        self.ids, self.null, self.score = ids[best], null[best], score[best]


def _search(batches: Iterator[pa.RecordBatch], items, k: int) -> Iterator[pa.RecordBatch]:
    heaps = [Heap(k) for _ in items.value]
    lists, current = Lists(), None

    def answer() -> None:
        for heap, terms in zip(heaps, items.value):
            docs, score, _ = lists.search(terms, heap.least(), k)
            if len(docs):
                heap.add(lists.ids[docs], lists.null[docs], score)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in LISTS.names if c != "count"]
        for shard, *entry in zip(*columns):
            if shard != current:
                if current is not None:
                    answer()
                lists, current = Lists(), shard
            lists.add(*entry)
    if current is not None:
        answer()
    for i, heap in enumerate(heaps):
        if len(heap.ids):
            yield pa.record_batch([pa.array(np.full(len(heap.ids), i, np.int32)), pa.array(heap.ids, mask=heap.null), pa.array(heap.score)],
                                  HITS.names)


def asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term) of all items."""
    terms = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(terms).alias("term")).distinct()


def corpus_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(TERM)), F.lit(0))
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = TOP, held: int = HELD) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    pairs = stored(asked(items, item, item_text))
    documents, length = corpus_size(docs, text)
    groups = -(-pairs.count() // held) if documents else 0
    out = None
    for g in range(groups):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        best = _group(docs, mine, documents, length, key, text, k)
        out = best if out is None else out.union(best)
    if out is None:
        kind = pairs.schema["item"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("item", kind), T.StructField("rank", T.IntegerType()), *HITS.fields[1:]]))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "copy")
    ranks = out.withColumn("copy", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order))
    return ranks.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _group(docs: DataFrame, pairs: DataFrame, documents: int, length: int, key: str, text: str, k: int) -> DataFrame:
    """Hits (item, doc_id, score) of the items of one group: the best of every task."""
    spark = docs.sparkSession
    context = spark.sparkContext
    held = pairs.orderBy("item", "term").toArrow()  # about HELD rows
    names = sorted(set(held["term"].to_pylist()))
    number = {name.encode(): i for i, name in enumerate(names)}
    vocabulary = context.broadcast(number)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = stored(source.mapInArrow(partial(_index, vocabulary=vocabulary, documents=documents, length=length), LISTS))
    weights = (index.where("term >= 0").groupBy("term").agg(F.sum("count").alias("df"), F.max("most").alias("most"))
               .withColumn("w", F.floor(1000 * F.log((2.0 * F.lit(documents) + 2) / (2.0 * F.col("df") + 1))))
               .select("term", "w", (F.col("w") * F.col("most")).alias("bound")))
    weight = {r["term"]: (r["w"], r["bound"]) for r in weights.collect()}  # a row per term of the group
    lists: dict = {}
    for name, term in zip(held["item"].to_pylist(), held["term"].to_pylist()):
        t = number[term.encode()]
        if t in weight:
            lists.setdefault(name, []).append((t, *weight[t]))
    if not lists:
        return spark.createDataFrame([], T.StructType([T.StructField("item", pairs.schema["item"].dataType), *HITS.fields[1:]]))
    shared = context.broadcast(list(lists.values()))
    dealt = index.repartition(max(partitions(docs), 1), "shard").sortWithinPartitions("shard", "term")
    hits = dealt.mapInArrow(partial(_search, items=shared, k=k), HITS)
    keys = F.broadcast(spark.createDataFrame(list(enumerate(lists)), T.StructType(
        [T.StructField("number", T.IntegerType()), T.StructField("name", pairs.schema["item"].dataType)])))
    hits = hits.withColumnRenamed("item", "number").join(keys, "number")
    return hits.select(F.col("name").alias("item"), "doc_id", "score")


def oracle_sql(k: int = TOP) -> str:
    """The ranking by its definition, as SQL over tables ``documents`` and ``benchmark``."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(text, '{upper}', '{low}'), '{TERM}')"
    return f"""
with doc as (select row_number() over () as r, doc_id, {terms} as t from documents where text is not null),
post as (select r, term, count(*) as tf from (select r, unnest(t) as term from doc) group by 1, 2),
size as (select r, sum(tf)::bigint as n from post group by 1),
whole as (select count(*) as total, sum(n)::bigint as length from size),
term as (select term, floor(1000 * ln((2 * total + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, whole group by term, total),
ask as (select distinct item_id, unnest({terms}) as term from benchmark where text is not null),
hit as (select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // length))))::bigint as score
    from ask join term using (term) join post using (term) join size using (r), whole group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id, r)::int as rank, doc_id, score
from hit join doc using (r) where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id, r) <= {k}
"""
