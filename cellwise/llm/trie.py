"""Prefix trie of conversations by vertical bitmaps.

* Turns become digests of role and text before anything is shuffled; a conversation is then the list of its digests.
* Conversations are sorted by these lists (and id) over range partitions, so that every subtree is one stretch of the
  order, however large. A partition is cut into shards of at most ``SHARD`` conversations and about ``SHARD_TURNS`` turns.
* In a shard an index leads from (position, turn) to the bitset of the conversations that have this turn there. The trie is
  walked depth first: a node's bitset meets the postings of the next turn of its lowest open member, which gives a child;
  its popcount, its lowest bit and the bitset of conversations that end at its depth give the node.
* A node whose conversations lie in one shard is finished there. Only nodes on the border of two shards, the common
  prefix of the last conversation of one and the first of the next, have parts in several. Children are counted where a node begins, leaves
  and tokens where it ends, so that all figures of the parts add up; end lists are hashed as a stream of parts in order.

Order in a conversation: turn (null first), then digest. Null role or text is empty. Rows equal in all columns are
turns of their own. Rows with a null id belong to no conversation and give no node. An empty table gives an empty result. A
conversation's list (16 bytes a turn) must fit a task; nothing else must. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, partitions
from .common import attach, n_words, stored

SHARD, SHARD_TURNS, EVERY, HEADS = 4096, 60_000, 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()

NODES = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("parent_key", T.BinaryType()), T.StructField("depth", T.LongType()),
                      T.StructField("conv_id", T.LongType()), T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()),
                      T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()), T.StructField("words", T.LongType()),
                      T.StructField("saved_tokens", T.LongType()), T.StructField("first_end", T.LongType()), T.StructField("ends", T.StringType())])
HASHES = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("hash", T.StringType())])


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn from any other."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def listed(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns (digest, words) of every conversation in order."""
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest(F.col(role), F.col(text)).alias("digest"), n_words(F.col(text)).alias("words")).alias("t"))
    turns = F.array_sort(F.collect_list("t"))  # by turn, null first, then digest
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def rebuilt(lists: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``every`` in place of its own first h;
    h = crc32(c) % ``heads``."""
    shared = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(shared, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when((F.col("h") > 0) & F.col("head").isNotNull(), F.slice("head", 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


class Shard:
    """Consecutive conversations of the sorted order."""

    def __init__(self, before: int):
        self.before, self.convs, self.turns = before, [], 0  # before: turns that the first shares with the conversation ahead of it

    def add(self, conv_id: int, path: list[bytes], words: list[int]) -> None:
        self.convs.append((conv_id, path, words))
        self.turns += len(path) + 1

    def nodes(self, after: int) -> list[tuple]:
        """All nodes; ``after``: turns that the last conversation shares with the one behind it."""
        first, last = self.convs[0][1], self.convs[-1][1]
        convs = sorted(self.convs)  # bits ascend with ids
        index: dict[tuple[int, bytes], int] = {}
        ending: dict[int, int] = {}
        for i, (_, path, _) in enumerate(convs):
            bit = 1 << i
            for at in enumerate(path):
                index[at] = index.get(at, 0) | bit
            ending[len(path)] = ending.get(len(path), 0) | bit
        keys = {}
        for path, most in ((first, self.before), (last, after)):
            key = b""
            for d in range(most + 1):
                keys[d, path[d - 1] if d else b"", key] = key = hashlib.blake2b(key + (path[d - 1] if d else b""), digest_size=16).digest()
        out: list[tuple] = []
        # A frame: bitset, bits without a child yet, depth, keys of the parent and the node, id of the parent, sums, begins here, ends here.
        whole = (1 << len(convs)) - 1
        key = keys.get((0, b"", b"")) if self.before >= 0 or after >= 0 else None
        stack = [[whole, whole & ~ending.get(0, 0), 0, None, key, None, 0, 0, 0, 0, self.before < 0, after < 0]]
        while stack:
            frame = stack[-1]
            bits, open_, depth = frame[:3]
            low = (bits & -bits).bit_length() - 1
            if open_:
                member = (open_ & -open_).bit_length() - 1
                turn = convs[member][1][depth]
                child = bits & index[depth, turn]
                frame[1] = open_ & ~child
                below = depth + 1
                begins = not (below <= self.before and first[depth] == turn and frame[4] is not None and not frame[10])
                ends = not (below <= after and last[depth] == turn and frame[4] is not None and not frame[11])
                key = None if begins and ends else keys[below, turn, frame[4]]
                frame[6] += begins
                stack.append([child, child & ~ending.get(below, 0), below, frame[4], key, convs[low][0], 0, 0, convs[member][2][depth], 0,
                              begins, ends])
                continue
            stack.pop()
            _, _, _, parent_key, key, parent, children, leaves, words, saved, begins, ends = frame
            size, over = bits.bit_count(), bits & ending.get(depth, 0)
            leaves += int(ends and over == bits)  # a node that goes on ends without children in its last part
            saved += size * words - (words if ends else 0)
            ids = []
            while over:
                ids.append(convs[(over & -over).bit_length() - 1][0])
                over &= over - 1
            text = ",".join(map(str, ids))
            if key is None:
                text = hashlib.sha256(text.encode()).hexdigest() if text else NOTHING
            out.append((key, parent_key, depth, convs[low][0], parent, size, children, leaves, words, saved, ids[0] if ids else None, text))
            if stack:
                stack[-1][7] += leaves
                stack[-1][9] += saved
        return out


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *[(f.name, pa.int64()) for f in NODES.fields[2:-1]], ("ends", pa.string())])

    def rows(shard: Shard, after: int) -> Iterator[pa.RecordBatch]:
        nodes = shard.nodes(after)
        for at in range(0, len(nodes), 10_000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*nodes[at:at + 10_000]), schema)], schema=schema)

    shard, path, after = None, [], -1
    for batch in batches:
        for conv_id, turns, words, ahead, behind in zip(*[c.to_pylist() for c in batch.columns]):
            if shard is None:
                shard = Shard(ahead)
            elif len(shard.convs) >= SHARD or shard.turns >= SHARD_TURNS:
                shared = common_prefix(path, turns)
                yield from rows(shard, shared)
                shard = Shard(shared)
            shard.add(conv_id, turns, words)
            path, after = turns, behind
    if shard is not None:
        yield from rows(shard, after)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the end lists, the parts of which come in order."""
    key, state, out = None, None, []
    for batch in batches:
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], HASHES.names)
            out = []
    if state is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], HASHES.names)


def _borders(sorted_: DataFrame) -> DataFrame:
    """(part, ahead, behind): how many turns the first and the last conversation of each partition share with their
    neighbours in other partitions; -1 at both ends of the order. One row per partition."""
    edge = lambda f: f(F.struct("place", "path"))["path"]
    parts = sorted_.groupBy("part").agg(edge(F.min).alias("first"), edge(F.max).alias("last"))
    by = Window.orderBy("part")
    shared = lambda a, b: F.when(b.isNull(), -1).otherwise(
        F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1,
                   F.size(a).cast("long")))
    return parts.select("part", shared(F.col("first"), F.lag("last").over(by)).alias("ahead"),
                        shared(F.col("last"), F.lead("first").over(by)).alias("behind"))


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of (conv_id, turns) as one row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    paths = conversations.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("path"),
                                 F.transform("turns", lambda t: t["words"]).alias("words"))
    number = F.monotonically_increasing_id()
    order = cut(paths.repartitionByRange(max(partitions(paths), 1), "path", "conv_id").sortWithinPartitions("path", "conv_id")
                .withColumn("place", number))
    order = order.withColumn("part", F.shiftright("place", 33))
    borders = F.broadcast(stored(_borders(order)))  # a row per partition
    walked = order.join(borders, "part").select("conv_id", "path", "words", "ahead", "behind").mapInArrow(_walk, NODES)
    walked = stored(walked)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = walked.where("key is null").withColumnRenamed("ends", "ends_sha256")
    shared = walked.where("key is not null")
    sums = shared.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                     *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    listed_ = shared.where("ends <> ''").select("key", "ends", "first_end")
    hashes = (listed_.repartition(max(partitions(paths), 1), "key").sortWithinPartitions("key", "first_end").select("key", "ends")
              .mapInArrow(_hash, HASHES))
    merged = stored(sums.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(NOTHING))))
    names = stored(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named")))
    below = stored(done.where("parent_key is not null").select("parent_key", *cols)
                   .union(merged.where("parent_key is not null").select("parent_key", F.col("conv_id"), "depth", F.lit(None).cast("long"),
                                                                        *cols[3:])))
    below = attach(below, names, "parent_key", F.struct("conv_id", "depth")).withColumn("parent_conv_id", F.col("named"))
    top = merged.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return done.where("parent_key is null").select(*cols).union(below.select(*cols)).union(top.select(*cols))


def prefix_trie(conversations: DataFrame, **names: str) -> DataFrame:
    """Nodes of the rebuilt conversations of a table of turns."""
    return nodes(rebuilt(listed(conversations, **names)))


def oracle_sql(every: int = EVERY, heads: int = HEADS) -> str:
    """The nodes by their definition, as SQL over table ``conversations``."""
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
with turn as (select conv_id, turn, substring(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as k,
    len(regexp_extract_all(coalesce(text, ''), '{word}'))::bigint as w from conversations where conv_id is not null),
own as (select conv_id, list(k order by turn nulls first, k) as k, list(w order by turn nulls first, k) as w, {_crc_sql()} % {heads} as h
    from turn group by 1),
conv as (select o.conv_id, list_concat(case when h > 0 then coalesce(b.k[1:h], []) else [] end, o.k[h + 1:]) as k,
    list_concat(case when h > 0 then coalesce(b.w[1:h], []) else [] end, o.w[h + 1:]) as w
    from own o left join (select conv_id as base, k, w from own) b on base = o.conv_id - o.conv_id % {every}),
place as (select conv_id, k, w, unnest(range(0, len(k) + 1)) as d from conv),
pre as (select conv_id, d, array_to_string(k[1:d], '') as p, coalesce(w[d], 0) as w, len(k) = d as ends from place),
node as (select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(w) as saved,
    sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from pre group by p),
child as (select left(p, greatest(length(p) - 32, 0)) as p, count(*) as n_children from node where depth > 0 group by 1),
full_ as (select node.*, coalesce(n_children, 0) as n_children from node left join child using (p)),
up as (select unnest(list_transform(range(0, depth + 1), lambda a: left(p, (32 * a)::int))) as p, n_children = 0 as leaf, saved from full_),
sub as (select p, count(*) filter (leaf) as n_leaves, sum(saved)::bigint as saved_tokens from up group by 1)
select f.conv_id, f.depth::bigint as depth, par.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_ f join sub using (p) left join node par on f.depth > 0 and par.p = left(f.p, greatest(length(f.p) - 32, 0))
"""


def _crc_sql() -> str:
    """Unsigned CRC-32 of the decimal conv_id, bit by bit."""
    bits = "flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: list_transform(range(0, 8), lambda b: (ascii(c) >> b) & 1)))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bits}), "
            "lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1))))")
