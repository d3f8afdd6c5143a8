import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from cellwise.llm import trie

from .fixtures import words

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("depth", "key", "turns", "path", "part")]])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def key_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def naive(rows):
    """Every node from all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), key_of(role, text), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(words(p[-1][1])) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.prefix_trie(df).select(*COLUMNS).collect())


def sample(seed, n=400):
    rng = random.Random(seed)
    texts = ["one two", "three", "", None, "a  b\tc d", "x" * 2000]
    rows = []
    for c in rng.sample(range(-50, 3000), n):
        length = rng.choice([1, 1, 2, 3, 4, 6, 9])
        hot = rng.random() < 0.4
        for t in range(length):
            text = "hot start" if hot and t < 2 else rng.choice(texts) if rng.random() < 0.8 else f"own {rng.random()}"
            rows.append((c, None if rng.random() < 0.02 else t, rng.choice(["user", "assistant", None]) if not hot else "user", text))
    rows += [(9001, t, "user", f"turn {t // 2}") for t in range(300)] + [(9003, t, "user", f"turn {t // 2}") for t in range(300)]
    rows += [(10_000 + i, 0, "user", "same") for i in range(150)] + [(10_000 + i, 1, "user", "end") for i in range(150)]
    rows += [(None, 0, "user", "lost"), (41, 0, "user", "twice"), (41, 0, "user", "twice"), (77, 5, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [trie.SHARD, 7, 1])
def test_equals_the_definition(spark, monkeypatch, shard):
    """With small shards nearly every node lies on a border (the walk runs here, in the driver's process)."""
    rows = sample(shard)
    if shard == trie.SHARD:
        assert got(table_of(spark, rows)) == naive(rows)
        return
    lists = {r["conv_id"]: r["turns"] for r in trie.rebuilt(trie.listed(table_of(spark, rows))).collect()}
    order = sorted((([bytes(t["digest"]) for t in v], c, [t["words"] for t in v]) for c, v in lists.items()), key=lambda x: x[:2])
    parts, before = [], -1
    for at in range(0, len(order), shard):
        piece = trie.Shard(before)
        for path, c, w in order[at:at + shard]:
            piece.add(c, path, w)
        more = order[at + shard:at + shard + 1]
        before = trie.common_prefix(piece.convs[-1][1], more[0][0]) if more else -1
        parts += piece.nodes(before)
    merged = defaultdict(list)
    for i, p in enumerate(parts):
        merged[p[0] or i].append(p)
    nodes = [(min(p[3] for p in v), v[0][2], sum(p[5] for p in v), sum(p[6] for p in v), sum(p[7] for p in v), sum(p[9] for p in v))
             for v in merged.values()]
    assert sorted(nodes) == sorted((n[0], n[1], *n[3:7]) for n in naive(rows))
    for v in merged.values():
        if v[0][0] is not None:
            firsts = [p[10] for p in v if p[10] is not None]
            assert firsts == sorted(firsts)


def test_many_partitions(spark):
    rows = sample(11, 250)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert got(table_of(spark, rows)) == naive(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_and_turnless(spark):
    assert got(table_of(spark, [])) == []
    assert got(table_of(spark, [(None, 0, "user", "x")])) == []
    short = [(c, 0, "user", "only") for c in range(1, 19)]  # no conversation 0: some lose their only turn
    assert got(table_of(spark, short)) == naive(short)
