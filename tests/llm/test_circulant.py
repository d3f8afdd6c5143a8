from collections import Counter

import numpy as np

from cellwise.llm import circulant
from cellwise.llm.links import components

from .fixtures import documents, empty, words


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    key = [circulant.NULL_ID if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(key[i], least.get(find(i), key[i]))
    return Counter((key[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_components_equal_all_pairs(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for width in (4, 5):
        got = Counter((r.id, r.n, r.component_id) for r in circulant.near_duplicates(docs, width=width).collect())
        assert got == brute(rows, width, 80)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = circulant.deduplicated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    groups = {c for i, n, c in brute(rows, 5, 80) if n}
    assert sum(1 for r in got if words(r.text)) == len(groups)
    blank = {(r.doc_id, r.text) for r in docs.collect() if not words(r.text)}
    assert {(r.doc_id, r.text) for r in got if not words(r.text)} == blank


def test_empty_table(spark):
    assert circulant.near_duplicates(empty(spark)).count() == 0
    assert circulant.deduplicated(empty(spark)).columns == empty(spark).columns


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    got = np.mean(circulant.signature(a, 512) == circulant.signature(b, 512))
    assert abs(got - 0.6) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def test_deduplicated_keeps_columns_of_any_name(spark):
    docs = documents(spark).withColumnsRenamed({"id": "_id", "hash": "_hash", "node": "doc", "score": "text_hash"})
    got = circulant.deduplicated(docs)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()
    assert {(r["_id"], r["_hash"], r["doc"], r["text_hash"]) for r in got.collect()} == {("x", "x", "x", "x")}


def test_few_texts_are_shuffled_for_a_few_chosen(spark):
    rows = spark.range(20_000).selectExpr("id", "id * 7 as text_hash", "'text' as text")
    chosen = rows.where("id % 500 = 3").select("id", "text_hash")
    got = {r.id for r in circulant.marked(rows, chosen, ["id", "text_hash"]).collect()}
    assert {r.id for r in chosen.collect()} <= got and len(got) < 60
    assert circulant.marked(rows, chosen.limit(0), ["id", "text_hash"]).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group of many different near copies, some linked and some not, is compared in tiles with few exact comparisons."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(240):
        text = list(base)
        for at in rng.choice(90, rng.integers(0, 6), replace=False):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    compared, verified = [], circulant._verified
    monkeypatch.setattr(circulant, "_verified", lambda pairs, *a: (compared.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(circulant, "TILE", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n, r.component_id) for r in circulant.near_duplicates(docs, width=4).collect())
    expected = brute(rows, 4, 80)
    assert got == expected and 20 < len({c for _, _, c in expected}) < 220
    assert sum(compared) < 2400


def test_bound_of_bitmaps_loses_no_link():
    rng = np.random.default_rng(6)
    for n in (3, 40, 500, 6000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.7, 0.85, 0.92, 1.0):
            b = np.unique(np.concatenate([a[:int(share * n)], rng.integers(0, 2**63, n - int(share * n)).astype(np.uint64)]))
            bits = np.frombuffer(circulant.bitmap(a) + circulant.bitmap(b), np.uint8).reshape(2, -1)
            common = len(np.intersect1d(a, b))
            u, _ = circulant._in_tile(bits, np.array([len(a), len(b)]), np.array([0, 1]), np.zeros(2), True, 8, 80)
            assert len(u) or 100 * common < 80 * (len(a) + len(b) - common)
