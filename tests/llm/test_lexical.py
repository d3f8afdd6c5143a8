import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cellwise.llm import lexical
from cellwise.llm.lexical import TERM, TOP

from .fixtures import documents, empty


def naive(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], k: int = TOP) -> set[tuple]:
    """The definition, for tests: every document scored for every item."""
    terms_of = lambda t: re.findall(TERM, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(i, Counter(w)) for i, t in docs if (w := terms_of(t))]
    total, n_docs = sum(sum(b.values()) for _, b in bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    asks: dict = {}
    for item, t in items:
        asks.setdefault(item, set()).update(terms_of(t))
    out = set()
    for item, terms in asks.items():
        found = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in terms if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)}
    return out


def rows(df):
    return [(r["item"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def items_of(spark, docs, seed=2, n=30):
    rng = random.Random(seed)
    texts = [r["text"] for r in docs.collect() if r["text"]]
    items = []
    for i in range(n):
        words = rng.choice(texts).split()
        items.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) if words else ""))
    items += [(3, "more terms"), (None, items[0][1]), (90, None), (91, ""), (92, "zzzz nowhere"), (93, items[1][1].upper())]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_the_definition(spark, monkeypatch, k):
    docs = documents(spark, n=150).repartition(5)
    items, plain = items_of(spark, docs)
    got = rows(lexical.ranked(docs, items, k=k))
    want = naive([(r["doc_id"], r["text"]) for r in docs.collect()], plain, k)
    assert len(got) == len(want) and set(got) == want


def test_groups_of_items_and_small_shards(spark, monkeypatch):
    docs = documents(spark, seed=5, n=120)
    items, plain = items_of(spark, docs, seed=6)
    want = naive([(r["doc_id"], r["text"]) for r in docs.collect()], plain)
    assert set(rows(lexical.ranked(docs, items, held=40))) == want


def test_empty_tables(spark):
    docs = documents(spark)
    items, _ = items_of(spark, docs)
    assert rows(lexical.ranked(empty(spark), items)) == []
    assert rows(lexical.ranked(docs, items.limit(0))) == []
    assert rows(lexical.ranked(docs.where("text is null"), items)) == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for top in (3, 300, 70_000):
        docs = np.unique(rng.integers(0, top * 50, 128)).astype(np.int64)
        tf = rng.integers(1, top, len(docs))
        got = lexical.unpack_block(lexical.pack_block(docs, tf), int(docs[0]))
        assert (got[0] == docs).all() and (got[1] == tf).all()


def filled(rng, docs, terms):
    shard = lexical.Shard()
    for d in range(docs):
        mine = np.flatnonzero(rng.random(terms) < np.linspace(0.9, 0.01, terms))
        shard.add(d, int(rng.integers(50, 400)), mine, rng.integers(1, 9, len(mine)))
    lists = lexical.Lists()
    for row in shard.rows(1).to_pylist():
        lists.add(row["term"], row["most"], row["firsts"], row["maxima"], row["places"], row["blocks"])
    return lists


def test_bounds_reject_blocks_and_lose_nothing():
    rng = np.random.default_rng(2)
    lists = filled(rng, 3000, 30)
    saved = 0
    for _ in range(40):
        terms = [(int(t), int(rng.integers(1, 5000)), None) for t in rng.choice(30, 8, replace=False)]
        terms = [(t, w, w * lists.raw[t][0]) for t, w, _ in terms]
        total = np.zeros(3000, np.int64)
        for t, w, _ in terms:
            docs, score = lists.list_of(t)
            total[docs] += w * score
        for least in (0, lexical._kth(total, 10)):
            docs, score, read = lists.search(terms, least, 10)
            assert (total[docs] == score).all()
            assert set(np.flatnonzero(total >= max(1, lexical._kth(total, 10)))) <= set(docs.tolist())
            saved += sum(len(lists.list_of(t)[0]) for t, _, _ in terms) - read
    assert saved > 0
