from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellwise.llm import mixing

from .fixtures import documents, empty, words


def waterfill(sizes, share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("options", [{}, {"block": 7, "shard": 16}, {"block": 1000}])
def test_targets_are_met(spark, options):
    docs = documents(spark)
    rows = docs.collect()
    place = mixing.placed(docs.select("doc_id", "text", "source"), keep=False)
    sources, pieces = mixing.mixed(place, **options)
    got = mixing.summary(place, sources, pieces).collect()
    assert Counter((r.id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = waterfill(sizes)
    by = {r.src: r for r in sources.collect()}
    for s in sizes:
        r = by["1" if s is None else "0" + s]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(round(r.target) for r in by.values())
    taken = Counter()
    for r in pieces.collect():
        taken[r.src] += r.n
    assert all(taken[k] == round(r.target) for k, r in by.items())


def test_each_pass_takes_a_word_at_most_once_and_reruns_agree(spark):
    place = mixing.placed(documents(spark).select("doc_id", "text", "source"), keep=False)
    _, pieces = mixing.mixed(place, block=16, shard=32)
    rows = pieces.collect()
    seen = Counter((r.src, r.bucket, r.rn, r.epoch, w) for r in rows for w in range(r.word, r.word + r.n))
    assert max(seen.values()) == 1
    blocks = defaultdict(int)
    for r in rows:
        blocks[r.shard, r.draw] += r.n
    assert max(blocks.values()) <= 16
    assert max(Counter(s for s, _ in blocks).values()) <= 33
    again = mixing.mixed(mixing.placed(documents(spark).select("doc_id", "text", "source").repartition(5), keep=False), block=16, shard=32)[1]
    assert Counter(rows) == Counter(again.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit("a")]).alias("i")).collect()
    assert sorted(r.i for r in got) == list(range(n))
    assert n < 10 or [r.i for r in got] != list(range(n))


def test_mixed_documents_keep_columns_and_words(spark):
    docs = documents(spark)
    got = mixing.mixed_documents(docs, n_chars="n_chars", block=16)
    assert got.columns == docs.columns
    rows = got.collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    taken = Counter()
    for r in rows:
        taken[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert taken == {s: round(t) for s, t in waterfill(sizes).items()}
    long = max(docs.collect(), key=lambda r: len(words(r.text)))
    for r in rows:
        if r.doc_id == long.doc_id:
            at = iter(words(long.text))
            assert all(w in at for w in words(r.text))  # in their order


def test_empty_table(spark):
    place = mixing.placed(empty(spark), keep=False)
    sources, pieces = mixing.mixed(place)
    assert mixing.summary(place, sources, pieces).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    place = mixing.placed(blank, keep=False)
    assert [(r.taken, r.target) for r in mixing.summary(place, *mixing.mixed(place)).collect()] == [(0, 0.0)] * 2


def test_mixture_keeps_columns_of_any_name(spark):
    docs = documents(spark).withColumnsRenamed({"id": "_text", "hash": "taken", "node": "runs", "score": "doc"})
    got = mixing.mixed_documents(docs, n_chars="n_chars")
    assert got.columns == docs.columns and got.count() > 0
    assert {(r["_text"], r["taken"], r["runs"], r["doc"]) for r in got.collect()} == {("x", "x", "x", "x")}
