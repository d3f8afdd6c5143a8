import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellwise.llm import classlm
from cellwise.llm.common import remainder

from .fixtures import documents, empty, words


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def test_counts_and_base_score(spark):
    docs = documents(spark)
    rows = docs.collect()
    counts, n_docs = Counter(), 0
    for r in rows:
        if not held(r.doc_id):
            counts.update(words(r.text))
            n_docs += 1
    total, kinds = sum(counts.values()) + n_docs, len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    want = Counter((r.doc_id, held(r.doc_id), len(words(r.text)) + 1, sum(counts[w] > 0 for w in words(r.text)) + 1, total,
                    round(sum(base(counts[w]) for w in words(r.text)) + base(n_docs), 6)) for r in rows)
    for options in ({}, {"clustered": 30, "dictionary": 60, "n_classes": 5}):
        got = classlm.score(docs, remainder(F.col("doc_id"), 10) == 0, **options)
        assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()) == want
        assert all(r.score < 0 for r in got.collect())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    classes = np.array([0, 1, 2, 1, 2, 3])
    before = rng.integers(0, 9, (6, 4))
    m = classlm._model(before, classes, 4, np.array([0, 1, 1, 1, 1, 1]), 3)
    assert np.allclose((10 ** m.transitions).sum(axis=1), 1)
    tokens = np.bincount(classes, weights=before.sum(axis=1), minlength=4)
    for c, kinds in ((1, 2), (2, 2), (3, 1)):
        mass = (tokens[c] + 0.1 * kinds + 0.1) / 10 ** m.emission[c]
        assert abs(mass - 1) < 1e-12


def test_exchange_finds_alternating_classes():
    """Two kinds of words that follow each other are told apart, and the gain never falls."""
    rng = np.random.default_rng(0)
    kinds = np.array([0] + [1, 2] * 10)
    seq = np.array([1 + 2 * rng.integers(0, 10) + (i % 2) for i in range(4000)])
    classes = np.concatenate([[0], 1 + rng.integers(0, 2, 20)])
    for _ in range(6):
        before, after = np.zeros((21, 3), int), np.zeros((21, 3), int)
        np.add.at(before, (seq[1:], classes[seq[:-1]]), 1)
        np.add.at(after, (seq[:-1], classes[seq[1:]]), 1)
        classes = classlm.exchange(before, after, classes, 3)
    assert len({(a, b) for a, b in zip(kinds, classes)}) == 3


def test_class_model_beats_unigrams_on_held_out_text(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"{'ab'[i % 2]}{rng.integers(0, 40)}" for i in range(n))
    docs = spark.createDataFrame([(i, text(200)) for i in range(80)], "doc_id long, text string")
    got = classlm.score(docs, remainder(F.col("doc_id"), 10) == 0, n_classes=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_empty_table(spark):
    assert classlm.score(empty(spark), remainder(F.col("doc_id"), 10) == 0).count() == 0


def test_words_outside_the_clustered_get_classes_of_their_own(spark):
    """Rare words of two kinds that share their last three bytes are told apart by their neighbours, in the dictionary or not."""
    rng = np.random.default_rng(8)
    text = lambda i: " ".join(f"{'ab'[k % 2]}{rng.integers(0, 4)}" if rng.random() < 0.8 else f"{'xy'[k % 2]}{i}{k % 10}end"
                              for k in range(200))
    docs = spark.createDataFrame([(i, text(i)) for i in range(80)], "doc_id long, text string")
    total = {}
    for dictionary in (8, 40, 5000):
        got = classlm.score(docs, F.lit(False), n_classes=3, clustered=8, dictionary=dictionary)
        total[dictionary] = got.agg(F.sum("score"), F.sum("base_score")).first()
    best = total[5000][0]
    assert all(abs(t[0] - best) < 1e-6 * abs(best) for t in total.values())
    # with both kinds known, each word is chosen among half of the vocabulary
    assert best - total[5000][1] > 0.95 * math.log10(2) * 80 * 199
