import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.llm import language
from cellwise.llm.common import remainder, table

from .fixtures import documents, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    found = language.identify(docs, language.fit(docs, ~held)).where(held)
    right, n, least, most = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 300 and right > 0.97 and 0 <= least <= most <= 1


def test_undetermined_and_clashing_columns(spark):
    docs = documents(spark).withColumns({"lang_pred": F.lit(7), "_found": F.lit("kept"), "_found_": F.lit("too")})
    model = language.fit(docs, F.lit(True))
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count() and {(r["_found"], r["_found_"]) for r in rows} == {("kept", "too")}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    odd = spark.createDataFrame([(1, "12 345 $$$"), (2, "Ωμέγα"), (3, "_")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(odd, model).orderBy("doc_id").collect()] == [True, False, True]


def test_no_labels_and_one_label(spark):
    docs = documents(spark)
    assert language.fit(docs, F.lit(False)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"und", "de"}
    assert language.identify(empty(spark), one).count() == 0


def test_families_are_named_once():
    langs = [x for members in language.FAMILIES.values() for x in members]
    assert len(langs) == len(set(langs))


@pytest.mark.parametrize("text", ["", None, "123", "  "])
def test_no_features(text):
    assert language.features(text) is None


def test_votes_by_definition():
    """Family by the largest margin, then a duel of every two languages of it, one row and one machine at a time."""
    rng = np.random.default_rng(2)
    langs = np.array(["en", "de", "nl", "fr", "es", "xx"] * 40, object)
    centres = {g: rng.random(64) for g in set(langs)}
    x = np.array([centres[g] + 0.4 * rng.random(64) for g in langs], np.float32)
    model = language.Classifier(x, langs)
    test = np.array([centres[g] * 0.6 + 0.7 * rng.random(64) for g in langs], np.float32)
    value = lambda w, v: float(np.dot(w[:-1], v.astype(float)) + w[-1])
    sure = lambda m: 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * m))))
    for v, (lang, score) in zip(test, model.predict(test)):
        margins = [value(w, v) for w in model.top]
        best = max(range(len(margins)), key=lambda k: margins[k])
        p = 1 / sum(math.exp(3 * max(-20, m - margins[best])) for m in margins)
        members = model.members[model.families[best]]
        votes, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
        for (a, b), w in model.pairs.items():
            if a in votes:
                win = sure(value(w, v))
                votes[a] += (win >= 0.5) + 1e-3 * win
                votes[b] += (win < 0.5) + 1e-3 * (1 - win)
                least[a], least[b] = min(least[a], win), min(least[b], 1 - win)
        want = max(members, key=lambda g: votes[g])
        assert lang == want and score == pytest.approx(p * least[want], rel=1e-3)


def test_fitting_does_not_copy_the_sample():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.random((400, 1 << language.BITS), np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    langs = np.array(["en", "de", "fr", "es"] * 100, object)
    tracemalloc.start()
    try:
        language.Classifier(x, langs)
        assert tracemalloc.get_traced_memory()[1] < 2 * x.nbytes
    finally:
        tracemalloc.stop()
