"""Language identification by hierarchical discrimination.

A first level of linear support vector machines (one per family) predicts the language family of a text; inside the family,
one machine per pair of languages votes. Features are hashed byte grams of the letters of the whole text.

The machines are fitted on the driver on a bounded sample of labelled rows: about ``PER_LANGUAGE`` rows per language
and at most ``SAMPLE`` in all, drawn by a hash of the row. Predictions are made batch by batch where the text lies;
nothing is shuffled.

Whether a text is written in the predicted language at all is told from its grams alone: their mean log-likelihood under
the language's training rows, against the spread of those rows, with an allowance for short texts. It does not depend on
the number of languages or families.

Null text and text without a letter: ``und`` with score 0. Without usable labels every text is ``und``. A single label is
predicted for every text. Rows with a null label never train. Existing columns with the results' names are replaced.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, release

PER_LANGUAGE, SAMPLE = 1000, 20_000
BITS = 11
UNKNOWN = "und"
#: A text fits a language up to ``REACH`` times the deviation that the share ``EDGE`` of the training rows exceeds (at least ``SPREADS``).
EDGE, REACH, SPREADS = 0.01, 3.0, 3.0

#: Closely related languages; a language named nowhere is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is"), "romance": ("fr", "es", "it", "pt", "ca", "ro"),
            "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"), "baltic": ("lt", "lv"),
            "finnic": ("fi", "et"), "indic": ("hi", "mr", "ne", "bn"), "turkic": ("tr", "az", "kk")}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than a-z becomes a blank; bytes of other letters stay.
LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the square-rooted counts of hashed 1- to 4-byte grams; None without a letter."""
    if not text or not LETTER.search(text):
        return None
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(LETTERS_ONLY), np.uint8).astype(np.uint32)
    total = np.zeros(1 << BITS)
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        gram = (gram[:len(b) - n + 1] * np.uint32(0x01000193)) ^ b[n - 1:]
        total += np.bincount(((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Weights of a linear machine with hinge loss (dual coordinate descent); the last one is the bias."""
    row, norms = np.ones(x.shape[1] + 1), np.empty(len(x))  # one row at a time in double precision: ``x`` is never copied
    for i, v in enumerate(x):
        row[:-1] = v
        norms[i] = (row * row).sum()
    alpha, w = np.zeros(len(x)), np.zeros(len(row))
    share = {s: cost * len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}  # classes weigh alike
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(x)):
            row[:-1] = x[i]
            gradient = y[i] * (row @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), share[int(y[i])])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


class Typical:
    """Gram log-likelihoods of a language and the least deviation of its texts."""

    def __init__(self, x: np.ndarray):
        grams = np.square(x, dtype=np.float64)
        mean = (grams.sum(axis=0) + 1 / x.shape[1]) / (len(x) + 1)
        self.log = np.log(mean).astype(np.float32)
        self.noise = max(float(mean @ self.log ** 2 - (mean @ self.log) ** 2), 1e-9)
        means = grams @ self.log
        self.centre = float(np.median(means))
        self.spread = float(np.median(np.abs(means - self.centre))) * 1.4826
        self.least = min(REACH * float(np.quantile(self.deviation(x), EDGE)), -REACH * SPREADS)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Distance of the mean log-likelihood from the centre in spreads; the rarest gram of a text counts once."""
        grams = np.square(x)
        rarest = np.min(grams, axis=1, where=grams > 0, initial=1.0)
        return (grams @ self.log - self.centre) / np.sqrt(self.spread ** 2 + self.noise * rarest)

    def fits(self, x: np.ndarray) -> np.ndarray:
        return self.deviation(x) >= self.least


class Classifier:
    """Family machines, and a machine for each pair of languages of one family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILY.get(lang, lang) for lang in langs], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(langs[family == f])) for f in self.families}
        self.top = (np.array([fit_svm(x, np.where(family == f, 1, -1)) for f in self.families])
                    if len(self.families) > 1 else None)
        self.typical = {lang: Typical(x[langs == lang]) for lang in sorted(set(langs))}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                some = (langs == a) | (langs == b)
                self.pairs[a, b] = fit_svm(x[some], np.where(langs[some] == a, 1, -1))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each row of features."""
        sure = lambda margin: 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        if self.top is None:
            first, p = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.top[:, :-1].T.astype(np.float32) + self.top[:, -1]
            first = margins.argmax(axis=1)
            e = np.exp(3 * np.clip(margins - margins.max(axis=1, keepdims=True), -20, 0))
            p = 1 / e.sum(axis=1)
        langs, scores = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(first == k)
            members = self.members[f]
            votes, least = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                w = self.pairs[a, b]
                win = sure(x[rows] @ w[:-1].astype(np.float32) + w[-1])
                votes[:, i] += (win >= 0.5) + 1e-3 * win
                votes[:, j] += (win < 0.5) + 1e-3 * (1 - win)
                least[:, i], least[:, j] = np.minimum(least[:, i], win), np.minimum(least[:, j], 1 - win)
            best = votes.argmax(axis=1)
            langs[rows] = np.array(members, object)[best]
            scores[rows] = p[rows] * least[np.arange(len(rows)), best]
        return list(zip(langs, scores.tolist()))


    def fits(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        """Whether each row of features is like the training rows of its language."""
        langs, out = np.array(langs, object), np.zeros(len(x), bool)
        for lang in set(langs):
            out[langs == lang] = self.typical[lang].fits(x[langs == lang])
        return out


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
FITTED = T.StructType([*RESULT.fields, T.StructField("fits", T.BooleanType())])


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    release()
    return pa.array([None if (v := features(t.as_py())) is None else v.tobytes() for t in texts], pa.binary())


def fit(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Classifier | None:
    """Classifier from a bounded sample of the rows of ``docs`` that train and carry a label."""
    rows = docs.where(training).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = min(per_language, max(1, sample // len(counts)))
    chance = F.lit(None).cast("double")
    for name, n in counts.items():
        chance = F.when(F.col("lang") == name, F.lit(each / n)).otherwise(chance)
    drawn = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(1 << 40)) < chance * (1 << 40)
    got = rows.where(drawn).select("lang", _features("text").alias("x")).where("x is not null").limit(2 * sample).toArrow()
    if not len(got):
        return None
    order = pc.sort_indices(got, [("lang", "ascending"), ("x", "ascending")]).to_numpy()
    langs, grams = np.array(got["lang"].to_pylist(), object)[order], got["x"]
    x = np.empty((len(order), 1 << BITS), np.float32)
    for at, i in enumerate(order.tolist()):
        x[at] = np.frombuffer(grams[i].as_buffer(), np.float32)
    del got, grams
    release()
    return Classifier(x, langs)


def identify(docs: DataFrame, model: Classifier | None, text: str = "text", batch: int = 64,
             fits: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the text alone; ``fits`` names a column for whether the text is like
    the training rows of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = FITTED if fits else RESULT

    @F.arrow_udf(kind)
    def predicted(texts: pa.Array) -> pa.Array:
        release()
        langs, scores, like = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at in range(0, len(texts), batch):
            found = [(i, v) for i, t in enumerate(texts[at:at + batch], at) if (v := features(t.as_py())) is not None]
            if not found or shared.value is None:
                continue
            rows, x = [i for i, _ in found], np.array([v for _, v in found])
            answers = shared.value.predict(x)
            scores[rows] = [s for _, s in answers]
            for i, (lang, _) in zip(rows, answers):
                langs[i] = lang
            if fits:
                like[rows] = shared.value.fits(x, [lang for lang, _ in answers])
        columns = [pa.array(langs, pa.string()), pa.array(scores), *([pa.array(like)] if fits else [])]
        return pa.StructArray.from_arrays(columns, kind.names)

    found = free_name(docs, "_found")
    out = docs.withColumn(found, predicted(F.col(text)))
    return out.withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"],
                            **({fits: F.col(found)["fits"]} if fits else {})}).drop(found)
