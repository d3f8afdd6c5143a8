"""Quality classification by histogram gradient-boosted trees over document statistics.

Every whole text is read once and becomes a short vector of statistics (lengths, shares of character classes, repeated
words, lines and word pairs, entropy, compressibility); only these vectors are stored, with the id. Trees are grown on the driver on at
most ``SAMPLE`` labelled rows, drawn by a hash: values are binned at quantiles, each level of a tree sums gradients per node,
feature and bin, and splits where the logistic loss falls most. The forest is flattened into arrays, and a batch of rows
walks all trees at the same time.

Null and empty texts have all statistics 0 and are scored like any other. A document with several labels trains with the
majority (none on a tie); rows that repeat an id train once each unless their statistics agree. Null ids never train. Without labels every
score is 0.5; with one label only, the score is the smoothed share of that label. Empty tables give empty results. Columns of the
result replace columns of the input with the same names; others travel untouched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Rows to train on at most, and the limits of the trees.
SAMPLE, TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 20_000, 80, 4, 64, 0.15, 10, 1.0

CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
           "blank": b" \t", "stop": b".", "pause": b",;:", "loud": b"!?", "quote": b"\"'`", "bracket": b"()[]{}<>",
           "symbol": b"#$%&*+-/=@\\^_|~"}
STATISTICS = ("log_chars", "log_words", "log_lines", "word_length", "word_spread", "short_words", "long_words", "distinct_words",
              "top_word", "repeated_next", "distinct_pairs", "marked_words", "shouted_words", "titled_words", "line_length",
              "distinct_lines", "other", "entropy", "compressed", *CLASSES)
_KIND = np.full(256, len(CLASSES) + 1, np.intp)
for _k, _members in enumerate(CLASSES.values()):
    _KIND[list(_members)] = _k
_KIND[128:] = len(CLASSES)
_KIND[128:192] = len(CLASSES) + 2  # continuation bytes are no characters
_BLANK, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")], _MARK[list(CLASSES["symbol"] + CLASSES["loud"] + b"<>")] = True, True


def statistics(text: bytes | None) -> np.ndarray:
    """Statistics of a whole UTF-8 text, in the order of ``STATISTICS``."""
    words = text.split() if text else []
    if not words:
        return np.zeros(len(STATISTICS), np.float32)
    n, raw = len(words), np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, counts, len(CLASSES) + 3)
    chars = max(1.0, float(len(text) - kinds[-1]))
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    lengths = ends - starts
    lower, upper = np.add.reduceat(_KIND[raw] == 0, starts), np.add.reduceat(_KIND[raw] == 1, starts)
    titled = (_KIND[raw[starts]] == 1) & (lower > 0)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:]) if n > 1 else ids
    lines = [line for line in text.split(b"\n") if line.strip()]
    p = counts[counts > 0] / len(text)
    values = [np.log1p(chars), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(),
              len(index) / n, np.bincount(ids).max() / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, len(pairs) / max(1, n - 1),
              _MARK[raw[ends - 1]].mean(), ((upper > 0) & (lower == 0)).mean(), titled.mean(), np.log1p(chars / len(lines)),
              len(set(lines)) / len(lines), kinds[len(CLASSES)] / chars, -(p * np.log2(p)).sum(), len(zlib.compress(text, 1)) / len(text)]
    return np.array([*values, *(kinds[:len(CLASSES)] / chars)], np.float32)


class Forest:
    """Boosted trees as arrays: node k of tree t splits ``feature[t, k]`` at ``limit[t, k]``; leaves lead to themselves."""

    def __init__(self, base: float, trees: list[tuple[list, list, list, list]], depth: int = 0):
        width = max([len(t[0]) for t in trees], default=1)
        self.base, self.depth = base, depth
        shape = (len(trees), width)
        self.feature, self.limit = np.zeros(shape, np.intp), np.full(shape, np.inf, np.float32)
        self.child, self.value = np.tile(np.arange(width), (*shape[:1], 1)), np.zeros(shape)
        for t, (feature, limit, child, value) in enumerate(trees):
            k = len(feature)
            self.feature[t, :k], self.limit[t, :k], self.child[t, :k], self.value[t, :k] = feature, limit, child, value

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probability of label 1 for each row: one step per level for all rows and trees of a block."""
        out, tree = np.full(len(x), self.base), np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), block):
            rows = np.arange(at, min(at + block, len(x)))[:, None]
            node = np.zeros((len(rows), tree.size), np.intp)
            for _ in range(self.depth):
                right = x[rows, self.feature[tree, node]] > self.limit[tree, node]
                node = self.child[tree, node] + right  # a leaf's limit is infinite, so it stays
            out[at:at + block] += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def edges(column: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 limits between distinct values, near the quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return values[:-1].astype(np.float32)


def grow(code: np.ndarray, limits: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, bins: int,
         least: int, ridge: float) -> tuple[tuple[list, list, list, list], np.ndarray]:
    """One tree by levels, and the value that it gives each row.

    A level adds up gradients per (node, feature, bin) and takes, for each node, the split with the largest gain.
    """
    rows, width = code.shape
    feature, limit, child, value = [0], [np.inf], [0], [-gradient.sum() / (hessian.sum() + ridge)]
    node, open_ = np.zeros(rows, np.intp), [0]
    gain_of = lambda g, h: g * g / (h + ridge)
    for _ in range(depth):
        slot = np.full(len(feature), -1, np.intp)
        slot[open_] = np.arange(len(open_))
        live = np.flatnonzero(slot[node] >= 0)
        cell = (slot[node[live], None] * width + np.arange(width)) * bins + code[live]
        size = len(open_) * width * bins
        add = lambda w: np.bincount(cell.ravel(), None if w is None else np.repeat(w[live], width), size).reshape(
            len(open_), width, bins).cumsum(axis=2)
        g, h, c = add(gradient), add(hessian), add(None)
        whole_g, whole_h, whole_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
        gain = gain_of(g, h) + gain_of(whole_g - g, whole_h - h) - gain_of(whole_g, whole_h)
        gain[(c < least) | (whole_c - c < least)] = -np.inf
        best = gain.reshape(len(open_), -1).argmax(axis=1)
        opened = []
        for s, k in enumerate(open_):
            f, b = divmod(int(best[s]), bins)
            if not gain[s, f, b] > 1e-9:
                continue
            left = len(feature)
            feature[k], limit[k], child[k] = f, float(limits[f][b]), left
            for gl, hl in ((g[s, f, b], h[s, f, b]), (whole_g[s, f, 0] - g[s, f, b], whole_h[s, f, 0] - h[s, f, b])):
                feature.append(0), limit.append(np.inf), child.append(len(child)), value.append(-gl / (hl + ridge))
            mine = live[node[live] == k]
            node[mine] = left + (code[mine, f] > b)
            opened += [left, left + 1]
        open_ = opened
        if not open_:
            break
    return (feature, limit, child, value), np.array(value)[node]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        least: int = LEAST_ROWS, ridge: float = RIDGE) -> Forest:
    """Forest for labels 0 and 1; the base is the smoothed log odds."""
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if ones in (0.0, float(len(y))):
        return Forest(base, [])
    limits = [edges(column, bins) for column in x.T]
    code = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(limits, x.T)])
    raw, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        (feature, limit, child, value), step = grow(code, limits, p - y, p * (1 - p), depth, bins, least, ridge)
        grown.append((feature, limit, child, [rate * v for v in value]))
        raw += rate * step
    return Forest(base, grown, depth)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    rows = [statistics(t.as_py()) for t in texts.cast(pa.binary())]
    flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics of each whole text in column ``statistics`` instead of the text."""
    kept = [F.col(c) for c in docs.columns if c not in (text, "statistics")]
    return docs.select(*kept, statistics_of(F.col(text)).alias("statistics"))


def training_rows(rows: DataFrame, labels: DataFrame, training: Column, key: str, label: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` (nearly; a hash draws them) rows, in a fixed order."""
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.signum(F.col(label).cast("double") - 0.5).alias("vote"), training.alias("trains"))
    votes = votes.where("trains").groupBy("key").agg(F.sum("vote").alias("vote")).where("vote <> 0")
    total = votes.count()
    drawn = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)) < F.lit(min(1.0, sample / max(1, total)) * (1 << 40))
    chosen = F.broadcast(votes.where(drawn).limit(2 * sample))  # at most 2 * sample keys
    known = rows.select(F.col(key).alias("key"), "statistics").join(chosen, "key")
    known = known.select("key", "vote", "statistics").distinct()  # copies of a row train once
    got = known.orderBy(F.xxhash64("key", "statistics"), "key").limit(2 * sample).toArrow()
    if not len(got):
        return np.empty((0, len(STATISTICS)), np.float32), np.empty(0)
    x = np.array(got["statistics"].combine_chunks().flatten(), np.float32).reshape(len(got), -1)
    return x, (np.array(got["vote"]) > 0).astype(float)


def scored(rows: DataFrame, model: Forest, limit: float = 0.3) -> DataFrame:
    """Rows of ``measured`` with ``score`` and ``predicted`` (1 from ``limit`` on) instead of their statistics."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def probability(batch: pa.Array) -> pa.Array:
        x = np.array(batch.flatten(), np.float32).reshape(len(batch), -1)
        return pa.array(shared.value.score(x))

    kept = [F.col(c) for c in rows.columns if c not in ("statistics", "score", "predicted")]
    return rows.select(*kept, probability("statistics").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= limit, 1).otherwise(0))


def classified(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text",
               label: str = "quality", sample: int = SAMPLE, limit: float = 0.3) -> DataFrame:
    """``docs`` without the text, with the score and the prediction of each row.

    ``training`` is a condition on the key that says which rows of ``labels`` may be learned from.
    """
    rows = stored(measured(docs, text))
    return scored(rows, fit(*training_rows(rows, labels, training, key, label, sample)), limit)
