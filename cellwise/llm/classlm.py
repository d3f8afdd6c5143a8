"""Language-model scoring by Brown classes: exchange clustering, class transitions and word emissions.

1. Words of all training documents are counted (combined per task before the shuffle).
2. Words are written as *units*. The most frequent words, at most ``CLUSTERED``, are units of their own; every other
   word stands for now in the unit of its spelling (last three bytes). The corpus is stored once as unit sequences.
3. Exchange clustering: each pass counts, over the whole training corpus, the classes before and after each unit; the
   counts (units x classes) are bounded and go to the driver, where units are moved one by one to the class that
   gains the most mutual information with the neighbouring classes, until the next pass refreshes the neighbours.
4. Every other training word gets a class of its own in Spark: the classes before and after it are counted over the whole
   training corpus, gathered by word, and the word goes to the class with the largest gain against the table of the last
   pass. Only words that never train keep the class of their spelling.
5. log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class). Transitions are counted over the whole
   training corpus with the classes of all words and smoothed towards class frequencies (Witten-Bell); emissions add 0.1
   per word of the class and one unseen word.

A dictionary of at most ``DICTIONARY`` words with their counts and classes is broadcast; the counts and classes of all
other words reach the documents that use them by a join on the word. Both bounds are parameters, and neither drops a word.

Null text counts as empty and holds the end token only. Empty tables, or tables without training rows, give scores of a
model without counts. Repeated rows are scored alike and all count in training. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

CLASSES, CLUSTERED, DICTIONARY, PASSES = 32, 16_000, 200_000, 3
SHAPES = 256
ADD = 0.1
LONG_WORD = 64
END = 0  # unit and class of the end token, which also stands before the first word

COUNTED = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])
ENCODED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("n_listed", T.LongType()), T.StructField("listed_log", T.DoubleType()), T.StructField("units", T.BinaryType()),
    T.StructField("outside", T.BinaryType()),  # of each place in a unit of a spelling: dictionary index, or -1 - index in rare
    T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])))])
TALLIED = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
CONTEXTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("seen", T.BinaryType())])
ASSIGNED = T.StructType([*COUNTED.fields, T.StructField("class", T.LongType())])
CLASSED = T.StructType([
    T.StructField("row", T.LongType()), *[f for f in ENCODED.fields if f.name not in ("units", "outside", "rare")],
    T.StructField("classes", T.BinaryType()), T.StructField("open", T.BinaryType())])


@dataclass
class Model:
    """Class of each row of the counts, log10 transition matrix and log10 emission denominator of each class."""

    classes: np.ndarray
    transitions: np.ndarray
    emission: np.ndarray


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; a word beyond 64 bytes is named by its digest."""
    words = text.lower().split() if text else []
    if words and max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.md5(w).digest() for w in words]
    return words


def shape(word: bytes) -> int:
    """Unit of a word by its spelling."""
    return 1 + zlib.crc32(word[-3:]) % SHAPES


def _count(batches: Iterator[pa.RecordBatch], held: int = 400_000) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for value in batch.column(0).cast(pa.binary()):
            counts.update(words_of(value.as_py()))
            if len(counts) > held:
                yield flush()
    if counts:
        yield flush()


def _encode(batches: Iterator[pa.RecordBatch], lists) -> Iterator[pa.RecordBatch]:
    index, unit, logs = lists.value
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for value in batch.column(2).cast(pa.binary()):
            words = words_of(value.as_py())
            at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
            units = np.zeros(len(words) + 1, np.uint16)
            missing = np.flatnonzero(at < 0)
            if len(unit):
                units[:-1] = unit[at]
            listed = at[at >= 0]
            rare: dict[bytes, int] = {}
            for i in missing.tolist():
                units[i] = shape(words[i])
                at[i] = -1 - rare.setdefault(words[i], len(rare))
            times = np.bincount(-1 - at[missing], minlength=len(rare)).tolist()
            outside = at[units[:-1] <= SHAPES].astype(np.int32)
            for col, x in zip(cols, (len(units), len(listed), float(logs[listed].sum()), units.tobytes(), outside.tobytes(),
                                     [{"word": w, "n": n} for w, n in zip(rare, times)])):
                col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
        yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                              ["id", "held_out", "n_tokens", "n_listed", "listed_log", "units", "outside", "rare"])


def _tally(batches: Iterator[pa.RecordBatch], classes: np.ndarray, n_classes: int) -> Iterator[pa.RecordBatch]:
    """Counts of (unit, class before) and, shifted by their number, of (unit, class after)."""
    size = len(classes) * n_classes
    total = np.zeros(2 * size, np.int64)
    for batch in batches:
        seq = np.frombuffer(np.uint16(END).tobytes() + b"".join(batch.column(0).to_pylist()), np.uint16).astype(np.int64)
        before, here = seq[:-1], seq[1:]
        total[:size] += np.bincount(here * n_classes + classes[before], minlength=size)
        total[size:] += np.bincount(before * n_classes + classes[here], minlength=size)
    keys = np.flatnonzero(total)
    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], ["key", "n"])


def _outside(seq: np.ndarray) -> np.ndarray:
    """Places of a unit sequence that stand in a unit of a spelling."""
    return np.flatnonzero((seq != END) & (seq <= SHAPES))


def _contexts(batches: Iterator[pa.RecordBatch], lists, classes: np.ndarray, n_classes: int, held: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Words outside the clustered ones with ``n * 2 * n_classes + key`` of each class before (key below the number of
    classes) and after (above), combined per task."""
    listed = pa.array(list(lists.value[0]), pa.binary())
    width, local, codes, pending = 2 * n_classes, {}, [], 0

    def flush() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(codes), return_counts=True)
        word, first = np.unique(found // width, return_index=True)
        ends = (8 * np.append(first, len(found))).astype(np.int32)
        seen = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(n * width + found % width)])
        words = pa.concat_arrays([listed, pa.array(list(local), pa.binary())]).take(pa.array(word))
        codes.clear(), local.clear()
        return pa.record_batch([words, seen], ["word", "seen"])

    for batch in batches:
        seq = np.frombuffer(np.uint16(END).tobytes() + b"".join(batch.column(0).to_pylist()), np.uint16)
        at, c = _outside(seq), classes[seq]
        outside = batch.column(1).to_pylist()
        word = np.frombuffer(b"".join(outside), np.int32).astype(np.int64)
        rare = batch.column(2)
        begins = np.cumsum([0, *rare.value_lengths().to_pylist()])[:-1]
        ids = np.fromiter((local.setdefault(w, len(local)) for w in rare.flatten().field("word").to_pylist()), np.int64)
        unlisted = word < 0
        begin = np.repeat(begins, [len(x) // 4 for x in outside])
        word[unlisted] = len(listed) + ids[(begin - 1 - word)[unlisted]]
        codes += [word * width + c[at - 1], word * width + n_classes + c[at + 1]]
        pending += 2 * len(word)
        if pending > held:
            yield flush()
            pending = 0
    if pending:
        yield flush()


def _assign(batches: Iterator[pa.RecordBatch], classes: np.ndarray, joint: np.ndarray, n_classes: int) -> Iterator[pa.RecordBatch]:
    """(word, count, class) from the contexts of ``_contexts`` ordered by word."""
    width, words, parts = 2 * n_classes, [], []

    def closed(some: list[bytes], seen: list[bytes]) -> pa.RecordBatch:
        names = list(dict.fromkeys(some))
        place = dict(zip(names, range(len(names))))
        word = np.repeat(np.fromiter(map(place.get, some), np.int64, len(some)), [len(x) // 8 for x in seen])
        n, key = np.divmod(np.frombuffer(b"".join(seen), np.int64), width)
        codes, at = np.unique(word * width + key, return_inverse=True)
        n = np.bincount(at, weights=n)
        word, key = np.divmod(codes, width)
        best = best_classes(word, key, n, classes[[shape(w) for w in names]], joint, n_classes)
        c = np.bincount(word, weights=n * (key < n_classes)).astype(np.int64)
        return pa.record_batch([pa.array(names, pa.binary()), pa.array(c), pa.array(best)], ["word", "c", "class"])

    for batch in batches:
        words += batch.column(0).to_pylist()
        parts += batch.column(1).to_pylist()
        last = len(words)
        while last and words[last - 1] == words[-1]:
            last -= 1
        if last:  # the last word may go on in the next batch
            yield closed(words[:last], parts[:last])
            words, parts = words[last:], parts[last:]
    if words:
        yield closed(words, parts)


def best_classes(word: np.ndarray, key: np.ndarray, n: np.ndarray, own: np.ndarray, joint: np.ndarray, n_classes: int) -> np.ndarray:
    """Class with the largest gain of each word, as in ``exchange``, against a fixed table that counts the word in ``own``.

    ``word`` (ascending), ``key`` and ``n`` list the counts of classes before and after the words 0, 1, ...
    """
    first = np.flatnonzero(np.diff(word, prepend=-1))
    rows = np.arange(len(own))
    side = (key >= n_classes).astype(np.int64)
    add = np.zeros((len(own), 2))
    np.add.at(add, (word, side), n)

    def gain(there: np.ndarray, more: np.ndarray) -> np.ndarray:
        return _xlogx(there + more) - _xlogx(there)

    there = joint[:, key]
    there[own[word], np.arange(len(word))] -= n
    mass = np.repeat(joint.reshape(n_classes, 1, 2, n_classes).sum(axis=3), len(own), axis=1)
    mass[own, rows] -= add
    gains = np.add.reduceat(gain(there, n), first, axis=1) - gain(mass, add).sum(axis=2)
    gains[END] = -np.inf
    best = gains.argmax(axis=0)
    return np.where(gains[best, rows] > gains[own, rows], best, own)


def _listed_classes(batches: Iterator[pa.RecordBatch], lists) -> Iterator[pa.RecordBatch]:
    index = lists.value[0]
    for batch in batches:
        found = [(i, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (i := index.get(w)) is not None]
        yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["key", "n"])


def _classed(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Classes of all places; ``open`` are pairs (place, index in rare) of the words outside the dictionary."""
    classes, listed = known.value
    for batch in batches:
        done, still = [], []
        for units, outside in zip(batch.column("units").to_pylist(), batch.column("outside").to_pylist()):
            seq, word = np.frombuffer(units, np.uint16), np.frombuffer(outside, np.int32)
            c, at = classes[seq].astype(np.uint8), _outside(seq)
            c[at[word >= 0]] = listed[word[word >= 0]]
            done.append(c.tobytes())
            still.append(np.stack([at[word < 0], -1 - word[word < 0]]).astype(np.int32).tobytes())
        yield pa.record_batch([*[batch.column(f) for f in CLASSED.names[:6]], pa.array(done, pa.binary()), pa.array(still, pa.binary())], CLASSED.names)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of words outside the dictionary put in their places; an unseen word keeps the class of its spelling."""
    for batch in batches:
        out = []
        joined = batch.column("rare_classes")
        k, known = (joined.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("k", "class"))
        ends = np.cumsum([0, *(n or 0 for n in joined.value_lengths().to_pylist())])
        for a, b, done, still in zip(ends, ends[1:], batch.column("classes").to_pylist(), batch.column("open").to_pylist()):
            c, (at, which) = np.frombuffer(done, np.uint8).copy(), np.frombuffer(still, np.int32).reshape(2, -1)
            if b > a:
                found = np.full(which.max() + 1, -1, np.int64)
                found[k[a:b]] = known[a:b]
                seen = found[which] >= 0
                c[at[seen]] = found[which[seen]]
            out.append(c.tobytes())
        names = [n for n in batch.schema.names if n not in ("classes", "open", "rare_classes")]
        yield pa.record_batch([*[batch.column(n) for n in names], pa.array(out, pa.binary())], [*names, "classes"])


def _pairs(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[pa.RecordBatch]:
    """Counts of (class, class before)."""
    total = np.zeros(n_classes * n_classes, np.int64)
    for batch in batches:
        seq = np.frombuffer(bytes([END]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
        total += np.bincount(seq[1:] * n_classes + seq[:-1], minlength=len(total))
    keys = np.flatnonzero(total)
    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], ["key", "n"])


def _transit(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        out = []
        for classes in batch.column("classes").to_pylist():
            c = np.frombuffer(classes, np.uint8)
            out.append(float(m.transitions[np.concatenate(([END], c[:-1])), c].sum() - m.emission[c].sum()))
        yield pa.record_batch([*[batch.column(n) for n in ("id", "held_out", "n_tokens", "n_known", "words_log")],
                               pa.array(out, pa.float64())],
                              ["id", "held_out", "n_tokens", "n_known", "words_log", "class_log"])


def _tallies(train: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class counts before and after each unit over the whole training corpus."""
    rows = (train.select("units").mapInArrow(partial(_tally, classes=classes, n_classes=n_classes), TALLIED)
            .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    both = np.zeros(2 * len(classes) * n_classes, np.int64)
    both[rows["key"].to_numpy()] = rows["n"].to_numpy()
    return tuple(both.reshape(2, len(classes), n_classes))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, n_classes: int, sweeps: int = 2) -> np.ndarray:
    """Units moved one by one to the class with the largest gain, most frequent first; the end token stays alone."""
    classes = classes.copy()
    sides = np.concatenate([before, after], axis=1).astype(float)  # neighbours as labelled by the last pass
    joint = np.zeros((n_classes, sides.shape[1]))
    np.add.at(joint, classes, sides)
    order = np.argsort(-before.sum(axis=1), kind="stable")
    order = [u for u in order.tolist() if u != END and sides[u].any()]
    half = n_classes
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own, row = classes[u], sides[u]
            joint[own] -= row
            mass = joint[1:].reshape(n_classes - 1, 2, half).sum(axis=2)
            add = row.reshape(2, half).sum(axis=1)
            at = np.flatnonzero(row)
            there = joint[1:, at]
            gain = ((_xlogx(there + row[at]) - _xlogx(there)).sum(axis=1)
                    - (_xlogx(mass + add) - _xlogx(mass)).sum(axis=1))
            best = 1 + int(np.argmax(gain))
            if gain[best - 1] <= gain[own - 1]:
                best = own
            joint[best] += row
            moved += best != own
            classes[u] = best
        if not moved:
            break
    return classes


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``, by whole steps of the log count (no sort of all words)."""
    step = F.floor(64 * F.log2("c")).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    low, total = None, 0
    for value, n in sizes:
        if total + n > most:
            break
        low, total = value, total + n
    return counts.where(step >= low) if low is not None else counts.limit(0)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", n_classes: int = CLASSES,
          clustered: int = CLUSTERED, dictionary: int = DICTIONARY, passes: int = PASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; at most 256 classes."""
    if n_classes > 256:
        raise ValueError("classes are stored as bytes: at most 256")
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(key).cast("long").alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))
    training = source.where(~F.col("held_out"))
    counts = stored(training.select("text").mapInArrow(_count, COUNTED).groupBy("word").agg(F.sum("c").alias("c")))
    n_docs = training.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_docs, distinct + (n_docs > 0)

    listed = _frequent(counts, dictionary).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    own = _frequent(counts, clustered).count()
    index = {w: i for i, w in enumerate(listed["word"].to_pylist())}
    unit = np.array([1 + SHAPES + i if i < own else shape(w) for i, w in enumerate(index)], np.uint16)
    logs = np.log10(listed["c"].to_numpy() + ADD)
    n_units = 1 + SHAPES + own
    lists = sc.broadcast((index, unit, logs))

    encoded = stored(source.mapInArrow(partial(_encode, lists=lists), ENCODED).withColumn("row", F.monotonically_increasing_id()))
    train = encoded.where(~F.col("held_out"))
    classes = np.concatenate([[END], 1 + np.arange(n_units - 1) % (n_classes - 1)]).astype(np.int64)
    for _ in range(passes):
        classes = exchange(*_tallies(train, classes, n_classes), classes, n_classes)
    joint = np.zeros((n_classes, 2 * n_classes))
    np.add.at(joint, classes, np.concatenate(_tallies(train, classes, n_classes), axis=1))
    assigned = stored(train.select("units", "outside", "rare")
                      .mapInArrow(partial(_contexts, lists=lists, classes=classes, n_classes=n_classes), CONTEXTS)
                      .repartition("word").sortWithinPartitions("word")
                      .mapInArrow(partial(_assign, classes=classes, joint=joint, n_classes=n_classes), ASSIGNED))
    found = assigned.select("word", "class").mapInArrow(partial(_listed_classes, lists=lists), TALLIED).toArrow()
    of_listed = np.zeros(len(index), np.uint8)
    of_listed[found["key"].to_numpy()] = found["n"].to_numpy()

    rare = encoded.select("row", F.posexplode("rare").alias("k", "r")).select("row", "k", "r.word", "r.n")
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(assigned, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + ADD)).alias("rare_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.when(c > 0, F.struct("k", "class"))).alias("rare_classes"))
    end_log = F.log10(F.lit(float(n_docs)) + ADD)
    classed = (encoded.drop("rare").mapInArrow(partial(_classed, known=sc.broadcast((classes, of_listed))), CLASSED)
               .join(rare, "row", "left").select(
        "id", "held_out", "n_tokens",
        (F.col("n_listed") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        (F.col("listed_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log).alias("words_log"), "classes", "open", "rare_classes"))
    plain = [f for f in classed.schema.fields if f.name not in ("classes", "open", "rare_classes")]
    classed = stored(classed.mapInArrow(_filled, T.StructType([*plain, T.StructField("classes", T.BinaryType())])))

    rows = (classed.where(~F.col("held_out")).select("classes").mapInArrow(partial(_pairs, n_classes=n_classes), TALLIED)
            .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    before = np.zeros(n_classes * n_classes, np.int64)
    before[rows["key"].to_numpy()] = rows["n"].to_numpy()
    kinds = np.bincount(classes[1 + SHAPES:], minlength=n_classes)
    for r in assigned.groupBy("class").count().collect():
        kinds[r["class"]] += r["count"]
    model = sc.broadcast(_model(before.reshape(n_classes, n_classes), np.arange(n_classes), n_classes, kinds, n_docs))

    scored = classed.mapInArrow(partial(_transit, model=model), T.StructType([*plain, T.StructField("class_log", T.DoubleType())]))
    return scored.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("words_log") - F.col("n_tokens") * F.log10(F.lit(total + ADD * (distinct + 1)))).alias("base_score"),
        (F.col("words_log") + F.col("class_log")).alias("score"))


def _model(before: np.ndarray, classes: np.ndarray, n_classes: int, words: np.ndarray, n_docs: int) -> Model:
    """Smoothed log10 probabilities from the class counts of the last pass."""
    follow = np.zeros((n_classes, n_classes))
    np.add.at(follow.T, classes, before)
    tokens = follow.sum(axis=0)
    share = (tokens + 1) / (tokens.sum() + n_classes)
    kinds = np.maximum((follow > 0).sum(axis=1), 1)[:, None]
    transitions = np.log10((follow + kinds * share) / (follow.sum(axis=1)[:, None] + kinds))
    sizes = np.bincount(classes, weights=words, minlength=n_classes)
    sizes[END] += n_docs > 0
    return Model(classes, transitions, np.log10(tokens + ADD * (sizes + 1)))
