"""Packing documents into token windows by order-preserving dynamic programming.

Documents are cut into ranges of consecutive keys with about as many documents each, so windows follow the order of the
keys through the whole table. A range's tokens form one stream. Cuts are allowed behind documents, behind sentences (a
small penalty), and a window behind any cut that would else leave more than ``SLACK`` tokens of padding (a larger one).
The cheapest cuts minimise padding plus penalties: the cost of a cut is the least over the cuts up to a window before,
kept in a monotone queue, so a stream takes time linear in its cuts. A window whose length is a power of two needs no
padding.

Tokens come from a public tokenizer file, word by word: its rules never join characters across ASCII blanks, so
the ids of a text are those of its words, and each task encodes a word once (a bounded memory of words, which keeps the
frequent ones when it is full). Where the file's rules part letters from the marks behind them and lower their case, a word is put
together from the ids of both, so that a word is encoded once with whatever marks and capitals. A range is streamed: the cuts of a stretch of tokens are fixed before the next one is read.

Null text is empty and yields the end token only. Rows equal in key and text are packed each. Null keys come first, and
rows of one key by a hash of their texts, so that a key of many rows is spread over ranges too.
Very long texts are split over windows. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import partitions
from .common import held

WINDOW, END_ID = 4096, 2
SENTENCE_PENALTY, HARD_PENALTY, SLACK = 8.0, 64.0, 64
SENTENCE_ENDS = tuple(".!?…。！？｡।॥؟۔")
CLOSERS = "\"')]}”’»›」』）"
LAST = frozenset("".join(SENTENCE_ENDS) + CLOSERS)
JOINED = 512  # words that are encoded as one text
RANGE_CHARS, STRETCH, WORDS_HELD, PIECES_HELD, LEARN_BYTES = 1_000_000, 1 << 19, 600_000, 300_000, 1 << 20

#: Letters whose case and composition no rule changes beyond lower case, and ASCII marks.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-/:-@\[-`{-~]"
LETTERS_MARKS = re.compile(f"({LETTERS}+)({MARKS}*)")
#: Rules of a tokenizer file that part letters from marks.
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def ends_sentence(word: str) -> bool:
    """Whether a word ends in a full stop or the like, perhaps before closing quotes and brackets."""
    return word.rstrip(CLOSERS).endswith(SENTENCE_ENDS)


def _suffix(path: str) -> str | None:
    """Suffix of the last token of every piece, if the rules of the file make lower-case letters one piece and the marks behind them another."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model, before, normal = rules["model"], rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
    steps = before.get("pretokenizers", [])
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
             and sorted(n["type"] for n in normal.get("normalizers", [])) == ["Lowercase", "NFC", "Replace"]
             and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal["normalizers"] if n["type"] == "Replace")
             and [n["type"] for n in steps] == ["Split", "ByteLevel"]
             and steps[0]["pattern"] == {"Regex": PARTING} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
             and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
             and not any(re.fullmatch(f"{LETTERS}*{MARKS}*", t["content"]) for t in rules.get("added_tokens", [])))
    return model.get("end_of_word_suffix") or None if plain else None


class Pieces:
    """Ids of lower-case letters or marks that a tokenizer takes as one piece; a full memory starts anew."""

    def __init__(self, tokenizer, suffix: str, held: int = PIECES_HELD):
        vocabulary = tokenizer.get_vocab()
        self.tokenizer, self.held = tokenizer, held
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index, self.ids, self.starts = {"": 0}, np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _learn(self, new: list[str]) -> None:
        groups = [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        ids, lengths = [], []
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(group) or ends[-1] != len(found):  # a token amid a piece looks like a last one
                each = [c.ids for c in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                found, ends = np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum([len(c) for c in each])
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        self.ids = np.concatenate([self.ids, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))

    def words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words, given as letters and marks in turn."""
        if len(self.index) > self.held:
            self._clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])], lengths.reshape(-1, 2).sum(axis=1)


class WordTokens:
    """Ids of words: each distinct word is encoded once while it is held."""

    def __init__(self, path: str, held: int = WORDS_HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.held = Tokenizer.from_file(path), held
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.single_word]
        self.between = f" {special[0]} " if special else None
        self.mark = self.tokenizer.token_to_id(special[0]) if special else None
        suffix = _suffix(path)
        self.pieces = Pieces(self.tokenizer, suffix) if suffix else None
        self.index: dict[bytes, int] = {}
        self.ids, self.starts = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.sentence, self.uses = np.empty(1 << 14, bool), np.zeros(1 << 14, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each text; many are encoded as one, parted by a special token.

        Where the special token occurs in a text as well, its group is encoded text by text.
        """
        if self.mark is None:
            return self._each(texts)
        groups = [texts[i:i + JOINED] for i in range(0, len(texts), JOINED)]
        joined = self.tokenizer.encode_batch_fast([self.between.join([*g, ""]) for g in groups], add_special_tokens=False)
        parts = []
        for group, coded in zip(groups, joined):
            ids = np.array(coded.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            parts.append((ids[ids != self.mark], np.diff(at, prepend=-1) - 1) if len(at) == len(group) else self._each(group))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = [LETTERS_MARKS.fullmatch(t) for t in texts] if self.pieces else [None] * len(texts)
        parts = [p for m in found if m for p in (m[1].lower(), m[2])]
        if parts:
            some = [i for i, m in enumerate(found) if m]
            self._add([words[i] for i in some], [texts[i] for i in some], *self.pieces.words(parts))
        rest = [i for i, m in enumerate(found) if not m]
        if rest:
            texts = [texts[i] for i in rest]
            self._add([words[i] for i in rest], texts, *self._coded(texts))

    def _add(self, words: list[bytes], texts: list[str], coded: np.ndarray, lengths: np.ndarray) -> None:
        n, more = len(self.index), len(words)
        begin, ends = self.starts[n], np.cumsum(lengths)
        while begin + ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + more >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sentence = np.concatenate([self.sentence, np.empty_like(self.sentence)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.ids[begin:begin + ends[-1]] = coded
        self.starts[n + 1:n + 1 + more] = begin + ends
        self.sentence[n:n + more] = [t[-1] in LAST and ends_sentence(t) for t in texts]
        self.uses[n:n + more] = 0
        self.index.update(zip(words, range(n, n + more)))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``at``, one after the other, and the places behind them."""
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _shed(self) -> None:
        """Keeps the words that were used again, at most the more frequent half."""
        uses = self.uses[:len(self.index)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > self.held // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:self.held // 2]])
        words, n = list(self.index), len(keep)
        ids, ends = self._gather(keep)
        self.ids[:len(ids)], self.starts[1:n + 1] = ids, ends
        self.sentence[:n], self.uses[:n] = self.sentence[keep], self.uses[keep] // 2
        self.index = {words[i]: k for k, i in enumerate(keep.tolist())}

    def encode_many(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the places behind its sentences; words that are new to all texts are learned at once."""
        lists = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string()))  # the six ASCII blanks
        flat = lists.values
        full = np.asarray(pc.binary_length(flat)) > 0
        before = np.concatenate([[0], np.cumsum(full)])[np.asarray(lists.offsets)]  # words before each text
        coded = flat.filter(pa.array(full)).dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > self.held:
            self._shed()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [words[i] for i in missing]
            self._learn(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        at = at[np.asarray(coded.indices)]
        self.uses[:len(self.index)] += np.bincount(at, minlength=len(self.index))
        ids, ends = self._gather(at)
        marks = ends[self.sentence[at]]
        begin = 0
        for end in np.concatenate([[0], ends])[before[1:]].tolist():
            low, high = np.searchsorted(marks, [begin, end], "right")
            yield ids[begin:end], marks[low:high] - begin
            begin = end

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and the places behind its sentences."""
        return next(self.encode_many([text]))


def word_tokens(path: str) -> WordTokens:
    """The words that this Python worker holds, shared by its tasks until another operator runs in it."""
    return held(("words", path), lambda: WordTokens(path))


def cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cheapest windows over ascending ``places`` (the first is the start, the last the end of the stream).

    The cost of ending at a place is the least cost of beginning within a window before it, plus the padding of the
    window, plus the penalty of the place. Windows as long as a power of two have no padding.
    """
    where, fine = places.tolist(), penalties.tolist()
    powers = [1 << k for k in range(window.bit_length())]
    exact: dict[int, list[int]] = {}  # begins from which a window is a power of two long
    for p in powers:
        if p == window:  # has no padding anyway
            break
        at = np.searchsorted(places, places - p)
        for j in np.flatnonzero(places[at] == places - p).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    cost, back = [0.0] * len(where), [0] * len(where)
    begins, values, head = [0], [0.0], 0  # the queue of begins, by ascending cost + place, from ``head`` on
    for j in range(1, len(where)):
        here = where[j]
        while where[begins[head]] < here - window:
            head += 1
        best, source = values[head] + window - here, begins[head]
        if j in exact:
            for i in exact[j]:
                if cost[i] < best:
                    best, source = cost[i], i
        best += fine[j]
        cost[j], back[j] = best, source
        value = best + here
        while values and values[-1] >= value:
            values.pop()
            begins.pop()
        if head > len(begins):
            head = len(begins)
        begins.append(j)
        values.append(value)
    path, j = [], len(where) - 1
    while j:
        path.append(where[j])
        j = back[j]
    return path[::-1]


def _hard(soft: np.ndarray, window: int) -> list[int]:
    """Places a window behind a cut (soft or hard) which has no other place for a cut within the slack of tokens before.

    So a window from any cut can be filled up to the slack, and no two hard places are closer than it.
    """
    slack, out, at, length = max(1, min(SLACK, window // 4)), [], 0, int(soft[-1])
    bare = soft[soft + window - soft[np.searchsorted(soft, soft + window, "right") - 1] >= slack]
    begins, soft_places = deque(bare.tolist()), soft.tolist()
    while begins or at < len(out):
        if at < len(out) and not (begins and begins[0] < out[at]):
            place, at = out[at] + window, at + 1
        else:
            place = begins.popleft() + window
        if place >= length:
            break
        if place - max(soft_places[bisect_right(soft_places, place) - 1], out[-1] if out else 0) >= slack:
            out.append(place)
    return out


def _candidates(length: int, documents: np.ndarray, sentences: np.ndarray, window: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts with their penalties; hard cuts wherever the others would leave padding."""
    soft = np.unique(np.concatenate([[0], documents, sentences, [length]]))
    hard = [_hard(soft, window)]
    if last:  # places from which the tail fills a power of two
        hard.append([length - (1 << k) for k in range(window.bit_length()) if 1 << k < length])
    fine = np.concatenate([np.zeros(len(documents) + 2), np.full(len(sentences), SENTENCE_PENALTY), np.full(sum(map(len, hard)), HARD_PENALTY)])
    place = np.concatenate([[0, length], documents, sentences, *hard]).astype(np.int64)
    order = np.lexsort((fine, place))
    place, first = np.unique(place[order], return_index=True)
    return place, fine[order][first]


class Stream:
    """The open stretch of a range: documents as (id, place of their first token, ids, tokens before)."""

    def __init__(self, part: int, window: int):
        self.part, self.window, self.sequences = part, window, 0
        self.docs: list[tuple[int | None, int, np.ndarray, int, int]] = []
        self.length, self.sentences = 0, []

    def add(self, key: int | None, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.sentences.append(sentences + self.length)
        self.docs.append((key, self.length, ids, 0, len(ids)))
        self.length += len(ids)

    def close(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are fixed; unless the range ends, the rest of the stretch stays open."""
        if not self.docs:
            return []
        ends = np.array([at + len(ids) for _, at, ids, _, _ in self.docs], np.int64)
        places, fine = _candidates(self.length, ends, np.concatenate(self.sentences), self.window, last)
        path = cuts(places, fine, self.window)
        if not last:
            path = path[:max(1, len(path) - 8)]  # the last windows may change with what follows
        out, begin, d = [], 0, 0
        for end in path:
            while d < len(self.docs) and self.docs[d][1] < end:
                key, at, ids, before, total = self.docs[d]
                a, b = max(begin, at), min(end, at + len(ids))
                part = ids[a - at:b - at]
                out.append((key, before + a - at, b - a, zlib.crc32(part.astype("<u4").tobytes()), total,
                            (self.part << 32) + self.sequences, a - begin))
                if at + len(ids) > end:
                    break
                d += 1
            begin, self.sequences = end, self.sequences + 1
        rest = []
        for key, at, ids, before, total in self.docs[d:]:
            skip = max(0, begin - at)
            rest.append((key, max(at, begin) - begin, ids[skip:], before + skip, total))
        sentences = np.concatenate(self.sentences)
        self.docs, self.length, self.sentences = rest, self.length - begin, [sentences[sentences > begin] - begin]
        return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words, stream = word_tokens(path), None

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pieces)], PIECES.names)

    def documents() -> Iterator[tuple]:
        """Range, key, ids and sentence ends of all rows; rows of about ``LEARN_BYTES`` are encoded together."""
        for batch in batches:
            held, size = [], 0
            for part, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = value.as_py()
                held.append((part, key, text))
                size += len(text or b"")
                if size >= LEARN_BYTES:
                    yield from ((c, k, *e) for (c, k, _), e in zip(held, words.encode_many([t for _, _, t in held])))
                    held, size = [], 0
            yield from ((c, k, *e) for (c, k, _), e in zip(held, words.encode_many([t for _, _, t in held])))

    for part, key, ids, sentences in documents():
        if stream is not None and stream.part != part:
            if done := stream.close(True):
                yield rows(done)
            stream = None
        stream = stream or Stream(part, window)
        stream.add(key, np.append(ids, np.uint32(end_id)), sentences)
        if stream.length >= STRETCH and (done := stream.close(False)):
            yield rows(done)
    if stream is not None and (done := stream.close(True)):
        yield rows(done)


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
           range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents in windows.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chars = source.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    order = ["id", F.xxhash64("text")]
    ranges = source.repartitionByRange(max(1, min(chars // range_chars, partitions(docs))), *order).sortWithinPartitions(*order)
    dealt = ranges.select(F.spark_partition_id().cast("long").alias("range"), "id", "text")
    return dealt.mapInArrow(partial(_pack, path=tokenizer, window=window, end_id=end_id), PIECES)
