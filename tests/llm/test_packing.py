import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellwise.llm import packing

from .fixtures import documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for key, texts in want.items():
        own = sorted((r for r in rows if r.id == key), key=lambda r: (r.start, r.doc_tokens))
        found = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        assert sum(r.length for r in own) == sum(map(len, texts))
        for (start, length, crc, total), n in found.items():
            fits = sum(zlib.crc32(t[start:start + length].tobytes()) == crc and len(t) == total for t in texts)
            assert fits >= n


@pytest.mark.parametrize("window,chars", [(4096, 1_000_000), (64, 4_000), (100, 20_000)])
def test_round_trip(spark, window, chars):
    docs = documents(spark)
    rows = packing.packed(docs, PATH, window=window, range_chars=chars).collect()
    check(rows, docs.collect(), window)


def test_stretches_give_one_gapless_stream(spark, monkeypatch):
    stream, out = packing.Stream(3, 64), []
    rng, texts = np.random.default_rng(2), []
    for key in range(40):
        ids = rng.integers(0, 99, rng.integers(1, 300)).astype(np.uint32)
        texts.append(ids)
        stream.add(key, ids, np.arange(9, len(ids), 10))
        if stream.length > 500:
            out += stream.close(False)
    out += stream.close(True)
    for key, ids in enumerate(texts):
        own = sorted(r for r in out if r[0] == key)
        assert [r[1] for r in own] == list(np.cumsum([0] + [r[2] for r in own])[:-1]) and sum(r[2] for r in own) == len(ids)
        assert all(zlib.crc32(ids[r[1]:r[1] + r[2]].astype("<u4").tobytes()) == r[3] for r in own)


def brute_cost(places, penalties, window):
    cost = [0.0]
    for j in range(1, len(places)):
        best = float("inf")
        for i in range(j):
            n = places[j] - places[i]
            if n <= window:
                best = min(best, cost[i] + (0 if n & (n - 1) == 0 else window - n))
        cost.append(best + penalties[j])
    return cost[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 17, rng.integers(2, 40)))]).astype(np.int64)
        penalties = rng.choice([0.0, 3.0, 20.0], len(places))
        penalties[0] = penalties[-1] = 0
        path = packing.cuts(places, penalties, 32)
        cost, at = 0.0, 0
        for p in path:
            n = p - at
            assert 0 < n <= 32
            cost, at = cost + (0 if n & (n - 1) == 0 else 32 - n) + penalties[list(places).index(p)], p
        assert at == places[-1] and cost == pytest.approx(brute_cost(places, penalties, 32))


def test_cuts_of_whole_windows_are_the_cheapest():
    """At the window of the query, also where a short window without padding lets the next one be full."""
    rng = np.random.default_rng(6)
    for lengths in ([32, 4096], [1, 4096, 4096], *[rng.choice([1, 2, 8, 32, 100, 1000, 4064, 4096], 12) for _ in range(30)]):
        places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        cost, at = 0.0, 0
        for p in packing.cuts(places, np.zeros(len(places)), 4096):
            cost, at = cost + (0 if (p - at) & (p - at - 1) == 0 else 4096 - (p - at)), p
        assert at == places[-1] and cost == brute_cost(places, np.zeros(len(places)), 4096)


def test_little_padding(spark):
    rows = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).collect()
    length = Counter()
    for r in rows:
        length[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in length.values())
    assert padding < 0.01 * sum(length.values())


def test_windows_follow_the_keys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(docs, PATH, range_chars=200_000).orderBy("sequence_id", "offset").collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    assert [(r.id, r.start) for r in rows] == sorted((r.id, r.start) for r in rows)


@pytest.mark.parametrize("tokens", [1366, 1400, 1500, 3000])
def test_little_padding_without_sentence_ends(tokens):
    stream, out = packing.Stream(0, 4096), []
    for key in range(300):
        stream.add(key, np.zeros(tokens, np.uint32), np.empty(0, np.int64))
        if stream.length > 1 << 18:
            out += stream.close(False)
    length = Counter()
    for r in out + stream.close(True):
        length[r[5]] += r[2]
    assert sum(length.values()) == 300 * tokens
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in length.values()) < 0.02 * 300 * tokens


def test_a_window_from_any_place_can_be_filled():
    rng = np.random.default_rng(3)
    for gaps in ([5], [1] * 300, [1000], rng.integers(1, 200, 50), rng.integers(1, 30, 200)):
        ends = np.cumsum(gaps).astype(np.int64)
        places, _ = packing._candidates(int(ends[-1]), ends, np.empty(0, np.int64), 64, False)
        for p in places[places + 64 < ends[-1]]:
            assert ((places > p + 48) & (places <= p + 64)).any()


@pytest.mark.parametrize("word,end", [("end.", True), ('end."', True), ("konec!»", True), ("终。", True), ("है।", True), ("a.b", False), ('"', False)])
def test_sentence_ends(word, end):
    assert packing.ends_sentence(word) is end


def test_a_full_memory_keeps_the_frequent_words():
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH, held=40)
    for round_ in range(6):
        text = " ".join(f"often{i} rare{round_}x{i}. often{i}" for i in range(15))
        assert words.encode(text.encode())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.index) <= 40 + 30
    assert b"often3" in words.index and b"rare0x3." not in words.index


def test_empty_table(spark):
    assert packing.packed(empty(spark), PATH).count() == 0


def test_words_are_encoded_like_texts():
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH, held=50)
    for text in ("Don't  Stop\n12,5 é́ ́x <|endoftext|> a<|startoftext|>b c　d", "ΣΑΣ σ\x1cx\x85y " * 30, "", "x" * 5000):
        assert words.encode(text.encode())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_are_encoded_once_with_whatever_marks_and_capitals():
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    text = "Straße straße, STRASSE. Ärger! ärger'' don't it's A's 'tis rock'n'roll x--y END... (end) ÿ´ ß~^` a_b é́, 3rd, İ, ſt ×, a÷"
    assert words.encode(text.encode())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert words.pieces.index.keys() == {"", "straße", ",", "strasse", ".", "ärger", "!", "''", "end", "...", "ß", "~^`"}
    rng = np.random.default_rng(5)
    letters, marks = list("abcXYZéÄß"), list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    some = ["".join(rng.choice(letters, rng.integers(1, 9))) + "".join(rng.choice(marks, rng.integers(0, 4))) for _ in range(3000)]
    for held in (packing.PIECES_HELD, 100):
        words = packing.WordTokens(PATH)
        words.pieces.held = held
        for at in range(0, 3000, 500):
            text = " ".join(some[at:at + 500])
            assert words.encode(text.encode())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.pieces.index) <= max(held, 100) + 1100


def test_other_rules_take_whole_words(tmp_path):
    import json
    rules = json.load(open(PATH, encoding="utf-8"))
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]  # capitals stay
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    tokenizer, words = Tokenizer.from_file(str(path)), packing.WordTokens(str(path))
    assert words.pieces is None
    text = "Some words, SOME Words. some"
    assert words.encode(text.encode())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_held_until_another_operator_runs():
    import weakref
    from cellwise.llm import circulant
    import pyarrow as pa
    words = packing.word_tokens(PATH)
    assert packing.word_tokens(PATH) is words
    gone = weakref.ref(words)
    del words
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["a few words"])], ["id", "text_hash", "text"])
    assert sum(b.num_rows for b in circulant._sign(iter([batch]), 5)) == 1
    assert gone() is None
