from collections import Counter, defaultdict

from cellwise.llm import perspectives as P

ROWS = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "ann", "same turn"), (1, None, "bob", "first"),
        (1, 3, None, "whisper"), (2, 0, "ann", "x"), (2, 0, "ann", "x"), (None, 0, "bob", ""), (3, 0, "system", "alone"), (3, 1, None, "y"),
        *[(4, i, "ab"[i % 2], f"t{i}") for i in range(10)]]
SCHEMA = "conv_id long, turn long, role string, text string, part string, speaker string"


def brute(rows, part):
    dialogues = defaultdict(list)
    for conv, turn, role, text in rows:
        dialogues[conv].append(((turn or 0) // part, turn is not None, turn or 0, role or "unknown", (text or "").replace("<|", "< |"), role))
    out = Counter()
    for conv, turns in dialogues.items():
        for speaker in {t[-1] for t in turns} - {None, "system"}:
            whole, parts = "", defaultdict(list)
            for number, _, _, role, body, _ in sorted(turns, key=lambda t: t[:5]):
                begin = len(whole)
                whole += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                own = len(whole)
                whole += body + "<|end|>\n"
                parts[number].append((begin, len(whole), f"{own}:{len(whole)}" if role == speaker else None))
            for number, some in parts.items():
                out[conv, number, speaker, some[0][0], len(some), whole[some[0][0]:some[-1][1]], ",".join(m for *_, m in some if m)] += 1
    return out


def test_every_perspective(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    for part in (64, 3):
        got = P.rotated(df, part=part)
        assert got.columns == ["conv_id", "part", "speaker", "begin", "n_turns", "rendered", "mask"]
        assert Counter(map(tuple, got.collect())) == brute(ROWS, part)


def test_empty_table(spark):
    assert P.rotated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_dialogue_is_the_same_in_any_parts(spark):
    rows = [(1, 0, "system", "rules"), *[(1, i, ("ann", "bob", "cy")[i % 3], f"turn {i} " + "é" * (i % 7)) for i in range(1, 400)], (1, 401, "ann", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def joined(part):
        out = {}
        for r in P.rotated(df, part=part).orderBy("part").collect():
            text, mask = out.get(r.speaker, ("", []))
            assert r.begin == len(text)
            out[r.speaker] = (text + r.rendered, mask + [m for m in r.mask.split(",") if m])
        return out

    one, many = joined(1_000), joined(64)
    assert one == many and set(one) == {"ann", "bob", "cy"}
    for text, mask in many.values():
        assert all(text[:int(m.split(":")[0])].endswith("<|assistant|>\n") and text[:int(m.split(":")[1])].endswith("<|end|>\n") for m in mask)
        assert text.count("<|assistant|>") == len(mask) and text.startswith("<|system|>\nrules")
