"""Secrets in texts: assignment-aware lexing besides three fixed patterns.

The lexer reads pairs of a name and a literal in source and configuration syntax: assignments and mappings with or without a
declared type, elements, key and value attributes, command-line flags; literals in single, double or three quotes, back quotes,
side by side, joined by ``+``, in brackets, formatted strings, block scalars. It follows constants (a name assigned a literal and used
elsewhere, before or after; ``$NAME`` references) and scores each literal by the name it ends up under.
A text is one row: nothing is shuffled, and memory is bounded by an Arrow batch of rows.

Null text counts as empty and has no span. Repeated rows get equal spans. Very long texts are lexed whole: every
pattern is linear in the text (possessive repeats). An existing column with the name of the result is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "lexed")

#: Sensitive words of a name and their weight; a name needs 2.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 2,
             "credentials": 2, "bearer": 2, "auth": 1, "api": 1, "private": 1, "access": 1, "signing": 1, "encryption": 1,
             "key": 1}
STEMS = tuple(SENSITIVE)  # a name that scores holds one of these
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your|dummy|xxxx|\*\*\*\*|<.*>|^(true|false|none|null)$")

TRIPLE = r'''[A-Za-z]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})'''
LITERAL = r"""(?:[rbufRBUF]{0,2}"(?:[^"\\\n]|\\.)*+"|[rbufRBUF]{0,2}'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
BARE = r"""[^\s"'`,;(){}\[\]<>]++"""
NAME = r"[A-Za-z_$][\w.$-]*+"
#: A name before its sign; a declared type may stand between (``name: string = ...``).
TARGET = re.compile(rf"(?<![\w.$-])({NAME})[\"']?\]?(?:[\x20\t]*+:[\x20\t]*+[A-Za-z_][\w.<>\[\]|?]*+(?=[\x20\t]*+=(?!=)))?[\x20\t]*+(?::=|=>|:|=(?!=))")
TERM = re.compile(rf"(?s:(?P<triple>{TRIPLE}))|(?P<quoted>{LITERAL})|\$\{{(?P<ref>\w++)\}}|(?P<open>\()|(?P<bare>{BARE})")
HELD = re.compile(r"\{([A-Za-z_]\w*+)\}")
SPACE, LINES = re.compile(r"[\x20\t]*+"), re.compile(r"\s*+")
BLOCK = re.compile(r"[|>][+-]?[\x20\t]*+\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]++)</([\w.:-]++)\s*+>")
ATTRIBUTES = re.compile(r"""\b(?:key|name)\x20*+=\x20*+["']([^"'\n]++)["']\s++value\x20*+=\x20*+["']([^"'\n]++)["']""")
FLAG = re.compile(rf"(?<!\S)--([A-Za-z][\w-]*+)(?:=|[\x20\t]++)({LITERAL}|{BARE})")
IDENTIFIER = re.compile(rf"\$?({NAME})")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_score(name: str) -> int:
    """Weight of the sensitive words in a name such as ``dbPassword``, ``API_KEY`` or ``auth.token``."""
    words = [p.lower() for p in PARTS.findall(name)]
    return sum(SENSITIVE.get(w, 0) for w in words)


def literal_score(value: str) -> int:
    """How much a literal looks like a credential: length, letters with digits, entropy; placeholders lose."""
    return -1 if _spoilt(value) else _tally_score(Counter(value))


def _spoilt(piece: str) -> bool:
    return " " in piece or PLACEHOLDER.search(piece) is not None


def _tally_score(counts: Mapping[str, float]) -> int:
    total = sum(counts.values())
    if total < 8:
        return -1
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    mixed = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    return 1 + mixed + (entropy >= 3.0)


def _pieces(text: str, start: int, end: int) -> list[tuple]:
    """Pieces of a quoted literal without prefix and quotes: spans, and names that a formatted string refers to."""
    first = start
    while text[first] not in "\"'`":
        first += 1
    width = 3 if end - first >= 6 and text[first:first + 3] in ('"""', "'''") else 1
    at, stop, out = first + width, end - width, []
    if text[first] == "`" or "f" in text[start:first].lower():
        for held in HELD.finditer(text, at, stop):
            dollar = text[held.start() - 1] == "$" and held.start() > at
            out += [(at, held.start() - dollar), held[1]]
            at = held.end()
    return [*out, (at, stop)]


def _block(text: str, target: int, at: int) -> tuple[list[tuple], int]:
    """Lines of a block scalar: those deeper than the line of its name."""
    head = text.rfind("\n", 0, target) + 1
    depth = SPACE.match(text, head).end() - head
    out = []
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        first = min(SPACE.match(text, at).end(), stop)
        line = text[first:stop].rstrip()
        if line and first - at <= depth:
            break
        if line:
            out.append((first, first + len(line)))
        at = stop + 1
    return out, min(at, len(text))


def _value(text: str, at: int, target: int) -> tuple[list[tuple], int]:
    """Pieces of the expression at ``at``: literals side by side or joined by ``+``, in brackets or not; names; a block."""
    at = SPACE.match(text, at).end()
    if block := BLOCK.match(text, at):
        return _block(text, target, block.end())
    out: list = []
    depth, joined = 0, True
    while True:
        blank = (LINES if depth else SPACE).match(text, at).end()
        if not joined:
            if text[blank:blank + 1] == "+" and text[blank:blank + 2] != "+=":
                at, joined = blank + 1, True
                continue
            if depth and text[blank:blank + 1] == ")":
                at, depth = blank + 1, depth - 1
                continue
        term = TERM.match(text, blank)
        if not term or not joined and term.lastgroup not in ("quoted", "triple"):
            return out, max(at, blank) if not out else at
        if term["open"]:
            depth += 1
        elif term["ref"]:
            out.append(term["ref"])
        elif term["bare"]:
            name = IDENTIFIER.fullmatch(text, *term.span())
            out.append((*term.span(), name[1]) if name else term.span())
        else:
            out += _pieces(text, *term.span())
        at, joined = term.end(), term["open"] is not None
        if term["bare"] and not depth and text[SPACE.match(text, at).end():][:1] != "+":
            return out, at


def pairs(text: str) -> list[tuple[str, list]]:
    """Names with the pieces assigned to them: assignments, elements, key and value attributes, flags; by place."""
    found, at = [], 0
    while target := TARGET.search(text, at):
        pieces, at = _value(text, target.end(), target.start())
        at = max(at, target.end())
        found.append((target.start(), target[1], pieces))
    if "</" in text:
        found += [(m.start(), m[1], [(m.start(2), m.start(2) + len(m[2].rstrip()))]) for m in ELEMENT.finditer(text) if m[1] == m[3]]
    if "value" in text:
        found += [(m.start(), m[1], [m.span(2)]) for m in ATTRIBUTES.finditer(text)]
    if "--" in text:
        for m in FLAG.finditer(text):
            quoted = m[2][-1] in "\"'`"
            if quoted or any(c.isdigit() for c in m[2]):
                found.append((m.start(), m[1], _pieces(text, *m.span(2)) if quoted else [m.span(2)]))
    return [x[1:] for x in sorted(found, key=lambda x: x[0])]


def lexed_spans(text: str) -> set[tuple[int, int]]:
    """Spans of literals assigned, directly or through constants, to names that are sensitive enough.

    A name used as a value stands for its last definition before the use, else for its first one after it.
    """
    defined = pairs(text)
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(defined):
        places.setdefault(name, []).append(i)

    def definition(name: str, use: int) -> int | None:
        known = places.get(name, ())
        k = bisect_left(known, use)
        return known[k - 1] if k else next((i for i in known[k:] if i != use), None)

    def parts(i: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Own literals of a definition and the definitions that it uses, each once."""
        own, used = {}, {}
        for piece in defined[i][1]:
            name = piece if isinstance(piece, str) else piece[2] if len(piece) == 3 else None
            source = definition(name, i) if name else None
            if source is not None:
                used[source] = None
            elif not isinstance(piece, str) and text[piece[0]] != "$" and piece[1] > piece[0]:
                own[piece[:2]] = None
        return list(own), list(used)

    graph = [parts(i) for i in range(len(defined))]
    tallies: list[dict[str, float] | None] = [None] * len(graph)  # characters of a value; none of a spoilt one; circles add nothing
    state = bytearray(len(graph))  # 0 new, 1 open, 2 done
    for root in range(len(graph)):
        todo = [root]
        while todo:
            i = todo[-1]
            own, used = graph[i]
            if state[i] == 0:
                state[i] = 1
                todo += [u for u in used if state[u] == 0]
                continue
            todo.pop()
            if state[i] == 2:
                continue
            state[i] = 2
            words = [text[a:b] for a, b in own]
            below = [tallies[u] for u in used if state[u] == 2 and u != i]
            if any(t is None for t in below) or any(_spoilt(w) for w in words):
                continue
            counts: dict[str, float] = Counter()
            for t in (*map(Counter, words), *below):
                for c, n in t.items():
                    counts[c] = min(counts[c] + n, 1e12)
            tallies[i] = counts
    todo = [i for i, (name, _) in enumerate(defined) if tallies[i] and name_score(name) >= 2 and _tally_score(tallies[i]) >= 2]
    reached, found = set(todo), set()
    while todo:
        own, used = graph[todo.pop()]
        found.update(own)
        todo += [u for u in used if u not in reached]
        reached.update(used)
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    if any(x in low for x in STEMS):
        found += [(3, a, b) for a, b in lexed_spans(text)]
    return [(KINDS[k], a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2]))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch], dtype=object)


@F.pandas_udf(T.StringType())
def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([redact(t) for t in batch], dtype=object)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (merged where spans meet) replaced by ``mark``; null stays null."""
    if not text:
        return text
    out, at, open_to = [], 0, -1
    for _, start, end in spans(text):
        if start > open_to:
            out += [text[at:start], mark]
        open_to = max(open_to, end)
        at = open_to
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the spans of each whole text in column ``out``."""
    return docs.withColumn(out, spans_of(F.col(text)))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame, key: str = "doc_id", found: str = "secrets") -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    s = F.col(found)
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(s, lambda x: x["kind"] != "lexed")
    return scanned.select(key, *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                          F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))
