"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random
import re

from pyspark.sql import types as T

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(n, T.StringType()) for n in ("id", "n", "size", "start", "node", "score", "bucket", "hash", "chunk", "row")]])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def prose(rng, n, stock):
    out = []
    for i in range(n):
        out.append(rng.choice(stock) + ("." if rng.random() < 0.1 else ""))
    return " ".join(out)


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [prose(rng, rng.randint(1, 160), stock) for _ in range(n)]
    texts += [None, "", " \t\n", "one", "One  two", prose(rng, 9000, stock), "x" * 30_000]
    texts += [texts[3]] * 12  # exact copies
    for k in range(25):  # near copies with a common base, some too far away
        base = texts[5].split(" ") if len(texts[5].split(" ")) > 60 else (texts[5] + " " + prose(rng, 90, stock)).split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(base))
        texts[5] = " ".join(texts[5].split(" "))
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[2], "en", "a", len(texts[2])), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
