import hashlib
import re

from pyspark.sql import functions as F

from cellwise.llm import bottomk

from .fixtures import documents, empty


def test_edited_texts_follow_the_ring(spark):
    docs = documents(spark)
    got = bottomk.edited(docs, k=16).collect()
    rows = [(bottomk.NULL_ID if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    hashes = {r.text: r.hash for r in got}
    ring = sorted(set(rows), key=lambda r: (r[0], hashes[r[1]]))
    after = dict(zip(ring, ring[1:] + ring[:1]))
    for r in got:
        n = len(r.text) // 4
        following = after[r.id, r.text][1]
        assert r.n_chars == len(r.text)
        assert r.edited == r.text[:len(r.text) - n] + following[:n]
        assert list(r.next_sketch) == next(list(x.sketch) for x in got if x.text == following)


def sketches(spark, texts, k):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r.i: list(r.s) for r in bottomk.sketched(df, "text", "s", k, 2).collect()}, bottomk.sketched(df, "text", "s", k, 2)


def test_sketch_is_the_k_smallest_hashes(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(3000))
    texts = ["a b c d", long, "x y " * 500, "", None, "solo", long + " tail"]
    (small, df), (whole, _) = sketches(spark, texts, 8), sketches(spark, texts, 10**5)
    for i, t in enumerate(texts):
        w = (t or "").split()
        kinds = len({tuple(w[j:j + 2]) for j in range(len(w) - 1)}) if len(w) > 1 else len(w)
        assert len(whole[i]) == kinds and small[i] == whole[i][:8]
    pairs = df.alias("a").join(df.alias("b"), F.lit(True)).select(
        F.col("a.i").alias("i"), F.col("b.i").alias("j"), bottomk.resemblance(F.col("a.s"), F.col("b.s"), 8).alias("r"),
        bottomk.merged(F.col("a.s"), F.col("b.s"), 8).alias("m"), bottomk.containment(F.col("a.s"), F.col("b.s"), 8).alias("c"))
    for r in pairs.collect():
        union = sorted(set(whole[r.i]) | set(whole[r.j]))
        assert list(r.m) == union[:8]
        both = set(whole[r.i]) & set(whole[r.j])
        assert r.r == (1.0 if not union else sum(x in both for x in union[:8]) / len(union[:8]))
        assert 0 <= r.c <= 1


def test_parts_merge(spark):
    df = spark.createDataFrame([(i % 3, f"a{i} b{i % 7} c{i % 11}") for i in range(300)], "g long, text string")
    parts = bottomk.sketched(df, "text", "s", 10, 1)
    got = {r.g: list(r.s) for r in bottomk.merge_parts(parts, ["g"], "s", 10).collect()}
    whole = df.groupBy("g").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    assert got == {r.g: list(r.s) for r in bottomk.sketched(whole, "text", "s", 10, 1).collect()}
    count = spark.range(1).select(F.lit(" ".join(f"z{i}" for i in range(5000))).alias("text"))
    n = bottomk.sketched(count, "text", "s", 256, 1).select(bottomk.distinct_count(F.col("s"), 256)).first()[0]
    assert abs(n / 5000 - 1) < 0.3


def test_empty_table(spark):
    assert bottomk.edited(empty(spark)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def test_query_columns(spark):
    from cellwise.llm.queries import QUERIES
    rows = QUERIES["op7_bottom_k"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts)
    for r in rows:
        t, n = texts[r.doc_id], len(texts[r.doc_id]) // 4
        nxt = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        a, b = shingles(t), shingles(t[:len(t) - n] + nxt[:n])
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.3
