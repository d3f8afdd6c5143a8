import random
import sys
from collections import Counter
from pathlib import Path

from cellwise.llm import secret_scan
from cellwise.llm.common import stored, table

from .fixtures import documents, empty, words
from .test_circulant import brute
from .test_packing import check

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark):
    docs = table(spark, SF, "documents")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["language_id", "minhash_near_dedup", "secret_scan", "mixing", "packing"]
    known = stored(stage["language_id"](spark, docs, SF))
    want = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id: r.text for r in known.collect()} == want and known.columns == docs.columns
    single = stored(stage["minhash_near_dedup"](spark, known, SF))
    tops = {c for _, n, c in brute(list(want.items()), 5, 80)}
    assert {r.doc_id: r.text for r in single.collect()} == {d: want[d] for d in tops} and single.columns == docs.columns
    masked = stored(stage["secret_scan"](spark, single, SF))
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts == {d: secret_scan.redact(want[d]) for d in tops} and masked.columns == docs.columns
    mixed = stored(stage["mixing"](spark, masked, SF))
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    total = sum(len(words(t)) for t in texts.values())
    assert abs(sum(len(words(r.text)) for r in rows) - 1.5 * total) < 20
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    packed = [r.asDict() for r in stage["packing"](spark, mixed, SF).collect()]
    check([type("R", (), {**r, "id": r["doc_id"]}) for r in packed], rows, 4096)


def test_run_and_odd_tables(spark, tmp_path):
    for name, docs in (("odd", documents(spark)), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")


def test_language_gate_drops_gibberish_and_foreign_texts(spark):
    rng = random.Random(3)
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    foreign = ("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "
               "i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności ",
               "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
               "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin oikeuksiin ",
               "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью ")
    odd = [t * 4 for t in foreign] + [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
                                               for _ in range(150)) for _ in range(5)]
    first = docs.first()  # a row for the other columns
    rows = [{**first.asDict(), "doc_id": -1 - i, "text": t, "lang": None, "n_chars": len(t)} for i, t in enumerate(odd)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in pipeline.identify_language(spark, both, SF).select("doc_id").collect()}
    # the table holds a document that is half French, half English
    assert min(kept) >= 0 and len(kept) >= 0.998 * docs.count()
