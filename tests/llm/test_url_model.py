import hashlib
import math
import re
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from cellwise.llm import url_model as U

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y=/z#w", "https://example.net/de/1", "http://xexample.net/en/1", "ftp://net",
        "http://net/", "http://a.org/fr/2", "http://a.org/FR/2", "http://example.com/de/", "http://b.example.com/de/9#a", "http://b.example.com/en/9",
        "x://h?q=http://z.net/", "http://Ünï.org/fr/é", "http://c.example.net/en/3", "http://d.example.net/en/4", "http://spam.net/a", "http://spam.com/a"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def held(url):
    return hashlib.md5((url or "").encode()).hexdigest()[0] < U.HELD_OUT


def brute_limit(urls, scores):
    """Where the deviations of both classes meet, over URLs that trained nothing (a class without such URLs: over all of its own)."""
    side = {}
    for verdict in ("allow", "block"):
        own = [(held(u), s) for u, s in zip(urls, scores) if expected(u)[3] == verdict]
        some = [s for h, s in own if h] or [s for _, s in own]
        side[verdict] = (statistics.fmean(some), statistics.pstdev(some))
    (ma, sa), (mr, sr) = side["allow"], side["block"]
    return (ma * sr + mr * sa) / (sa + sr) if sa + sr else (ma + mr) / 2


def brute_scores(urls, order):
    labels = [expected(u)[3] for u in urls]
    labels = [None if held(u) else v for u, v in zip(urls, labels)]
    counts = {v: defaultdict(lambda: defaultdict(int)) for v in ("allow", "block")}
    letters = set()
    for u, v in zip(urls, labels):
        t = U.EDGE * order + (u or "").lower() + U.EDGE
        for i in range(order, len(t)):
            letters.add(t[i])
            if v:
                for k in range(order + 1):
                    counts[v][t[i - k:i]][t[i]] += 1

    def p(v, context, c):
        shorter = 1 / len(letters) if not context else p(v, context[1:], c)
        if context == "":
            shorter = 1 / len(letters)
        seen = counts[v][context]
        n, kinds = sum(seen.values()), len(seen)
        return shorter if not n else (seen.get(c, 0) + kinds * shorter) / (n + kinds)
    out = []
    for u in urls:
        t = U.EDGE * order + (u or "").lower() + U.EDGE
        logs = [math.log(p("allow", t[i - order:i], t[i])) - math.log(p("block", t[i - order:i], t[i])) for i in range(order, len(t))]
        out.append(sum(logs) / len(logs))
    return out


def test_rules_and_scores(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, gram string")
    for order in (1, 4):
        rows = sorted(U.judged(df, order=order).collect(), key=lambda r: r.page_id)
        scores = brute_scores(URLS * 2, order)
        limit = brute_limit(URLS * 2, scores)
        for r, u, s in zip(rows, URLS * 2, scores):
            host, path, rule, verdict = expected(u)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert abs(r.score - s) < 1e-9
            assert r.verdict == (verdict or ("allow" if r.score >= limit - 1e-12 else "block"))
            assert r.gram == "y"


def test_judges_urls_like_those_with_a_rule(spark):
    urls = [f"http://s{i}.org/fr/garden{i % 7}" for i in range(60)] + [f"http://s{i}.net/casino{i % 7}" for i in range(60)]
    urls += ["http://new.com/garden3", "http://new.com/casino3"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.url: r.verdict for r in U.judged(df).where(F.col("rule").isNull()).collect()}
    assert got == {"http://new.com/garden3": "allow", "http://new.com/casino3": "block"}


def test_input_columns_with_names_of_results(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "old", 5, "v", "t", "r")], "page_id long, url string, Host string, score int, verdict string, _score string, rule string")
    got = U.judged(df)
    assert got.columns == ["page_id", "url", "_score", "host", "path", "rule", "score", "verdict"]
    assert got.select("host", "verdict", "_score").first() == ("a.net", "block", "t")


def test_a_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://a.net/" + "x" * 200_000), (2, "http://b.org/fr/" + "y" * 9), (3, "http://c.io/" + "y" * 100_000)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judged(df).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/y"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in U.judged(df).collect()) == ["allow", "allow", "block"]
    assert U.judged(df.limit(0)).count() == 0
