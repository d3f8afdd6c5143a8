import math
from collections import Counter

import numpy as np

from cellwise.llm import spherical as S


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows],
                                 "vec_id long, embedding array<float>, label string, node string")


def brute(rows, cosine=0.9):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    x = [np.array(v, np.float32).astype(float) if fine(v) else None for _, v in rows]
    key = [S.NULL_ID if i is None else i for i, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(key[i], least.get(find(i), key[i]))
    return Counter((key[i], links[i], least[find(i)]) for i in range(len(rows)))


def sample(n=300, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    near = base[rng.integers(0, 20, 150)] + rng.standard_normal((150, dims)) * 0.3
    crowd = base[0] + rng.standard_normal((120, dims)) * 0.15
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, crowd, np.repeat(base[5:6], 30, axis=0), 2 * base[6:8]]))]
    return rows + [(None, base[9].tolist()), (900, None), (901, []), (902, [0.0] * dims), (903, [None] + [1.0] * (dims - 1)),
                   (904, [float("nan")] * dims), (905, [float("inf")] * dims), (906, [1.0, 2.0]), (907, [2.0, 4.0]), rows[3], rows[3]]


def test_links_and_components(spark):
    rows = sample()
    got = Counter(map(tuple, S.linked_vectors(table(spark, rows)).collect()))
    assert got == brute(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    rows = sample(seed=1)
    assert Counter(map(tuple, S.linked_vectors(table(spark, rows)).collect())) == brute(rows)


def test_list_decoding_is_complete():
    rng = np.random.default_rng(2)
    units = rng.standard_normal((20, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rotation, codes, places = S._code(2, 16, 6)
    for u, found in zip(units @ rotation, S.list_decode(units, 6, 0.3, 2, 0)):
        a, b = (u[p] @ w for p, w in zip(places, codes))
        assert found.tolist() == np.flatnonzero(np.add.outer(a, b).ravel() >= 0.3).tolist()


def test_recall_at_the_threshold():
    """Pairs of cosine 0.9 share a filter at the sizes of the tables here and beyond."""
    rng = np.random.default_rng(3)
    for vectors in (2_000, 50_000, 2_000_000):
        a = rng.standard_normal((300, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((300, 64))
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.9 * a + math.sqrt(1 - 0.81) * b
        met = [bool(np.intersect1d(x, y).size) for x, y in zip(S.passed_filters(a, vectors), S.passed_filters(b, vectors))]
        assert np.mean(met) >= 0.95, (vectors, np.mean(met))


def test_empty_table(spark):
    assert S.linked_vectors(table(spark, [(1, [1.0])]).limit(0)).count() == 0
