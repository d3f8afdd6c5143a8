"""Near-duplicate vectors by spherical-cap filters.

After a random rotation a vector is cut into two parts, each with its own code of random unit directions; a filter is one
code word per part, so a few dozen words make thousands of directions. A vector passes every filter whose direction
it exceeds by a threshold; list decoding finds those filters by extending only beginnings that can still reach it. Four
such product codes are used, as one alone leaves some vectors with few filters. Vectors meet in the filters they
share, and pairs are verified by their cosine in double precision.

* Equal vectors form one class first, so any number of copies is one row.
* A crowded filter is cut into tiles by a hash; tiles meet pairwise in tasks of bounded size. No pair is sent on: a
  tile pair returns, per vector, how many others it links with and a spanning forest of the links found.
* Two vectors that share several filters are counted in the smallest one only.

The number of filters grows with the number of distinct vectors, so that a filter holds about as many at every size. Recall is measured against brute force in the tests. Null vectors, zero vectors and vectors with null or
non-finite components link with nothing. Only vectors of equal length are compared. Repeated ids are rows of their own. Empty
tables give empty results. Null ids come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import partitions
from .common import attach, stored
from .links import components

COSINE = 0.9
CODES, PARTS, SEED = 6, 2, 20_261
WANTED, LEAST = 5.0, 4  # filters of each code that a vector passes: by the threshold on average, and at least
CROWD = 256  # vectors that a filter holds, on average
TILE = 512
NULL_ID = (1 << 63) - 1

FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("i", "links", "root")])


def _parts(dims: int) -> int:
    return PARTS if dims >= 8 else 1


@lru_cache(maxsize=32)
def _code(number: int, dims: int, words: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation of one product code, and for each part its code words (columns), scaled so that a filter has unit length."""
    rng = np.random.default_rng([SEED, number, dims, words])
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    bounds = np.linspace(0, dims, _parts(dims) + 1).round().astype(int)
    places = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
    codes = []
    for p in places:
        c = rng.standard_normal((p.stop - p.start, words))
        codes.append(c / np.linalg.norm(c, axis=0) * math.sqrt((p.stop - p.start) / dims))
    return rotation, codes, places


def list_decode(units: np.ndarray, words: int, threshold: float, code: int = 0, least: int = LEAST) -> list[np.ndarray]:
    """Numbers of all filters of a code that each unit vector exceeds, ascending.

    A vector that exceeds too few has its threshold lowered, and its ``least`` best filters are taken.
    """
    rotation, codes, places = _code(code, units.shape[1], words)
    turned = units @ rotation
    marks = [turned[:, p] @ c for p, c in zip(places, codes)]
    most = [m.max(axis=1) for m in marks]

    def decode(i: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        begun, number = np.zeros(1), np.zeros(1, np.int64)
        for k, m in enumerate(marks):
            rest = sum(x[i] for x in most[k + 1:])
            able = np.flatnonzero(begun >= limit - rest - most[k][i])
            rows, cols = np.nonzero(np.add.outer(begun[able], m[i]) >= limit - rest)
            begun, number = begun[able][rows] + m[i][cols], number[able][rows] * words + cols
        return begun, number

    out, enough = [], min(least, words ** len(marks))
    for i in range(len(units)):
        limit = threshold
        begun, number = decode(i, limit)
        if len(number) < enough:
            while len(number) < enough:
                limit -= 0.05
                begun, number = decode(i, limit)
            number = number[np.argsort(-begun, kind="stable")[:enough]]
        out.append(np.sort(number))
    return out


@lru_cache(maxsize=32)
def design(vectors: int, dims: int) -> tuple[int, float]:
    """Words per part and threshold: a filter holds about ``CROWD`` of ``vectors`` vectors (a fiftieth of few), and a
    vector passes about ``WANTED`` filters of each code. The threshold is the exact quantile of the cap on the sphere."""
    share = min(0.02, CROWD / max(1, vectors))
    angle = np.linspace(0, math.pi / 2, 200_001)
    cap = np.cumsum(np.sin(angle) ** (dims - 2)) if dims > 1 else np.ones_like(angle)
    threshold = math.cos(angle[np.searchsorted(cap / (2 * cap[-1]), share)]) if dims > 1 else 0.5
    return math.ceil((WANTED / share) ** (1 / _parts(dims))), threshold


def passed_filters(units: np.ndarray, vectors: int) -> list[np.ndarray]:
    """Numbers of the filters of all codes passed by unit vectors of one length."""
    dims = units.shape[1]
    words, threshold = design(vectors, dims)
    each = [[f + c * words ** _parts(dims) for f in list_decode(units, words, threshold, c)] for c in range(CODES)]
    return [np.concatenate(x) for x in zip(*each)]


PASSED = T.StructType([T.StructField("i", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("dims", T.IntegerType()),
                       T.StructField("filters", T.ArrayType(T.LongType())), T.StructField("vector", T.BinaryType()),
                       T.StructField("marks", T.BinaryType())])


def _pass(batches: Iterator[pa.RecordBatch], vectors: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.array(v, kind) for v in batch.column(2).to_pylist()]
        filters: list = [None] * len(values)
        for dims in sorted({len(v) for v in values}):
            rows = [i for i, v in enumerate(values) if len(v) == dims]
            units = np.array([values[i] for i in rows], float)
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            for i, f in zip(rows, passed_filters(units, vectors)):
                filters[i] = f
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array([len(v) for v in values], pa.int32()), pa.array(filters, pa.list_(pa.int64())),
            pa.array([v.tobytes() for v in values], pa.binary()), pa.array([f.tobytes() for f in filters], pa.binary())], PASSED.names)


def _shared_before(filters: list[np.ndarray], number: int) -> np.ndarray:
    """Which vectors share a filter with a smaller number."""
    flat = np.concatenate(filters)
    owner = np.repeat(np.arange(len(filters)), [len(f) for f in filters])
    small = flat < number
    kinds, column, times = np.unique(flat[small], return_inverse=True, return_counts=True)
    several = times[column] > 1
    marks = np.zeros((len(filters), len(kinds)), np.float32)
    marks[owner[small][several], column[several]] = 1
    return marks @ marks.T > 0


def _meet(group: list[dict], cosine: float, kind: str) -> list[tuple[int, int, int]]:
    """Link counts and a spanning forest of one pair of tiles (or one tile) of a filter."""
    group = sorted(group, key=lambda r: r["i"])
    x = np.frombuffer(b"".join(r["vector"] for r in group), kind).astype(float).reshape(len(group), -1)
    norms = (x * x).sum(axis=1)
    cosines = (x @ x.T) / np.sqrt(np.outer(norms, norms))
    linked = cosines >= cosine
    for i, j in zip(*np.nonzero(np.triu(np.abs(cosines - cosine) < 1e-12, 1))):  # rounding decides: sum exactly
        linked[i, j] = linked[j, i] = math.fsum(x[i] * x[j]) / math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(x[j] * x[j])) >= cosine
    np.fill_diagonal(linked, False)
    if group[0]["one"] != group[0]["two"]:
        side = np.array([r["side"] for r in group])
        linked &= side[:, None] != side[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return []
    group, linked = [group[i] for i in some], linked[np.ix_(some, some)]
    linked &= ~_shared_before([np.frombuffer(r["marks"], np.int64) for r in group], group[0]["filter"])
    label = np.arange(len(group))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(group)).min(axis=1))
        if (new == label).all():
            break
        label = new
    counts = linked @ np.array([r["copies"] for r in group])
    return [(group[i]["i"], int(counts[i]), group[label[i]]["i"]) for i in np.flatnonzero(counts)]


def _meetings(batches: Iterator[pa.RecordBatch], cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by filter and tile pair; one pair of tiles is held at a time."""
    held, key, out = [], None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["dims"], row["filter"], row["one"], row["two"])
            if now != key:
                if len(held) > 1:
                    out += _meet(held, cosine, kind)
                held, key = [], now
            held.append(row)
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], FOUND.names)
            out = []
    if len(held) > 1 and (out := _meet(held, cosine, kind)):
        yield pa.record_batch([pa.array(c) for c in zip(*out)], FOUND.names)


def linked_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id) of every row of ``table``."""
    v = F.col("vector")
    kind = "f4" if table.schema[vector].dataType.elementType == T.FloatType() else "f8"
    exact = "array<float>" if kind == "f4" else "array<double>"
    rows = table.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector).cast(exact).alias("vector"))
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists(v, lambda x: x != 0), F.lit(False))
    name = F.when(usable, F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), v))))
    rows = stored(rows.withColumn("node", name))
    classes = stored(rows.where("node is not null").groupBy("node").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("i", F.monotonically_increasing_id()))
    passed = stored(classes.select("i", "copies", "vector").mapInArrow(partial(_pass, vectors=classes.count(), kind=kind), PASSED))
    at = passed.select("dims", F.explode("filters").alias("filter"), "i", "copies", "vector", "marks")
    sizes = stored(at.groupBy("dims", "filter").count().where("count > 1").select("dims", "filter", F.ceil(F.col("count") / TILE).alias("tiles")))
    at = at.join(sizes, ["dims", "filter"]).withColumn("tile", F.pmod(F.xxhash64("i"), F.col("tiles")))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    at = at.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other"), "side": F.col("tile") < F.col("other")})
    place = ["dims", "filter", "one", "two"]
    at = at.repartition(partitions(table), *place).sortWithinPartitions(*place)
    found = stored(at.select(*place, "side", "i", "copies", "vector", "marks").mapInArrow(partial(_meetings, cosine=cosine, kind=kind), FOUND))
    labels = components(found.select(F.col("i").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "i")
    links = found.groupBy("i").agg(F.sum("links").alias("links"))
    member = stored(classes.select("i", "node", "first", "copies").join(links, "i", "left").join(labels, "i", "left"))
    tops = member.where("label is not null").groupBy("label").agg(F.min("first").alias("top"))
    member = stored(member.join(tops, "label", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "first").alias("component_id")))
    some = attach(rows.where("node is not null").select("id", "node"), member, "node", F.col("id")).select("id", "n_links", "component_id")
    return some.union(rows.where("node is null").select("id", F.lit(0).cast("long"), "id"))


def oracle_sql(cosine: float = COSINE) -> str:
    """Links and components over all pairs, as SQL over table ``embeddings``."""
    from .links import COMPONENT_SQL
    return f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
fine as (select vec_id, e, len(e) as dims, sqrt(list_inner_product(e, e)) as norm from v
    where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.dims = b.dims and a.vec_id <> b.vec_id
    where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {cosine}),
degree as (select a as id, count(*) as n from link group by 1),
node as (select vec_id as id from embeddings),
{COMPONENT_SQL}
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join component on component.id = vec_id left join degree on degree.id = vec_id
"""
