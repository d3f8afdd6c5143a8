import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.functions import columns as K
from cellwise.operators import ahp as H
from cellwise.operators import aoa as A
from cellwise.operators import forest as FO
from cellwise.operators import quality as Q
from cellwise.operators import sampling as S
from cellwise.operators.grid import GridSpec
from cellwise.operators.polygons import ring_edges
from cellwise.plans import learning as L
from cellwise.plans import studies as P
from cellwise.sources import readers, sinks
from cellwise.streaming.rows import validate_stream

KM = GridSpec(300000.0, 7010000.0, 1000.0, 1000.0, 4, 4, 32719)


def frame(spark, **bands):
    a = next(iter(bands.values()))
    r, c = np.mgrid[0:a.shape[0], 0:a.shape[1]]
    pdf = pd.DataFrame({"r": r.ravel(), "c": c.ravel(), **{k: v.ravel().astype(float) for k, v in bands.items()}})
    df = spark.createDataFrame(pdf)
    return df.select("r", "c", *[K.clean_band(b).alias(b) for b in bands])


@pytest.fixture(scope="module")
def cross(spark):
    nd = -9999.0
    prob = np.array([[nd, 0, .9, .3], [.8, .75, .5, nd], [.95, .2, 0, .85], [.1, .7, .72, .4]])
    return frame(spark, prob=prob, yld=1000.0 + 100 * np.arange(16).reshape(4, 4)).withColumn("cell", F.col("r") * 4 + F.col("c"))


def test_cross_masks(cross):
    out = P.cross_layers(cross, 0.7)
    assert out.count() == 14
    assert out.where("en_aptas is not null").count() == out.where("prob >= 0.7").count() == 7
    assert out.where("prob = 0").agg(F.max("ranking")).first()[0] == 0.0


def test_cross_study_counts(cross):
    r = P.cross_study(cross, 0.7, "cell").first()
    assert (r.celdas_validas, r.celdas_aptas, r.celdas_sin_ghi) == (14, 7, 0)
    assert np.isclose(r.pct_aptas, 50.0) and r.overlap_top1_pct == 100.0


def test_cross_without_cells_fails(cross):
    with pytest.raises(ValueError):
        P.cross_study(cross.withColumn("yld", F.lit(0.0)), 0.7, "cell")


def test_mounts(spark):
    one = np.ones((4, 4))
    df = frame(spark, prob=0.9 * one, fijo=1400 * one, seguidor=2100 * one, plano=1000 * one)
    r = P.mount_study(df, KM, 0.7, "fijo", "seguidor", "plano").first()
    assert np.allclose([r.ganancia_media_pct, r.ganancia_fijo_vs_plano_pct, r.ganancia_seguidor_vs_plano_pct], [50, 40, 110])
    assert np.isclose(r.ganancia_mediana_bloque_pct, 50) and "por encima" in r.lectura


def test_consensus(spark):
    v = np.linspace(0, 1, 100).reshape(10, 10)
    df = frame(spark, con=v, bal=v, agr=v[::-1, ::-1])
    flags = P.consensus_cells(df, ("con", "bal", "agr"), 90.0)
    sums = flags.agg(*[F.sum(f"apto_{p}").alias(p) for p in ("con", "bal", "agr")]).first()
    assert tuple(sums) == (10, 10, 10)
    counts = {r.consenso: r.celdas for r in P.consensus_counts(flags, ("con", "bal", "agr")).collect()}
    assert sum(counts.values()) == 100 and counts == {0: 80, 1: 10, 2: 10, 3: 0}  # a class without a cell is a row, too
    per = {r.perfil: (r.celdas_aptas, r.celdas_validas) for r in P.consensus_profiles(flags, ("con", "bal", "agr"), 90.0).collect()}
    assert per == {p: (10, 100) for p in ("con", "bal", "agr")}
    reading = P.consensus_reading(P.consensus_counts(flags, ("con", "bal", "agr")), ("con", "bal", "agr")).first().lectura
    assert reading == "0.00% apta en los 3 perfiles (consenso); 20.00% solo en algunos (divergencia)"
    rho = {r.par: r.rho for r in P.profile_correlations(df, ("con", "bal", "agr")).collect()}
    assert np.isclose(rho["con_vs_bal"], 1.0) and np.isclose(rho["con_vs_agr"], -1.0)
    with pytest.raises(ValueError):
        P.consensus_cells(df.where("r > 50"), ("con", "bal", "agr"), 90.0)


def test_decoupling_status(spark):
    prob, yld = np.full((10, 10), 0.5), np.full((10, 10), 2000.0)
    prob[0], yld[:, 9] = 0.9, 0.0
    df = frame(spark, prob=prob, yld=yld)
    st = P.with_status(df, excluded=(F.col("r") == 5) & (F.col("c") < 5))
    n = {r["status"]: r["count"] for r in st.groupBy("status").count().collect()}
    assert n == {"sin_ghi": 10, "excluida": 5, "valida": 85}
    r = P.yield_contrast(st.where("status = 'valida'"), 0.7).first()
    assert (r.celdas_validas, r.celdas_aptas, r.media_region) == (85, 9, 2000.0)


def test_decoupling_study(spark):
    rng = np.random.default_rng(0)
    prob = rng.random((40, 40))
    df = frame(spark, prob=prob, yld=1800 + 300 * prob + rng.normal(0, 5, (40, 40)))
    g = GridSpec(300000.0, 7010000.0, 1000.0, 1000.0, 40, 40, 32719)
    rows = {r.ambito: r for r in P.decoupling_study(df, g, 0.7, 20, 42, 15000.0).collect()}
    assert rows["region"].rho_celda > 0.9 and rows["region"].rho_bloque > 0
    assert rows["region"].bloque_ic_inf <= rows["region"].bloque_ic_sup
    with pytest.raises(ValueError):
        P.decoupling_study(df.where("prob < 0.5"), g, 0.7, 5)


def test_block_of_neighbours(spark):
    g = GridSpec(300000.0, 7000000.0, 100.0, 100.0, 10, 10)
    df = spark.createDataFrame([(0, 0), (5, 5)], "r int, c int")
    assert df.select(K.block_number(g.x(), g.y(), 30000.0).alias("b")).distinct().count() == 1


@pytest.fixture(scope="module")
def topk(spark):
    df = frame(spark, prob=np.arange(100.0).reshape(10, 10))
    plants = spark.createDataFrame([(9, 5), (9, 8), (0, 1), (0, 2)], "r long, c long")
    foot = spark.createDataFrame([(9, c) for c in range(4)] + [(2, c) for c in range(6)], "r long, c long")
    return P.topk_cells(df, "prob", plants=plants, footprint=foot)


def test_topk_recall_and_area(topk):
    r = P.topk_metrics(topk, "prob", (10.0,)).first()
    assert (r.n_top, r.recall, r.captured) == (10, 0.5, 2)
    assert np.allclose([r.area_precision, r.area_ceiling, r.pct_ceiling, r.area_base], [.4, 1.0, 40.0, .1])


def test_recall_grows_with_k(topk):
    rec = [r.recall for r in P.topk_metrics(topk, "prob").orderBy("k").collect()]
    assert rec == sorted(rec)


def test_topk_zones(topk):
    g = GridSpec(0.0, 5000.0, 500.0, 500.0, 10, 10)
    r = P.topk_zones(topk, "prob", g, (10.0, 90.0)).orderBy("k").collect()
    assert (r[0].n_zones, r[0].precision, r[0].max_km2) == (1, 1.0, 2.5)
    assert r[1].random_base > 0.8


def test_small_footprint_reaches_its_ceiling(spark):
    df = frame(spark, prob=np.arange(100.0).reshape(10, 10))
    plants = spark.createDataFrame([(9, 5)], "r long, c long")
    foot = spark.createDataFrame([(9, 1), (9, 2)], "r long, c long")
    r = P.topk_metrics(P.topk_cells(df, "prob", plants=plants, footprint=foot), "prob", (10.0,)).first()
    assert np.allclose([r.area_precision, r.area_ceiling, r.pct_ceiling], [.2, .2, 100.0])


# -- validation ------------------------------------------------------------------------

def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id int, x double, y double" + extra)


def test_validation_points(spark):
    df = points(spark, [(1, 350000.0, 7350000.0), (2, 9999999.0, 100000.0), (3, None, None)])
    out = Q.validate_sites(df, "id")
    a = Q.audit(out).first()
    assert (a.validos, a.rechazados) == (1, 2)
    reasons = {r.id: r.motivos_rechazo for r in out.collect()}
    assert reasons[1] == "OK" and reasons[3] == "GEOMETRIA_NULA_O_VACIA" and reasons[2].startswith("EASTING_UTM_FUERA_DE_RANGO (9999999.0")


def test_technical_rules(spark):
    df = points(spark, [(1, 350000.0, 7350000.0, 10.0, 2000.0, 220.0, .85), (2, 360000.0, 7350000.0, 25.0, 1500.0, 200.0, .9),
                        (3, 370000.0, 7350000.0, 5.0, 4000.0, 100.0, .5), (4, 380000.0, 7350000.0, None, None, None, None)],
                ", slope double, elev double, ghi double, probabilidad double")
    out = Q.validate_sites(df, "id")
    assert {r.id for r in out.where("es_valido").collect()} == {1, 4}
    h = {r.motivo: r.n for r in Q.reason_histogram(out).collect()}
    assert h == {"PENDIENTE_EXCEDE_MAXIMA": 1, "ELEVACION_EXCEDE_MAXIMA": 1, "GHI_BAJO_MINIMO": 1, "APTITUD_BAJO_UMBRAL": 1}


def test_exclusion_and_duplicates(spark):
    ring = [(349000.0, 7349000.0), (350500.0, 7349000.0), (350500.0, 7350500.0), (349000.0, 7350500.0), (349000.0, 7349000.0)]
    zone = ring_edges(spark.createDataFrame([(1, ring)], "zone_id int, ring array<struct<x:double,y:double>>"), "zone_id", "ring")
    out = Q.validate_sites(points(spark, [(1, 350000.0, 7350000.0), (2, 360000.0, 7360000.0)]), "id", exclusions={"snap": zone})
    got = {r.id: r.motivos_rechazo for r in out.collect()}
    assert got == {1: "INTERSECTA_ZONA_EXCLUSION_SNAP", 2: "OK"}
    out = Q.validate_sites(points(spark, [(1, 350000.0, 7350000.0), (2, 350005.0, 7350005.0)]), "id")
    got = {r.id: r.motivos_rechazo for r in out.collect()}
    assert got == {1: "OK", 2: "DUPLICADO_ESPACIAL (a 7.1m del objeto index=1)"}


def test_sql_export(spark, tmp_path):
    df = spark.createDataFrame([("A'1", .88, 15000.0, 230.5, 4.2, 1850.0, 350000.0, 7350000.0), ("B", .5, 1.0, None, float("nan"), 2.0, None, None)],
                               "site_id string, probabilidad double, area_m2 double, ghi double, slope double, elev double, x double, y double")
    lines = [r.value for r in sinks.to_insert_sql(df).orderBy("part", "line").collect()]
    assert any(v.startswith("CREATE TABLE public.instalaciones_solares_optimas") for v in lines)
    assert "VALUES ('A''1', 0.8800, 15000.00, 230.50, 4.20, 1850.00, TRUE, NULL, ST_SetSRID(ST_GeomFromText('POINT (350000 7350000)'), 32719));" in lines[-2]
    assert lines[-1].endswith("VALUES ('B', 0.5000, 1.00, NULL, NULL, 2.00, TRUE, NULL, NULL);")
    sinks.write_sql(sinks.to_insert_sql(df), str(tmp_path / "sql"))
    assert spark.read.text(str(tmp_path / "sql")).count() == 7


def test_validation_on_a_stream(spark, tmp_path):
    src, name = str(tmp_path / "in"), "checked"
    points(spark, [(1, 350000.0, 7350000.0), (2, 1.0, 7350000.0)]).write.parquet(src)
    q = (validate_stream(spark.readStream.schema("id int, x double, y double").parquet(src))
         .writeStream.format("memory").queryName(name).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.es_valido for r in spark.table(name).collect()} == {1: True, 2: False}


def test_reconcile_raises(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert Q.reconcile(a, a, ["k"], "v", 1e-9).first().max_diff == 0.0
    with pytest.raises(ValueError):
        Q.reconcile(a, a.withColumn("v", F.col("v") + 1), ["k"], "v", 0.5)
    with pytest.raises(ValueError):
        Q.reconcile(a, a.where("k = 1"), ["k"], "v", 0.5)


# -- sources and sinks -----------------------------------------------------------------

def test_cells_round_trip(spark, tmp_path):
    df = frame(spark, v=np.array([[1.0, -9999.0], [3.0, 4.0]]))
    sinks.write_cells(df, GridSpec(0, 2, 1, 1, 2, 2), "v", str(tmp_path / "cells"))
    raw = spark.read.parquet(str(tmp_path / "cells"))
    assert raw.where("v = -9999").count() == 1
    assert readers.read_cells(spark, str(tmp_path / "cells"), ["v"]).where("v is null").count() == 1


def test_samples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "clase int, dist_transmision double, dist_almacen double")
    sinks.write_samples(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["clase", "dist_trans", "dist_almac"]
    assert readers.read_samples(spark, str(tmp_path / "s")).columns == df.columns


def test_geojson_layers(spark, tmp_path):
    doc = ('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"z","REGION":"02"},"geometry":{"type":"Polygon",'
           '"coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}}]}')
    f = tmp_path / "z.json"
    f.write_text(doc)
    e = readers.read_geojson(spark, str(f), "polygon")
    assert e.count() == 4 and e.first().properties["REGION"] == "02"
    assert readers.in_region(points(spark, [(1, 1.0, 1.0), (2, 9.0, 9.0)]), ["02"], "id", e, "feature_id").count() == 1
    with pytest.raises(ValueError):
        readers.regions_of(spark.createDataFrame([("99",)], "REGION string"), "REGION", ["02"])


def test_report_parameters_and_fallback(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"best_params": {"max_depth": 10, "n_estimators": 600}}')
    (tmp_path / "e.json").write_text('{"auc": 1}')
    assert readers.tuned_parameters(spark, str(tmp_path / "r.json"))["max_depth"] == 10
    assert readers.tuned_parameters(spark, "none", {"max_depth": 3}) == {"max_depth": 3}
    with pytest.raises(ValueError):
        readers.tuned_parameters(spark, str(tmp_path / "e.json"))
    spark.range(3).write.parquet(str(tmp_path / "b"))
    name, df = readers.first_available(spark, [("a", str(tmp_path / "a")), ("b", str(tmp_path / "b"))])
    assert name == "b" and df.count() == 3


def test_region_codes(spark):
    df = spark.createDataFrame([(1, " 02 "), (2, "ATACAMA;COQUIMBO"), (3, None), (4, "13")], "id int, REGION string")
    ids = lambda m: {r.id for r in df.where(K.region_filter("REGION", ["02", "ATACAMA"], m)).collect()}
    assert ids("exact") == {1} and ids("compound") == {1, 2}


# -- sampling and models ------------------------------------------------------------------

def test_retired_design_name():
    assert S.strategy_name("fondo_objetivo") == "sin_filtros_geofisicos"
    with pytest.raises(ValueError):
        S.strategy_name("otra")


def test_leak_control_keeps_the_negatives(spark):
    df = spark.range(500).select(F.col("id"), F.lit(200.0).alias("ghi"), F.lit(3.0).alias("slope"), F.lit(900.0).alias("elev"),
                                 (F.col("id") * 100.0).alias("crit"), (F.col("id") * 130.0).alias("dist_transmision"))
    crit = {"ghi_min": 160.0, "slope_max": 15.0, "elev_max": 3500.0, "dist_max": 20000.0}
    with_leak = {r.id for r in S.negatives(df, "ahp_filtrado", crit, "crit").collect()}
    free = S.negatives(df, "ahp_filtrado", crit, "crit")
    assert {r.id for r in free.collect()} == with_leak and free.where("dist_transmision < crit").count() == 0
    assert S.negatives(df, "ahp_filtrado", crit, "dist_transmision").count() < len(with_leak)


def test_draws_are_repeatable(spark):
    df = spark.range(1000)
    a, b = ({r.id for r in S.draw_rows(df.repartition(n), "id", 50, 7).collect()} for n in (1, 6))
    assert a == b and len(a) == 50
    assert S.draw_rows(df, "id", 5000, 7).count() == 1000
    assert {r.id for r in S.draw_rows(df, "id", 50, 8).collect()} != a


def test_folds_are_disjoint_and_balanced(spark):
    df = spark.range(3000).select("id", (F.col("id") % 100).alias("block"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).cast("int").alias("clase"))
    f = S.group_folds(df, "block", "clase", 5)
    assert f.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    pos = [r.p for r in f.groupBy("fold").agg(F.sum("clase").alias("p")).collect()]
    assert len(pos) == 5 and max(pos) - min(pos) < 0.15 * sum(pos) / 5


def test_impute_dates(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(i, d + dt.timedelta(i) if i % 3 else None) for i in range(30)], "id int, f date")
    out = S.impute_dates(df, "id", "f", 1)
    known = {r.f for r in df.where("f is not null").collect()}
    assert out.where("f is null").count() == 0 and {r.f for r in out.collect()} <= known
    assert out.where("fecha_imputada").count() == 10
    with pytest.raises(ValueError):
        S.impute_dates(df.where("f is null"), "id", "f", 1)


def test_ahp(spark):
    m = [[1, 3, 5], [1 / 3, 1, 2], [1 / 5, 1 / 2, 1]]
    df = spark.createDataFrame([("p", i, j, float(m[i][j])) for i in range(3) for j in range(3)], "profile string, i int, j int, value double")
    out = H.ahp_weights(df).orderBy("i").collect()
    assert np.isclose(sum(r.weight for r in out), 1.0) and out[0].weight > out[1].weight > out[2].weight
    assert out[0].consistent and 0 < out[0].cr < 0.1


@pytest.fixture(scope="module")
def aoa_data(spark):
    rng = np.random.default_rng(0)
    cols = list("abcdefg")
    tr = pd.DataFrame(rng.normal(10, 2, (50, 7)), columns=cols).assign(k=np.arange(50))
    return spark.createDataFrame(tr), cols, dict(zip(cols, [.3, .2, .15, .1, .1, .1, .05]))


def test_aoa(spark, aoa_data):
    tr, cols, w = aoa_data
    fit = A.fit(tr, cols, "k", w)
    zone = spark.createDataFrame([(0, *fit.means), (1, *[m + 20 * s for m, s in zip(fit.means, fit.sds)])], "k int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: r.inside for r in A.dissimilarity(fit, zone, "k").collect()}
    assert got == {0: True, 1: False}
    x = tr.toPandas()[cols].to_numpy()
    z = (x - x.mean(0)) / x.std(0) * np.sqrt(np.array([w[c] for c in cols]))
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = d.min(1)
    q25, q75 = np.percentile(near / near.mean(), [25, 75])
    assert np.isclose(fit.mean_distance, near.mean()) and np.isclose(fit.threshold, q75 + 1.5 * (q75 - q25))
    rep = A.zone_report(A.dissimilarity(fit, zone, "k")).first()
    assert rep.pct_inside + rep.pct_outside == 100.0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    n = 600
    p = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    p["clase"] = ((p.a + 0.5 * p.b + 0.3 * rng.normal(size=n)) > 0.6).astype(int)
    p["block"], p["region"] = p.id % 30, p.id % 2
    return spark.createDataFrame(p).cache()


PARAMS = {"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 3}


def test_contributions_add_up(labelled, tmp_path):
    f = ["a", "b", "c"]
    m = FO.train(labelled, f, "clase", PARAMS)
    FO.save(m, str(tmp_path / "m"))
    s = FO.score(FO.load(str(tmp_path / "m")), labelled, f)
    phi = FO.contributions(m, s, f, ["id", "prob"])
    gap = phi.agg(F.max(F.abs(F.col("prob") - F.col("base") - F.col("phi_a") - F.col("phi_b") - F.col("phi_c")))).first()[0]
    assert gap < 1e-12
    shares = FO.contribution_shares(phi, f).orderBy("place").collect()
    assert shares[0].feature == "a" and np.isclose(sum(r.pct for r in shares), 100.0)


def _plain_trees(nodes):
    """Each tree as nested (feature, cut, share of the left, left, right) or a leaf value."""
    def walk(begin, k):
        i = begin + k
        if not nodes.child[i]:
            return float(nodes.value[i])
        left, right = begin + nodes.child[i], begin + nodes.other[i]
        return (int(nodes.feature[i]), float(nodes.cut[i]), nodes.weight[left] / (nodes.weight[left] + nodes.weight[right]),
                walk(begin, nodes.child[i]), walk(begin, nodes.other[i]))
    return [walk(b, 0) for b in nodes.begins[:-1]]


def _expected(tree, x, known):
    if isinstance(tree, float):
        return tree
    f, cut, share, left, right = tree
    if f in known:
        return _expected(left if x[f] <= cut else right, x, known)
    return share * _expected(left, x, known) + (1 - share) * _expected(right, x, known)


def test_contributions_match_definition(labelled):
    """Every feature's mean gain over all orders in which features become known."""
    from itertools import permutations

    from cellwise.operators import attribution as AT

    f = ["a", "b", "c", "d"]
    data = labelled.withColumn("d", F.pmod(F.col("id") * 7, F.lit(11)) + F.col("a") * 0.5)
    m = FO.train(data, f, "clase", {"n_estimators": 5, "max_depth": 6, "min_samples_leaf": 1})
    table = AT.stored_nodes(m)
    nodes = AT.held_nodes(table, 0, 5)
    trees = _plain_trees(nodes)
    rows = np.array(data.select(*f).limit(12).collect(), float)
    phi, base = AT.forest_contributions(nodes, rows)
    assert np.isclose(base, sum(_expected(t, rows[0], ()) for t in trees))
    for x, got in zip(rows, phi):
        want, orders = np.zeros(4), list(permutations(range(4)))
        for order in orders:
            for k, j in enumerate(order):
                want[j] += sum(_expected(t, x, order[:k + 1]) - _expected(t, x, order[:k]) for t in trees) / len(orders)
        assert np.allclose(got, want, atol=1e-12)
    # groups of trees add up to the same
    one = FO.contributions(m, data, f, ["id"]).orderBy("id").toPandas()
    many = FO.contributions(m, data, f, ["id"], held=40).orderBy("id").toPandas()
    assert len(AT.groups(table, 40)) > 2 and np.allclose(one, many, atol=1e-12)


def test_contributions_of_a_large_forest():
    import time

    from cellwise.operators import attribution as AT

    rng, depth, trees, width = np.random.default_rng(1), 10, 200, 7
    inner, size = (1 << depth) - 1, (2 << depth) - 1
    k = np.arange(size)
    child = np.where(k < inner, 2 * k + 1, 0)
    weight = np.zeros((trees, size))
    weight[:, inner:] = rng.integers(1, 50, (trees, inner + 1))
    for i in range(inner - 1, -1, -1):
        weight[:, i] = weight[:, 2 * i + 1] + weight[:, 2 * i + 2]
    nodes = AT.Nodes(np.arange(trees + 1) * size, np.tile(child, trees), np.tile(np.where(k < inner, 2 * k + 2, 0), trees),
                     rng.integers(0, width, trees * size), rng.random(trees * size), rng.random(trees * size), weight.ravel())
    x = rng.random((16, width))
    start = time.perf_counter()
    phi, base = AT.forest_contributions(nodes, x)
    assert time.perf_counter() - start < 60
    leaf = np.zeros(16)
    for t in range(trees):
        at = np.zeros(16, int)
        for _ in range(depth):
            i = t * size + at
            at = np.where(x[np.arange(16), nodes.feature[i]] <= nodes.cut[i], 2 * at + 1, 2 * at + 2)
        leaf += nodes.value[t * size + at]
    assert np.allclose(phi.sum(axis=1) + base, leaf)


def test_spatial_validation(labelled):
    folds = FO.spatial_cv(labelled, ["a", "b", "c"], "block", "clase", PARAMS, 3)
    r = FO.cv_summary(folds).first()
    assert r.n_folds == 3 and r.auc_mean > 0.8 and r.brier_mean < 0.2
    loro = FO.leave_one_region_out(labelled, ["a", "b", "c"], "region", "clase", PARAMS)
    assert loro.count() == 2 and FO.region_gap(loro).first().gap < 0.2
    with pytest.raises(ValueError):
        FO.leave_one_region_out(labelled.where("region = 0"), ["a", "b", "c"], "region", "clase", PARAMS)


def test_search_is_repeatable(labelled):
    space = {"n_estimators": (3, 5, 2), "max_depth": (2, 3, 1)}
    a, b = (FO.search(labelled, ["a", "b"], "block", 2, "clase", space, 2).drop("auc_mean").first() for _ in range(2))
    assert a == b


def test_covariate_shift(spark):
    tr = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    zo = spark.createDataFrame([(-5.0,), (5.0,), (20.0,), (30.0,)], "v double")
    r = P.covariate_shift(tr, zo, ["v"]).first()
    assert (r.pct_below, r.pct_above, r.pct_outside) == (25.0, 50.0, 75.0)
    assert np.isclose(r.shift_sd, (12.5 - 5.0) / np.std(np.arange(11)))


def test_design_agreement(spark):
    from cellwise.functions.columns import FEATURES

    rows = [("d1", "ghi", {f: float(i) for i, f in enumerate(FEATURES)}), ("d2", "ghi", {f: float(i) for i, f in enumerate(FEATURES)}),
            ("d3", "slope", {f: -float(i) for i, f in enumerate(FEATURES)})]
    df = spark.createDataFrame(rows, "estrategia string, dominante string, shares map<string,double>")
    got = {(r.a, r.b): (r.tau, r.rho, r.misma_dominante) for r in L.design_agreement(df).collect()}
    assert got == {("d1", "d2"): (1.0, 1.0, True), ("d1", "d3"): (-1.0, -1.0, False), ("d2", "d3"): (-1.0, -1.0, False)}


def test_topk_needs_cells_and_plants(spark):
    cells = spark.createDataFrame([(0, 0, 0.5, 0), (0, 1, 0.7, 0)], "r long, c long, prob double, n_plants long")
    with pytest.raises(ValueError, match="plant"):
        P.topk_metrics(cells, "prob", (10.0,))
    with pytest.raises(ValueError, match="cell"):
        P.topk_metrics(cells.limit(0), "prob", (10.0,))


def test_layers_follow_one_system(spark):
    from cellwise.operators import quality as Q

    geo = spark.createDataFrame([(1, -70.0, -24.0), (2, -69.2, -25.5)], "k int, x double, y double")
    east = {r.k: (r.x, r.y) for r in Q.in_system(geo, 4326, 32719).collect()}
    assert all(200_000 < x < 800_000 and 7_000_000 < y < 8_000_000 for x, y in east.values())
    again = Q.in_system(Q.in_system(geo, 4326, 32718), 32718, 32719)
    assert all(np.allclose((r.x, r.y), east[r.k], atol=0.05) for r in again.collect())
    for srid in (None, 32719):
        assert {r.k: (r.x, r.y) for r in Q.in_system(geo, srid, 32719).collect()} == {1: (-70.0, -24.0), 2: (-69.2, -25.5)}
    with pytest.raises(ValueError):
        Q.in_system(geo, 3857, 32719)


def test_applicability_with_one_group_uses_plain_neighbours(spark):
    from cellwise.operators import aoa as A

    df = spark.createDataFrame([(i, float(i * i % 17), float(i % 5), 1) for i in range(40)], "k int, a double, b double, g int")
    assert A.fit(df, ["a", "b"], "k", group="g").threshold == A.fit(df, ["a", "b"], "k").threshold


def test_train_study_end_to_end(spark, tmp_path):
    rows = spark.range(240).select(
        F.col("id").alias("cell"), F.expr("id div 20").alias("block"), ((F.col("id") * 37) % 101).cast("double").alias("f1"),
        ((F.col("id") * 11) % 17).cast("double").alias("f2")).withColumn("y", (F.col("f1") + F.col("f2") > 70).cast("int"))
    pos, pool = rows.where("y = 1").drop("y"), rows.where("y = 0").drop("y")
    space = {"n_estimators": (3, 6, 3), "max_depth": (2, 4, 2), "min_samples_leaf": (1, 2, 1)}
    path = str(tmp_path / "study")
    out = L.train_study(pos, pool, "cell", "block", 1, 2, 4, space, 5, ["f1", "f2"], 3, 7, path)
    m = out["metrics"].first()
    assert (m.n_pos, m.n_neg) == (pos.count(), min(pos.count(), pool.count()))
    assert m.best_params.asDict() == out["params"] == {k: out["search"].orderBy("brier_mean", *space).first()[k] for k in space}
    assert m.auc_sbcv > 0.8 and m.auc_split > 0.8 and m.ratio_alt == 2
    assert m.lectura == ("robusto al ratio" if abs(m.auc_alt - m.auc_split) < 0.02 else "sensible al ratio")
    assert out["model"].getNumTrees == out["params"]["n_estimators"]
    # what is written can be read by the next study
    assert readers.tuned_parameters(spark, path + "/metrics") == out["params"]
    again = FO.score(FO.load(path + "/model"), out["data"], ["f1", "f2"]).orderBy("cell").collect()
    assert [r.prob for r in again] == [r.prob for r in FO.score(out["model"], out["data"], ["f1", "f2"]).orderBy("cell").collect()]
    assert spark.read.parquet(path + "/samples").count() == m.n_pos + m.n_neg
    # a pool that cannot serve the other ratio leaves its columns null
    short = L.train_study(pos, pool.where("cell < 60"), "cell", "block", 3, 10, 1, space, 5, ["f1", "f2"], 2, 7)["metrics"].first()
    assert short.auc_alt is None and short.lectura is None and short.ratio_alt is None
    with pytest.raises(ValueError):
        L.train_study(pos, pool.limit(0), "cell", "block", 1, None, 1, space, 5, ["f1", "f2"], 2, 7)
