"""Rank correlations of redrawn blocks against rows that are repeated one by one."""

import numpy as np
import pandas as pd
import pytest

from cellwise.operators import redraws as R
from cellwise.operators import sampling as S


@pytest.mark.parametrize("few", [5, 10**6])
def test_redrawn_blocks_without_repeated_rows(spark, monkeypatch, few):
    def refuse(*a, **k):
        raise AssertionError("rows are repeated per replicate")

    monkeypatch.setattr(S, "spearman", refuse)
    monkeypatch.setattr(R, "REPLICATES", 4)
    monkeypatch.setattr(R, "FEW", few)
    rng = np.random.default_rng(2)
    block = np.where(rng.random(600) < 0.3, 0, rng.integers(0, 30, 600))  # one block and one value hold a third of the rows
    a, b = np.where(rng.random(600) < 0.3, 0.5, rng.random(600)), rng.integers(0, 40, 600) + 5.0 * (block % 3)
    df = pd.DataFrame({"block": block, "a": a, "b": b.astype(float)})
    rows = spark.createDataFrame(df)
    missing = spark.createDataFrame([(1, None, 2.0), (2, 0.1, None)], "block long, a double, b double")
    got = {r.rep: r.rho for r in S.cluster_bootstrap(rows.unionByName(missing), "block", "a", "b", 7, 11).collect()}
    times = S._multiplicity(rows, "block", 7, 11).toPandas()
    for rep, drawn in times.groupby("rep"):
        again = df.merge(drawn, on="block")
        again = again.loc[again.index.repeat(again["times"])]
        assert got.pop(rep) == pytest.approx(again["a"].rank().corr(again["b"].rank()), abs=1e-12)
    assert not got


def test_constant_values_have_no_correlation(spark):
    rows = spark.range(50).selectExpr("id % 5 as block", "1.0D as a", "cast(id as double) as b")
    assert [r.rho for r in S.cluster_bootstrap(rows, "block", "a", "b", 2, 1).collect()] == [None, None]
