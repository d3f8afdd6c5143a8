"""Pairwise judgement matrices to criterion weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Random consistency index by matrix order; the last one serves larger orders.
RANDOM_INDEX = {1: 0.00, 2: 0.00, 3: 0.58, 4: 0.90, 5: 1.12,
                6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}
CONSISTENT_BELOW = 0.10

SCHEMA = ("profile string, i int, weight double, lambda_max double, "
          "ci double, ri double, cr double, consistent boolean")


def ahp_weights(judgements: DataFrame) -> DataFrame:
    """Weights and consistency per profile from long matrices ``(profile, i, j, value)``.

    A group is one criteria matrix, a few dozen numbers.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        if len(pdf) != n * n:
            raise ValueError("the judgement matrix must be square")
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = pdf["value"]
        values, vectors = np.linalg.eig(m)
        top = int(values.real.argmax())
        lam = float(values[top].real)
        w = np.abs(vectors[:, top].real)
        ci = (lam - n) / (n - 1) if n > 1 else 0.0
        ri = RANDOM_INDEX.get(n, RANDOM_INDEX[10])
        cr = ci / ri if ri > 0 else 0.0
        return pd.DataFrame({"profile": pdf["profile"].iloc[0], "i": np.arange(n, dtype="int32"),
                             "weight": w / w.sum(), "lambda_max": lam, "ci": ci, "ri": ri,
                             "cr": cr, "consistent": cr < CONSISTENT_BELOW})

    return judgements.groupBy("profile").applyInPandas(solve, SCHEMA)


def resolve_weights(ahp: DataFrame, direct: DataFrame) -> DataFrame:
    """Matrix weights where a matrix exists, else the direct ones: ``(profile, criterion, weight)``."""
    return (direct.withColumnRenamed("weight", "_direct")
            .join(ahp.withColumnRenamed("weight", "_ahp"), ["profile", "criterion"], "full")
            .select("profile", "criterion", F.coalesce("_ahp", "_direct", F.lit(0.0)).alias("weight")))
