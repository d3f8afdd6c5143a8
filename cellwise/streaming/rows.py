"""Row-local record checks on a stream.

The library's stages are batch jobs. Checks that look at one record at a time are
plain column expressions, so the same code runs on a streaming frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Rules, validate_rows


def validate_stream(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Streaming records with their verdict and joined reasons."""
    ok = F.size("reasons") == 0
    return validate_rows(stream, rules).withColumn("es_valido", ok).withColumn(
        "motivos_rechazo", F.when(ok, "OK").otherwise(F.array_join("reasons", "; "))).drop("reasons")
