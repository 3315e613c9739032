"""Join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(df: DataFrame, **params) -> DataFrame:
    """Each row once per parameter combination; the grid is a literal array, so nothing is joined."""
    out = df
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
