"""Hooks for user code on Arrow batches and groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_batches(df: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """Apply ``predict(pandas) -> pandas`` to Arrow batches of every partition."""
    def run(batches):
        for pdf in batches:
            yield predict(pdf)

    return df.mapInPandas(run, schema)


def per_unit(df: DataFrame, key: Sequence[str], worker: Callable, schema: str) -> DataFrame:
    """Apply ``worker(pandas) -> pandas`` to each unit's rows; a unit must fit one task."""
    return df.groupBy(*key).applyInPandas(worker, schema)


def unit_slices(units: DataFrame, lo="lo", hi="hi") -> DataFrame:
    return units.select("unit", F.explode(F.sequence(F.col(lo), F.col(hi))).alias("slice_y"))


def file_rows(df: DataFrame, col="produced_files", sep=";") -> DataFrame:
    """One row per listed file with its position and the list length; empty lists keep one row."""
    files = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), sep), lambda s: s != "")
    e = df.withColumn("_f", files).select("*", F.posexplode_outer("_f").alias("idx", "file"))
    return e.withColumns({"n_listed": F.size("_f"), "idx": F.coalesce("idx", F.lit(0))}).drop("_f")
