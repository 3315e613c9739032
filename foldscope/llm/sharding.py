"""Rendezvous sharding: every record goes to the shard that draws best for the record's key.

A shard's draw depends on the key and the shard alone, so a further shard takes records only into itself, and a
shard that goes gives away its own records only. Only DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope.llm.common import partitions
from foldscope.runtime import cut

# What a record takes beside its text, in bytes.
OVERHEAD = 16
# Rows that one task numbers.
TASK_ROWS = 1_000_000


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's draw for the key: w / -ln(u), with u in (0, 1) from 52 bits of md5(key:shard). The largest wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return weight / -F.ln((bits + 0.5) / F.lit(2.0**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) with the largest draw, the first of equal ones; shards of weight 0 get nothing."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("shards need weights of at least 0, one of them above 0")
    live = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])
    draws = F.transform(live, lambda s: F.struct(draw(key, s["i"], s["w"]).alias("v"), (-s["i"]).alias("i")))
    return -F.array_max(draws)["i"]


def placed(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, all by default), size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shards decide; equal texts under different ids go their own ways. size is the
    UTF-8 bytes of the text plus ``OVERHEAD``. ``grown_shard`` is the shard under the weights ``grown`` (by default
    one more shard of the mean weight); it differs from shard only where it is a new one, if the old weights stay.
    ``slot`` numbers a shard's rows from 0 by md5 of the id, then md5 of the text; only rows equal in both may swap.

    NULL ids are one key; a NULL text is empty; rows under one id share a shard, as the law asks, and are numbered by
    any number of tasks; an empty table gives no rows. Columns keep their names inside ``row``, so none can clash.

    Rows are range-partitioned by (shard, order) and written sorted, a file by a task. A row's slot is its place in its
    file, less the shard's first place there, plus the shard's rows in files before: no window over the rows of a shard.
    """
    spark = docs.sparkSession
    weights = [float(w) for w in weights]
    grown = [*weights, sum(weights) / max(len(weights), 1)] if grown is None else [float(w) for w in grown]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"))
    key, text = F.coalesce("_id", F.lit("")), F.coalesce("_text", F.lit(""))
    d = d.select(
        "row", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"), F.md5(key).alias("_o"), F.md5(text).alias("_t"))
    d = cut(d).withColumn("_i", F.monotonically_increasing_id())  # the last resort among equal rows, so that ranges can part them
    parts = max(partitions(spark), -(-d.count() // TASK_ROWS))
    order = ["shard", "_o", "_t", "_i"]
    d = cut(d.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    d = d.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_at"))
    runs = d.groupBy("shard", "_f").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.min(F.struct(*order[1:])).alias("_key"))
    before = Window.partitionBy("shard").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("shard", "_f", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    d = d.join(bases, ["shard", "_f"])  # a row per shard and file: at most the files plus the shards
    return d.select("row", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_base")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float]) -> None:
    """All columns of ``docs`` with shard and slot as a table in folders by shard, each file in slot order."""
    rows = placed(docs, weights)
    rows.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).repartitionByRange(
        partitions(docs.sparkSession), "_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
