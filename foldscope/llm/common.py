"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscope.runtime import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text: str | Column) -> Column:
    """128 bits of a text as two longs in a struct; NULL and '' differ."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c, F.length(c)).alias("a"), F.xxhash64(F.lit("salt"), c).alias("b"))


def sha256_of(parts: Column) -> Column:
    """Lowercase hex of the comma-joined strings of an array."""
    return F.sha2(F.array_join(parts, ","), 256)


def row_key(*cols: str) -> list[Column]:
    """Columns _a and _b: 128 bits that stand for the values of ``cols``, never NULL themselves."""
    parts = [p for c in cols for p in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit("salt"), *parts).alias("_b")]


def packed(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df`` beside the whole row in ``_row``, so that no other column name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).select("_row", *[F.col(f"_row.{c}").alias(c) for c in cols])
