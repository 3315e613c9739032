"""Fill-in-the-middle: texts cut at two unit borders and written with the middle last.

The rewriting runs on whole Arrow batches with ``pyarrow.compute``: texts become lists of units, the units are
flattened beside the index of their text, numbered within it, filtered by role, put back into lists and joined.
Texts travel to Python alone; the other columns of a row never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Control strings of the output, in the order prefix, suffix, middle. None may share a border with another.
MARKS = ("<P>", "<S>", "<M>")
# Texts in a hundred that are rewritten, and of these the ones with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
# A unit is a run of ASCII letters or any other code point. The pattern reads UTF-8 bytes; 0xFF is in no text.
UNIT = rb"([A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*|[\x80-\xbf])"
BORDER = b"\xff"
# Bytes of text whose units are held at once; a longer text is taken alone.
SLICE_BYTES = 2 << 20
PIECES = StructType([StructField("n", LongType()), *[StructField(c, StringType()) for c in ("prefix", "middle", "suffix")]])


def cut_texts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.StructArray:
    """Unit count and the three pieces of every text; the borders are ``first`` and ``second`` modulo the count + 1."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=b"\\1" + BORDER)
    units = pc.split_pattern(marked, BORDER)  # ends with an empty unit after the last border
    flat = pc.list_flatten(units)
    parent = pc.list_parent_indices(units).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    n = sizes - 1
    at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[parent]
    a, b = first % (n + 1), second % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    role = (at >= a[parent]).astype(np.int8) + (at >= b[parent])
    pieces = []
    for k, count in enumerate((a, b - a, sizes - b)):
        offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
        rebuilt = pa.ListArray.from_arrays(offsets, pc.filter(flat, pa.array(role == k)))
        pieces.append(pc.binary_join(rebuilt, b"").cast(pa.string()))
    return pa.StructArray.from_arrays([pa.array(n), *pieces], ["n", "prefix", "middle", "suffix"])


def _slices(texts: pa.Array) -> Iterator[slice]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield slice(start, stop)
        start = stop


@F.arrow_udf(PIECES)
def _pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    h1, h2 = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([cut_texts(texts[s], h1[s], h2[s]) for s in _slices(texts)] or [cut_texts(texts, h1, h2)])


def draws(key: str, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:key``; a NULL key draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _meet(a: str, b: str) -> bool:
    """Whether ``b`` can start inside ``a``, so that a text between them could complete a false mark."""
    return (a != b and b in a) or any(b.startswith(a[k:]) for k in range(0 if a == b else 1, len(a)) if k)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) as ``row`` beside n, form, output and the three pieces.

    form is ``plain`` (output is the text), ``psm`` (prefix, suffix, middle behind their marks) or ``spm`` (suffix,
    prefix, middle). The seed and doc_id decide, so equal ids draw alike; pieces are NULL where plain.
    Texts that are empty or hold a mark stay plain, so every output can be read back (``restored``). A NULL text
    is empty and gives n 0; a text of any length is cut whole; repeated rows stay; an empty table gives no rows.
    The columns of ``docs`` keep their names inside ``row``, so none can clash.
    """
    if not all(marks) or any(_meet(a, b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j or len(a) > 1):
        raise ValueError("marks must be distinct, not empty and must not overlap one another")
    h1, h2, h3, h4 = draws("_row.doc_id", seed)
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(text, F.lit(m))
    plain = (text == "") | held | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    d = d.withColumn("_form", form).withColumn("_p", _pieces(text, h1, h2))
    p, s, m = (F.lit(x) for x in marks)
    psm = F.concat(p, "_p.prefix", s, "_p.suffix", m, "_p.middle")
    spm = F.concat(s, "_p.suffix", p, "_p.prefix", m, "_p.middle")
    out = F.when(F.col("_form") == "plain", text).when(F.col("_form") == "psm", psm).otherwise(spm)
    pieces = [F.when(F.col("_form") != "plain", F.col(f"_p.{c}")).alias(c) for c in ("prefix", "middle", "suffix")]
    return d.select(F.col("_row").alias("row"), F.col("_p.n").alias("n"), F.col("_form").alias("form"), out.alias("output"), *pieces)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text of an output: the pieces behind its marks, put back in order."""
    pieces = F.split(output, "|".join(re.escape(m) for m in marks))  # an empty piece before the first mark
    joined = lambda *order: F.concat(*[F.get(pieces, F.lit(k)) for k in order])
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and hashes of the output and of the text read back from it."""
    return rows.select(
        "row.doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
