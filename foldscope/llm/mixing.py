"""Mixing sources to target weights along a time-varying curriculum.

Every source has a token target (capped water-filling over the source weights) and a schedule: its relative
weight over training time 0..1. The integral of the schedule is the source's cumulative demand; inverting it at a
document's place in the source's stream gives the training time at which the document is due.
Only DataFrame operations: a source of any size is split by hash bucket for its running sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope.runtime import cut

WORDS = r"[^\x20\x09-\x0D]+"
# Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
# Share of all words that the mix takes, and the most that a source or a document may be repeated.
SHARE, MOST = 1.5, 2
# (time, relative weight) knots by rank of the source, repeating: early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
# Leading hex digits of the order hash that split a source.
BUCKET_DIGITS = 3


def due(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Training time at which a source with this schedule has been asked for ``share`` (0..1) of its target."""
    segments = list(zip(knots, knots[1:]))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in segments)
    if whole <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of at least 0 and an integral above 0")
    out, done = F.lit(float(knots[-1][0])), 0.0
    pieces = []
    for (t0, w0), (t1, w1) in segments:
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((done, done + area, t0, w0, (w1 - w0) / (t1 - t0)))
        done += area
    for lo, hi, t0, w0, slope in reversed(pieces):
        if hi > lo:
            y = share * F.lit(whole) - F.lit(lo)
            x = y * F.lit(2.0) / F.nullif(F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * y), F.lit(0.0))
            out = F.when(share * F.lit(whole) < F.lit(hi), F.lit(t0) + F.coalesce(x, F.lit(0.0))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source: source, rank (by code point, NULL last), source_size, target.

    ``share`` of all words is dealt by weight; a source stops at ``most`` times its size and the rest is dealt
    again. The level is exact: with sources ordered by the level at which they fill, it is the largest quotient of
    remaining words and remaining weight that does not exceed the next source's filling level.
    """
    if share > most:
        raise ValueError("the sources hold fewer words than the share asks for")
    by = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy("_fills", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("_fills", F.lit(float(most)) * F.col("source_size") / F.col("_w"))
    s = s.withColumn("_full", F.coalesce(F.sum("source_size").over(fills), F.lit(0)) * F.lit(float(most)))
    s = s.withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(fills), F.lit(0.0)))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("_full")) / F.col("_rest"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fills"), F.col("_level"))).over(everything))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("_level") * F.col("_w"), F.lit(float(most)) * F.col("source_size")))
    return s.select("source", "rank", "source_size", target.alias("target"))


def _stream(docs: DataFrame, keep: list[str], weights, share: float, most: int) -> DataFrame:
    """Every row of ``docs`` with its columns ``keep`` as ``_row``, its size, its source's figures and its start in the source's stream.

    Running sums are split by the leading digits of the order hash: one aggregate gives the words of each (source,
    bucket), a window over those gives the bases, and only the rows of one bucket are ever ordered together.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    d = docs.select(row.alias("_row"), "source", size.alias("size"), order.alias("_o"), F.xxhash64("text").alias("_t"))
    # A key that is never NULL, so that the join below and the window share one exchange.
    d = d.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("_b", F.substring("_o", 1, BUCKET_DIGITS))
    sums = cut(d.groupBy("_s", "_b").agg(F.first("source").alias("source"), F.sum("size").alias("size")))
    t = targets(sums, weights, share, most)
    t = t.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_s", "_b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_base")).join(t, "_s")
    inside = Window.partitionBy("_s", "_b").orderBy("_o", "_t").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(cut(bases), ["_s", "_b"])
    d = d.withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.withColumn("_words", F.floor(F.col("target") + 0.5))


def _words_in_pass(n: Column) -> Column:
    """Words that pass ``n`` (from 0) over the source takes of a document."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - n * F.col("source_size") - F.col("_start")))


def _position(n: Column, schedules) -> Column:
    """Time at which pass ``n`` over the document is due, in 10^-12 of the training run (floor)."""
    share = (F.col("_start") + n * F.col("source_size")) / F.nullif(F.col("_words"), F.lit(0))
    at = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        at = F.when((F.col("rank") - 1) % len(schedules) == k, due(share, knots)).otherwise(at)
    return F.floor(at * F.lit(1e12))


def placements(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position: a row per document.

    A source's stream is its documents by md5 of the id (ties by text hash), ``most`` times over; the mix takes
    its first round(target) words, so ``taken`` adds up to that and the last document may be taken in part.
    ``position`` is the training time of the first word (see ``_position``), NULL if nothing is taken.
    NULL and blank texts have size 0 and are taken with 0 words; NULL sources are one source, the last; repeated
    rows are documents of their own; an empty table gives no rows.
    """
    d = _stream(docs, ["doc_id"], weights, share, most)
    taken = sum((_words_in_pass(F.lit(p)) for p in range(math.ceil(most))), F.lit(0)).cast("long")
    d = d.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, _position(F.lit(0), schedules)))
    return d.select("_row.doc_id", "size", "source", "source_size", "target", "taken", "position")


def curriculum(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """The rows of ``docs`` in training order: one row for each pass that takes any words of a document.

    Documents stay whole: a pass that takes part of one takes its row, so a source is over its target by less
    than one document. Documents without words are never due. All columns of ``docs`` are kept, whatever their
    names; the order is a range sort by position, ties by source rank and place in the stream.
    """
    d = _stream(docs, docs.columns, weights, share, most).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    d = d.filter(_words_in_pass(F.col("_pass")) > 0).select("_row", "rank", "_start", _position(F.col("_pass"), schedules).alias("_at"))
    return d.orderBy("_at", "rank", "_start").select("_row.*")
