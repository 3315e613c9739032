"""Ranks, prefix sums and exact quantiles that never need one big window.

Small inputs (at most ``WINDOW_ROWS`` rows, counted first) use a plain window.
Larger inputs are range-partitioned on (group, order); each range is scanned by
its own task and a table of range totals supplies the offsets, so one group
that holds most of the rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope import runtime

SEG = "_seg"


def _segments(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int | None):
    limit = runtime.WINDOW_ROWS if limit is None else limit
    table = runtime.cut(df)
    n = table.count()
    if n <= limit:
        return table.withColumn(SEG, F.lit(0)), False
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / max(limit, 1)))
    ranged = table.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    return runtime.cut(ranged.withColumn(SEG, F.spark_partition_id())), True


def prefix_sum(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{name: expr}`` along ``order`` within ``by``.

    ``order`` must be total within a group: collapse ties or end with a key.
    """
    by = list(by)
    inputs = {f"_in_{k}": v for k, v in sums.items()}
    table, split = _segments(df.withColumns(inputs), by, order, limit)
    local = Window.partitionBy(*by, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumns({k: F.sum(f"_in_{k}").over(local) for k in sums})
    if split:
        totals = table.groupBy(*by, SEG).agg(*[F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums])
        earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *[F.col(c).alias(f"_g_{c}") for c in by],
            F.col(SEG).alias("_oseg"),
            *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums],
        )
        cond = F.col(SEG) == F.col("_oseg")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        out = out.join(offsets, cond).withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums})
        out = out.drop("_oseg", *[f"_g_{c}" for c in by], *[f"_o_{k}" for k in sums])
    return out.drop(SEG, *inputs)


def ranked(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rn", limit: int | None = None
) -> DataFrame:
    """``row_number`` over (by, order), spread over range partitions when large."""
    return prefix_sum(df, order, {name: F.lit(1).cast("long")}, by, limit)


def top_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], value: Sequence[str] | None = None) -> DataFrame:
    """First row of every ``key`` in ``order`` (columns ascending), by a map-side combined ``min``.

    ``order`` expressions must be comparable; negate a number for descending order.
    """
    rest = [c for c in (value or df.columns) if c not in key]
    packed = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(*key).agg(packed.alias("_m")).select(*key, *[F.col(f"_m._row.{c}").alias(c) for c in rest])


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), weight: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles ``{name: p}`` of ``value`` within ``by``, with count ``n``.

    Values are collapsed to (group, value, count) before ranking. NULL and NaN are ignored.
    """
    by = list(by)
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = base.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("_c")
    )
    cum = prefix_sum(cells, [F.col("_v")], {"_cum": F.col("_c")}, by, limit)
    total = cum.groupBy(*by).agg(F.sum("_c").alias("n"))
    if by:
        names = {c: f"_g_{c}" for c in by}
        t = total.withColumnsRenamed(names)
        cond = F.lit(True)
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(names[c]))
        cum = cum.join(t, cond).drop(*names.values())
        n = F.col("n")
    else:
        n = F.lit(total.first()["n"]).cast("long")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (n - 1)
        at = lambda r: F.max(F.when((F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum")), F.col("_v")))
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    out = cum.groupBy(*by).agg(F.max("_cum").alias("n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*by, *cols, "n")
