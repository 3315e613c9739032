"""Slices are cut along lines that no box crosses before they are fused; the rows stay those of one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.operators import boxes as B


def boxes(spark, n=240):
    """Heaps 30 apart, some of them a thousandth as large, and one long box over a row of heaps."""
    r = np.random.default_rng(4)
    rows = [(k, 0, 0.0, 60.0, 200.0, 66.0, 0.5) for k in (1, None)]
    for i in range(n):
        s = 2.0**-10 if i % 3 == 0 else 1.0
        x, z = s * (30 * r.integers(0, 6) + r.integers(0, 4)), s * (30 * r.integers(0, 5) + r.integers(0, 4))
        rows.append((1 if i % 2 else None, 0, *map(float, (x, z, x + s * r.integers(6, 20), z + s * r.integers(6, 20))), float(r.integers(1, 1000)) / 1000))
    return spark.createDataFrame(rows, "unit int, slice_y int, x1 double, z1 double, x2 double, z2 double, score double").repartition(3)


def fused(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v or 0 for v in q) for q in B.wbf(df, 1e9, 1e9).collect())


@pytest.mark.parametrize("limit", [1, 8])
def test_regions_equal_whole_slices(spark, monkeypatch, limit):
    b = boxes(spark)
    monkeypatch.setattr(runtime, "FOLD_BOXES", 10**6)
    whole = fused(b)
    monkeypatch.setattr(runtime, "FOLD_BOXES", limit)
    assert fused(b) == whole and len(whole) > 20


def test_no_box_crosses_a_line(spark, monkeypatch):
    monkeypatch.setattr(runtime, "FOLD_BOXES", 3)
    b = boxes(spark).withColumn("_m", F.lit(1)).filter("unit = 1")
    small, crowds = B._regions(b, ["unit", "slice_y"])
    by = {}
    for q in small.collect():
        by.setdefault(q["_c"], []).append(q)
    hull = [[f(q[c] for q in rows) for f, c in ((min, "x1"), (min, "z1"), (max, "x2"), (max, "z2"))] for rows in by.values()]
    assert len(hull) > 15 and max(map(len, by.values())) <= 12
    assert not [1 for i, a in enumerate(hull) for c in hull[:i] if a[0] < c[2] and c[0] < a[2] and a[1] < c[3] and c[1] < a[3]]
    assert sum(map(len, by.values())) + (crowds.count() if crowds else 0) == b.count()


def test_small_regions_meet_in_no_pair_join(spark, monkeypatch):
    b = boxes(spark, 60).filter("x2 - x1 < 100")
    monkeypatch.setattr(B, "pair_join", None)
    assert B.wbf(b, 1e9, 1e9).agg(F.sum("n_boxes")).first()[0] == b.count()
