"""Placement held against a plain loop; taken cells, donors and band travel a bounded number of times, whatever the pastes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.operators import components as C
from foldscope.operators import sampling as K

FRAME = (12, 6, 40)


def pick(n, *key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:15], 16) % n


def loop(targets, band, shapes, taken, attempts, seed=42):
    out = set()
    for u, n in targets:
        sites, full = sorted(band), set(taken)
        for j in range(1, n + 1):
            d = pick(len(shapes), seed, u, j, "donor")
            for a in range(1, attempts + 1):
                s = sites[pick(len(sites), seed, u, j, a, "site")]
                cells = {tuple(p + q for p, q in zip(s, c)) for c in shapes[d]}
                cells = {c for c in cells if all(0 <= v < m for v, m in zip(c, FRAME))}
                if cells and 1 - len(cells) / len(shapes[d]) <= 0.25 and not cells & full:
                    out.add((u, a, j, d, *s))
                    full |= cells
                    break
    return out


def case(spark, n_taken, units=12):
    r = np.random.default_rng(3)
    shapes = [[(i, j, k) for i in range(-1, 1 + d % 2) for j in range(-(d // 4), 1) for k in range(-1, 1 + d % 3)] for d in range(8)]
    band = [(int(x), int(y), int(z)) for x, y, z in np.argwhere(r.random(FRAME) < 0.03)]
    taken = [(int(x), int(y), int(z)) for x, y, z in np.argwhere(r.random(FRAME) < n_taken)]
    targets = [(u, u % 5) for u in range(units)]
    frame = lambda cells: spark.createDataFrame([(u, *c) for u in range(units) for c in cells], "unit int, x int, y int, z int")
    dn = spark.createDataFrame([(d, *c) for d, s in enumerate(shapes) for c in s], "donor long, dx int, dy int, dz int")
    return targets, band, shapes, taken, spark.createDataFrame(targets, "unit int, n_pastes int"), frame(band), dn, frame(taken)


# Few taken cells: four attempts go first. Many: all of them at once.
@pytest.mark.parametrize("n_taken, attempts", [(0.1, 30), (0.3, 5)])
def test_placement_equals_the_loop(spark, n_taken, attempts):
    targets, band, shapes, taken, t, b, dn, occ = case(spark, n_taken)
    want = loop(targets, band, shapes, taken, attempts)
    got = K.place_donors(t, b, dn, occ, FRAME, attempts)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and any(a > 4 for _, a, *_ in want) == (attempts > 5)


def test_taken_cells_and_idle_donors_are_not_rewritten(spark, monkeypatch):
    *_, t, b, dn, occ = case(spark, 0.5)
    idle = spark.range(8, 5000).select(F.col("id").alias("donor"), *[F.lit(0).alias(c) for c in ("dx", "dy", "dz")])
    rows, cut = [], runtime.cut
    monkeypatch.setattr(runtime, "cut", lambda df: rows.append((o := cut(df)).count()) or o)
    K.place_donors(t, b, dn.unionByName(idle), occ, FRAME, 4)
    assert max(rows) < min(occ.count(), 4992)


@pytest.mark.parametrize("mm", [1.0, 2.0])
def test_band_across_tiles(spark, monkeypatch, mm):
    monkeypatch.setattr(runtime, "TILE_ROWS", 40)
    monkeypatch.setattr(runtime, "TILE_HELD", 20)
    r = np.random.default_rng(9)
    cells = [(int(x) - 3, int(y) + 29, int(z) - 4) for x, y, z in np.argwhere(r.random((9, 6, 42)) < 0.3)]
    own, ball = set(cells), C.stencil(mm)
    around = lambda s: {(x + i, y + j, z + k) for x, y, z in s for i, j, k in ball}
    out = around(own) - own
    want = out | (around(out) & own)
    v = spark.createDataFrame([(u, *c) for c in cells * 2 for u in ("a", "b", None)], "unit string, x int, y int, z int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        both = C.border_band(v, mm, side=None)
        got = [tuple(q) for q in both.collect()]
        right = [tuple(q) for q in C.border_band(v, mm).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == {(u, *c) for c in want for u in ("a", "b", None)}
    mid = sum(x for x, *_ in own) / len(own)
    assert len(right) == len(set(right)) and set(right) == {(u, *c) for c in want if c[0] > mid for u in "ab"}
    assert both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_columns_hold_their_cells(spark):
    cells = [(1, x, y, z) for x in (-2, 5) for y in (0, 3) for z in (-33, -32, -1, 0, 31, 32, 63)]
    packed = C.columns(spark.createDataFrame(cells + cells, "unit int, x int, y int, z int"))
    back = packed.select("unit", "x", "y", "_tz", F.explode(F.expr(C.BITS)).alias("b")).select("unit", "x", "y", (F.shiftleft("_tz", C.TZ) + F.col("b")).alias("z"))
    assert sorted(map(tuple, back.collect())) == sorted(cells) and C.columns(packed) is packed
