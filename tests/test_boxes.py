"""Suppression, fusion and matching: goldens, and both execution routes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope.operators import boxes as B

XY = ["x1", "z1", "x2", "z2"]


def iou(a, b):
    w = max(min(a[2], b[2]) - max(a[0], b[0]), 0)
    h = max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def random_boxes(n, seed, span=60, units=2):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x, z, w, h = r.integers(0, span), r.integers(0, span), r.integers(2, 30), r.integers(2, 30)
        out.append((int(r.integers(0, units)), 0, float(x), float(z), float(x + w), float(z + h), round(float(r.random()), 3)))
    # Copies of one box make a hot geometry.
    return out + [(0, 0, 5.0, 5.0, 20.0, 20.0, round(0.2 + 0.001 * i, 3)) for i in range(n // 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit int, slice_y int, x1 double, z1 double, x2 double, z2 double, score double")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return out


@pytest.mark.parametrize("thr,cap,cell_boxes", [(0.5, 100, 1024), (0.3, None, 5), (0.5, 4, 5), (0.0, None, 5)])
def test_nms(spark, cell_boxes, thr, cap, monkeypatch):
    monkeypatch.setattr(B.runtime, "CELL_BOXES", cell_boxes)
    rows = random_boxes(60, 1)
    want = set()
    for k, g in groups(rows).items():
        kept = []
        for b in sorted(g, key=lambda b: (-b[6], b[2:6])):
            if (cap is None or len(kept) < cap) and all(iou(b[2:6], c[2:6]) <= thr for c in kept):
                kept.append(b)
        want |= {(*k, *b[2:7]) for b in kept}
    got = {tuple(r) for r in B.nms(frame(spark, rows), thr, cap).collect()}
    assert got == want


def brute_wbf(rows, thr):
    out = []
    for k, g in groups(rows).items():
        cl = []
        for b in sorted(g, key=lambda b: (-b[6], b[2:6])):
            v = [iou(c["box"], b[2:6]) for c in cl]
            i = int(np.argmax(v)) if v else -1
            if i >= 0 and v[i] > thr:
                c = cl[i]
                c["m"].append(b)
                sw = sum(x[6] for x in c["m"])
                c["box"] = [sum(x[6] * x[2 + j] for x in c["m"]) / sw for j in range(4)]
            else:
                cl.append({"m": [b], "box": list(b[2:6])})
        out += [(*k, *c["box"], sum(x[6] for x in c["m"]) / len(c["m"]), len(c["m"])) for c in cl]
    return sorted(tuple(np.round(o, 6)) for o in out)


@pytest.mark.parametrize("thr,span,cell_boxes", [(0.4, 60, 5), (0.55, 200, 1024), (0.0, 300, 5), (0.999, 60, 1024), (1.0, 60, 5), (-0.5, 60, 5)])
def test_wbf(spark, cell_boxes, thr, span, monkeypatch):
    monkeypatch.setattr(B.runtime, "CELL_BOXES", cell_boxes)
    rows = random_boxes(40, 2, span)
    rows += rows[:10]  # copies of boxes and scores
    got = B.wbf(frame(spark, rows), 400, 400, thr).collect()
    assert sorted(tuple(np.round(tuple(r), 6)) for r in got) == brute_wbf(rows, thr)


def test_wbf_groups_that_meet_by_fusion(spark):
    """A third box overlaps no box of the pair by the threshold, but it does overlap their fused box."""
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 0, 0.0, 0.0, 10.0, 22.0, 0.89), (0, 0, 0.0, 0.0, 17.0, 16.0, 0.5), (None, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (None, 0, 0.0, 0.0, 10.0, 11.0, 0.9)]
    assert iou(rows[0][2:6], rows[1][2:6]) > 0.45 and iou(rows[0][2:6], rows[2][2:6]) < 0.45 and iou(rows[1][2:6], rows[2][2:6]) < 0.56
    for thr in (0.45, 0.3, 0.56):
        got = [r for r in B.wbf(frame(spark, rows), 200, 200, thr).collect() if r.unit == 0]
        assert sorted(tuple(np.round(tuple(r), 6)) for r in got) == brute_wbf(rows[:3], thr)
    none = B.wbf(frame(spark, rows).limit(0), 200, 200)
    assert none.count() == 0


def test_wbf_golden(spark):
    rows = [(0, 7, 10.0, 10.0, 30.0, 30.0, 0.6), (0, 7, 11.0, 11.0, 31.0, 31.0, 0.5), (0, 7, 9.0, 10.0, 29.0, 30.0, 0.7)]
    out = B.wbf(frame(spark, rows), 384, 384, 0.3).collect()
    assert len(out) == 1 and out[0].slice_y == 7 and out[0].score == pytest.approx(0.6)


def brute_tags(pred, gt, thr):
    out = []
    pg, gg = groups(pred), groups(gt)
    for k in set(pg) | set(gg):
        gs = sorted(g[2:6] for g in gg.get(k, []))
        taken = set()
        for p in sorted(pg.get(k, []), key=lambda b: (-b[6], b[2:6])):
            free = [(iou(p[2:6], g), -i) for i, g in enumerate(gs) if i not in taken]
            if free and max(free)[0] >= thr:
                i = -max(free)[1]
                taken.add(i)
                out.append((*k, "tp", *p[2:7], *gs[i]))
            else:
                out.append((*k, "fp", *p[2:7]))
        out += [(*k, "fn", *g) for i, g in enumerate(gs) if i not in taken]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_boxes", [1024, 5])
def test_tag_events(spark, cell_boxes, monkeypatch):
    monkeypatch.setattr(B.runtime, "CELL_BOXES", cell_boxes)
    pred, gt = random_boxes(30, 3), random_boxes(24, 4)
    got = []
    for r in B.tag_events(frame(spark, pred), frame(spark, gt), 0.3).collect():
        base = (r.unit, r.slice_y, r.tag, r.x1, r.z1, r.x2, r.z2)
        got.append((*base, r.score, *r.gt) if r.tag == "tp" else ((*base, r.score) if r.tag == "fp" else base))
    assert sorted(got, key=repr) == brute_tags(pred, gt, 0.3)


def test_tag_golden_and_one_sided_slices(spark):
    f = lambda rows: frame(spark, rows)
    pred = [(0, 0, 10.0, 10.0, 20.0, 20.0, 0.9), (0, 0, 60.0, 60.0, 70.0, 70.0, 0.8), (0, 1, 1.0, 1.0, 5.0, 5.0, 0.5)]
    gt = [(0, 0, 11.0, 10.0, 21.0, 20.0, 0.0), (0, 0, 40.0, 40.0, 50.0, 50.0, 0.0), (0, 2, 1.0, 1.0, 5.0, 5.0, 0.0)]
    n = {(r.slice_y, r.tag): r["count"] for r in B.tag_events(f(pred), f(gt)).groupBy("slice_y", "tag").count().collect()}
    assert n == {(0, "tp"): 1, (0, "fp"): 1, (0, "fn"): 1, (1, "fp"): 1, (2, "fn"): 1}


@pytest.mark.parametrize("tile", [4.0, 64.0])
def test_pairs_do_not_depend_on_the_tile(spark, tile):
    a, b = random_boxes(30, 5), random_boxes(30, 6)
    got = B.overlap_pairs(frame(spark, a), frame(spark, b), tile=tile).agg(F.sum(F.col("na") * F.col("nb")), F.sum(F.col("iou") * F.col("na") * F.col("nb"))).collect()[0]
    all_ = [iou(p[2:6], q[2:6]) for p in a for q in b if p[:2] == q[:2]]
    assert got[0] == sum(v > 0 for v in all_) and got[1] == pytest.approx(sum(all_))


def test_size_threshold_golden(spark):
    rows = [(0, 0, 0.0, 0.0, 20.0, 20.0, 0.06), (0, 0, 0.0, 0.0, 5.0, 5.0, 0.06)]
    assert [r.x2 for r in B.size_threshold(frame(spark, rows), 0.05, 0.30).collect()] == [20.0]


def test_rescore_passes_unknown_slices(spark):
    b = frame(spark, [(0, 10, 0.0, 0.0, 1.0, 1.0, 0.8), (0, 10, 0.0, 0.0, 2.0, 1.0, 0.6), (0, 12, 0.0, 0.0, 1.0, 1.0, 0.4), (0, 13, 0.0, 0.0, 1.0, 1.0, 0.9)])
    p = spark.createDataFrame([(0, 10, 0.5), (0, 12, 0.5)], "unit int, slice_y int, prob double")
    assert sorted(round(r.score, 6) for r in B.rescore(b, p).collect()) == [0.2, 0.3, 0.4, 0.9]


def test_topk_mean(spark):
    df = spark.createDataFrame([(0, s) for s in (0.1, 0.4, 0.9, 0.2, 0.7, 0.3)] + [(1, 0.1), (1, 0.2), (1, 0.3), (1, None)], "unit int, score double")
    out = {r.unit: (round(r.topk_mean, 6), r.k_used) for r in B.topk_mean(df, ["unit"], 3).collect()}
    assert out == {0: (round((0.9 + 0.7 + 0.4) / 3, 6), 3), 1: (0.2, 3)}


def test_dynamic_k_contested_candidate_goes_to_cheapest_of_all(spark):
    rows = [(0, 0, 1, 1, 0.9, 0.2), (0, 0, 2, 1, 0.9, 0.3), (0, 0, 3, 1, 0.9, 0.1), (0, 0, 3, 2, 0.9, 0.05)]
    df = spark.createDataFrame(rows, "unit int, slice_y int, gt int, cand int, iou double, cost double")
    out = {(r.cand, r.gt) for r in B.dynamic_k_assign(df).collect()}
    assert out == {(1, 3), (2, 3)}


def test_nms_extremes_and_null_keys(spark):
    rows = [(None, 1, 0, 0, 10, 10, 0.9), (None, 1, 0, 0, 10, 10, 0.5), (None, 1, 1, 1, 11, 11, 0.8), (1, 1, 5, 5, 5, 9, 0.7), (1, 1, 5, 5, 5, 9, 0.6), (1, 1, 0, 0, 4, 4, 0.4)]
    b = spark.createDataFrame(rows, "unit long, slice_y int, x1 int, z1 int, x2 int, z2 int, score double")
    got = sorted((r.unit or 0, r.score) for r in B.nms(b, 0.5).collect())
    assert got == [(0, 0.9), (1, 0.4), (1, 0.6), (1, 0.7)]
    assert B.nms(b, 1.0).count() == 6
    assert sorted(r.score for r in B.nms(b, 0.0, closed=True).collect()) == [0.7, 0.9]
    assert sorted(r.score for r in B.nms(b, 0.5, max_per=1).collect()) == [0.7, 0.9]


def test_suppression_reaches_any_size(spark):
    """With a threshold of 0 a box far larger than another still suppresses it."""
    b = frame(spark, [(0, 0, 0.0, 0.0, 20000.0, 20000.0, 0.9), (0, 0, 10.0, 10.0, 11.0, 11.0, 0.8), (0, 0, 30000.0, 0.0, 30001.0, 1.0, 0.7)])
    assert sorted(r.score for r in B.nms(b, 0.0).collect()) == [0.7, 0.9]


@pytest.mark.parametrize("limit", [4, 64, 10_000])
def test_pair_join_on_a_crowded_spot(spark, limit):
    """Small boxes in one cell, large ones that no smaller cell could part, NULL keys and boxes without area."""
    r = np.random.default_rng(7)
    rows = []
    for k in range(240):
        x, z = (r.random(2) * (4 if k % 3 else 400)).round(3)
        w, h = (r.random(2) * (0.3 if k % 3 else 30)).round(3)
        rows.append((None if k % 5 == 0 else 1, 0, float(x), float(z), float(x + w), float(z + (h if k % 40 else 0)), 0.5))
    rows += [(1, 0, 0.0, 0.0, 300.0 + k, 300.0, 0.5) for k in range(60)]
    a, b = rows[::2], rows[1::2]
    meets = lambda p, q: min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]) and p[4] > p[2] and p[5] > p[3]
    want = sorted((p[0] or 0, p[2:6], q[2:6]) for p in a for q in b if p[:2] == q[:2] and meets(p, q) and q[5] > q[3])
    got = B.overlap_pairs(frame(spark, a), frame(spark, b), limit=limit).collect()
    assert sorted((g.unit or 0, tuple(g.a), tuple(g.b)) for g in got for _ in range(g.na * g.nb)) == want


def test_pair_join_deals_a_crowded_spot_evenly(spark):
    """A third of all boxes in one cell: no leaf holds more than a few times the limit."""
    n = 30_000
    spot = spark.range(n).selectExpr("1 as unit", "0 as slice_y", "if(id % 3 = 0, 0.001, 1) as s", "cast(id as double) as i", "cast(id % 2 as int) as _side")
    rows = spot.selectExpr("unit", "slice_y", "i % 173 * 30 * s as x1", "floor(i / 173) * 30 * s as z1", "(i % 173 * 30 + 40) * s as x2", "(floor(i / 173) * 30 + 40) * s as z2", "_side")
    leaves = B._dealt(B.runtime.cut(rows), ["unit", "slice_y"], 64.0, 256)
    sizes = leaves.groupBy("_lv", "_cx", "_cz", "_sh").count()
    assert sizes.agg(F.max("count")).first()[0] <= 256 and leaves.count() < 12 * n


def test_matching_with_null_keys(spark):
    p = spark.createDataFrame([(None, 0, 0, 10, 10, 0.9), (None, 0, 0, 9, 10, 0.8), (1, 0, 0, 2, 2, 0.5)], "unit long, x1 int, z1 int, x2 int, z2 int, score double")
    g = spark.createDataFrame([(None, 0, 0, 10, 10), (1, 50, 50, 60, 60)], "unit long, x1 int, z1 int, x2 int, z2 int")
    for thr in (0.0, 0.3):
        got = sorted((r.unit or 0, r.tag) for r in B.tag_events(p, g, thr, ["unit"]).collect())
        assert got == [(0, "fp"), (0, "tp"), (1, "fn"), (1, "fp")]


def fold_wbf(boxes, thr):
    """Fused boxes (x1, z1, x2, z2, score, n), with running sums as the check SQL has them."""
    cl = []
    for *b, s in boxes:
        v = [iou(c[0], b) for c in cl]
        if v and max(v) > thr:
            c = cl[v.index(max(v))]
            c[1:] = [c[1] + s, [w + s * x for w, x in zip(c[2], b)], c[3] + 1]
            c[0] = [w / c[1] for w in c[2]]
        else:
            cl.append([b, s, [s * x for x in b], 1])
    return [(*c[0], c[1] / c[3], c[3]) for c in cl]


def test_wbf_places_at_the_threshold(spark):
    """Equal boxes sum up to a fused box an ulp off, which decides where another box overlaps by exactly the threshold."""
    x, z = 26.341796875, 0.1484375
    big, small = (x, z, x + 20 / 1024, z + 21 / 1024), (x, z, x + 12 / 1024, z + 14 / 1024)
    r = np.random.default_rng(3)
    piles = [((u, 0), sorted(r.uniform(0.5, 1, 2), reverse=True)) for u in range(60)] + [((u, 1), [r.uniform(0.5, 1)] * 3) for u in range(60)]
    slices = {k: [(*big, float(s)) for s in scores] + [(*small, 0.0131)] for k, scores in piles}
    want = sorted(tuple(np.round((*k, *o), 6)) for k, boxes in slices.items() for o in fold_wbf(boxes, 0.4))
    rows = [(*k, *b) for k, boxes in slices.items() for b in boxes]
    assert sorted(tuple(np.round(tuple(r), 6)) for r in B.wbf(frame(spark, rows), 400, 400, 0.4).collect()) == want
    assert all(max(w[-1] for w in want if w[1] == s) > n for s, n in ((0, 2), (1, 3)))
