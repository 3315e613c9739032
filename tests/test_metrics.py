"""Hand-computed values and algebraic properties of the metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope.functions import hashing as H
from foldscope.operators import metrics as M


def pairs(spark, rows):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(rows)], "unit long, score double, label int")


def one(df):
    return df.collect()[0][0]


def brute_auroc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


@pytest.mark.parametrize("limit", [None, 5])
def test_auroc_ap(spark, limit):
    r = np.random.default_rng(3)
    rows = [(round(float(r.random()), 1), int(r.random() < 0.4)) for _ in range(80)]
    df = pairs(spark, rows)
    assert one(M.auroc(df, limit=limit)) == pytest.approx(brute_auroc(rows))
    neg = pairs(spark, [(-s, y) for s, y in rows])
    assert one(M.auroc(neg)) == pytest.approx(1 - brute_auroc(rows))
    assert one(M.cliffs_delta(df)) == pytest.approx(2 * brute_auroc(rows) - 1)


def test_single_class_and_empty(spark):
    assert one(M.auroc(pairs(spark, [(0.5, 1), (0.2, 1)]))) is None
    assert one(M.average_precision(pairs(spark, [(0.5, 0)]))) is None
    assert one(M.average_precision(pairs(spark, [(0.5, 1), (0.5, 0)]))) == 0.5
    assert one(M.brier(pairs(spark, []))) is None
    assert [tuple(r) for r in M.slice_metrics(pairs(spark, [(0.5, 1)]).withColumn("epoch", F.lit(0))).collect()] == [(0, 0.0, 0.0)]


def test_calibration_goldens(spark):
    assert one(M.brier(pairs(spark, [(1.0, 0), (0.0, 1)] * 5))) == 1.0
    assert one(M.ece(pairs(spark, [(0.05, 0)] * 10 + [(0.95, 1)] * 10))) == pytest.approx(0.05)
    assert one(M.ece(pairs(spark, [(0.95, 0)] * 20))) == pytest.approx(0.95)
    assert one(M.ece(pairs(spark, [(0.95, 0), (1.5, 0)]))) == pytest.approx(0.475)
    rel = M.reliability(pairs(spark, [(0.5, 1), (0.5, 0)])).collect()
    assert len(rel) == 10 and sum(r.cnt == 0 for r in rel) == 9 and max(r.cnt for r in rel) == 2


def test_froc_orders_ties_by_unit(spark):
    df = pairs(spark, [(0.9, 1), (0.5, 0), (0.5, 1), (0.5, 0), (0.1, 1)])
    s = {r.fp_target: r.sens for r in M.sens_at_fp(M.froc_curve(df), [0.0, 0.2, 0.4, 1.0]).collect()}
    assert s == pytest.approx({0.0: 1 / 3, 0.2: 2 / 3, 0.4: 1.0, 1.0: 1.0})
    g = {r.fp_target: r.sens for r in M.sens_at_fp(M.froc_curve(df, group_ties=True), [0.0, 0.2, 0.4]).collect()}
    assert g == pytest.approx({0.0: 1 / 3, 0.2: 1 / 3, 0.4: 1.0})


def test_bootstrap_mean(spark):
    df = pairs(spark, [(i, 0) for i in range(100)])
    ci = M.bootstrap_ci(df, ["unit"], "mean", n_boot=200).collect()[0]
    assert ci.ci_lower < 49.5 < ci.ci_upper
    a = M.bootstrap_ci(df.repartition(1), ["unit"], "mean", n_boot=50).collect()
    b = M.bootstrap_ci(df.repartition(8), ["unit"], "mean", n_boot=50, limit=10).collect()
    assert a == b
    p = M.bootstrap_ci(df, ["unit"], "mean", n_boot=200, method="poisson").collect()[0]
    assert p.ci_lower < 49.5 < p.ci_upper


def test_resample_draws_as_many_as_units(spark):
    df = pairs(spark, [(0.1 * i, i % 2) for i in range(30)])
    n = M.resample(df, ["unit"], 20).groupBy("_b").agg(F.sum("_wt").alias("n")).collect()
    assert len(n) == 20 and all(r.n == 30 for r in n)


def test_size_strata(spark):
    calls = spark.createDataFrame([("a", "tp", 50.0), ("b", "fn", 50.0), ("c", "tp", 500.0), ("d", "fn", 2000.0), ("e", "fp", 90.0)], "call_id string, call_type string, volume_mm3 double")
    out = {r.stratum_value: (r.value, r.n_lesions) for r in M.size_strata(calls, n_boot=20).collect()}
    assert out == {"<=200mm3": (0.5, 2), "200-1000mm3": (1.0, 1), "1000-5000mm3": (0.0, 1), ">5000mm3": (None, 0)}
    ten = spark.createDataFrame([(str(i), "tp" if i < 8 else "fn", 50.0) for i in range(10)], "call_id string, call_type string, volume_mm3 double")
    r = M.size_strata(ten, n_boot=200).filter("n_lesions > 0").collect()[0]
    assert r.ci_lower <= 0.8 <= r.ci_upper and r.ci_upper - r.ci_lower > 0.1


def test_grid_search_finds_the_separating_cell(spark):
    tops = [(i, 1, 0, 0.51 + 0.01 * i, None) for i in range(4)] + [(10 + i, 0, 1, None, 0.61 + 0.01 * i) for i in range(4)]
    df = spark.createDataFrame(tops, "unit long, label int, fold int, large_max float, small_max float")
    grid = M.grid_search(df, [0.3, 0.5, 0.7], [0.3, 0.5, 0.7], 0.1)
    assert grid.count() == 9
    best = M.best_cell(grid).collect()[0]
    assert best.large_thr < 0.7 and best.small_thr >= 0.7 and best.sens == 1.0


@pytest.mark.parametrize("fp,limit", [(0.0, None), (0.05, 3), (0.2, None), (0.45, 3), (2.0, None)])
def test_grid_search_sweeps_ties_unit_by_unit(spark, fp, limit, monkeypatch):
    """Coarse scores make ties at every target; the curve is swept by descending score, then ascending unit."""
    monkeypatch.setattr(M, "CELLS_AT_ONCE", 4)
    r = np.random.default_rng(3)
    pick = lambda: None if r.random() < 0.3 else float(np.float32(round(r.random() * 6) / 10))
    tops = [(int(u), int(r.random() < 0.4), None if u % 7 == 0 else int(u % 2), pick(), pick()) for u in r.permutation(90)]
    larges, smalls = [0.1, 0.25, 0.5], [0.0, 0.3]
    df = spark.createDataFrame(tops, "unit long, label int, fold int, large_max float, small_max float").repartition(3)
    got = {(g.fold, g.large_thr, g.small_thr): g.sens for g in M.grid_search(df, larges, smalls, fp, by=["fold"], limit=limit).collect()}
    for fold in (None, 0, 1):
        mine = [t for t in tops if t[2] == fold]
        p = sum(t[1] for t in mine)
        for lt in larges:
            for st in smalls:
                alive = lambda v, thr: v is not None and v >= np.float32(thr)
                score = lambda t: max([0.0, *[v for v, thr in ((t[3], lt), (t[4], st)) if alive(v, thr)]])
                best = tp = fps = 0
                for t in sorted(mine, key=lambda t: (-score(t), t[0])):
                    tp, fps = tp + t[1], fps + 1 - t[1]
                    if fps / len(mine) <= fp:
                        best = tp
                assert got[fold, lt, st] == pytest.approx(best / p), (fold, lt, st)
    assert len(got) == 18
    alone = M.grid_search(df.filter("label = 0"), larges, smalls, fp).collect()
    assert [g.sens for g in alone] == [None] * 6


def test_leave_one_out_never_sees_its_own_fold(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "unit int, fold int")
    out = M.leave_one_out(df, 5)
    assert out.filter("fold = tune_fold").isEmpty() and out.count() == 200
    assert M.leave_one_out(df.filter("fold = 0"), 1).count() == 10


def test_ensemble_threshold(spark):
    df = spark.createDataFrame([(0.04, 0.2), (0.06, 0.3), (0.08, 0.4)], "large_thr double, small_thr double")
    assert tuple(M.ensemble_threshold(df).collect()[0]) == pytest.approx((0.06, 0.30))
    assert tuple(M.ensemble_threshold(df.limit(0)).collect()[0]) == (0.05, 0.30)


def test_strata_partition_the_units(spark):
    df = spark.createDataFrame([(i, "Artist" if i < 12 else "Explorer", 1.5 if i < 12 else 3.6) for i in range(20)], "unit int, model string, mm double")
    s = M.expand_strata(df, {"model": F.col("model"), "bin": F.when(F.col("mm") <= 2, "<=2mm").otherwise(">2mm")})
    n = {(r.stratum_kind, r.stratum_value): r["count"] for r in s.groupBy("stratum_kind", "stratum_value").count().collect()}
    assert n == {("model", "Artist"): 12, ("model", "Explorer"): 8, ("bin", "<=2mm"): 12, ("bin", ">2mm"): 8}


def test_mean_roc_matches_interp(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, round(float(r.random()), 2), int(r.random() < 0.5)) for i in range(90)]
    df = spark.createDataFrame(rows, "unit int, fold int, score double, label int")
    got = [x.mean_tpr for x in M.mean_roc(df).orderBy("k").collect()]
    ys = []
    for f in range(3):
        sub = [(s, y) for _, g, s, y in rows if g == f]
        p, n = sum(y for _, y in sub), sum(1 - y for _, y in sub)
        ts = sorted({s for s, _ in sub}, reverse=True)
        fx = [0] + [sum(1 - y for s, y in sub if s >= t) * 100 for t in ts]
        ty = [0.0] + [sum(y for s, y in sub if s >= t) / p for t in ts]
        y = np.interp(np.arange(101) * n, fx, ty)
        y[0] = 0.0
        ys.append(y)
    assert got == pytest.approx(np.mean(ys, axis=0))


def test_seeds(spark):
    def want(*parts):
        h = 0xCBF29CE484222325
        for p in parts:
            h = ((h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h & 0x7FFFFFFF

    r = spark.range(1).select(H.fold_seed(42, 7).alias("a"), H.fold_seed(5000000000, 3, -1).alias("b")).collect()[0]
    assert (r.a, r.b) == (want(42, 7), want(5000000000, 3, -1))


def test_coarse_metrics(spark):
    r = np.random.default_rng(9)
    rows = [(round(float(r.random()), 2), int(r.random() < 0.3)) for _ in range(60)]
    neg, pos = [s for s, y in rows if not y], np.array([s for s, y in rows if y])
    thr = np.quantile(neg, 1 - 2 / len(neg))
    out = M.coarse_metrics(pairs(spark, rows)).collect()[0]
    assert out.auroc == pytest.approx(brute_auroc(rows)) and out.sens_at_2fp == pytest.approx((pos >= thr).mean())
    none = M.coarse_metrics(pairs(spark, [(0.4, 1)])).collect()[0]
    assert none.auroc is None and none.sens_at_2fp is None
