"""Evaluation metrics, resampling and reports on the bound unit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldscope.operators import metrics as M
from foldscope.plans.bindings import bound, with_
from foldscope.plans.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
PTS = [0.005, 0.01, 0.05, 0.1, 0.25, 0.5]
PTS_SQL = "(VALUES " + ", ".join(f"(CAST({p} AS DOUBLE))" for p in PTS) + ") t(fp_target)"
EDGES_SQL = "[" + ", ".join(f"{e!r}e0" for e in M.bin_edges(10)[1:-1]) + "]"
BIN_SQL = f"CASE WHEN score >= 0 AND score <= 1 THEN len(list_filter({EDGES_SQL}, lambda e: score >= e)) END"


def curve_sql(src: str, by: str, w: str = "1", unit: str = "") -> str:
    """Collapsed score table with running totals, for group columns ``by``."""
    u = f", {unit}" if unit else ""
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""cells AS (SELECT {g}score{u}, sum({w}*label) AS pos, sum({w}*(1-label)) AS neg FROM {src} GROUP BY {g}score{u}),
    curve AS (SELECT *, sum(pos) OVER (win ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (win ROWS UNBOUNDED PRECEDING) AS fp,
      sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM cells WINDOW win AS ({part} ORDER BY score DESC{u}))"""


AUROC_SQL = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CAST(pos AS DOUBLE) * ((n - fp) + neg / 2e0)) / (CAST(max(p) AS DOUBLE) * max(n)) END"
AP_SQL = "CASE WHEN max(p) > 0 THEN sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(p) END"


@query("m1_auroc", f"{with_('units')}, {curve_sql('units', 'fold')} SELECT fold, round({AUROC_SQL}, 6) AS auroc FROM curve GROUP BY fold")
def _(spark, d):
    return M.auroc(bound(spark, d, "units"), by=["fold"]).select("fold", r6("auroc"))


@query("m1_auroc_pooled", f"{with_('units')}, {curve_sql('units', '')} SELECT round({AUROC_SQL}, 6) AS auroc FROM curve")
def _(spark, d):
    return M.auroc(bound(spark, d, "units")).select(r6("auroc"))


@query("m2_average_precision", f"{with_('units')}, {curve_sql('units', 'fold')} SELECT fold, round({AP_SQL}, 6) AS ap FROM curve GROUP BY fold")
def _(spark, d):
    return M.average_precision(bound(spark, d, "units"), by=["fold"]).select("fold", r6("ap"))


@query("m3_roc_curve", f"""{with_('units')}, {curve_sql('units', 'fold')}
SELECT fold, round(score, 6) AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM curve""")
def _(spark, d):
    c = M.roc_curve(bound(spark, d, "units"), by=["fold"])
    return c.select("fold", r6("threshold"), r6("fpr"), r6("tpr"))


@query("m4_mean_roc", f"""{with_('units')}, {curve_sql('units', 'fold')},
pts AS (SELECT fold, fp * 100 AS fx, n, tp / CAST(p AS DOUBLE) AS tpr FROM curve UNION ALL SELECT DISTINCT fold, 0, n, 0 FROM curve),
g AS (SELECT f.fold, k, f.n FROM (SELECT DISTINCT fold, n FROM curve) f, range(101) r(k)),
lo AS (SELECT g.fold, g.k, arg_max(fx, fx + tpr * 1e-3) AS fx, max(tpr) AS tpr FROM g JOIN pts ON g.fold = pts.fold AND fx <= k * g.n GROUP BY 1, 2),
hi AS (SELECT g.fold, g.k, min(fx) AS fx, min(tpr) AS tpr FROM g JOIN pts ON g.fold = pts.fold AND fx > k * g.n GROUP BY 1, 2),
y AS (SELECT g.fold, g.k, CASE WHEN g.k = 0 THEN 0 WHEN hi.fx IS NULL OR lo.fx = g.k * g.n THEN lo.tpr
      ELSE lo.tpr + (hi.tpr - lo.tpr) * (g.k * g.n - lo.fx) / (hi.fx - lo.fx) END AS y
      FROM g JOIN lo ON lo.fold = g.fold AND lo.k = g.k LEFT JOIN hi ON hi.fold = g.fold AND hi.k = g.k)
SELECT CAST(k AS INT) AS k, round(avg(y), 6) AS mean_tpr, round(min(y), 6) AS min_tpr, round(max(y), 6) AS max_tpr FROM y GROUP BY k""")
def _(spark, d):
    return M.mean_roc(bound(spark, d, "units")).select("k", r6("mean_tpr"), r6("min_tpr"), r6("max_tpr"))


@query("a11_coarse_metrics", f"""{with_('units')}, {curve_sql('units', 'fold')}, au AS (SELECT fold, {AUROC_SQL} AS auroc FROM curve GROUP BY fold),
neg AS (SELECT fold, score, row_number() OVER (PARTITION BY fold ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY fold) AS n FROM units WHERE label = 0),
q AS (SELECT *, greatest(0, 1 - 2e0 / n) * (n - 1) AS pos FROM neg),
thr AS (SELECT fold, max(CASE WHEN r = floor(pos) THEN score END) AS lo, max(CASE WHEN r = ceil(pos) THEN score END) AS hi, max(pos - floor(pos)) AS f FROM q GROUP BY fold)
SELECT u.fold, round(max(au.auroc), 6) AS auroc, round(avg(CASE WHEN label = 1 THEN CASE WHEN u.score >= lo + (hi - lo) * f THEN 1e0 ELSE 0e0 END END), 6) AS sens_at_2fp
FROM units u JOIN thr USING (fold) JOIN au USING (fold) GROUP BY u.fold""")
def _(spark, d):
    return M.coarse_metrics(bound(spark, d, "units"), by=["fold"]).select("fold", r6("auroc"), r6("sens_at_2fp"))


FROC_SQL = f"""{with_('units')}, {curve_sql('units', 'fold', unit='unit')},
froc AS (SELECT fold, score, unit, fp / CAST(p + n AS DOUBLE) AS fp_per_unit, tp / CAST(p AS DOUBLE) AS sens FROM curve)"""


@query("m5_froc_curve", f"{FROC_SQL} SELECT fold, unit, round(fp_per_unit, 6) AS fp_per_unit, round(sens, 6) AS sens FROM froc")
def _(spark, d):
    return M.froc_curve(bound(spark, d, "units"), by=["fold"]).select("fold", "unit", r6("fp_per_unit"), r6("sens"))


SENS_SQL = f"""sens AS (SELECT fold, fp_target, coalesce(max(CASE WHEN fp_per_unit <= fp_target THEN sens END), 0) AS sens
FROM froc, {PTS_SQL} GROUP BY fold, fp_target)"""


@query("m6_sens_at_fp", f"{FROC_SQL}, {SENS_SQL} SELECT fold, fp_target, round(sens, 6) AS sens FROM sens")
def _(spark, d):
    c = M.froc_curve(bound(spark, d, "units"), by=["fold"])
    return M.sens_at_fp(c, PTS, ["fold"]).select("fold", "fp_target", r6("sens"))


@query("m8_cpm", f"{FROC_SQL}, {SENS_SQL} SELECT fold, round(avg(sens), 6) AS cpm FROM sens GROUP BY fold")
def _(spark, d):
    return M.cpm(M.froc_curve(bound(spark, d, "units"), by=["fold"]), PTS, ["fold"]).select("fold", r6("cpm"))


@query("m9_brier", f"{with_('units')} SELECT fold, round(avg((score - label) * (score - label)), 6) AS brier FROM units GROUP BY fold")
def _(spark, d):
    return M.brier(bound(spark, d, "units"), by=["fold"]).select("fold", r6("brier"))


@query("m10_ece", f"""{with_('units')}, b AS (SELECT fold, {BIN_SQL} AS bin, count(*) AS c, sum(score) AS s, sum(label) AS y FROM units GROUP BY 1, 2)
SELECT fold, round(sum(CASE WHEN bin IS NOT NULL THEN abs(s - y) ELSE 0 END) / sum(c), 6) AS ece FROM b GROUP BY fold""")
def _(spark, d):
    return M.ece(bound(spark, d, "units"), by=["fold"]).select("fold", r6("ece"))


@query("m11_reliability", f"""{with_('units')}, b AS (SELECT {BIN_SQL} AS bin, count(*) AS c, avg(score) AS s, avg(label) AS y FROM units GROUP BY 1)
SELECT CAST(k AS INT) AS bin, coalesce(c, 0) AS cnt, round(s, 6) AS mean_score, round(y, 6) AS frac_pos FROM range(10) r(k) LEFT JOIN b ON b.bin = k""")
def _(spark, d):
    return M.reliability(bound(spark, d, "units")).select("bin", "cnt", r6("mean_score"), r6("frac_pos"))


NULL_FROC_SQL = FROC_SQL.replace(with_("units"), with_("units_folds")).replace("FROM units ", "FROM units_folds ")


@query("m6_sens_at_fp_null_group", f"{NULL_FROC_SQL}, {SENS_SQL} SELECT fold, fp_target, round(sens, 6) AS sens FROM sens")
def _(spark, d):
    c = M.froc_curve(bound(spark, d, "units_folds"), by=["fold"])
    return M.sens_at_fp(c, PTS, ["fold"]).select("fold", "fp_target", r6("sens"))


@query("m11_reliability_null_group", f"""{with_('units_folds')}, b AS (SELECT fold, {BIN_SQL} AS bin, count(*) AS c, avg(score) AS s, avg(label) AS y FROM units_folds GROUP BY 1, 2),
g AS (SELECT DISTINCT fold, k FROM b, range(10) r(k) WHERE bin IS NOT NULL)
SELECT g.fold, CAST(k AS INT) AS bin, coalesce(c, 0) AS cnt, round(s, 6) AS mean_score, round(y, 6) AS frac_pos FROM g LEFT JOIN b ON b.bin = k AND b.fold IS NOT DISTINCT FROM g.fold""")
def _(spark, d):
    return M.reliability(bound(spark, d, "units_folds"), by=["fold"]).select("fold", "bin", "cnt", r6("mean_score"), r6("frac_pos"))


@query("m25_ks_null_group", f"{with_('units_folds')}, {curve_sql('units_folds', 'fold')} SELECT fold, round(max(abs(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE))), 6) AS ks FROM curve GROUP BY fold")
def _(spark, d):
    return M.ks_2samp(bound(spark, d, "units_folds"), by=["fold"]).select("fold", r6("ks"))


def boot_sql(n_boot: int, body: str, src: str = "units_small") -> str:
    return f"""{with_(src)}, idx AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n0 FROM {src}),
    draws AS (SELECT b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 15))::BIGINT % n0 AS i FROM idx, range({n_boot}) r(b)),
    rep AS (SELECT b, wt, {src}.* FROM (SELECT b, i, count(*) AS wt FROM draws GROUP BY b, i) d JOIN idx {src} ON {src}.i = d.i), {body}"""


CI = "round(quantile_cont(s, 0.025), 6) AS ci_lower, round(quantile_cont(s, 0.975), 6) AS ci_upper"


@query("m12_bootstrap_auroc", boot_sql(1000, f"{curve_sql('rep', 'b', 'wt')}, st AS (SELECT b, {AUROC_SQL} AS s FROM curve GROUP BY b) SELECT {CI} FROM st"))
def _(spark, d):
    return M.bootstrap_ci(bound(spark, d, "units_small"), ["unit"], "auroc", n_boot=1000).select(r6("ci_lower"), r6("ci_upper"))


@query("m12_bootstrap_ap", boot_sql(1000, f"{curve_sql('rep', 'b', 'wt')}, st AS (SELECT b, {AP_SQL} AS s FROM curve GROUP BY b) SELECT {CI} FROM st"))
def _(spark, d):
    return M.bootstrap_ci(bound(spark, d, "units_small"), ["unit"], "ap", n_boot=1000).select(r6("ci_lower"), r6("ci_upper"))


@query("m12_bootstrap_brier", boot_sql(1000, f"st AS (SELECT b, sum(wt * (score - label) * (score - label)) / sum(wt) AS s FROM rep GROUP BY b) SELECT {CI} FROM st"))
def _(spark, d):
    return M.bootstrap_ci(bound(spark, d, "units_small"), ["unit"], "brier", n_boot=1000).select(r6("ci_lower"), r6("ci_upper"))


@query("m12_bootstrap_ece", boot_sql(1000, f"""bn AS (SELECT b, {BIN_SQL} AS bin, sum(wt) AS c, sum(wt * score) AS ss, sum(wt * label) AS y FROM rep GROUP BY 1, 2),
st AS (SELECT b, sum(CASE WHEN bin IS NOT NULL THEN abs(ss - y) ELSE 0 END) / sum(c) AS s FROM bn GROUP BY b) SELECT {CI} FROM st"""))
def _(spark, d):
    return M.bootstrap_ci(bound(spark, d, "units_small"), ["unit"], "ece", n_boot=1000).select(r6("ci_lower"), r6("ci_upper"))


@query("m12_bootstrap_by_stratum", f"""{with_('units_small')}, idx AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n0 FROM units_small),
draws AS (SELECT lang, b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 15))::BIGINT % n0 AS i FROM idx, range(1000) r(b)),
rep AS (SELECT d.lang, b, x.score FROM draws d JOIN idx x ON x.lang = d.lang AND x.i = d.i), st AS (SELECT lang, b, avg(score) AS s FROM rep GROUP BY 1, 2)
SELECT lang, {CI} FROM st GROUP BY lang""")
def _(spark, d):
    ci = M.bootstrap_ci(bound(spark, d, "units_small"), ["unit"], "mean", n_boot=1000, by=["lang"])
    return ci.select("lang", r6("ci_lower"), r6("ci_upper"))


@query("m12_bootstrap_null_group", f"""{with_('units_small')}, s AS (SELECT unit, score, nullif(lang, 'en') AS lang FROM units_small),
idx AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n0 FROM s),
draws AS (SELECT lang, b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 15))::BIGINT % n0 AS i FROM idx, range(1000) r(b)),
rep AS (SELECT d.lang, b, x.score FROM draws d JOIN idx x ON x.lang IS NOT DISTINCT FROM d.lang AND x.i = d.i), st AS (SELECT lang, b, avg(score) AS s FROM rep GROUP BY 1, 2)
SELECT lang, {CI} FROM st GROUP BY lang""")
def _(spark, d):
    u = bound(spark, d, "units_small").withColumn("lang", F.nullif("lang", F.lit("en")))
    return M.bootstrap_ci(u, ["unit"], "mean", n_boot=1000, by=["lang"]).select("lang", r6("ci_lower"), r6("ci_upper"))


@query("m13_bootstrap_froc", boot_sql(1000, f"""{curve_sql('rep', 'b', 'wt', 'unit')},
froc AS (SELECT b, fp / CAST(p + n AS DOUBLE) AS fp_per_unit, tp / CAST(p AS DOUBLE) AS sens FROM curve),
st AS (SELECT b, fp_target, coalesce(max(CASE WHEN fp_per_unit <= fp_target THEN sens END), 0) AS s FROM froc, {PTS_SQL} GROUP BY 1, 2)
SELECT fp_target, {CI} FROM st GROUP BY fp_target"""))
def _(spark, d):
    return M.bootstrap_froc(bound(spark, d, "units_small"), targets=PTS, n_boot=1000).select("fp_target", r6("ci_lower"), r6("ci_upper"))


def battery_sql(src: str, by: str) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""{curve_sql(src, by, unit='unit').replace('cells', 'ucells').replace('curve', 'ucurve')},
    {curve_sql(src, by)}, bn AS (SELECT {g}{BIN_SQL} AS bin, count(*) AS c, sum(score) AS s, sum(label) AS y FROM {src} GROUP BY {g}bin),
    rows_ AS (SELECT {g}'auroc' AS metric, {AUROC_SQL} AS value FROM curve {grp}
    UNION ALL SELECT {g}'ap', {AP_SQL} FROM curve {grp}
    UNION ALL SELECT {g}'brier', avg((score - label) * (score - label)) FROM {src} {grp}
    UNION ALL SELECT {g}'ece', sum(CASE WHEN bin IS NOT NULL THEN abs(s - y) ELSE 0 END) / sum(c) FROM bn {grp}
    UNION ALL SELECT {g}'sens@' || printf('%.3f', fp_target) || 'fp', CASE WHEN max(p) > 0 THEN coalesce(max(CASE WHEN fp / CAST(p + n AS DOUBLE) <= fp_target THEN tp / CAST(p AS DOUBLE) END), 0) END
      FROM ucurve, {PTS_SQL} GROUP BY {g}fp_target)"""


@query("m15_unit_metrics", f"{with_('units')}, {battery_sql('units', 'fold')} SELECT fold, metric, round(value, 6) AS value FROM rows_")
def _(spark, d):
    return M.unit_metrics(bound(spark, d, "units"), by=["fold"], targets=PTS).select("fold", "metric", r6("value"))


CI_PTS = "(VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) t(fp_target)"


@query("m15_unit_metrics_ci", boot_sql(1000, f"""{curve_sql('rep', 'b', 'wt')}, {curve_sql('rep', 'b', 'wt', 'unit').replace('cells', 'ucells').replace('curve', 'ucurve')},
bn AS (SELECT b, {BIN_SQL} AS bin, sum(wt) AS c, sum(wt * score) AS ss, sum(wt * label) AS y FROM rep GROUP BY 1, 2),
st AS (SELECT b, 'auroc' AS metric, {AUROC_SQL} AS s FROM curve GROUP BY b UNION ALL SELECT b, 'ap', {AP_SQL} FROM curve GROUP BY b
UNION ALL SELECT b, 'brier', sum(wt * (score - label) * (score - label)) / sum(wt) FROM rep GROUP BY b
UNION ALL SELECT b, 'ece', sum(CASE WHEN bin IS NOT NULL THEN abs(ss - y) ELSE 0 END) / sum(c) FROM bn GROUP BY b
UNION ALL SELECT b, 'sens@' || printf('%.3f', fp_target) || 'fp', coalesce(max(CASE WHEN fp / CAST(p + n AS DOUBLE) <= fp_target THEN tp / CAST(p AS DOUBLE) END), 0) FROM ucurve, {CI_PTS} GROUP BY b, fp_target)
SELECT metric, {CI} FROM st GROUP BY metric"""))
def _(spark, d):
    m = M.unit_metrics(bound(spark, d, "units_small"), targets=[0.1, 0.5], n_boot=1000)
    return m.select("metric", r6("ci_lower"), r6("ci_upper"))


STRATA_SQL = """strata AS (SELECT unit, score, label, 'priority' AS stratum_kind, priority AS stratum_value FROM units
UNION ALL SELECT unit, score, label, 'price_bin', CASE WHEN price <= 150000 THEN '<=150k' ELSE '>150k' END FROM units)"""


@query("m16_stratified_metrics", f"{with_('units')}, {STRATA_SQL}, {battery_sql('strata', 'stratum_kind, stratum_value')} SELECT stratum_kind, stratum_value, metric, round(value, 6) AS value FROM rows_")
def _(spark, d):
    kinds = {"priority": F.col("priority"), "price_bin": F.when(F.col("price") <= 150000, "<=150k").otherwise(">150k")}
    m = M.stratified_metrics(bound(spark, d, "units"), kinds, targets=PTS)
    return m.select("stratum_kind", "stratum_value", "metric", r6("value"))


LARGES, SMALLS = [0.01, 0.03, 0.05, 0.10], [0.10, 0.20, 0.30, 0.40, 0.50]
GRID_VALUES = ", ".join(f"({i * len(SMALLS) + j}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, a in enumerate(LARGES) for j, b in enumerate(SMALLS))
# One unit per (supplier, slice); a unit is positive when it holds a ground-truth box.
TOPS_SQL = """ub AS (SELECT unit * 20 + slice_y AS unit, CAST(unit % 5 AS INT) AS fold, x1, z1, x2, z2, CAST(score AS FLOAT) AS s, is_pred FROM boxes),
lab AS (SELECT unit, fold, CAST(max(CASE WHEN NOT is_pred AND s > 0.9::FLOAT THEN 1 ELSE 0 END) AS INT) AS label FROM ub GROUP BY 1, 2)"""
SCORED_SQL = f"""grid(cell, lt, st) AS (VALUES {GRID_VALUES}),
scored AS (SELECT u.unit, u.fold, u.label, g.cell, g.lt, g.st, coalesce(max(b.s), 0) AS score
  FROM lab u CROSS JOIN grid g LEFT JOIN ub b ON b.unit = u.unit AND b.is_pred
   AND b.s >= CAST(CASE WHEN greatest(b.x2 - b.x1, b.z2 - b.z1) * 0.82e0 >= 10 THEN g.lt ELSE g.st END AS FLOAT)
  GROUP BY ALL)"""


def unit_tops(spark, d):
    b = bound(spark, d, "boxes").select(
        (F.col("unit") * 20 + F.col("slice_y")).alias("unit"), (F.col("unit") % 5).cast("int").alias("fold"), "x1", "z1", "x2", "z2", "score", "is_pred"
    )
    gt = (~F.col("is_pred")) & (F.col("score").cast("float") > F.lit(0.9).cast("float"))
    units = b.groupBy("unit", "fold").agg(F.max(gt.cast("int")).alias("label"))
    return M.size_threshold_scores(b.filter("is_pred"), units)


@query("m18_grid_search", f"""{with_('boxes')}, {TOPS_SQL}, {SCORED_SQL}, {curve_sql('scored', 'cell, lt, st', unit='unit')}
SELECT lt AS large_thr, st AS small_thr, round(coalesce(max(CASE WHEN fp / CAST(p + n AS DOUBLE) <= 0.2 THEN tp / CAST(p AS DOUBLE) END), 0), 6) AS sens FROM curve GROUP BY lt, st""")
def _(spark, d):
    g = M.grid_search(unit_tops(spark, d), LARGES, SMALLS, 0.2)
    return g.select("large_thr", "small_thr", r6("sens"))


TUNE_SQL = f"""{with_('boxes')}, {TOPS_SQL}, {SCORED_SQL}, pool AS (SELECT s.*, f AS tune_fold FROM scored s JOIN range(5) r(f) ON f <> s.fold),
{curve_sql('pool', 'tune_fold, cell, lt, st', unit='unit')},
cells2 AS (SELECT tune_fold, cell, lt, st, coalesce(max(CASE WHEN fp / CAST(p + n AS DOUBLE) <= 0.2 THEN tp / CAST(p AS DOUBLE) END), 0) AS sens FROM curve GROUP BY 1, 2, 3, 4),
tuned AS (SELECT * FROM cells2 QUALIFY row_number() OVER (PARTITION BY tune_fold ORDER BY sens DESC, cell) = 1)"""


@query("m19_tune_cross_fold", f"{TUNE_SQL} SELECT CAST(tune_fold AS INT) AS tune_fold, lt AS large_thr, st AS small_thr, round(sens, 6) AS sens FROM tuned")
def _(spark, d):
    t = M.tune_cross_fold(unit_tops(spark, d), 5, LARGES, SMALLS, 0.2)
    return t.select("tune_fold", "large_thr", "small_thr", r6("sens"))


@query("a23_ensemble_threshold", f"{TUNE_SQL} SELECT round(avg(lt), 6) AS large_thr, round(avg(st), 6) AS small_thr FROM tuned")
def _(spark, d):
    t = M.tune_cross_fold(unit_tops(spark, d), 5, LARGES, SMALLS, 0.2)
    return M.ensemble_threshold(t).select(r6("large_thr"), r6("small_thr"))


@query("j9_leave_one_out_pool", f"{with_('units')} SELECT CAST(f AS INT) AS tune_fold, count(*) AS n, sum(label) AS n_pos FROM units JOIN range(5) r(f) ON f <> fold GROUP BY f")
def _(spark, d):
    p = M.leave_one_out(bound(spark, d, "units"), 5)
    return p.groupBy("tune_fold").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query("j10_grid", f"""{with_('units')}, g(lt, st) AS (SELECT a, b FROM (VALUES (0.1e0), (0.4e0)) x(a), (VALUES (0.2e0), (0.6e0)) y(b))
SELECT lt AS large_thr, st AS small_thr, count(*) AS n FROM units, g WHERE score >= CASE WHEN price >= 150000 THEN lt ELSE st END GROUP BY 1, 2""")
def _(spark, d):
    from foldscope.operators.joins import grid

    g = grid(bound(spark, d, "units"), large_thr=[0.1, 0.4], small_thr=[0.2, 0.6])
    keep = F.col("score") >= F.when(F.col("price") >= 150000, F.col("large_thr")).otherwise(F.col("small_thr"))
    return g.filter(keep).groupBy("large_thr", "small_thr").agg(F.count("*").alias("n"))


# --- report tables ------------------------------------------------------------------------------

SCOPE = ", ".join(M.SCOPE)
REPORT_SQL = f"""{with_('units_folds')}, cv AS (SELECT * FROM units_folds WHERE fold IS NOT NULL),
scoped AS (SELECT unit, label, score, lesions, 'per_fold' AS scope, fold, CAST(NULL AS VARCHAR) AS stratum_kind, CAST(NULL AS VARCHAR) AS stratum_value FROM cv
UNION ALL SELECT unit, label, score, lesions, 'cv_pooled', NULL, NULL, NULL FROM cv
UNION ALL SELECT unit, label, score, lesions, 'stratum', NULL, 'priority', priority FROM cv
UNION ALL SELECT unit, label, score, lesions, 'stratum', NULL, 'price_bin', CASE WHEN price <= 150000 THEN '<=150k' ELSE '>150k' END FROM cv
UNION ALL SELECT unit, label, score, lesions, 'holdout', NULL, NULL, NULL FROM units_folds WHERE fold IS NULL),
{battery_sql('scoped', SCOPE)}, counts AS (SELECT {SCOPE}, count(*) AS np, sum(lesions) AS nl FROM scoped GROUP BY {SCOPE}),
report AS (SELECT 'run_1' AS run_id, 'cv' AS entrypoint, r.metric, r.scope, r.fold, r.stratum_kind, r.stratum_value, false AS rescored, round(r.value, 6) AS value, CAST(np AS INT) AS n_patients, CAST(nl AS INT) AS n_lesions
FROM rows_ r JOIN counts c ON c.scope = r.scope AND c.fold IS NOT DISTINCT FROM r.fold AND c.stratum_kind IS NOT DISTINCT FROM r.stratum_kind AND c.stratum_value IS NOT DISTINCT FROM r.stratum_value)"""


def report(spark, d):
    kinds = {"priority": F.col("priority"), "price_bin": F.when(F.col("price") <= 150000, "<=150k").otherwise(">150k")}
    r = M.scoped_report(bound(spark, d, "units_folds"), kinds, "run_1", "cv", False, "v1", lesions="lesions", targets=PTS)
    return r.withColumn("value", F.round("value", 6))


@query("m20_report_rows", f"""{REPORT_SQL} SELECT run_id, entrypoint, metric, scope, fold, stratum_kind, stratum_value,
rescored, value, CAST(NULL AS DOUBLE) AS ci_lower_95, CAST(NULL AS DOUBLE) AS ci_upper_95, n_patients, n_lesions, 'v1' AS code_version FROM report""")
def _(spark, d):
    return report(spark, d)


@query("p9_filter_report", f"{REPORT_SQL} SELECT fold, value FROM report WHERE metric = 'auroc' AND scope = 'per_fold'")
def _(spark, d):
    return M.filter_report(report(spark, d), metric="auroc", scope="per_fold", stratum_kind=None).select("fold", "value")


RUNS_SQL = """runs AS (SELECT 'metric_' || priority AS metric, CAST(day AS DATE) AS run_id, CAST(floor(price) AS BIGINT) % 2 = 1 AS rescored, score AS value, unit FROM units)"""


def runs(spark, d):
    u = bound(spark, d, "units")
    return u.select(F.concat(F.lit("metric_"), "priority").alias("metric"), F.col("day").cast("date").alias("run_id"),
                    (F.floor("price") % 2 == 1).alias("rescored"), F.col("score").alias("value"), "unit")


@query("m21_headline", f"{with_('units')}, {RUNS_SQL} SELECT metric, round(arg_max(value, (run_id, unit)), 6) AS value FROM runs GROUP BY metric")
def _(spark, d):
    r = runs(spark, d).select("metric", "value", F.col("value").alias("ci_lower_95"), F.col("value").alias("ci_upper_95"), F.struct("run_id", "unit").alias("ord"))
    return M.headline(r, "ord").select("metric", r6("value"))


@query("m22_compare_methods", f"""{with_('units')}, {RUNS_SQL}, c AS (SELECT metric, avg(CASE WHEN NOT rescored THEN value END) AS a, stddev_samp(CASE WHEN NOT rescored THEN value END) AS sa,
avg(CASE WHEN rescored THEN value END) AS b, stddev_samp(CASE WHEN rescored THEN value END) AS sb FROM runs GROUP BY metric)
SELECT metric, round(a, 6) AS mean_a, round(sa, 6) AS std_a, round(b, 6) AS mean_b, round(sb, 6) AS std_b, CASE WHEN b > a THEN 'b' ELSE 'a' END AS winner FROM c""")
def _(spark, d):
    return M.compare_methods(runs(spark, d)).select("metric", r6("mean_a"), r6("std_a"), r6("mean_b"), r6("std_b"), "winner")


EPOCH_SQL = "ep AS (SELECT unit, label, score, CAST(date_part('year', day) AS INT) AS epoch FROM units)"


@query("m23_slice_metrics", f"""{with_('units')}, {EPOCH_SQL}, {curve_sql('ep', 'epoch')} SELECT epoch, round(coalesce({AUROC_SQL}, 0), 6) AS auroc,
round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN {AP_SQL} ELSE 0 END, 6) AS ap FROM curve GROUP BY epoch""")
def _(spark, d):
    u = bound(spark, d, "units").withColumn("epoch", F.year("day"))
    return M.slice_metrics(u).select("epoch", r6("auroc"), r6("ap"))


@query("m24_log_loss", f"""{with_('units')}, p AS (SELECT fold, label, greatest(least(score, 1 - 1e-7), 1e-7) AS s FROM units)
SELECT fold, round(avg(-(label * ln(s) + (1 - label) * ln(1 - s))), 6) AS log_loss FROM p GROUP BY fold""")
def _(spark, d):
    return M.log_loss(bound(spark, d, "units"), by=["fold"]).select("fold", r6("log_loss"))


@query("m24_dice", f"{with_('units')} SELECT fold, round((2e0 * sum(score * label) + 1) / (sum(score) + sum(label) + 1), 6) AS dice FROM units GROUP BY fold")
def _(spark, d):
    return M.dice(bound(spark, d, "units"), "score", "label", ["fold"]).select("fold", r6("dice"))


@query("m25_ks", f"{with_('units')}, {curve_sql('units', 'fold')} SELECT fold, round(max(abs(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE))), 6) AS ks FROM curve GROUP BY fold")
def _(spark, d):
    return M.ks_2samp(bound(spark, d, "units"), by=["fold"]).select("fold", r6("ks"))


@query("m25_cliffs_delta", f"""{with_('units')}, a AS (SELECT fold, score, count(*) AS c FROM units WHERE label = 1 GROUP BY 1, 2), b AS (SELECT fold, score, count(*) AS c FROM units WHERE label = 0 GROUP BY 1, 2)
SELECT a.fold, round(sum(sign(a.score - b.score) * a.c * b.c) / CAST(sum(a.c * b.c) AS DOUBLE), 6) AS cliffs_delta FROM a JOIN b ON a.fold = b.fold GROUP BY a.fold""")
def _(spark, d):
    return M.cliffs_delta(bound(spark, d, "units"), by=["fold"]).select("fold", r6("cliffs_delta"))


@query("m25_chi2", f"""{with_('units')}, o AS (SELECT priority, status, count(*) AS o FROM units GROUP BY 1, 2),
m AS (SELECT a.priority, b.status, a.c * b.c / CAST((SELECT count(*) FROM units) AS DOUBLE) AS e FROM (SELECT priority, count(*) AS c FROM units GROUP BY 1) a, (SELECT status, count(*) AS c FROM units GROUP BY 1) b),
x AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2 FROM m LEFT JOIN o USING (priority, status)),
k AS (SELECT count(DISTINCT priority) AS na, count(DISTINCT status) AS nb, count(*) AS n FROM units)
SELECT round(chi2, 6) AS chi2, (na - 1) * (nb - 1) AS dof, round(sqrt(chi2 / (n * (least(na, nb) - 1))), 6) AS cramers_v FROM x, k""")
def _(spark, d):
    return M.chi2(bound(spark, d, "units"), "priority", "status").select(r6("chi2"), "dof", r6("cramers_v"))


@query("m25_single_class_strata", f"{with_('units')} SELECT status, min(label) AS only_label, count(*) AS n FROM units GROUP BY status HAVING min(label) = max(label)")
def _(spark, d):
    return M.single_class_strata(bound(spark, d, "units"), "status")


@query("m26_profile", f"""{with_('units')} SELECT priority, {', '.join(f"round(quantile_cont(price, {p}), 6) AS p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in (0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995))},
count(*) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std FROM units GROUP BY priority""")
def _(spark, d):
    p = M.profile(bound(spark, d, "units"), "price", ["priority"])
    qs = [c for c in p.columns if c.startswith("p") and c != "priority"]
    return p.select("priority", *[r6(c) for c in qs], "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("m27_size_category", "SELECT CASE WHEN p_size < 5 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS cat, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    from foldscope.plans.bindings import table

    return table(spark, d, "part").groupBy(M.size_category(F.col("p_size")).alias("cat")).agg(F.count("*").alias("n"))


@query("m27_fold_balance", f"{with_('units')} SELECT fold, count(*) AS n, sum(label) AS n_pos, count(*) - sum(label) AS n_neg, round(avg(label), 6) AS pos_frac FROM units GROUP BY fold")
def _(spark, d):
    return M.fold_balance(bound(spark, d, "units")).select("fold", "n", "n_pos", "n_neg", r6("pos_frac"))


@query("w8_prefix_sum", f"{with_('units')} SELECT unit, sum(label) OVER (PARTITION BY fold ORDER BY score DESC, unit ROWS UNBOUNDED PRECEDING) AS running FROM units")
def _(spark, d):
    from foldscope.operators.ordering import prefix_sum

    u = bound(spark, d, "units")
    return prefix_sum(u, [F.col("score").desc(), F.col("unit")], {"running": F.col("label")}, ["fold"]).select("unit", "running")
