"""Boxes: thresholds, pair joins, suppression, fusion, matching and slice scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldscope.operators import boxes as B
from foldscope.plans.bindings import bound, table, with_
from foldscope.plans.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
XY = list(B.XY)


def iou_sql(a: str, b: str) -> str:
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.z2, {b}.z2) - greatest({a}.z1, {b}.z1), 0)"
    ar = lambda t: f"({t}.x2 - {t}.x1) * ({t}.z2 - {t}.z1)"
    return f"(CAST({inter} AS DOUBLE) / ({ar(a)} + {ar(b)} - {inter}))"


SPLIT = "pred AS (SELECT * FROM boxes WHERE is_pred), gt AS (SELECT * FROM boxes WHERE NOT is_pred)"
GEO = "g_p AS (SELECT unit, slice_y, x1, z1, x2, z2, count(*) AS na FROM pred GROUP BY ALL), g_g AS (SELECT unit, slice_y, x1, z1, x2, z2, count(*) AS nb FROM gt GROUP BY ALL)"
PAIRS = f"pairs AS (SELECT p.unit, p.slice_y, p.x1, p.z1, p.x2, p.z2, {iou_sql('p', 'g')} AS iou, na, nb FROM g_p p JOIN g_g g USING (unit, slice_y) WHERE p.x1 < g.x2 AND g.x1 < p.x2 AND p.z1 < g.z2 AND g.z1 < p.z2)"


def pred(spark, d):
    return bound(spark, d, "boxes").filter("is_pred")


def gt(spark, d):
    return bound(spark, d, "boxes").filter("not is_pred")


@query("p7_size_threshold", f"""{with_('boxes')}, {SPLIT} SELECT unit, count(*) AS n, round(sum(score), 6) AS s FROM pred
WHERE CAST(score AS FLOAT) >= CAST(CASE WHEN greatest(x2 - x1, z2 - z1) * 0.82e0 >= 10 THEN 0.05 ELSE 0.3 END AS FLOAT) GROUP BY unit""")
def _(spark, d):
    k = B.size_threshold(pred(spark, d), 0.05, 0.30)
    return k.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("s"))


@query("p8_passes_threshold", f"""{with_('boxes')} SELECT score >= CASE WHEN greatest(x2 - x1, z2 - z1) * 0.82e0 >= 10 THEN 0.05e0 ELSE 0.3e0 END AS passes_threshold, count(*) AS n FROM boxes GROUP BY 1""")
def _(spark, d):
    c = bound(spark, d, "boxes").withColumn("max_dim_mm", B.max_dim_mm())
    return B.passes_threshold(c, 0.05, 0.30).groupBy("passes_threshold").agg(F.count("*").alias("n"))


CROP = "greatest(least({c} - {o}, {n}), 0)"


def crop_sql(o, n):
    f = lambda c: f"least(greatest({c} - {o}, 0), {n}) AS {c}"
    return f"SELECT unit, slice_y, {f('x1')}, {f('z1')}, {f('x2')}, {f('z2')} FROM boxes"


SUMS = "count(*) AS n, sum(x1) AS sx1, sum(z1) AS sz1, sum(x2) AS sx2, sum(z2) AS sz2"


def sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in XY])


@query("p10_crop_boxes", f"{with_('boxes')}, c AS ({crop_sql(24, 50)}) SELECT unit, {SUMS} FROM c WHERE x2 > x1 AND z2 > z1 GROUP BY unit")
def _(spark, d):
    return sums(B.crop_boxes(bound(spark, d, "boxes"), F.lit(24), F.lit(24), F.lit(50), F.lit(50)), "unit")


@query("p11_clamp_boxes", f"{with_('boxes')}, c AS ({crop_sql(0, 90)}) SELECT unit, {SUMS} FROM c WHERE x2 - x1 >= 6 AND z2 - z1 >= 6 GROUP BY unit")
def _(spark, d):
    return sums(B.clamp_boxes(bound(spark, d, "boxes"), 90, 90, 6), "unit")


@query("f13_affine_boxes", f"""{with_('boxes')}, t AS (SELECT unit, slice_y / 1e1 AS th, x1 - 48e0 AS a, x2 - 48e0 AS b, z1 - 48e0 AS c, z2 - 48e0 AS e FROM boxes),
q AS (SELECT unit, [1.1e0 * (cos(th) * a - sin(th) * c), 1.1e0 * (cos(th) * a - sin(th) * e), 1.1e0 * (cos(th) * b - sin(th) * c), 1.1e0 * (cos(th) * b - sin(th) * e)] AS xs,
[1.1e0 * (sin(th) * a + cos(th) * c), 1.1e0 * (sin(th) * a + cos(th) * e), 1.1e0 * (sin(th) * b + cos(th) * c), 1.1e0 * (sin(th) * b + cos(th) * e)] AS zs FROM t)
SELECT unit, round(avg(list_min(xs) + 51), 5) AS x1, round(avg(list_max(xs) + 51), 5) AS x2, round(avg(list_min(zs) + 46), 5) AS z1, round(avg(list_max(zs) + 46), 5) AS z2 FROM q GROUP BY unit""")
def _(spark, d):
    a = B.affine_boxes(bound(spark, d, "boxes"), F.col("slice_y") / 10.0, F.lit(1.1), F.lit(3.0), F.lit(-2.0), 48.0, 48.0)
    return a.groupBy("unit").agg(*[F.round(F.avg(c), 5).alias(c) for c in XY])


@query("f14_box_geometry", f"""{with_('boxes')} SELECT unit, sum((x2 - x1) * (z2 - z1)) AS area, round(max(greatest(x2 - x1, z2 - z1) * 0.82e0), 6) AS max_dim_mm,
round(sum(least(x2 / 96e0, 1)), 6) AS nx2, round(sum(least(x2 / 96e0, 1) * 96), 6) AS px2 FROM boxes GROUP BY unit""")
def _(spark, d):
    b = bound(spark, d, "boxes")
    n = B.normalize(b.withColumns({"area": B.area(), "mm": B.max_dim_mm()}), 96, 96)
    n = B.denormalize(n.withColumn("nx2", F.col("x2")), 96, 96)
    return n.groupBy("unit").agg(F.sum("area").alias("area"), F.round(F.max("mm"), 6).alias("max_dim_mm"), F.round(F.sum("nx2"), 6).alias("nx2"), F.round(F.sum("x2"), 6).alias("px2"))


@query("j15_iou_join", f"""{with_('boxes')}, {SPLIT}, {GEO}, {PAIRS} SELECT unit, slice_y, CAST(sum(na * nb) AS BIGINT) AS n_pairs, CAST(sum(CASE WHEN iou >= 0.3 THEN na * nb ELSE 0 END) AS BIGINT) AS n_match,
round(sum(iou * na * nb), 6) AS sum_iou FROM pairs GROUP BY unit, slice_y""")
def _(spark, d):
    n = F.col("na") * F.col("nb")
    return B.iou_join(pred(spark, d), gt(spark, d)).groupBy("unit", "slice_y").agg(
        F.sum(n).alias("n_pairs"), F.sum(F.when(F.col("iou") >= 0.3, n).otherwise(0)).alias("n_match"), F.round(F.sum(F.col("iou") * n), 6).alias("sum_iou"))


@query("c6_max_iou", f"""{with_('boxes')}, {SPLIT}, {GEO}, {PAIRS}, m AS (SELECT unit, slice_y, x1, z1, x2, z2, max(iou) AS v FROM pairs GROUP BY ALL)
SELECT unit, slice_y, count(*) AS n, round(sum(coalesce(v, 0)), 6) AS s FROM pred LEFT JOIN m USING (unit, slice_y, x1, z1, x2, z2) GROUP BY 1, 2""")
def _(spark, d):
    m = B.max_iou(pred(spark, d), gt(spark, d))
    return m.groupBy("unit", "slice_y").agg(F.count("*").alias("n"), F.round(F.sum("max_iou"), 6).alias("s"))


def nms_sql(thr, op, boxes=with_("boxes", recursive=True)):
    return f"""{boxes}, {SPLIT}, u AS (SELECT unit, slice_y, x1, z1, x2, z2, max(score) AS score FROM pred GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY unit, slice_y ORDER BY score DESC, x1, z1, x2, z2) AS rn,
  {{'x1': x1, 'z1': z1, 'x2': x2, 'z2': z2, 'score': score}} AS bx FROM u),
rec AS (SELECT unit, slice_y, rn, [bx] AS kept FROM b WHERE rn = 1
  UNION ALL SELECT b.unit, b.slice_y, b.rn, CASE WHEN len(kept) >= 100 OR len(list_filter(kept, lambda k: {iou_sql('k', 'b')} {op} {thr})) > 0 THEN kept ELSE list_append(kept, b.bx) END
  FROM rec r JOIN b ON b.unit = r.unit AND b.slice_y = r.slice_y AND b.rn = r.rn + 1),
fin AS (SELECT unit, slice_y, unnest(arg_max(kept, rn)) AS k FROM rec GROUP BY 1, 2)
SELECT unit, slice_y, k.x1 AS x1, k.z1 AS z1, k.x2 AS x2, k.z2 AS z2, round(k.score, 6) AS score FROM fin"""


@query("c1_nms", nms_sql(0.5, ">"))
def _(spark, d):
    return B.nms(pred(spark, d), 0.5).select("unit", "slice_y", *XY, r6("score"))


@query("c1_nms_closed", nms_sql(0.5, ">="))
def _(spark, d):
    return B.nms(pred(spark, d), 0.5, closed=True).select("unit", "slice_y", *XY, r6("score"))


def wbf_sql(src, key, thr, models, edge=96):
    k = ", ".join(key)
    same = " AND ".join(f"b.{c} = r.{c}" for c in key)
    new = "{'x1': b.x1, 'z1': b.z1, 'x2': b.x2, 'z2': b.z2, 'sw': b.s, 'wx1': b.s * b.x1, 'wz1': b.s * b.z1, 'wx2': b.s * b.x2, 'wz2': b.s * b.z2, 'n': 1}"
    up = lambda c: f"'{c}': (c.w{c} + s * {c}) / (c.sw + s)"
    grown = "{" + ", ".join(up(c) for c in XY) + ", 'sw': c.sw + s, " + ", ".join(f"'w{c}': c.w{c} + s * {c}" for c in XY) + ", 'n': c.n + 1}"
    return f"""b AS (SELECT {k}, CAST(x1 AS DOUBLE) AS x1, CAST(z1 AS DOUBLE) AS z1, CAST(least(x2, {edge}) AS DOUBLE) AS x2, CAST(least(z2, {edge}) AS DOUBLE) AS z2, score AS s,
  row_number() OVER (PARTITION BY {k} ORDER BY score DESC, x1, z1, least(x2, {edge}), least(z2, {edge})) AS rn FROM {src} WHERE score >= 0.001),
rec AS (SELECT {k}, rn, [{new}] AS cl FROM b WHERE rn = 1
  UNION ALL SELECT {k}, rn, CASE WHEN v > {thr} THEN list_transform(cl, lambda c, i: CASE WHEN i = pos THEN {grown} ELSE c END) ELSE list_append(cl, nw) END
  FROM (SELECT *, list_max(vs) AS v, list_position(vs, list_max(vs)) AS pos FROM (SELECT {', '.join('b.' + c for c in key)}, b.rn, b.s, b.x1, b.z1, b.x2, b.z2, r.cl, {new} AS nw,
    list_transform(r.cl, lambda c: {iou_sql('c', 'b')}) AS vs FROM rec r JOIN b ON {same} AND b.rn = r.rn + 1) q) q2),
fin AS (SELECT {k}, unnest(arg_max(cl, rn)) AS c FROM rec GROUP BY {k})
SELECT {k}, round(c.x1 + 1e-9, 5) AS x1, round(c.z1 + 1e-9, 5) AS z1, round(c.x2 + 1e-9, 5) AS x2, round(c.z2 + 1e-9, 5) AS z2, round(c.sw / c.n * least(c.n, {models}) / {models}e0 + 1e-9, 5) AS score, CAST(c.n AS BIGINT) AS n_boxes FROM fin"""


# A nudge below the printed precision keeps exact half-way values from rounding apart.
r5 = lambda c: F.round(F.col(c) + 1e-9, 5).alias(c)


@query("c2_wbf", f"{with_('boxes', recursive=True)}, {SPLIT}, {wbf_sql('pred', ['unit', 'slice_y'], 0.4, 1)}")
def _(spark, d):
    f = B.wbf(pred(spark, d), 96, 96)
    return f.select("unit", "slice_y", *[r5(c) for c in XY], r5("score"), "n_boxes")


# The two return flags left of the ground-truth flag stand for two models.
@query("c15_ensemble", f"{with_('boxes', recursive=True)}, {SPLIT}, {wbf_sql('pred', ['unit', 'slice_y'], 0.55, 2)}")
def _(spark, d):
    f = B.ensemble(pred(spark, d), 96, 96, iou_thr=0.55, n_models=2)
    return f.select("unit", "slice_y", *[r5(c) for c in XY], r5("score"), "n_boxes")


@query("c15_ensemble_per_model", f"{with_('boxes', recursive=True)}, {SPLIT}, md AS (SELECT *, x1 % 16 AS model FROM pred), {wbf_sql('md', ['unit', 'slice_y', 'model'], 0.4, 1)}")
def _(spark, d):
    f = B.ensemble(pred(spark, d).withColumn("model", F.col("x1") % 16), 96, 96, per_model=True)
    return f.select("unit", "slice_y", "model", *[r5(c) for c in XY], r5("score"), "n_boxes")


def tag_sql(boxes=with_("boxes", recursive=True)):
    return f"""{boxes}, {SPLIT},
gs AS (SELECT unit, slice_y, list({{'x1': x1, 'z1': z1, 'x2': x2, 'z2': z2}} ORDER BY x1, z1, x2, z2) AS gs FROM gt GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY unit, slice_y ORDER BY score DESC, x1, z1, x2, z2) AS rn FROM pred),
rec AS (SELECT unit, slice_y, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS m FROM p GROUP BY 1, 2
  UNION ALL SELECT unit, slice_y, rn, list_append(m, CASE WHEN v >= 0.3 THEN list_position(vs, v) ELSE -1 END) FROM (
    SELECT *, list_max(vs) AS v FROM (SELECT p.unit, p.slice_y, p.rn, r.m, list_transform(g.gs, lambda x, i: CASE WHEN list_contains(r.m, i) THEN -1e0 ELSE {iou_sql('x', 'p')} END) AS vs
      FROM rec r JOIN p ON p.unit = r.unit AND p.slice_y = r.slice_y AND p.rn = r.rn + 1 LEFT JOIN gs g ON g.unit = p.unit AND g.slice_y = p.slice_y) q) q2),
fin AS (SELECT unit, slice_y, arg_max(m, rn) AS m FROM rec GROUP BY 1, 2),
tp AS (SELECT p.unit, p.slice_y, x1, z1, x2, z2, score, gs[m[rn]] AS g, m[rn] AS gi FROM p JOIN fin USING (unit, slice_y) LEFT JOIN gs USING (unit, slice_y) WHERE m[rn] > 0),
allg AS (SELECT unit, slice_y, unnest(gs) AS g, generate_subscripts(gs, 1) AS gi FROM gs)
SELECT unit, slice_y, 'tp' AS tag, x1, z1, x2, z2, round(score, 6) AS score, g.x1 AS gx1, g.z1 AS gz1 FROM tp
UNION ALL SELECT p.unit, p.slice_y, 'fp', x1, z1, x2, z2, round(score, 6), NULL, NULL FROM p JOIN fin USING (unit, slice_y) WHERE coalesce(m[rn], -1) < 0
UNION ALL SELECT a.unit, a.slice_y, 'fn', a.g.x1, a.g.z1, a.g.x2, a.g.z2, NULL, a.g.x1, a.g.z1 FROM allg a LEFT JOIN tp t ON t.unit = a.unit AND t.slice_y = a.slice_y AND t.gi = a.gi WHERE t.gi IS NULL"""


@query("c5_tag_events", tag_sql())
def _(spark, d):
    t = B.tag_events(pred(spark, d), gt(spark, d))
    return t.select("unit", "slice_y", "tag", *XY, r6("score"), F.col("gt.x1").alias("gx1"), F.col("gt.z1").alias("gz1"))


# Crowded slices: the check SQL fuses, suppresses and matches place by place.
CROWDED = with_("boxes_crowded", recursive=True).replace("boxes_crowded AS", "boxes AS")


def crowded(spark, d, is_pred):
    return bound(spark, d, "boxes_crowded").withColumn("slice_y", (F.col("slice_y") % 4).cast("int")).filter(F.col("is_pred") == is_pred)


def by_slice(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(slice_y % 4 AS INT) AS slice_y) FROM ({sql}) p"


@query("j15_iou_join_crowded", f"""{CROWDED}, {SPLIT}, {GEO}, {PAIRS} SELECT unit, CAST(slice_y % 4 AS INT) AS slice_y, CAST(sum(na * nb) AS BIGINT) AS n_pairs,
CAST(sum(CASE WHEN iou >= 0.3 THEN na * nb ELSE 0 END) AS BIGINT) AS n_match, round(sum(iou * na * nb), 5) AS sum_iou FROM pairs GROUP BY unit, slice_y % 4""")
def _(spark, d):
    n = F.col("na") * F.col("nb")
    return B.iou_join(crowded(spark, d, True), crowded(spark, d, False)).groupBy("unit", "slice_y").agg(
        F.sum(n).alias("n_pairs"), F.sum(F.when(F.col("iou") >= 0.3, n).otherwise(0)).alias("n_match"), F.round(F.sum(F.col("iou") * n), 5).alias("sum_iou"))


@query("c1_nms_crowded", by_slice(nms_sql(0.3, ">", CROWDED)))
def _(spark, d):
    return B.nms(crowded(spark, d, True), 0.3).select("unit", "slice_y", *XY, r6("score"))


@query("c2_wbf_crowded", by_slice(f"{CROWDED}, {SPLIT}, {wbf_sql('pred', ['unit', 'slice_y'], 0.4, 1, 1e9)}"))
def _(spark, d):
    f = B.wbf(crowded(spark, d, True), 1e9, 1e9)
    return f.select("unit", "slice_y", *[r5(c) for c in XY], r5("score"), "n_boxes")


@query("c5_tag_crowded", by_slice(tag_sql(CROWDED)))
def _(spark, d):
    t = B.tag_events(crowded(spark, d, True), crowded(spark, d, False))
    return t.select("unit", "slice_y", "tag", *XY, r6("score"), F.col("gt.x1").alias("gx1"), F.col("gt.z1").alias("gz1"))


CAND = f"""cands AS (SELECT unit, slice_y, x1 * 1000000 + z1 * 10000 + x2 * 100 + z2 AS cand, gid AS gt, iou, round(1 - iou + cs * 1e-1, 9) AS cost FROM (
SELECT p.unit, p.slice_y, p.x1, p.z1, p.x2, p.z2, g.x1 * 1000000 + g.z1 * 10000 + g.x2 * 100 + g.z2 AS gid, {iou_sql('p', 'g')} AS iou, p.cs
FROM (SELECT unit, slice_y, x1, z1, x2, z2, max(score) AS cs FROM pred GROUP BY ALL) p JOIN (SELECT DISTINCT unit, slice_y, x1, z1, x2, z2 FROM gt) g USING (unit, slice_y)
WHERE p.x1 < g.x2 AND g.x1 < p.x2 AND p.z1 < g.z2 AND g.z1 < p.z2) t)"""


@query("c16_dynamic_k_assign", f"""{with_('boxes')}, {SPLIT}, {CAND},
ks AS (SELECT unit, slice_y, gt, greatest(floor(round(sum(iou), 9)), 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY unit, slice_y, gt ORDER BY iou DESC, cand) AS r FROM cands) t WHERE r <= 13 GROUP BY ALL),
ch AS (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY unit, slice_y, gt ORDER BY cost, cand) AS r FROM cands) c JOIN ks USING (unit, slice_y, gt) WHERE r <= k),
n AS (SELECT unit, slice_y, cand, count(*) AS n, min(gt) AS one FROM ch GROUP BY ALL),
bestg AS (SELECT unit, slice_y, cand, arg_min(gt, (cost, gt)) AS g FROM cands GROUP BY ALL)
SELECT unit, slice_y, cand, CASE WHEN n > 1 THEN g ELSE one END AS gt FROM n JOIN bestg USING (unit, slice_y, cand)""")
def _(spark, d):
    num = lambda s: (F.col(f"{s}.x1") * 1000000 + F.col(f"{s}.z1") * 10000 + F.col(f"{s}.x2") * 100 + F.col(f"{s}.z2"))
    best = pred(spark, d).groupBy("unit", "slice_y", F.struct(*XY).alias("a")).agg(F.max("score").alias("cs"))
    c = B.iou_join(pred(spark, d), gt(spark, d)).join(best, ["unit", "slice_y", "a"])
    c = c.select("unit", "slice_y", num("a").alias("cand"), num("b").alias("gt"), "iou", F.round(1 - F.col("iou") + F.col("cs") * 0.1, 9).alias("cost"))
    return B.dynamic_k_assign(c).select("unit", "slice_y", "cand", "gt")


@query("a8_unit_score", "SELECT s_suppkey AS unit, round(coalesce(max((l_extendedprice % 1000e0) / 1000e0), 0), 6) AS score FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag <> 'R' GROUP BY 1")
def _(spark, d):
    units = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    return B.unit_score(pred(spark, d).select("unit", "score"), units).select("unit", r6("score"))


@query("a9_topk_mean", f"""{with_('boxes')}, {SPLIT} SELECT unit, round(avg(score), 6) AS topk_mean, count(*) AS k_used FROM
(SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC) AS r FROM pred) t WHERE r <= 5 GROUP BY unit""")
def _(spark, d):
    return B.topk_mean(pred(spark, d), ["unit"], 5).select("unit", r6("topk_mean"), "k_used")


AUX = "aux AS (SELECT unit, slice_y, max(CAST(x2 AS DOUBLE)) / 120e0 AS aux_max FROM boxes GROUP BY 1, 2)"


def aux(spark, d):
    return bound(spark, d, "boxes").groupBy("unit", "slice_y").agg((F.max(F.col("x2").cast("double")) / 120.0).alias("aux_max"))


@query("a10_slice_max", f"""{with_('boxes')}, {SPLIT}, {AUX}, t AS (SELECT unit, slice_y, max(score) AS b FROM pred GROUP BY 1, 2)
SELECT unit, slice_y, round(greatest(b, aux_max), 6) AS slice_max FROM aux LEFT JOIN t USING (unit, slice_y)""")
def _(spark, d):
    return B.slice_max(pred(spark, d), aux(spark, d)).select("unit", "slice_y", r6("slice_max"))


@query("j17_rescore", f"""{with_('boxes')}, {SPLIT}, {AUX}, pr AS (SELECT unit, slice_y, aux_max AS prob FROM aux WHERE aux_max < 0.9)
SELECT unit, slice_y, count(*) AS n, round(sum(score * coalesce(prob, 1)) + 1e-9, 6) AS s FROM pred LEFT JOIN pr USING (unit, slice_y) GROUP BY 1, 2""")
def _(spark, d):
    probs = aux(spark, d).filter("aux_max < 0.9").withColumnRenamed("aux_max", "prob")
    return B.rescore(pred(spark, d), probs).groupBy("unit", "slice_y").agg(F.count("*").alias("n"), F.round(F.sum("score") + 1e-9, 6).alias("s"))


INDEX = """idx AS (SELECT s_suppkey AS unit, s_nationkey % 2 AS label, CAST(k AS INT) AS slice_y FROM supplier, range(24) r(k)),
hb AS (SELECT DISTINCT unit, slice_y FROM gt), si AS (SELECT i.unit, i.slice_y, h.unit IS NOT NULL AS is_positive_slice,
CASE WHEN h.unit IS NOT NULL THEN 'pos_slice' WHEN label = 1 THEN 'neg_slice_pos_vol' ELSE 'neg_slice_neg_vol' END AS kind FROM idx i LEFT JOIN hb h ON h.unit = i.unit AND h.slice_y = i.slice_y)"""


def slice_idx(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_nationkey") % 2).alias("label"), F.lit(0).alias("lo"), F.lit(23).alias("hi"))
    return B.slice_index(u, gt(spark, d))


@query("j18_slice_index", f"{with_('boxes')}, {SPLIT}, {INDEX} SELECT * FROM si")
def _(spark, d):
    return slice_idx(spark, d)
