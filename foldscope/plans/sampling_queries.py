"""Pools, samples, scheduled draws, placement, quality rules, file round trips, streams and user hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing as H
from foldscope.operators import batch as BT
from foldscope.operators import boxes as B
from foldscope.operators import cohort as CO
from foldscope.operators import components as C
from foldscope.operators import metrics as M
from foldscope.operators import quality as Q
from foldscope.operators import sampling as K
from foldscope.operators.ordering import prefix_sum, ranked
from foldscope.plans.bindings import bound, table, with_
from foldscope.plans.box_queries import INDEX, SPLIT, pred, slice_idx
from foldscope.plans.cohort_queries import EMA, HIST, ema, history
from foldscope.plans.registry import query
from foldscope.sources import files as S
from foldscope.streaming import online as T

r6 = lambda c: F.round(c, 6).alias(c)
n_ = lambda: F.count("*").alias("n")
HASH = lambda *p, digits=8: "('0x' || substr(md5(" + " || ':' || ".join(p) + f"), 1, {digits}))::BIGINT"


def slice_scores(spark, d):
    return pred(spark, d).groupBy("unit", "slice_y").agg(F.max("score").alias("score"))


TOP = "ss AS (SELECT unit, slice_y, max(score) AS score FROM pred GROUP BY 1, 2)"


@query("k1_hard_pool", f"{with_('boxes')}, {SPLIT}, {TOP}, {INDEX} SELECT unit, slice_y, round(score, 6) AS score FROM ss SEMI JOIN (SELECT * FROM si WHERE NOT is_positive_slice) x USING (unit, slice_y) WHERE score >= 0.05 ORDER BY ss.score DESC, unit, slice_y LIMIT 1000")
def _(spark, d):
    idx = slice_idx(spark, d).filter("not is_positive_slice")
    return K.hard_pool(slice_scores(spark, d), idx).select("unit", "slice_y", r6("score"))


@query("k2_ema_topk", f"{with_('steps', recursive=True)}, {EMA} SELECT unit, slice_y, round(ema + 1e-9, 6) AS ema FROM fin ORDER BY fin.ema DESC, unit, slice_y LIMIT 100")
def _(spark, d):
    return K.ema_topk(ema(spark, d), 100).select("unit", "slice_y", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


@query("k3_select_pilot", """WITH c AS (SELECT o_custkey AS unit, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS category FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT DISTINCT unit FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY unit) AS r FROM c) t WHERE r <= CASE category WHEN 'single' THEN 5 WHEN 'multi' THEN 3 ELSE 2 END""")
def _(spark, d):
    o = table(spark, d, "orders")
    c = o.groupBy(F.col("o_custkey").alias("unit")).agg(F.when(F.count("*") == 1, "single").otherwise("multi").alias("category"))
    u = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("unit"), F.lit("urgent").alias("category")).distinct()
    return K.select_pilot(c.unionByName(u), {"single": 5, "multi": 3, "urgent": 2})


@query("k4_smoke_subset", f"""{with_('units')}, s AS (SELECT unit, label, fold = 0 AS z, row_number() OVER (PARTITION BY label, fold = 0 ORDER BY price, unit) AS r FROM units)
SELECT unit FROM s WHERE r <= CASE WHEN z THEN 1 WHEN label = 1 THEN 1 ELSE 2 END""")
def _(spark, d):
    return K.smoke_subset(bound(spark, d, "units"), size="price").select("unit")


@query("k5_sample_events", f"""WITH e AS (SELECT event_type AS kind, props AS path, count(*) AS copies FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {HASH("'42'", "path")}, path) AS r FROM e) SELECT kind, path, copies FROM r WHERE r <= 20""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("path"))
    return K.sample_events(e, 20)


@query("k6_cap_per_type", f"{with_('steps')} SELECT kind, step FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY step) AS r FROM steps) t WHERE r <= 200")
def _(spark, d):
    return K.cap_per_type(bound(spark, d, "steps")).select("kind", "step")


def draws_sql(epoch, hard):
    p = 0.5 + min(epoch / 30, 1) * -0.25
    h = "2216829733"
    basis = 2216829733
    for v in (42, epoch):
        basis = ((basis ^ v) * 435) & 0xFFFFFFFF
    es = f"'{basis & 0x7FFFFFFF}'"
    ninv = f"CASE WHEN h < 0.3 THEN 'hard' ELSE 'ninv' END" if hard else "'ninv'"
    return f"""pools AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY unit, slice_y) - 1 AS i, count(*) OVER (PARTITION BY pool) AS np FROM (
      SELECT unit, slice_y, CASE kind WHEN 'pos_slice' THEN 'pos' WHEN 'neg_slice_pos_vol' THEN 'nipv' ELSE 'ninv' END AS pool FROM si UNION ALL SELECT unit, slice_y, 'hard' FROM hp) t),
    dr AS (SELECT draw, {HASH(es, 'draw', "'class'")} / 4294967296e0 AS r, {HASH(es, 'draw', "'hard'")} / 4294967296e0 AS h, {HASH(es, 'draw', "'pick'", digits=15)} AS pick FROM range((SELECT count(*) FROM si)) x(draw)),
    dp AS (SELECT draw, pick, CASE WHEN r < {p}e0 THEN 'pos' WHEN (r - {p}e0) / (1 - {p}e0) < 0.5 THEN 'nipv' ELSE {ninv} END AS pool FROM dr)
    SELECT draw, pool, unit, slice_y FROM dp JOIN pools USING (pool) WHERE i = pick % np"""


HP = "hp AS (SELECT unit, slice_y FROM ss ORDER BY score DESC, unit, slice_y LIMIT 500)"


@query("k7_scheduled_sample", f"{with_('boxes')}, {SPLIT}, {TOP}, {HP}, {INDEX}, {draws_sql(12, True)}")
def _(spark, d):
    hard = slice_scores(spark, d).orderBy(F.col("score").desc(), "unit", "slice_y").limit(500)
    return K.scheduled_sample(slice_idx(spark, d), 12, hard=hard)


@query("k8_n_pastes", f"""WITH u AS (SELECT o_orderkey AS k, {HASH("'7'", "o_orderkey", "'any'")} / 4294967296e0 AS a, ({HASH("'7'", "o_orderkey", "'n'", "'u1'")} + 1e0) / 4294967297e0 AS u1, {HASH("'7'", "o_orderkey", "'n'", "'u2'")} / 4294967296e0 AS u2 FROM orders)
SELECT k, CAST(CASE WHEN a >= 0.7 THEN 0 ELSE least(floor(abs(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) * 1.5) + 1, 7) END AS INT) AS n_pastes FROM u""")
def _(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), K.n_pastes(0.7, 1.5, 7, 7, k).alias("n_pastes"))


@query("k9_place_donors")
def _(spark, d):
    v = runtime.cut(bound(spark, d, "voxels").select("unit", "x", "y", "z"))
    cc = C.connected_components(C.voxel_cells(v))
    # Components are numbered from 1 in each unit, so a donor's number is that plus the components of the units before.
    many = cc.groupBy("unit").agg(F.max("cc_id").cast("long").alias("_c"))
    before = prefix_sum(many, [F.col("unit")], {"_upto": F.col("_c")}).select("unit", (F.col("_upto") - F.col("_c")).alias("_before"))
    lab = cc.join(before, "unit").withColumn("donor", F.col("_before") + F.col("cc_id") - 1)
    cells = lab.select("donor", "y", "z", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    mid = C.component_stats(lab, by=("donor",)).select("donor", "cx", "cy", "cz")
    dn = cells.join(mid, "donor", "left").select("donor", *[(F.col(c) - F.rint(f"c{c}")).cast("int").alias(f"d{c}") for c in "xyz"])
    t = v.select("unit").distinct().withColumn("n_pastes", K.n_pastes(0.9, 1.0, 7, 42, F.col("unit")))
    return K.place_donors(t, C.band_columns(v), dn, v, (50, 10, 55))


@query("k10_blend_donor", f"""{with_('voxels')}, s AS (SELECT unit, avg(v) AS m, stddev_pop(v) AS sd FROM voxels GROUP BY 1), g AS (SELECT avg(v) AS gm, stddev_pop(v) AS gs FROM voxels),
b AS (SELECT v.unit, (v - m) / CASE WHEN sd > 1e-8 THEN sd ELSE 1 END * gs + gm AS mv, v, least(greatest(1 - abs(x - 25) / 3e1, 0), 1) AS a FROM voxels v JOIN s USING (unit), g)
SELECT unit, round(avg(a * mv + (1 - a) * v), 4) AS blended FROM b GROUP BY 1""")
def _(spark, d):
    v = bound(spark, d, "voxels")
    st = v.groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    g = v.agg(F.avg("v").alias("gm"), F.stddev_pop("v").alias("gs"))
    out = K.blend_donor(F.col("v"), F.col("v"), F.abs(F.col("x") - 25) / 30.0, F.col("m"), F.col("sd"), g.select("gm").scalar(), g.select("gs").scalar())
    return v.join(st, "unit").withColumn("b", out).groupBy("unit").agg(F.round(F.avg("b"), 4).alias("blended"))


@query("k10_paste_donors", f"""{with_('voxels')}, c AS (SELECT unit, x, y, z, v, CASE WHEN (x + z) % 17 <> 0 THEN v END AS donor, abs(x - 25) <= 4 AS inside, abs(x - 25) <= 7 AS near,
  (abs(x - 25) - 4) * 0.4e0 AS dist FROM voxels),
s AS (SELECT unit, avg(v) FILTER (near AND NOT inside) AS m, count(*) FILTER (near AND NOT inside) AS n, stddev_pop(v) FILTER (near AND NOT inside) AS sd, avg(v) FILTER (inside) AS i,
  avg(donor) FILTER (inside) AS dm, stddev_pop(donor) FILTER (inside) AS ds FROM c GROUP BY 1),
t AS (SELECT *, coalesce(m, i, 0) AS mt, greatest(CASE WHEN n > 1 THEN sd ELSE 1 END, 1e-6) AS st, CASE WHEN ds > 1e-6 THEN ds ELSE 1 END AS own FROM c JOIN s USING (unit)),
o AS (SELECT unit, CASE WHEN inside THEN coalesce((donor - dm) / own, 0) * st + mt WHEN near AND dist < 1 THEN (1 - dist) * mt + dist * v ELSE v END AS v,
  CASE WHEN inside THEN 'inside' WHEN near AND dist < 1 THEN 'shell' END AS part FROM t)
SELECT unit, part, count(*) AS n, round(avg(v), 4) AS mean FROM o GROUP BY 1, 2""")
def _(spark, d):
    v = bound(spark, d, "voxels").drop("copies")
    off = F.abs(F.col("x") - 25)
    cells = v.filter(off <= 7).select(
        "unit", "x", "y", "z", F.when((F.col("x") + F.col("z")) % 17 != 0, F.col("v")).alias("donor"), F.when(off <= 4, "inside").otherwise("shell").alias("part"), ((off - 4) * 0.4).alias("dist"))
    return K.paste_donors(v, cells).groupBy("unit", "part").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("k12_latest_run", "SELECT o_custkey AS experiment, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("run"))
    return K.latest_run(o)


@query("k13_cluster_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) t WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 12 WHEN 'HOUSEHOLD' THEN 1 END")
def _(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return K.cluster_sample(c, {"BUILDING": 5, "MACHINERY": 12, "HOUSEHOLD": 1}, "c_mktsegment", [F.col("c_custkey")])


# --- quality ------------------------------------------------------------------------------------

MAN = """m AS (SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 10 = 9 THEN 'holdout' ELSE 'cv' END AS cohort, CASE WHEN o_orderkey % 10 = 9 AND o_orderpriority <> '5-LOW' THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS fold,
CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CASE WHEN o_orderstatus <> 'O' THEN 'm' END AS mask FROM orders)"""


def man(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("unit"), F.when(k % 10 == 9, "holdout").otherwise("cv").alias("cohort"),
        F.when(~((k % 10 == 9) & (F.col("o_orderpriority") != "5-LOW")), (k % 6).cast("int")).alias("fold"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), F.when(F.col("o_orderstatus") != "O", "m").alias("mask"))


@query("q1_manifest_invariants", f"""WITH {MAN} SELECT unit, 'holdout_fold' AS rule FROM m WHERE (cohort = 'holdout') <> (fold IS NULL) UNION ALL SELECT unit, 'positive_mask' FROM m WHERE (label = 1) <> (mask IS NOT NULL)
UNION ALL SELECT unit, 'fold_range' FROM m WHERE fold >= 5 UNION ALL SELECT unit, 'duplicate_id' FROM m GROUP BY unit HAVING count(*) > 1""")
def _(spark, d):
    return Q.manifest_invariants(man(spark, d), 5)


@query("q2_box_invariants", f"""{with_('boxes')}, b AS (SELECT unit, slice_y, x1, z1, x2, z2, x1 AS cc_id FROM boxes), u AS (SELECT s_suppkey AS unit, 18 AS n_slices, s_nationkey % 2 AS label, 12 AS n_components FROM supplier), j AS (SELECT * FROM b LEFT JOIN u USING (unit)),
v AS (SELECT unit, 'bounds' AS rule FROM j WHERE x2 > 96 OR z2 > 100 UNION ALL SELECT unit, 'slice_range' FROM j WHERE slice_y >= n_slices UNION ALL SELECT unit, 'not_positive' FROM j WHERE coalesce(label, 0) <> 1
UNION ALL SELECT u.unit, 'component_count' FROM u LEFT JOIN (SELECT unit, count(DISTINCT cc_id) AS k FROM b GROUP BY 1) h USING (unit) WHERE label = 1 AND coalesce(k, 0) <> n_components) SELECT unit, rule, count(*) AS n FROM v GROUP BY 1, 2""")
def _(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.lit(18).alias("n_slices"), (F.col("s_nationkey") % 2).alias("label"), F.lit(12).alias("n_components"))
    return Q.box_invariants(bound(spark, d, "boxes").withColumn("cc_id", F.col("x1")), u, 96, 100).groupBy("unit", "rule").agg(n_())


@query("q3_cross_agreement", """WITH j AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 <> CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey % 5 END)
SELECT 'fold_agrees' AS "check", n = 0 AS ok, n AS detail FROM j UNION ALL SELECT 'one_version_a', count(DISTINCT o_orderstatus) = 1, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'one_version_b', true, 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.select(k.alias("unit"), (k % 5).alias("fold"), F.col("o_orderstatus").alias("code_version"))
    b = o.select(k.alias("unit"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(k % 5).alias("fold"), F.lit("v1").alias("code_version"))
    return Q.cross_agreement(a, b)


@query("q4_all_true", "SELECT l_suppkey, bool_and(l_tax < 0.08 AND l_discount < 0.1) AS aligned, CAST(sum(CASE WHEN l_tax < 0.08 AND l_discount < 0.1 THEN 0 ELSE 1 END) AS BIGINT) AS n_bad FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_tax") < 0.08, "b": F.col("l_discount") < 0.1})
    return Q.all_true(li, ["a", "b"], ["l_suppkey"])


@query("q5_contrast_tiers", "SELECT CASE WHEN c_acctbal / 1e4 < 0 THEN 'fail' WHEN c_acctbal / 1e4 < 0.121 THEN 'warn' ELSE 'ok' END AS severity, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("contrast_z", F.col("c_acctbal") / 10000.0)
    return Q.contrast_tiers(c).groupBy("severity").agg(n_())


@query("q6_run_gates", f"""WITH {HIST}, p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY epoch) AS p FROM l),
g AS (SELECT key, coalesce(bool_and(CASE WHEN p IS NOT NULL THEN value < p END), false) AS d, coalesce(bool_and(CASE WHEN p IS NOT NULL THEN value <= p * 1.05e0 END), false) AS w, max(value) = 0 AS z FROM p GROUP BY key),
c(key, gate) AS (VALUES ('click', 'decreasing'), ('view', 'decreasing'), ('signup', 'within'), ('error', 'all_zero'), ('absent', 'all_zero'))
SELECT c.key, gate, CASE WHEN coalesce(CASE gate WHEN 'decreasing' THEN d WHEN 'within' THEN w ELSE coalesce(z, true) END, false) THEN 'PASS' ELSE 'FAIL' END AS result FROM c LEFT JOIN g USING (key)""")
def _(spark, d):
    return Q.run_gates(history(spark, d), ["click", "view"], ["signup"], ["error", "absent"])


@query("q7_migration_preflight", """WITH p AS (SELECT o_orderkey AS src, o_custkey AS id, o_custkey || o_orderstatus AS dst FROM orders), f AS (SELECT l_orderkey AS src, sum(l_linenumber) AS length FROM lineitem GROUP BY 1), j AS (SELECT * FROM p LEFT JOIN f USING (src))
SELECT 'missing_source' AS "check", count(*) AS n, count(*) = 0 AS ok FROM j WHERE length IS NULL UNION ALL SELECT 'duplicate_target', count(*), count(*) = 0 FROM (SELECT dst FROM p GROUP BY dst HAVING count(*) > 1) t
UNION ALL SELECT 'unmapped_id', count(*), count(*) = 0 FROM (SELECT DISTINCT id FROM p WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) t UNION ALL SELECT 'row_count', count(*), count(*) = 15000 FROM p
UNION ALL SELECT 'total_bytes', CAST(coalesce(sum(length), 0) AS BIGINT), true FROM j""")
def _(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), "o_orderstatus").alias("dst"))
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.sum("l_linenumber").alias("length"))
    ids = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return Q.migration_preflight(p, f, ids, 15000)


@query("q8_qc_summary", "SELECT read_status AS status, count(*) AS n, read_status <> 'ok' AS flagged FROM (" + with_("series").split("AS (", 1)[1].rsplit(")", 1)[0] + ") s GROUP BY 1")
def _(spark, d):
    return Q.qc_summary(bound(spark, d, "series").withColumnRenamed("read_status", "status"))


@query("q9_update_ledger", """WITH l AS (SELECT c_custkey AS id, 'old' AS reason FROM customer WHERE c_acctbal < 0), f AS (SELECT c_custkey AS id, 'new' AS reason FROM customer WHERE c_acctbal < 500), x AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5)
SELECT * FROM l WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT * FROM f WHERE id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM l)""")
def _(spark, d):
    c = table(spark, d, "customer")
    of = lambda cond, why: c.filter(cond).select(F.col("c_custkey").alias("id"), F.lit(why).alias("reason"))
    return Q.update_ledger(of("c_acctbal < 0", "old"), of("c_acctbal < 500", "new"), of("c_nationkey < 5", "x"))


# --- files --------------------------------------------------------------------------------------


def tmp(spark, name):
    return f"{runtime.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_read_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    p = tmp(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(p)
    return S.read_csv(spark, p, "c_custkey long, c_name string, c_acctbal double")


@query("s2_read_manifest", "SELECT o_orderkey AS unit, o_orderstatus AS status, o_totalprice AS price FROM orders")
def _(spark, d):
    p = tmp(spark, "manifest")
    CO.to_nested(table(spark, d, "orders"), {"unit": "o_orderkey", "rec": {"status": "o_orderstatus", "price": "o_totalprice"}}).write.json(p)
    return S.read_manifest(spark, p, "unit long, rec struct<status:string,price:double>").select("unit", "rec.status", "rec.price")


@query("s3_read_donors", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def _(spark, d):
    p = tmp(spark, "donors")
    table(spark, d, "documents").select("doc_id", "lang", "n_chars").write.json(p)
    return S.read_donors(spark, p, "doc_id long, lang string, n_chars long", F.col("n_chars") > 1000).drop("n_chars")


@query("s4_boxes_parquet", f"{with_('boxes')} SELECT CAST(unit AS VARCHAR) AS unit, slice_y, count(*) AS n, CAST(sum(x1) AS BIGINT) AS s FROM boxes GROUP BY 1, 2")
def _(spark, d):
    p = tmp(spark, "boxes")
    S.write_boxes(bound(spark, d, "boxes").withColumns({"cc_id": F.lit(1), "box_max_dim_mm": B.max_dim_mm()}), p)
    return S.read_boxes(spark, p).groupBy("unit", "slice_y").agg(n_(), F.sum("x1").alias("s"))


@query("s5_read_parts", "SELECT source AS part, doc_id, n_chars FROM documents")
def _(spark, d):
    p = tmp(spark, "parts")
    table(spark, d, "documents").select("source", "doc_id", "n_chars").write.partitionBy("source").option("header", True).csv(p)
    r = S.read_parts(spark, f"{p}/*/*.csv", "doc_id long, n_chars long", "part_file")
    return r.select(F.regexp_extract(F.input_file_name(), "source=([^/]+)/", 1).alias("part"), "doc_id", "n_chars")


@query("s6_list_files")
def _(spark, d):
    return S.list_files(spark, d, "*.parquet", 1).select("name", "length")


@query("s7_file_hashes")
def _(spark, d):
    return S.file_hashes(spark, d, "*.parquet").select("name", "length", "sha256")


@query("s8_write_verified", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    return S.write_verified(table(spark, d, "labels"), tmp(spark, "verified"))


@query("s9_append_report", """SELECT run_id, c_mktsegment AS metric, count(*) AS value FROM customer, (VALUES ('r1'), ('r2')) t(run_id) GROUP BY 1, 2""")
def _(spark, d):
    p = tmp(spark, "report")
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("metric")).agg(F.count("*").alias("value"))
    for r in ("r1", "r2"):
        S.append_report(rows, p, r)
    return spark.read.parquet(p).select("run_id", "metric", "value")


@query("s10_replace_table", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def _(spark, d):
    p = tmp(spark, "table")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    S.replace_table(s, p)
    S.replace_table(s.withColumn("s_acctbal", F.col("s_acctbal") + 1), p)
    return spark.read.parquet(p)


@query("s10_publish_table", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def _(spark, d):
    p = tmp(spark, "published")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    first = S.publish_table(s, p)
    S.publish_table(S.read_published(spark, p).withColumn("s_acctbal", F.col("s_acctbal") + 1), p, expected=first)
    return S.read_published(spark, p)


@query("s11_upsert_by_key", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'new' ELSE c_mktsegment END AS seg FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return S.upsert_by_key(old, c.filter("c_nationkey < 5").select("c_custkey", F.lit("new").alias("seg")), "c_custkey")


@query("s12_write_calls", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders")
def _(spark, d):
    p = tmp(spark, "calls")
    S.write_calls(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score")), p)
    return spark.read.schema("o_orderkey long, score double").json(p)


@query("s13_write_id_list", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders")
def _(spark, d):
    p = tmp(spark, "ids")
    S.write_id_list(table(spark, d, "orders"), p, "o_custkey")
    return spark.read.text(p)


@query("s14_ingest_parts", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    o = table(spark, d, "orders")
    done = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    return S.ingest_parts(o.select(F.col("o_orderkey").alias("id")), done)


# --- streams ------------------------------------------------------------------------------------


def event_stream(spark, d, parts: int = 4):
    """Events as files written in step order, read one file per micro-batch."""
    p = tmp(spark, "events")
    e = bound(spark, d, "steps").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.coalesce(F.min("step"), F.lit(0)), F.coalesce(F.max("step"), F.lit(0))).first()
    part = F.least(F.floor((F.col("step") - lo) * parts / F.lit(hi - lo + 1)), F.lit(parts - 1))
    for k in range(parts):  # the source takes files in order of their times
        e.filter(part == k).coalesce(1).write.mode("append").parquet(p)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(p)


@query("t1_score_ema_stream", f"{with_('steps', recursive=True)}, {EMA} SELECT unit, slice_y, round(ema + 1e-9, 6) AS ema, n_updates FROM fin")
def _(spark, d):
    s = event_stream(spark, d)
    state, ck = tmp(spark, "state"), tmp(spark, "ck")
    T.ema_stream(s, state, ck)
    out = T.ema_state(spark, state, [s.schema["unit"], s.schema["slice_y"]])
    return out.select("unit", "slice_y", F.round(F.col("ema") + 1e-9, 6).alias("ema"), "n_updates")


@query("t1_score_ema_keyed", f"{with_('steps', recursive=True)}, {EMA} SELECT unit, slice_y, round(ema + 1e-9, 6) AS ema, n_updates FROM fin")
def _(spark, d):
    s = event_stream(spark, d, parts=8)
    sink = tmp(spark, "ema")
    T.ema_keyed_stream(s, sink, tmp(spark, "ck"))
    out = T.ema_state(spark, sink, [s.schema["unit"], s.schema["slice_y"]])
    return out.select("unit", "slice_y", F.round(F.col("ema") + 1e-9, 6).alias("ema"), "n_updates")


@query("t2_progress_stream", """WITH w AS (SELECT event_type, unnest(range(0, 20)) AS k, CAST(floor(epoch(ts) / 30) AS BIGINT) * 30 AS b FROM events)
SELECT b - k * 30 AS start_sec, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
round(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / 1e1, 6) AS rate_per_min FROM w GROUP BY 1""")
def _(spark, d):
    c = {"done": F.col("kind") != "error", "failed": F.col("kind") == "error"}
    w = T.run_windows(T.window_counts(event_stream(spark, d), "10 minutes", "30 seconds", "1 day", c), tmp(spark, "win"), tmp(spark, "ck"))
    return T.progress(w, 10.0).select(F.unix_timestamp("start").alias("start_sec"), "done", "failed", r6("rate_per_min"))


@query("t3_ingest_stream", "SELECT user_id AS id, CASE WHEN bool_or(event_type <> 'error') THEN 'ok' ELSE 'failed' END AS status FROM events GROUP BY 1")
def _(spark, d):
    s = event_stream(spark, d).select(F.col("unit").alias("id"), F.when(F.col("kind") == "error", "failed").otherwise("ok").alias("status"))
    return T.ingest_stream(s, tmp(spark, "sink"), tmp(spark, "ck"))


@query("t4_anomaly_stream", """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_sec, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM events GROUP BY 1 HAVING bad > 3""")
def _(spark, d):
    w = T.run_windows(T.window_counts(event_stream(spark, d), "1 hour", None, "1 day", {"bad": F.col("kind") == "error"}), tmp(spark, "win"), tmp(spark, "ck"))
    return T.anomalies(w, "bad", 3).select(F.unix_timestamp("start").alias("start_sec"), "bad")


# --- user hooks ---------------------------------------------------------------------------------


@query("x1_bootstrap_udf", f"""{with_('units_small')}, idx AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n0 FROM units_small),
rep AS (SELECT b, quantile_cont(score, 0.5) AS s FROM (SELECT b, {HASH("'42'", 'b', 'i', digits=15)} % n0 AS i FROM idx, range(1000) r(b)) d JOIN idx USING (i) GROUP BY b) SELECT round(quantile_cont(s, 0.025), 6) AS ci_lower, round(quantile_cont(s, 0.975), 6) AS ci_upper FROM rep""")
def _(spark, d):
    import numpy as np

    return M.bootstrap_udf(bound(spark, d, "units_small"), ["unit"], np.median, ["score"], 1000).select(r6("ci_lower"), r6("ci_upper"))


@query("x2_score_batches", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) / 64, 5) AS score FROM embeddings")
def _(spark, d):
    def predict(pdf):
        import numpy as np

        w = np.arange(1, 65, dtype="float64") / 64
        return pdf[["vec_id"]].assign(score=np.stack(pdf["embedding"].to_list()).astype("float64") @ w)

    s = BT.score_batches(table(spark, d, "embeddings").select("vec_id", "embedding"), predict, "vec_id long, score double")
    return s.select("vec_id", F.round("score", 5).alias("score"))


@query("x3_per_unit", "SELECT conv_id, count(*) AS n_turns, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY 1")
def _(spark, d):
    def worker(pdf):
        import pandas as pd

        return pd.DataFrame({"conv_id": [pdf.conv_id.iloc[0]], "n_turns": [len(pdf)], "longest": [int(pdf.text.str.len().max())]})

    return BT.per_unit(table(spark, d, "conversations"), ["conv_id"], worker, "conv_id long, n_turns long, longest long")


@query("x4_table_generators", """SELECT doc_id, CAST(i - 1 AS INT) AS idx, CASE WHEN n > 0 THEN l[i] END AS file, CAST(n AS INT) AS n_listed FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS l, len(list_filter(string_split(text, chr(10)), lambda s: s <> '')) AS n FROM documents) t, LATERAL (SELECT unnest(range(1, greatest(n, 1) + 1)) AS i) u""")
def _(spark, d):
    return BT.file_rows(table(spark, d, "documents").select("doc_id", "text"), "text", "\n").drop("text")
