"""Cohort building on the bound series, order and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldscope.operators import cohort as C
from foldscope.plans.bindings import bound, table, with_
from foldscope.plans.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
n_ = lambda: F.count("*").alias("n")

RULES_SQL = """tag AS (SELECT *, CASE WHEN unit % 50 = 7 THEN 'excluded' WHEN read_status = 'empty_folder' THEN 'empty_folder' WHEN descr IN ('de') THEN 'wrong_type' END AS reason FROM series)"""


def rules():
    return [("excluded", F.col("unit") % 50 == 7), ("empty_folder", F.col("read_status") == "empty_folder"), ("wrong_type", F.col("descr").isin("de"))]


@query("p1_filter_with_log", f"{with_('series')}, {RULES_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, CAST(sum(series) AS BIGINT) AS s FROM tag GROUP BY 1")
def _(spark, d):
    kept, skipped = C.filter_with_log(bound(spark, d, "series"), rules())
    both = kept.withColumn("reason", F.lit("kept")).unionByName(skipped)
    return both.groupBy("reason").agg(n_(), F.sum("series").alias("s"))


@query("p2_to_nested", """SELECT o_orderkey AS id, {'status': o_orderstatus, 'price': {'total': o_totalprice, 'priority': o_orderpriority}} AS rec FROM orders""")
def _(spark, d):
    return C.to_nested(table(spark, d, "orders"), {"id": "o_orderkey", "rec": {"status": "o_orderstatus", "price": {"total": "o_totalprice", "priority": "o_orderpriority"}}})


CANON_SQL = """fr AS (SELECT descr, count(*) AS f FROM series WHERE token = 'WATER' GROUP BY 1),
can AS (SELECT unit, arg_min(series, (-f, -n_files, series)) AS series FROM series JOIN fr USING (descr) WHERE token = 'WATER' GROUP BY unit)"""


@query("p3_assign_roles", f"""{with_('series')}, {CANON_SQL}, j AS (SELECT s.*, c.series IS NOT NULL AS c FROM series s LEFT JOIN can c ON c.unit = s.unit AND c.series = s.series),
r AS (SELECT *, row_number() OVER (PARTITION BY unit, token, c ORDER BY descr, series) AS k, CASE token WHEN 'WATER' THEN 'water_alt' ELSE 'fat' END AS p FROM j)
SELECT unit, series, CASE WHEN c THEN 'canonical' ELSE p END AS role, CASE WHEN c THEN 'canonical' ELSE printf('%s_%02d', p, k) END AS basename FROM r""")
def _(spark, d):
    return C.assign_roles(bound(spark, d, "series"), {"WATER": "water_alt", "FAT": "fat"}).select("unit", "series", "role", "basename")


@query("w1_pick_canonical", f"{with_('series')}, {CANON_SQL} SELECT unit, series FROM can")
def _(spark, d):
    return C.pick_canonical(bound(spark, d, "series").filter("token = 'WATER'")).select("unit", "series")


SPLIT_SQL = "CASE WHEN o_orderkey % 10 = 9 THEN 'holdout' ELSE 'fold' || (o_orderkey % 5) END"


@query("p4_split_to_fold", f"""WITH s AS (SELECT {SPLIT_SQL} AS split FROM orders) SELECT CASE WHEN split = 'holdout' THEN 'holdout' ELSE 'cross-validation' END AS cohort,
CASE WHEN split <> 'holdout' THEN CAST(substr(split, 5) AS INT) END AS fold, count(*) AS n FROM s GROUP BY 1, 2""")
def _(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.when(k % 10 == 9, "holdout").otherwise(F.concat(F.lit("fold"), (k % 5).cast("string"))).alias("split"))
    cohort, fold = C.split_to_fold(F.col("split"))
    return s.groupBy(cohort.alias("cohort"), fold.alias("fold")).agg(n_())


@query("p5_fold_split", f"""{with_('units')} SELECT CAST(f AS INT) AS run_fold, CASE WHEN cohort = 'holdout' THEN 'holdout' WHEN fold = f THEN 'val' ELSE 'train' END AS role, count(*) AS n, sum(label) AS n_pos
FROM units, range(5) r(f) GROUP BY 1, 2""")
def _(spark, d):
    return C.fold_split(bound(spark, d, "units"), 5).groupBy("run_fold", "role").agg(n_(), F.sum("label").alias("n_pos"))


@query("p6_guard_holdout", f"{with_('units')} SELECT cohort, count(*) AS n, false AS stopped FROM units WHERE cohort <> 'holdout' GROUP BY 1 UNION ALL SELECT 'holdout', count(*), true FROM units WHERE cohort = 'holdout'")
def _(spark, d):
    """Rows that pass the guard, and the holdout rows with whether the guard stops on them."""
    u = bound(spark, d, "units")
    passed = C.guard_holdout(u.filter("cohort <> 'holdout'")).groupBy("cohort").agg(n_())
    try:
        C.guard_holdout(u).write.format("noop").mode("overwrite").save()
        stopped = False
    except Exception as e:
        stopped = "holdout" in str(e)
    held = u.filter("cohort = 'holdout'").groupBy("cohort").agg(n_())
    return passed.withColumn("stopped", F.lit(False)).unionByName(held.withColumn("stopped", F.lit(stopped)))


@query("p13_reclassify", f"""{with_('series')}, e AS (SELECT DISTINCT unit FROM series WHERE n_files > 5000)
SELECT CASE WHEN s.cohort = 'pos' AND e.unit IS NULL THEN 'neg' ELSE s.cohort END AS cohort, s.cohort = 'pos' AND e.unit IS NULL AS soft_negative, count(*) AS n FROM series s LEFT JOIN e USING (unit) GROUP BY 1, 2""")
def _(spark, d):
    s = bound(spark, d, "series")
    return C.reclassify(s, s.filter("n_files > 5000")).groupBy("cohort", "soft_negative").agg(n_())


@query("p14_backfill", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS v FROM customer), s AS (SELECT c_custkey AS k, c_name AS v FROM customer)
SELECT a.k, coalesce(nullif(trim(a.v), ''), s.v) AS v FROM a LEFT JOIN s USING (k)""")
def _(spark, d):
    c = table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, None).otherwise(F.col("c_mktsegment")).alias("v"))
    return C.backfill(a, c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), "k", "v")


@query("p15_shard", "SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS INT) AS shard FROM orders")
def _(spark, d):
    return C.shard(table(spark, d, "orders").select("o_orderkey"), 16, ["o_orderkey"])


@query("p16_build_queue", """SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1 LIMIT 40""")
def _(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    q, _miss = C.build_queue(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", of("F"), of("O"), of("P"), 40)
    return q


@query("p17_derive_flags", "SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_core, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS bucket, count(*) AS n FROM customer GROUP BY 1, 2")
def _(spark, d):
    b = F.col("c_acctbal")
    f = C.derive_flags(table(spark, d, "customer"), {"is_core": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "bucket": F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high")})
    return f.groupBy("is_core", "bucket").agg(n_())


# --- joins --------------------------------------------------------------------------------------


@query("j1_join_scan", "SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return C.join_scan(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment", "c_acctbal"]).drop("o_custkey")


@query("j2_annotate_splits", f"WITH sp AS (SELECT o_orderkey AS unit, {SPLIT_SQL} AS split FROM orders WHERE o_orderstatus <> 'P') SELECT split, split IS NOT NULL AS in_splits, count(*) AS n FROM orders LEFT JOIN sp ON unit = o_orderkey GROUP BY 1, 2")
def _(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    sp = o.filter("o_orderstatus <> 'P'").select(k.alias("unit"), F.when(k % 10 == 9, "holdout").otherwise(F.concat(F.lit("fold"), (k % 5).cast("string"))).alias("split"))
    return C.annotate_splits(o.select(k.alias("unit")), sp).groupBy("split", "in_splits").agg(n_())


OLD_NEW = """o AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_acctbal < 9000),
n AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 8000 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal < -500 THEN c_nationkey + 1 ELSE c_nationkey END AS nat FROM customer WHERE c_acctbal > -900)"""


def old_new(spark, d):
    c, b = table(spark, d, "customer"), F.col("c_acctbal")
    o = c.filter(b < 9000).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    n = c.filter(b > -900).select(F.col("c_custkey").alias("k"), F.when(b <= 8000, F.col("c_mktsegment")).alias("seg"), F.when(b < -500, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("nat"))
    return o, n


@query("j3_snapshot_diff", f"""WITH {OLD_NEW}, j AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NULL AS added, n.k IS NULL AS removed, CASE WHEN o.k IS NOT NULL THEN coalesce(o.seg, '') END AS os, CASE WHEN n.k IS NOT NULL THEN coalesce(n.seg, '') END AS ns,
CASE WHEN o.k IS NOT NULL THEN coalesce(o.nat::VARCHAR, '') END AS on_, CASE WHEN n.k IS NOT NULL THEN coalesce(n.nat::VARCHAR, '') END AS nn FROM o FULL JOIN n ON o.k = n.k),
c AS (SELECT k, added, removed, 'seg' AS col, os AS old, ns AS new FROM j UNION ALL SELECT k, added, removed, 'nat', on_, nn FROM j)
SELECT k, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS status, col, old, new FROM c WHERE old IS DISTINCT FROM new""")
def _(spark, d):
    return C.snapshot_diff(*old_new(spark, d), "k", ["seg", "nat"])


@query("j4_assert_unchanged", f"WITH {OLD_NEW} SELECT o.k, o.seg, n.seg AS new_hash FROM o LEFT JOIN n ON o.k = n.k WHERE o.nat >= 5 AND o.seg IS DISTINCT FROM n.seg")
def _(spark, d):
    o, n = old_new(spark, d)
    return C.assert_unchanged(o, n, "k", "seg", o.filter("nat < 5"))


@query("j5_restrict", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.restrict(table(spark, d, "orders"), ids, ["o_custkey"]).agg(n_(), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("j6_exclude", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.exclude(table(spark, d, "orders"), ids, ["o_custkey"]).agg(n_(), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("j7_crosswalk", """WITH m AS (SELECT doc_id AS unit, CAST(n_chars % 2 AS INT) AS label FROM documents), sp AS (SELECT doc_id AS unit FROM documents WHERE lang <> 'es')
SELECT m.unit, 'no_sidecar' AS violation FROM m WHERE unit NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT unit, 'no_split' FROM m WHERE unit NOT IN (SELECT unit FROM sp)
UNION ALL SELECT m.unit, 'label_mismatch' FROM m JOIN labels ON doc_id = unit WHERE quality <> label""")
def _(spark, d):
    docs = table(spark, d, "documents")
    m = docs.select(F.col("doc_id").alias("unit"), (F.col("n_chars") % 2).cast("int").alias("label"))
    sc = table(spark, d, "labels").select(F.col("doc_id").alias("unit"), F.col("quality").alias("label"))
    sp = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("unit"), F.lit("fold0").alias("split"))
    return C.crosswalk(m, sc, sp)[1]


@query("j8_keep_best_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey)")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return C.keep_best_rank(li, "l_orderkey", "l_linenumber")


MASKS = """masks AS (SELECT o_orderkey AS mask, o_custkey AS unit, [CAST(o_orderkey % 40 AS INT), CAST(floor(o_totalprice) AS BIGINT)::INT % 60 + 40, 400] AS dims, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'none' END AS suffix FROM orders),
ser AS (SELECT l_suppkey AS unit, l_orderkey * 10 + l_linenumber AS series, CAST(l_quantity AS INT) AS n_files, min(l_linestatus) AS descr FROM lineitem GROUP BY 1, 2, 3)"""


def masks_series(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("mask"), F.col("o_custkey").alias("unit"),
        F.array((F.col("o_orderkey") % 40).cast("int"), (F.floor("o_totalprice") % 60 + 40).cast("int"), F.lit(400)).alias("dims"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise("none").alias("suffix"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("series"), F.col("l_quantity").cast("int").alias("n_files")).agg(F.min("l_linestatus").alias("descr"))
    return o, s


NEAR = """near AS (SELECT m.unit, m.mask, min(s.series) AS series, min(list_min(list_transform(m.dims, lambda x: abs(x - s.n_files)))) AS diff FROM masks m JOIN ser s ON s.unit = m.unit AND list_min(list_transform(m.dims, lambda x: abs(x - s.n_files))) <= 2
GROUP BY 1, 2 HAVING count(DISTINCT s.series) = 1)"""


@query("j11_nearest_match", f"WITH {MASKS}, {NEAR} SELECT unit, mask, series, CAST(diff AS INT) AS diff FROM near")
def _(spark, d):
    return C.nearest_match(*masks_series(spark, d)).select("unit", "mask", "series", "diff")


@query("j12_cascade_match", f"""WITH {MASKS}, {NEAR}, ex AS (SELECT m.unit, m.mask, min(s.series) AS series FROM masks m JOIN ser s ON s.unit = m.unit AND s.descr = m.suffix GROUP BY 1, 2),
one AS (SELECT unit, min(series) AS series FROM ser GROUP BY 1 HAVING count(DISTINCT series) = 1)
SELECT m.unit, m.mask, coalesce(ex.series, near.series, one.series) AS series, CASE WHEN ex.series IS NOT NULL THEN 'exact_name' WHEN near.series IS NOT NULL THEN 'nearest_dim' WHEN one.series IS NOT NULL THEN 'single_series' ELSE 'no_match' END AS method
FROM masks m LEFT JOIN ex USING (unit, mask) LEFT JOIN near USING (unit, mask) LEFT JOIN one USING (unit)""")
def _(spark, d):
    return C.cascade_match(*masks_series(spark, d)).select("unit", "mask", "series", "method")


@query("j13_shape_match", """WITH m AS (SELECT p_partkey AS mask, p_brand AS unit, [p_size, p_partkey % 3, 7] AS dims FROM part), v AS (SELECT p_name || p_partkey AS file, p_brand AS unit, p_partkey % 5 AS pref, [7, p_size, p_partkey % 3] AS dims FROM part)
SELECT m.unit, m.mask, arg_min(file, (pref, file)) AS file FROM m JOIN v ON v.unit = m.unit AND list_sort(v.dims) = list_sort(m.dims) GROUP BY 1, 2""")
def _(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    m = p.select(k.alias("mask"), F.col("p_brand").alias("unit"), F.array(F.col("p_size").cast("long"), k % 3, F.lit(7).cast("long")).alias("dims"))
    v = p.select(F.concat("p_name", k.cast("string")).alias("file"), F.col("p_brand").alias("unit"), (k % 5).alias("pref"), F.array(F.lit(7).cast("long"), F.col("p_size").cast("long"), k % 3).alias("dims"))
    return C.shape_match(m, v).select("unit", "mask", "file")


@query("j14_prefix_map", r"""SELECT url AS file, regexp_extract(url, '^http://([a-z]+)\.', 1) AS id, n.k FROM pages LEFT JOIN (SELECT regexp_extract(url, '^http://([a-z]+)\.', 1) AS id, count(*) AS k FROM pages GROUP BY 1 HAVING count(*) > 1) n ON n.id = regexp_extract(url, '^http://([a-z]+)\.', 1)""")
def _(spark, d):
    f = table(spark, d, "pages").select(F.col("url").alias("file"))
    rx = r"^http://([a-z]+)\."
    ids = f.groupBy(F.regexp_extract("file", rx, 1).alias("id")).agg(F.count("*").alias("k")).filter("k > 1")
    return C.prefix_map(f, ids, rx).select("file", "id", "k")


@query("j21_preflight", """WITH f AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'error' ELSE 'warning' END AS severity, CASE WHEN n IS NULL THEN 'missing_source' ELSE 'count_mismatch' END AS "check", count(*) AS n
FROM orders LEFT JOIN f ON k = o_orderkey WHERE n IS NULL OR n <> 4 GROUP BY 1, 2""")
def _(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(4).alias("n_expected"))
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("n_files"))
    return C.preflight(plan, files).groupBy("severity", "check").agg(n_())


@query("j22_attach", "SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return C.attach(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", ["n_name", "n_regionkey"]).drop("s_nationkey")


# --- aggregates ---------------------------------------------------------------------------------


@query("a1_count_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return C.count_by(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a2_fold_summary", f"{with_('units')} SELECT cohort, CASE WHEN cohort <> 'holdout' THEN fold END AS fold, count(*) AS n, sum(label) AS n_pos, count(*) - sum(label) AS n_neg FROM units GROUP BY 1, 2")
def _(spark, d):
    return C.fold_summary(bound(spark, d, "units"))


@query("a3_check_counts", """WITH h AS (SELECT c_mktsegment AS seg, count(*) AS a FROM customer GROUP BY 1), e AS (SELECT upper(p_type) AS seg, count(*) AS e FROM part GROUP BY 1 UNION ALL SELECT 'BUILDING', 312)
SELECT seg, coalesce(a, 0) AS actual, coalesce(e, 0) AS expected, coalesce(a, 0) = coalesce(e, 0) AS ok FROM h FULL JOIN e USING (seg)""")
def _(spark, d):
    exp = table(spark, d, "part").groupBy(F.upper("p_type").alias("seg")).agg(F.count("*").alias("expected"))
    exp = exp.unionByName(spark.range(1).select(F.lit("BUILDING").alias("seg"), F.lit(312).cast("long").alias("expected")))
    return C.check_counts(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "seg"), exp, ["seg"])


@query("a4_value_freq", "SELECT source, count(*) AS freq FROM documents GROUP BY 1")
def _(spark, d):
    return C.value_freq(table(spark, d, "documents"), "source")


@query("a5_n_unique", "SELECT count(DISTINCT o_custkey) AS n_unique FROM orders")
def _(spark, d):
    return C.n_unique(table(spark, d, "orders"), "o_custkey")


QZ = "round_even(round_even(l_discount / 0.01e0, 0) * 0.01e0, 2)"


@query("a6_binned_mode", f"SELECT {QZ} AS value, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM lineitem), 6) AS pct FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def _(spark, d):
    return C.binned_mode(table(spark, d, "lineitem"), "l_discount").select("value", "n", r6("pct"))


@query("a7_dominant_or_median", f"""WITH c AS (SELECT {QZ} AS v, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT arg_min(v, (-n, v)) AS v, max(n) AS n, sum(n) AS t FROM c)
SELECT CASE WHEN n * 2 > t THEN v ELSE (SELECT round_even(round_even(median(l_discount) / 0.01e0, 0) * 0.01e0, 2) FROM lineitem) END AS chosen FROM m""")
def _(spark, d):
    return C.dominant_or_median(table(spark, d, "lineitem"), "l_discount")


@query("f10_quantize", "SELECT round_even(round_even(l_extendedprice / 0.5e0, 0) * 0.5e0, 2) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(C.quantize(F.col("l_extendedprice"), 0.5).alias("q")).agg(n_())


@query("a18_latency_summary", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n, round(avg(value), 6) AS mean
FROM events WHERE value <> 0 GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    s = C.latency_summary(e, "value", ["event_type"])
    return s.select("event_type", r6("p50"), r6("p90"), r6("p99"), "n", r6("mean"))


@query("a19_run_summary", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS growth, round(avg(l_extendedprice / l_quantity), 4) AS mean_ratio, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "ok").otherwise("failed"))
    s = C.run_summary(li, "l_extendedprice", "l_quantity", by=["l_returnflag"])
    return s.select("l_returnflag", F.round("growth", 4).alias("growth"), F.round("mean_ratio", 4).alias("mean_ratio"), "n_ok", "n")


@query("a20_dataset_summary", f"{with_('units')} SELECT count(DISTINCT cust) AS n_units, count(*) AS n_rows, round(sum(label) / CAST(sum(1 - label) AS DOUBLE), 6) AS pos_neg_ratio FROM units")
def _(spark, d):
    return C.dataset_summary(bound(spark, d, "units"), "cust").select("n_units", "n_rows", r6("pos_neg_ratio"))


@query("a21_presence_breakdown", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS presence, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return C.presence_breakdown(of("F"), of("P"), "id")


EMA = """e AS (SELECT *, row_number() OVER (PARTITION BY unit, slice_y ORDER BY step) AS i FROM steps WHERE NOT is_positive),
rec AS (SELECT unit, slice_y, i, score AS ema FROM e WHERE i = 1 UNION ALL SELECT e.unit, e.slice_y, e.i, 0.9e0 * r.ema + (1 - 0.9e0) * e.score FROM rec r JOIN e ON e.unit = r.unit AND e.slice_y = r.slice_y AND e.i = r.i + 1),
fin AS (SELECT unit, slice_y, arg_max(ema, i) AS ema, max(i) AS n_updates FROM rec GROUP BY 1, 2)"""


def ema(spark, d):
    s = bound(spark, d, "steps").filter("not is_positive")
    return C.score_ema(s, ["unit", "slice_y"], ["step"])


@query("a22_score_ema", f"{with_('steps', recursive=True)}, {EMA} SELECT unit, slice_y, round(ema + 1e-9, 6) AS ema, n_updates FROM fin")
def _(spark, d):
    return ema(spark, d).select("unit", "slice_y", F.round(F.col("ema") + 1e-9, 6).alias("ema"), "n_updates")


@query("a24_gap_pool", "SELECT label, CAST(ch - 1 AS INT) AS channel, round(avg(CAST(embedding[ch] AS DOUBLE)), 6) AS value FROM embeddings, range(1, 65) r(ch) GROUP BY 1, 2")
def _(spark, d):
    return C.gap_pool(table(spark, d, "embeddings").withColumnRenamed("embedding", "feats"), ["label"]).select("label", "channel", r6("value"))


@query("a26_expand_strata", f"""{with_('units')} SELECT 'priority' AS stratum_kind, priority AS stratum_value, count(*) AS n, sum(label) AS n_pos FROM units GROUP BY 2
UNION ALL SELECT 'status', status, count(*), sum(label) FROM units GROUP BY 2 UNION ALL SELECT 'thick', CASE WHEN price > 400000 THEN 'unknown' ELSE 'known' END, count(*), sum(label) FROM units GROUP BY 2""")
def _(spark, d):
    from foldscope.operators.metrics import expand_strata

    kinds = {"priority": F.col("priority"), "status": F.col("status"), "thick": F.when(F.col("price") <= 400000, "known")}
    return expand_strata(bound(spark, d, "units"), kinds).groupBy("stratum_kind", "stratum_value").agg(n_(), F.sum("label").alias("n_pos"))


@query("a27_score_hist", f"{with_('boxes')} SELECT CAST(least(floor(score * 10), 9) + 1 AS INT) AS bucket, count(*) AS n FROM boxes WHERE is_pred GROUP BY 1")
def _(spark, d):
    return C.score_hist(bound(spark, d, "boxes").filter("is_pred"))


# --- windows ------------------------------------------------------------------------------------


@query("w2_pick_subvolume", """WITH m AS (SELECT o_custkey AS unit, o_orderpriority AS file, CAST(min(o_orderkey % 3) AS INT) AS pref FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)
SELECT o.o_custkey AS unit, arg_min(o_orderkey, (coalesce(m.pref, 2147483647), o_orderstatus <> 'F', -floor(o_totalprice / 1000), o_orderkey)) AS idx FROM orders o LEFT JOIN m ON m.unit = o_custkey AND m.file = o_orderpriority GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("kind"), F.floor(F.col("o_totalprice") / 1000).alias("n_slices"), F.col("o_orderkey").alias("idx"))
    m = o.filter("kind = 'P'").groupBy("unit", "file").agg(F.min(F.col("idx") % 3).cast("int").alias("pref"))
    return C.pick_subvolume(o, m, want="F").select("unit", "idx")


BATCH = "b AS (SELECT doc_id % 97 AS unit, source AS batch, count(*) AS n_series FROM documents GROUP BY 1, 2), p AS (SELECT DISTINCT doc_id % 97 AS unit FROM documents WHERE n_chars > 60000)"


def batches(spark, d):
    docs = table(spark, d, "documents")
    b = docs.groupBy((F.col("doc_id") % 97).alias("unit"), F.col("source").alias("batch")).agg(F.count("*").alias("n_series"))
    return b, docs.filter("n_chars > 60000").select((F.col("doc_id") % 97).alias("unit")).distinct()


@query("w3_dedup_batches", f"WITH {BATCH} SELECT unit, arg_min(batch, (-n_series, batch)) AS batch, max(n_series) AS n_series, count(*) - 1 AS n_alternates FROM b WHERE unit NOT IN (SELECT unit FROM p) GROUP BY unit")
def _(spark, d):
    return C.dedup_batches(*batches(spark, d))


@query("w3_batch_alternates", f"WITH {BATCH}, w AS (SELECT unit, arg_min(batch, (-n_series, batch)) AS batch FROM b WHERE unit NOT IN (SELECT unit FROM p) GROUP BY unit) SELECT b.* FROM b JOIN w ON w.unit = b.unit AND w.batch <> b.batch")
def _(spark, d):
    b, p = batches(spark, d)
    return C.batch_alternates(b, C.dedup_batches(b, p))


def alloc_sql(src, name, target):
    return f"""{name}_r AS (SELECT *, {target}::BIGINT * size / CAST((SELECT sum(size) FROM {src}) AS DOUBLE) AS raw FROM {src}),
{name}_f AS (SELECT *, least(floor(raw), size) AS fl, row_number() OVER (ORDER BY raw - least(floor(raw), size) DESC, k) AS rk FROM {name}_r),
{name} AS (SELECT k, size, CAST(fl AS BIGINT) + CASE WHEN rk <= {target} - (SELECT sum(fl) FROM {name}_f) AND fl < size THEN 1 ELSE 0 END AS alloc FROM {name}_f)"""


@query("w5_proportional_alloc", f"WITH s AS (SELECT o_orderpriority || o_orderstatus AS k, count(*) AS size FROM orders GROUP BY 1), {alloc_sql('s', 'al', 1234)} SELECT k, size, alloc FROM al")
def _(spark, d):
    s = table(spark, d, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("k")).agg(F.count("*").alias("size"))
    return C.proportional_alloc(s, 1234, ["k"])


@query("w4_stratified_split", f"""WITH u AS (SELECT o_orderkey AS unit, o_orderpriority AS k FROM orders), s AS (SELECT k, count(*) AS size FROM u GROUP BY 1), {alloc_sql('s', 'h', 100)},
rs AS (SELECT k, size - alloc AS size FROM h), {alloc_sql('rs', 'c', 501)},
r AS (SELECT unit, k, row_number() OVER (PARTITION BY k ORDER BY ('0x' || substr(md5('42:' || unit), 1, 8))::BIGINT, unit) AS rk FROM u)
SELECT unit, k, CASE WHEN rk <= h.alloc THEN 'holdout' WHEN rk - h.alloc - 1 < c.alloc THEN 'fold' || ((rk - h.alloc - 1) % 5) ELSE 'unused' END AS split FROM r JOIN h USING (k) JOIN c USING (k)""")
def _(spark, d):
    u = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("k"))
    return C.stratified_split(u, ["k"], 100, 501, 5)


@query("w6_context_window", """WITH t AS (SELECT conv_id, turn, length(text) AS value FROM conversations), w AS (SELECT conv_id, turn, list(value) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS "window" FROM t)
SELECT * FROM w WHERE len("window") = 5""")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("value"))
    return C.context_window(t, ["conv_id"], "turn")


POS = "SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)"


def signal(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query("w9_regrid_linear", """WITH t AS (SELECT CAST(j AS INT) AS j, j * (63e0 / 77) AS x FROM range(78) r(j)), s AS (SELECT j, x - least(floor(x), 63) AS f, CAST(least(floor(x), 63) AS INT) AS lo FROM t)
SELECT vec_id, j AS i, round(CAST(embedding[lo + 1] AS DOUBLE) * (1 - f) + coalesce(CAST(embedding[lo + 2] AS DOUBLE), 0) * f, 6) AS v FROM embeddings, s""")
def _(spark, d):
    return C.regrid(signal(spark, d), ["vec_id"], "i", "v", 64, 1.0, 0.82).select("vec_id", "i", r6("v"))


@query("w9_regrid_nearest", f"WITH p AS ({POS}), t AS (SELECT CAST(j AS INT) AS j, j * (63e0 / 77) AS x FROM range(78) r(j)) SELECT vec_id, t.j AS i, round(v, 6) AS v FROM t JOIN p ON p.i = least(floor(x + 0.5), 63)")
def _(spark, d):
    return C.regrid(signal(spark, d), ["vec_id"], "i", "v", 64, 1.0, 0.82, 0).select("vec_id", "i", r6("v"))


@query("w9_regrid_per_unit", """WITH u AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 82 WHEN 1 THEN 100 ELSE 41 END AS n_out FROM (SELECT vec_id, embedding FROM embeddings)),
t AS (SELECT vec_id, embedding, unnest(range(n_out)) AS j, 63e0 / (n_out - 1) AS step FROM (SELECT vec_id, embedding, CAST(round_even(64 * (CASE vec_id % 3 WHEN 0 THEN 0.82e0 WHEN 1 THEN 1e0 ELSE 0.41e0 END) / 0.82e0, 0) AS INT) AS n_out FROM u)),
s AS (SELECT *, j * step - least(floor(j * step), 63) AS f, CAST(least(floor(j * step), 63) AS INT) AS lo FROM t)
SELECT vec_id, CAST(j AS INT) AS i, round(CAST(embedding[lo + 1] AS DOUBLE) * (1 - f) + coalesce(CAST(embedding[lo + 2] AS DOUBLE), 0) * f, 6) AS v FROM s""")
def _(spark, d):
    spacing = F.when(F.col("vec_id") % 3 == 0, 0.82).when(F.col("vec_id") % 3 == 1, 1.0).otherwise(0.41)
    return C.regrid(signal(spark, d), ["vec_id"], "i", "v", 64, spacing, 0.82).select("vec_id", "i", r6("v"))


@query("w10_crop_pad", f"WITH p AS ({POS}) SELECT vec_id, i - 8 + 20 AS i, round(v, 6) AS v FROM p WHERE i >= 8 AND i < 48")
def _(spark, d):
    return C.crop_pad(signal(spark, d), "i", 8, 48, 80).select("vec_id", "i", r6("v"))


HIST = "h AS (SELECT CAST(event_id // 1000 AS INT) AS epoch, event_id AS step, event_type AS key, value FROM events), l AS (SELECT key, epoch, arg_max(value, step) AS value FROM h GROUP BY 1, 2)"


def history(spark, d):
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).cast("int").alias("epoch"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value")


@query("w11_last_per_epoch", f"WITH {HIST} SELECT key, epoch, round(value, 6) AS value FROM l")
def _(spark, d):
    return C.last_per_epoch(history(spark, d)).select("key", "epoch", r6("value"))


@query("w12_trend_gates", f"""WITH {HIST}, p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY epoch) AS p FROM l)
SELECT key, coalesce(bool_and(CASE WHEN p IS NOT NULL THEN value < p END), false) AS decreasing, coalesce(bool_and(CASE WHEN p IS NOT NULL THEN value <= p * 1.05e0 END), false) AS within, max(value) = 0 AS all_zero FROM p GROUP BY key""")
def _(spark, d):
    return C.trend_gates(history(spark, d))


@query("w13_csr_offsets", f"{with_('boxes')}, c AS (SELECT unit, slice_y, count(*) AS n FROM boxes GROUP BY 1, 2) SELECT unit, slice_y, n, sum(n) OVER (ORDER BY unit, slice_y ROWS UNBOUNDED PRECEDING) - n AS start FROM c")
def _(spark, d):
    return C.csr_offsets(bound(spark, d, "boxes"), ["unit", "slice_y"])


@query("w14_progress_rate", """WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM events GROUP BY 1),
w AS (SELECT sec, sum(d) OVER (ORDER BY sec) AS total_done, sum(f) OVER (ORDER BY sec) AS total_failed, sum(d) OVER (ORDER BY sec RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM s)
SELECT sec, total_done, total_failed, recent, round(recent / 1e1, 6) AS rate_per_min, round((20000 - total_done) / nullif(recent / 1e1 / 6e1, 0), 4) AS eta_sec FROM w""")
def _(spark, d):
    p = C.progress_rate(table(spark, d, "events"), ok=F.col("event_type") != "error", expected=20000)
    return p.select("sec", "total_done", "total_failed", "recent", r6("rate_per_min"), F.round("eta_sec", 4).alias("eta_sec"))


@query("w15_pad_sequences", """WITH r AS (SELECT conv_id, length(text) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), g AS (SELECT c.conv_id, i FROM (SELECT DISTINCT conv_id FROM conversations) c, range(1, 13) x(i))
SELECT g.conv_id, g.i - 1 AS pos, coalesce(v, 0) AS v, v IS NOT NULL AS valid FROM g LEFT JOIN r USING (conv_id, i)""")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("v"))
    return C.pad_sequences(t, ["conv_id"], "turn", "v", 12)


# --- sets ---------------------------------------------------------------------------------------


@query("u1_union_relaxed", "SELECT c_nationkey AS nat, CAST(c_acctbal AS DOUBLE) AS amount, c_mktsegment AS seg FROM customer UNION ALL SELECT s_nationkey, CAST(s_suppkey AS DOUBLE), NULL FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nat"), F.col("s_suppkey").alias("amount"))
    return C.union_relaxed(a, b)


@query("u2_union", "SELECT c_nationkey AS nat FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nat")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nat")))


@query("u3_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return C.except_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("u4_overlap", f"{with_('units')} SELECT cust FROM units WHERE cohort = 'holdout' INTERSECT SELECT cust FROM units WHERE cohort <> 'holdout'")
def _(spark, d):
    u = bound(spark, d, "units")
    return C.overlap(u.filter("cohort = 'holdout'"), u.filter("cohort <> 'holdout'"), "cust")


@query("u5_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return C.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
