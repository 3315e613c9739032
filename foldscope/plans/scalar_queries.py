"""Column functions on whole driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing as H
from foldscope.functions import scalar as S
from foldscope.plans.bindings import bound, table, with_
from foldscope.plans.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
n_ = lambda: F.count("*").alias("n")

# Fixed word lists for mnemonic ids.
WORDS = [
    ["amber", "brisk", "calm", "dapper", "eager", "fuzzy", "gentle", "hazel", "ivory", "jolly", "keen", "lucid", "mellow", "noble", "opal", "proud"],
    ["badger", "crane", "dingo", "egret", "finch", "gecko", "heron", "ibis", "jackal", "koala", "lemur", "marmot", "newt", "otter", "puffin", "quail"],
    ["anchor", "beacon", "canyon", "delta", "ember", "fjord", "glade", "harbor", "island", "jungle", "knoll", "lagoon", "meadow", "nebula", "oasis", "prairie"],
]


@query("f1_parse_name", r"""SELECT c_custkey AS k, regexp_extract(c_name, '^(Customer#[0-9]{6})([0-9]{3})$', 1) AS id, CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 16) END AS suffix FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    nm = F.concat(F.substring("c_name", 1, 15), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_"), F.substring("c_name", 16, 9))).otherwise(""), F.lit(".nii.gz"))
    i, s = S.parse_name(nm, "Customer#[0-9]{6}", r"nii\.gz")
    return c.select(F.col("c_custkey").alias("k"), i.alias("id"), s.alias("suffix"))


@query("f2_classify", """SELECT CASE WHEN contains(upper(p_name), 'RED') AND contains(upper(p_name), 'WIDGET') THEN 'B' WHEN contains(upper(p_name), 'WIDGET') THEN 'A' ELSE 'unknown' END AS variant,
CASE WHEN starts_with(upper(p_type), 'ECONOMY') THEN 'ECONOMY' WHEN starts_with(upper(p_type), 'STANDARD') THEN 'STANDARD' ELSE 'OTHER' END AS family, count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, d):
    v = S.classify(F.col("p_name"), [("B", ["RED", "WIDGET"]), ("A", ["WIDGET"])])
    fam = S.prefix_family(F.col("p_type"), ["ECONOMY", "STANDARD"])
    return table(spark, d, "part").groupBy(v.alias("variant"), fam.alias("family")).agg(n_())


@query("f3_safe_numbers", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'n/a' ELSE conv_id || '.5' END AS a, CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) ELSE role END AS b FROM conversations)
SELECT conv_id, turn, TRY_CAST(nullif(a, '') AS DOUBLE) AS f, TRY_CAST(b AS BIGINT) AS i FROM t""")
def _(spark, d):
    a = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "n/a").otherwise(F.concat(F.col("conv_id").cast("string"), F.lit(".5")))
    b = F.when(F.col("role") == "user", F.col("conv_id").cast("string")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.safe_float(a).alias("f"), S.safe_int(b).alias("i"))


@query("f4_parse_shape", """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE [512, p_size, 400] END AS shape, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS middle FROM part""")
def _(spark, d):
    z = F.col("p_size").cast("string")
    txt = F.when(F.col("p_partkey") % 5 == 0, "bad").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("(512, "), z, F.lit(", 400)"))).otherwise(F.concat(F.lit("512x"), z, F.lit("x400")))
    s = S.parse_shape(txt)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), s.alias("shape"), S.middle_dim(s).alias("middle"))


@query("f5_split_list", "SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '') AS parts, string_split(url, '/')[4] AS fourth FROM pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.split_list(u, "/").alias("parts"), S.nth_token(u, "/", 3).alias("fourth"))


@query("f6_phase_of", "SELECT regexp_replace(regexp_replace(o_orderpriority, '^[0-9]-', ''), 'IUM$', '') AS phase, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(S.phase_of(F.col("o_orderpriority"), "[0-9]-", "IUM").alias("phase")).agg(n_())


@query("f7_path_of", "SELECT doc_id, printf('/%s/%05d_%s.txt', source, doc_id, lang) AS path FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.path_of("/%s/%05d_%s.txt", F.col("source"), F.col("doc_id"), F.col("lang")).alias("path"))


@query("f8_mnemonic", "WITH h AS (SELECT c_custkey AS id, sha256(c_custkey || ':0') AS h FROM customer) SELECT id, " + " || '_' || ".join(
    f"({w!r})[CAST(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT % {len(w)} AS INT) + 1]" for i, w in enumerate(WORDS)) + " AS name FROM h")
def _(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), S.mnemonic(k, F.lit(0), WORDS).alias("name"))


def name_words(n: int) -> list[list[str]]:
    """The words with four endings, and with numbered ones besides until there are two names for each of ``n`` ids."""
    ends = ["", "er", "ly", "ish"]
    while math.prod(len(w) * len(ends) for w in WORDS) < 2 * n:
        ends.append(str(len(ends)))
    return [[a + b for a in w for b in ends] for w in WORDS]


@query("f8_assign_mnemonics")
def _(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return S.assign_mnemonics(ids, name_words(ids.count()))


@query("f9_replace_once", "SELECT page_id, CASE WHEN strpos(html, 'li') > 0 THEN sha256(substr(html, 1, strpos(html, 'li') - 1) || url || substr(html, strpos(html, 'li') + 2)) ELSE sha256(html) END AS h FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(S.replace_once(F.col("html"), F.lit("li"), F.col("url")), 256).alias("h"))


@query("f12_jitter", f"""{with_('steps')}, n AS (SELECT step, score, (('0x' || substr(md5('7:' || step || ':u1'), 1, 8))::BIGINT + 1e0) / 4294967297e0 AS u1, ('0x' || substr(md5('7:' || step || ':u2'), 1, 8))::BIGINT / 4294967296e0 AS u2 FROM steps)
SELECT step, round(sign(score - 40) * pow(abs(score - 40), 0.8e0) + 2 * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)), 5) AS g FROM n""")
def _(spark, d):
    g = S.jitter(F.col("score"), F.lit(-40.0), F.lit(0.8), 2.0, 7, F.col("step"))
    return bound(spark, d, "steps").select("step", F.round(g, 5).alias("g"))


@query("f13_rotate_inverse", "SELECT l_suppkey, round(avg(l_quantity), 6) AS x, round(avg(l_linenumber), 6) AS z FROM lineitem GROUP BY 1")
def _(spark, d):
    args = (F.col("l_tax") * 10, F.lit(1.25), F.lit(4.0), F.lit(-3.0), 20.0, 10.0)
    li = table(spark, d, "lineitem")
    x, z = S.rotate(F.col("l_quantity"), F.col("l_linenumber").cast("double"), *args)
    li = li.withColumns({"fx": x, "fz": z})
    x, z = S.rotate(F.col("fx"), F.col("fz"), *args, inverse=True)
    return li.withColumns({"x": x, "z": z}).groupBy("l_suppkey").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("z"), 6).alias("z"))


@query("f15_size_labels", """SELECT CASE WHEN p_retailprice < 200 THEN '<=200mm3' WHEN p_retailprice < 1000 THEN '200-1000mm3' WHEN p_retailprice < 5000 THEN '1000-5000mm3' ELSE '>5000mm3' END AS label, count(*) AS n FROM part GROUP BY 1""")
def _(spark, d):
    from foldscope.operators.metrics import VOLUME_EDGES, size_bin, size_bin_labels

    names = F.array(*[F.lit(x) for x in size_bin_labels(VOLUME_EDGES)])
    return table(spark, d, "part").groupBy(F.get(names, size_bin(F.col("p_retailprice"))).alias("label")).agg(n_())


@query("f16_thickness_bin", "SELECT CASE WHEN l_tax = 0 THEN 'unknown' WHEN l_tax * 100 <= 4 THEN 'thin' ELSE 'thick' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    t = F.when(F.col("l_tax") != 0, F.col("l_tax") * 100)
    return table(spark, d, "lineitem").groupBy(S.thickness_bin(t).alias("bin")).agg(n_())


@query("m17_stratum_value", """WITH t AS (SELECT CASE WHEN l_tax > 0 THEN l_tax * 100 END AS mm, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' END AS v FROM lineitem)
SELECT CASE WHEN mm <= 2 THEN '<=2mm' WHEN mm > 2 THEN '>2mm' WHEN v = 'A' THEN '<=2mm' WHEN v = 'B' THEN '>2mm' ELSE 'unknown' END AS stratum, count(*) AS n FROM t GROUP BY 1""")
def _(spark, d):
    v = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B")
    return table(spark, d, "lineitem").groupBy(S.stratum_thickness(F.when(F.col("l_tax") > 0, F.col("l_tax") * 100), v).alias("stratum")).agg(n_())


@query("f17_decay", "SELECT CAST(o_orderkey % 61 AS INT) AS epoch, round(least(greatest(0.5e0 + least((o_orderkey % 61) / 30e0, 1) * -0.25e0, 0.25), 0.5), 6) AS p, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    e = (F.col("o_orderkey") % 61).cast("int")
    return table(spark, d, "orders").groupBy(e.alias("epoch"), F.round(S.decay(e, 0.5, 0.25, 30), 6).alias("p")).agg(n_())


@query("f18_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events")
def _(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_path(p, "$.k").cast("long").alias("k"), S.json_path(p, "$.other", "none").alias("missing"))


@query("f19_run_id", "SELECT event_id, 'run_' || strftime(ts, '%Y_%m_%d_%H%M%S') || '_' || substr(md5(props), 1, 7) AS run_id FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.run_id("run", F.col("ts"), F.substring(F.md5("props"), 1, 7)).alias("run_id"))


@query("f20_sorted_unique", "SELECT conv_id, turn, list_sort(list_distinct(string_split(text, ' '))) AS words FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.sorted_unique(F.split("text", " ")).alias("words"))


@query("f21_build_map", "SELECT l_orderkey, l_linenumber AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    m = S.build_map(li, ["l_orderkey"], "l_linenumber", "q")
    return m.select("l_orderkey", F.explode("map").alias("k", "q"))


CFG = """a AS (SELECT 'events.' || event_id || '.k' AS path, json_extract_string(props, '$.k') AS value FROM events), b AS (SELECT path, CASE WHEN value = '7' THEN '8' ELSE value END AS value FROM a WHERE value <> '9')"""


@query("f22_config_diff", f"WITH {CFG} SELECT coalesce(a.path, b.path) AS path, a.value AS old, b.value AS new FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value")
def _(spark, d):
    doc = F.concat(F.lit('{"events":{"'), F.col("event_id").cast("string"), F.lit('":'), F.col("props"), F.lit('},"logging":{"level":"'), F.col("event_type"), F.lit('"}}'))
    a = runtime.cut(S.flatten_json(table(spark, d, "events").select(doc.alias("doc")), "doc", 3))
    b = a.filter("value <> '9'").withColumn("value", F.when(F.col("value") == "7", "8").otherwise(F.col("value")))
    return S.config_diff(a.filter("path not like 'logging%'"), b.filter("path not like 'logging%'"))


@query("f23_status_of", """SELECT CASE WHEN l_linenumber = 1 AND l_tax > 0.05 THEN 'failed' WHEN l_linenumber = 1 THEN 'no_output' WHEN l_quantity < 30 THEN 'qc_flag:low_slice_count' WHEN l_tax > 0.05 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    s = S.status_of((F.col("l_tax") > 0.05).cast("int"), F.col("l_linenumber") - 1, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(s.alias("status")).agg(n_())


@query("f24_verdict", """WITH t AS (SELECT concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey > 20 THEN 'far' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'household' END) AS reasons FROM customer)
SELECT CASE WHEN reasons = '' THEN 'PASS' ELSE 'REVIEW' END AS verdict, reasons, count(*) AS n FROM t GROUP BY 1, 2""")
def _(spark, d):
    v, r = S.verdict({"debt": F.col("c_acctbal") < 0, "far": F.col("c_nationkey") > 20, "household": F.col("c_mktsegment") == "HOUSEHOLD"})
    return table(spark, d, "customer").groupBy(v.alias("verdict"), r.alias("reasons")).agg(n_())


@query("k11_row_seed", "SELECT l_orderkey, l_linenumber, count(*) AS n, ('0x' || substr(sha256('42:' || l_orderkey || ':' || l_linenumber), 1, 15))::BIGINT AS seed FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(n_())
    return g.withColumn("seed", H.row_seed(42, F.col("l_orderkey"), F.col("l_linenumber")))


def _fnv(*vs):
    e = "2216829733::BIGINT"
    for v in vs:
        e = f"((xor({e}, ({v})::BIGINT & 4294967295) * 435) & 4294967295)"
    return f"({e} & 2147483647)"


@query("k11_fold_seed", f"SELECT o_orderkey, {_fnv('o_orderkey', 'o_custkey', '17')} AS seed FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", H.fold_seed(F.col("o_orderkey"), F.col("o_custkey"), 17).alias("seed"))
