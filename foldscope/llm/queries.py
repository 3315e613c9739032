"""The registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscope.llm import audit, chat, decontaminate, html_main, infill, mixing, neardup, quality, sharding, spans, tokens, topk, toxicity
from foldscope.llm.common import scratch, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op8_token_ids")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    import public_tokenizers

    path = scratch(docs.sparkSession, "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.document_digests(tokens.read_tokens(docs.sparkSession, path))


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as o, text from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as rank from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((rank - 1) % 3 + 1)::int] as w from s),
f as (select *, 2.0::double * source_size / w as fills from w),
l as (
  select *, (sum(source_size) over () * 1.5::double - 2.0::double * coalesce(sum(source_size) over (order by fills, rank rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by fills, rank rows between unbounded preceding and 1 preceding), 0.0)) as level from f),
t as (
  select source, rank, source_size, least(2.0::double * source_size, (select max(level) from l where level <= fills) * w) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, t.rank, floor(t.target + 0.5)::bigint as words,
    coalesce(sum(d.size) over (partition by t.rank order by d.o, hash(d.text) rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source),
k as (
  select *, greatest(0, least(size, words - start)) + greatest(0, least(size, words - source_size - start)) as taken, start::double / nullif(words, 0) as u from p)
select doc_id, size, source_size, target, taken::bigint as taken,
  case when taken > 0 then floor(1e12::double * case (rank - 1) % 3
    when 0 then u * 2.0::double / (1.5::double + sqrt(2.25::double - 2.0::double * u))
    when 1 then u
    else case when u < 0.3125::double then u * 2.0::double / (0.5::double + sqrt(0.25::double + 1.0::double * u))
         else 0.5::double + (u - 0.3125::double) * 2.0::double / (0.75::double + sqrt(0.5625::double + 5.0::double * (u - 0.3125::double))) end end)::bigint end as position
from k
"""


@query("op10_mix_sources", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.placements(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.col("position").cast("long").alias("position"))


HITS_SQL = r"""
with d as (
  select doc_id, row_number() over () as rid,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
v as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)),
g as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from v))),
m as (select g.rid, g.i, g.n, v.item_id from g join v on g.win = v.win and g.n = v.n),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from m)) group by rid),
t as (select rid, list_sort(list(distinct item_id::varchar)) as items from m group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (rid) left join t using (rid)
"""


@query("op4_decontaminate", HITS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.dedup_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_sentences", "n_removed", "first_doc_ids", "text")


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    return chat.digests(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


@query("op6_html_main")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on q.vec_id <> v.vec_id and q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query("op9_exact_topk", TOPK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "p_text", "p_meta", "quality", F.col("good").alias("keep"))


INFILL_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256(concat('1:', doc_id::varchar)) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
d as (
  select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as x, ('0x' || h[9:16])::bigint % (len(u) + 1) as y,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from t),
p as (
  select *, array_to_string(u[1:least(x, y)], '') as prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as middle, array_to_string(u[greatest(x, y) + 1:], '') as suffix from d)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query("op11_fill_in_middle", INFILL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


AUDIT_SQL = r"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) over (partition by text), false)} as m
  from t left join l using (doc_id)),
cells as (
  select part, good, toxic, count(*) as n, concat(case when m.A then 'A' end, case when m.B then 'B' end, case when m.C then 'C' end, case when m.D then 'D' end, case when m.E then 'E' end) as fails
  from f group by part, good, toxic, m),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select concat(a.x, b.x, c.x, d.x, e.x) as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select part, filter_order, step::int as step, good, toxic, n, fails, contains(fails, filter_order[step]) as bad, len(translate(filter_order[1:step - 1], fails, '')) < step - 1 as gone
  from cells, orders, range(1, 6) r(step)),
s as (
  select part, filter_order, step, sum(case when not bad and not gone then n else 0 end)::bigint as kept, sum(case when bad and not gone then n else 0 end)::bigint as removed,
    sum(case when bad and gone then n else 0 end)::bigint as redundant, sum(case when bad and len(fails) = 1 then n else 0 end)::bigint as unique_fails,
    sum(case when bad and not gone and good then n else 0 end)::bigint as good_lost, sum(case when bad and not gone and toxic then n else 0 end)::bigint as toxic_lost
  from steps group by all)
select *, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from s
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SHARDS_SQL = r"""
with recursive poly as (
  select i, i::ubigint as c, 0 as k from range(256) r(i)
  union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from poly where k < 8),
crc as (select list(c order by i) as tab from poly where k = 8),
d as (
  select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, '') as key from documents),
w as (
  select *, list_transform(range(41), lambda s: {'v': 1.0::double / -ln((('0x' || md5(concat(key, ':', s))[1:13])::bigint::double + 0.5) / 4503599627370496.0::double), 'i': -s}) as draws from d),
p as (
  select *, (-list_max(draws[1:40]).i)::int as shard, (-list_max(draws).i)::int as grown_shard from w)
select doc_id, strlen(text) + 16 as size,
  xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(text), '..'), lambda b: ('0x' || b)::ubigint)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255::ubigint)::int + 1])), 4294967295::ubigint)::bigint as text_crc32,
  'key' as law, shard, row_number() over (partition by shard order by md5(key), md5(text)) - 1 as slot, grown_shard
from p, crc
"""


@query("op13_shards", SHARDS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.placed(table(spark, sf_dir, "documents"), weights=[1] * 40, keep=["doc_id"])
    return rows.select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
