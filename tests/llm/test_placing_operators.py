"""Infilling, the filter audit and sharding against brute force, on awkward rows, at scale of hot groups and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import rows
from pyspark.sql import functions as F

from foldscope.llm import audit, infill, queries, sharding
from foldscope.llm.common import scratch

NEW = ["op11_fill_in_middle", "op12_filter_audit", "op13_shards"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, sf, name):
    from compare import connect, duck_rows, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(connect(sf), queries.ORACLES[name])


# --- infilling


def brute_infill(doc, text, seed=1, rate=90, first=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m) if h[3] % 100 < first else (n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m)


@pytest.mark.parametrize("seed,rate,first", [(1, 90, 20), (7, 100, 50), (2, 0, 0), (3, 100, 100)])
def test_infill_equals_brute_force_and_reads_back(odd, seed, rate, first):
    got = infill.fill_in_middle(odd, seed, rate, first)
    got = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter((r[0], r[1]) for r in rows())
    for r in got:
        assert (r.n, r.form, r.output, r.prefix, r.middle) == brute_infill(r.row.doc_id, r.row.text, seed, rate, first)
        assert r.back == (r.row.text or "") and r.row.content == "c"


def test_infill_texts_of_control_characters_and_marks(spark, none):
    texts = ["\x00\n\r\t", "a<P>b", "<S", "S>", "<M>", "<<S>>", "é中😀 z", "A" * 300000, "<P", "P><S><M", "   "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 9)], "doc_id long, text string")
    got = infill.fill_in_middle(docs, rate=100).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.row.text and (r.form == "plain") == any(m in r.row.text for m in infill.MARKS) for r in got)
    assert infill.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(none, marks=("<P>", "<P", "<M>"))
    with pytest.raises(ValueError):
        infill.fill_in_middle(none, marks=("aba", "<S>", "<M>"))


def test_infill_slices_meet(monkeypatch):
    texts = pa.array(["one two", "", "three, four five", "x" * 50, "é!"])
    h = np.arange(5) * 7
    whole = infill.cut_texts(texts, h, h + 3).to_pylist()
    monkeypatch.setattr(infill, "SLICE_BYTES", 8)
    cut = [infill.cut_texts(texts[s], h[s], h[s] + 3).to_pylist() for s in infill._slices(texts)]
    assert sum(cut, []) == whole and [w["prefix"] + w["middle"] + w["suffix"] for w in whole] == texts.to_pylist()


# --- the filter audit


def brute_audit(docs, labels):
    """Filters applied to the documents one after another, order by order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails, parts = [], [s or "" for _, _, s in docs]
    for d, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]]
        fails.append({c for c, x in zip("ABCDE", f, strict=True) if x})
    out = {}
    for part in set(parts):
        mine = [i for i in range(len(docs)) if parts[i] == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, c in enumerate(order, 1):
                gone = {i for i in left if c in fails[i]}
                redundant = sum(c in fails[i] for i in mine if i not in left)
                left -= gone
                out[part, order, step] = [
                    len(left), len(gone), redundant, sum(fails[i] == {c} for i in mine), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (*(r[f] for f in audit.FIELDS), r.shapley) for r in audit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark, odd, odd_labels):
    labels = [tuple(r) for r in odd_labels.collect()]
    docs = [(r[0], r[1], r[3]) for r in rows()]
    assert audited(odd, odd_labels) == brute_audit(docs, labels)
    # Copies over sources, ids and labels; NULL ids among them; more NULL and empty sources.
    rng = np.random.default_rng(5)
    pool = ["Aa " * 300, "w1 w2 " * 60, "plain words here", "X#", None, "", " ".join(f"w{k}" for k in range(300)), " ".join(f"W{k} $" for k in range(250))]
    docs = [(None if rng.random() < 0.1 else int(rng.integers(0, 60)), pool[int(rng.integers(0, len(pool)))], [None, "", "s", "t"][int(rng.integers(0, 4))]) for _ in range(400)]
    labels = [(int(rng.integers(0, 60)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for _ in range(30)] + [(None, 1, 1), (3, None, 1)]
    got = audited(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == brute_audit(docs, labels) and {k[0] for k in got} == {"", "s", "t"}


def test_audit_of_an_empty_table(none, odd, odd_labels):
    assert audit.audit(none, odd_labels).count() == 0
    assert audit.audit(odd, odd_labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_gathers_no_more_than_cells(spark):
    """A group of copies under many ids and one id under many texts come down to a few cells."""
    docs = spark.range(5000).selectExpr("id % 3000 as doc_id", "if(id < 3000, 'same text', concat('other ', id)) as text", "concat('s', id % 2) as source")
    c = audit.cells(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert c.count() <= 12 and c.agg(F.sum("n")).first()[0] == 5000


# --- sharding


def test_shards_follow_the_law(odd, none):
    got = sharding.placed(odd, [1] * 5).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter((r[0], r[1]) for r in rows()) and got[0].row.content == "c"
    for r in got:
        raw = (r.row.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        draws = [-1 / np.log((int(hashlib.md5(f"{'' if r.row.doc_id is None else r.row.doc_id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for s in range(6)]
        assert r.shard == int(np.argmax(draws[:5])) and r.grown_shard == int(np.argmax(draws)) and r.grown_shard in (r.shard, 5)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.placed(none, [1, 1]).count() == 0


def test_shares_follow_the_weights_and_few_rows_move(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    weights = [1.0, 2.0, 0.0, 5.0]
    share = {r.shard: r["count"] / 20000 for r in sharding.placed(docs, weights).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 3} and all(abs(share[k] - weights[k] / 8) < 0.02 for k in share)
    grown = sharding.placed(docs, weights, grown=[*weights, 2.0]).filter("grown_shard <> shard")
    assert [r.grown_shard for r in grown.select("grown_shard").distinct().collect()] == [4] and abs(grown.count() / 20000 - 0.2) < 0.02
    # A shard that goes gives away its own rows only.
    less = sharding.placed(docs, weights, grown=[1.0, 0.0, 0.0, 5.0]).filter("grown_shard <> shard")
    assert [r.shard for r in less.select("shard").distinct().collect()] == [1]
    for bad in ([], [0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            sharding.placed(docs, bad)


def test_a_hot_key_is_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 100)
    docs = spark.range(3000).selectExpr("if(id < 2000, 7, id) as doc_id", "if(id < 1500, 'same', cast(id as string)) as text")
    got = sharding.placed(docs, [1] * 4).select("row.doc_id", "shard", "slot").collect()
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_written_shards_hold_all_columns_in_slot_order(spark, odd):
    path = scratch(spark, "shards")
    sharding.write_shards(odd, path, [1, 1, 2])
    back = spark.read.parquet(path)
    assert set(odd.columns) <= set(back.columns) and back.count() == odd.count()
    runs = back.select("_shard", "_slot", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    for key in {(r._shard, r.f) for r in runs}:
        slots = [r._slot for r in sorted((r for r in runs if (r._shard, r.f) == key), key=lambda r: r.i)]
        assert slots == sorted(slots)
