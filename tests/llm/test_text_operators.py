"""Spans, decontamination, near duplicates and mixing against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose, rows
from pyspark.sql import functions as F

from foldscope.llm import decontaminate, mixing, neardup, spans


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# --- spans


M64, ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def spread(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def word_hash(word):
    return spread(sum((ord(c) + 1) * pow(ODD, k, 1 << 64) for k, c in enumerate(word)) & M64)


def plain_words_of(text):
    """(start, word) by walking over the characters."""
    out, k = [], 0
    cjk = lambda c: any(a <= ord(c) <= b for a, b in spans.CJK)
    while k < len(text):
        if text[k].isspace():
            k += 1
            continue
        at, k = k, k + 1
        if cjk(text[at]):
            while k < len(text) and text[k] in "。！？":
                k += 1
        else:
            while k < len(text) and not text[k].isspace() and not cjk(text[k]) and (text[k] in "。！？" or text[k - 1] not in "。！？"):
                k += 1
        out.append((at, text[at:k]))
    return out


def plain_sentences(text):
    """(start, words) of sentences and of pieces of long ones, written out word by word."""
    found, here = [], []
    words = plain_words_of(text)
    for i, (at, w) in enumerate(words):
        here.append((at, w))
        behind = text[at + len(w) : words[i + 1][0] if i + 1 < len(words) else len(text)]
        if i + 1 == len(words) or w[-1] in "。！？" or (w[-1] in ".!?" and behind) or any(c in "\n\r\v\f\x85\u2028\u2029" for c in behind):
            found.append(here)
            here = []
    out = []
    for s in found:
        cuts = [0]
        if len(s) > 16:
            h = [word_hash(w) for _, w in s]
            cuts += [i for i in range(1, len(s)) if all(h[i] < x for x in h[max(i - 2, 0) : i]) and all(h[i] <= x for x in h[i + 1 : i + 3])]
        for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
            step = 8 if b - a > 16 else b - a
            out += [(s[k][0], tuple(w for _, w in s[k : min(k + step, b)])) for k in range(a, b, step)]
    return out


def brute_spans(docs):
    """(doc_id, text) -> text without sentences covered by a later occurrence of a run."""
    seen, all_runs = {}, []
    cuts = {t: plain_sentences(t or "") for _, t in docs}
    for d, t in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        u = [w for _, w in cuts[t]]
        all_runs += [(tuple(u[i : i + 3]), d, t, i) for i in range(len(u) - 2) if sum(map(len, u[i : i + 3])) >= 8]
    out = {}
    for run, d, t, i in all_runs:
        if run in seen:
            out.setdefault((d, t), set()).update(range(i, i + 3))
        else:
            seen[run] = d
    cut = {}
    for d, t in docs:
        gone = out.get((d, t), set())
        at = [x for x, _ in cuts[t]]
        cut[d, t] = t[: at[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(at, [*at[1:], len(t)], strict=True)) if k not in gone) if gone else t
    return cut


def test_spans_equal_brute_force(odd):
    got = spans.dedup_spans(odd)
    assert {"doc_id", "lang", "_row", "content", "n_sentences", "removed"} <= set(got.columns)
    docs = [(r[0], r[1]) for r in rows()]
    want = brute_spans(docs)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d, want[d, t]) for d, t in docs)


def test_spans_catch_a_passage_and_name_its_source(spark, odd):
    got = {r.doc_id: r for r in spans.dedup_spans(odd).collect() if r.doc_id in (1, 2, 10, 11)}
    assert got[1].n_removed == 0 and got[2].text == "" and got[2].first_doc_ids == [1]
    assert got[10].n_removed == 0 and got[11].first_doc_ids == [10] and prose(3, 60)[:200] not in got[11].text


def unmarked(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvwy"), rng.integers(2, 8))) for _ in range(n))


@pytest.mark.parametrize("before", range(12))
def test_spans_catch_a_passage_in_mid_line(spark, before):
    """Copies are cut alike whatever stands before them and after them."""
    texts = [f"{unmarked(k + 100, n)} {unmarked(k, 60)} {unmarked(k + 200, 9)}.".lstrip() for k in range(20) for n in (0, before)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in spans.dedup_spans(docs).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] >= 3 for k in range(20))


def test_spans_ignore_white_space_and_read_wide_marks(spark):
    three = ["Here are the first words.", "And then come some others.", "At last these end it."]
    wide = "我们今天去公园玩。天气一直很好！你明天也去吗？"
    texts = [" ".join(three) + "\nMore", " ".join(three) + " Other", " ".join(three), wide, "他说" + "。" + wide + "好"]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in range(5)] == [0, 3, 3, 0, 3] and got[4].text == "他说。好"
    long_text = "".join(chr(0x4E00 + int(k)) for k in np.random.default_rng(3).integers(0, 20000, 60))
    got = spark.createDataFrame([(long_text,)], "text string").select(spans.sentences("text").alias("s")).first().s
    assert len(got) >= 4 and "".join(got) == long_text


def test_spans_on_an_empty_table(none):
    assert spans.dedup_spans(none).count() == 0


def test_cutting_equals_a_plain_walk():
    rng = np.random.default_rng(0)
    texts = ["", *("".join(rng.choice(list("ab .!?\n\u3000\u00a0\u2028。！天x,9"), rng.integers(0, 400), p=[0.15, 0.1, 0.35, 0.02, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.02, 0.01, 0.05, 0.14, 0.05, 0.05])) for _ in range(200)), "", "w " * 100]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    got = spans.cut_up(points, np.cumsum([len(t) for t in texts]))
    begin = np.r_[0, np.cumsum([len(t) for t in texts])]
    want = [(i, begin[i] + at, len(words)) for i, t in enumerate(texts) for at, words in plain_sentences(t)]
    assert list(zip(got.text, got.start, got.words, strict=True)) == want
    by_words = {}
    for h, words in zip(got.hash.tolist(), (w for t in texts for _, w in plain_sentences(t)), strict=True):
        assert by_words.setdefault(words, h) == h
    assert len(set(by_words.values())) == len(by_words)


@pytest.mark.parametrize("text", ["a b. c d! e\nf", "  x. \n\n y", "one " * 40, "a.b c.d? e", "", "。 あ。い"])
def test_sentences_join_to_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(spans.sentences("text").alias("s")).first().s
    assert re.match(r"\s*", text)[0] + "".join(got) == text


# --- decontamination

NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(NOT_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(i) for i in of if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


ITEMS = [(1, prose(3, 40)), (10, prose(3, 20)), (2, "Only four WORDS here"), (3, "pines"), (4, None), (5, ""), (None, prose(2, 30)), (6, prose(1, 13)), (6, prose(9, 15)), (7, "é É"), (8, "...")]


def test_hits_equal_brute_force(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r[0], r[1]) for r in rows()]
    assert counted(decontaminate.report(odd, items)) == brute_hits(docs, ITEMS)
    left = decontaminate.drop_contaminated(odd, items)
    bad = {k[0] for k in brute_hits(docs, ITEMS) if k[5]}
    assert left.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)


def test_hits_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(odd, items.limit(0)).filter("contaminated or n_items > 0").count() == 0


# --- near duplicates


def brute_classes(docs):
    sets = [neardup.shingles(t) for _, t in docs]
    df = np.zeros(1 << neardup.BUCKET_BITS)
    for s in sets:
        df[np.unique(neardup.buckets(s[0]))] += 1
    idf = neardup.inverse(df, sum(len(s[0]) > 0 for s in sets))
    vec = [dict(zip(s[0].tolist(), neardup.weights(s[0], s[1], idf).tolist(), strict=True)) for s in sets]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if vec[i] and vec[j]:
                shared = sum(min(w, vec[j].get(k, 0.0)) for k, w in vec[i].items())
                if shared >= 0.8 * (sum(vec[i].values()) + sum(vec[j].values()) - shared) - 1e-9:
                    root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    return Counter((d, min((x for x in ids[find(i)] if x is not None), default=None), len(ids[find(i)])) for i, (d, _) in enumerate(docs))


def test_classes_equal_brute_force(odd):
    got = neardup.classes(odd)
    assert counted(got.select("doc_id", "class_id", "class_size")) == brute_classes([(r[0], r[1]) for r in rows()])
    assert {r.doc_id for r in got.collect() if not r.kept} == {2, 3, 9}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = counted(neardup.classes(docs).select("doc_id", "class_id", "class_size"))
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_texts_needs_more_pivots(spark, monkeypatch):
    """Neighbours in a chain are similar, ends aren't; without the shortcut every round tries pivots alone."""
    words = [f"w{i}" for i in range(260)]
    docs = [(k, " ".join(words[4 * k : 4 * k + 140])) for k in range(30)] + [(100 + k, " ".join(words[4 * k : 4 * k + 140]).upper()) for k in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_classes(docs)
    assert len({k[1] for k in want}) == 1
    assert counted(neardup.classes(table).select("doc_id", "class_id", "class_size")) == want
    for bound in ("PAIRS_PER_CONTENT", "COMPARED_PER_CONTENT"):
        monkeypatch.setattr(neardup, bound, 0)
        assert counted(neardup.classes(table).select("doc_id", "class_id", "class_size")) == want


def test_one_of_each_stays(odd, none):
    left = neardup.keep_one(odd)
    assert left.columns == odd.columns and neardup.keep_one(none).count() == 0
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 8, None, None, 10, 11, 12, 13, 14, 15, 16, 17]))


def test_one_of_each_stays_in_any_script(spark):
    texts = ["我们今天去公园玩", "привет мир и всем", "مرحبا بالعالم", "!!! ..."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts) for _ in range(3)], "doc_id long, text string")
    assert counted(neardup.keep_one(docs).select("doc_id")) == {(0,): 1, (1,): 1, (2,): 1, (3,): 3}


def test_bands_follow_similarity():
    """Share of agreeing draws is close to the weighted Jaccard."""
    rng = np.random.default_rng(5)
    sampler, agree, true = neardup.Sampler(), [], []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 400, np.uint64))
        w, v = rng.random(400) + 0.5, None
        v = np.where(rng.random(400) < 0.15, w * 0.3, w)
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
        agree.append((sampler.bands(h, w) == sampler.bands(h, v)).mean())
    assert abs(np.mean(agree) - np.mean(np.power(true, neardup.ROWS))) < 0.06


# --- mixing


def test_mix_meets_its_targets(odd, none):
    got = mixing.placements(odd).collect()
    docs = [(r[0], r[1], r[3]) for r in rows()]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs)
    by, size = {}, {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for s, rs in by.items():
        size[s] = sum(r["size"] for r in rs)
        assert rs[0].source_size == size[s] and sum(r.taken for r in rs) == math.floor(rs[0].target + 0.5)
    order = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in over or free:
            want[s] = 2.0 * size[s] if over else level * weight[s]
        left -= sum(want[s] for s in over)
        free = free - over if over else set()
    assert {s: rs[0].target for s, rs in by.items()} == pytest.approx(want)
    assert mixing.placements(none).count() == 0


def test_curriculum_is_in_order_and_repeats_rows(odd, none):
    rows_ = mixing.curriculum(odd)
    assert rows_.columns == odd.columns and mixing.curriculum(none).count() == 0
    got = Counter(r.doc_id for r in rows_.collect())
    for r in mixing.placements(odd).filter("doc_id <> 4 and doc_id is not null").collect():
        passes = 0 if not r["size"] else (1 if 0 < r.taken <= r["size"] else 2 if r.taken else 0)
        assert got[r.doc_id] == passes, r


@pytest.mark.parametrize("knots", [*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0)), ((0.0, 0.0), (0.5, 0.0), (1.0, 1.0))])
def test_demand_is_inverted(spark, knots):
    t = np.linspace(0, 1, 101)
    w = np.interp(t, *zip(*knots, strict=True))
    fine = np.linspace(0, 1, 20001)
    fw = np.interp(fine, *zip(*knots, strict=True))
    share = np.r_[0, np.cumsum((fw[1:] + fw[:-1]) / 2)]
    share = np.interp(t, fine, share / share[-1])
    df = spark.createDataFrame([(float(u),) for u in share[:-1]], "u double").select(mixing.due(F.col("u"), knots).alias("t"))
    got = np.array([r.t for r in df.collect()])
    moving = w[:-1] > 1e-9
    assert np.abs(got - t[:-1])[moving].max() < 2e-4
