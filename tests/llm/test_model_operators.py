"""Chat, tokens, top-k, pages, classifiers, the pipeline and the check SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pytest
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from foldscope.llm import chat, html_main, linear, quality, tokens, topk, toxicity
from foldscope.llm.common import scratch

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# --- chat


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40) | st.sampled_from(["<|im_end|>", "\\<|", "<\\|", "\\\\<|im_sep|>"]))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversed(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


TURNS = [
    (1, 0, "user", "Hi"), (1, 1, "assistant", "  Hello\n\nyou  "), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "日本語 é 😀 <|im_end|>\n"),
    (2, None, None, "no turn"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 0, "assistant", "\\"), (3, 0, "user", None), (4, 0, "as<|sistant", "x"), (5, 0, "assistant", "long " * 20000),
]


def test_chat_reads_back(spark):
    table = spark.createDataFrame([(*t, "c", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table, BYTES)).collect()}
    by = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(table.limit(0), BYTES).count() == 0


# --- tokens


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.where(rng.random(n) < 0.1, rng.integers(0, 2**32, n), 7), np.full(n, 2**32 - 1)):
        assert (tokens.unpack(tokens.pack(ids.astype("<u4"))) == ids).all()


def test_exceptions_make_blocks_smaller():
    ids = np.full(256, 5, "<u4")
    ids[::16] = 40000
    assert len(tokens.pack(ids)) < len(tokens.pack(ids, percentile=100))


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], max_codepoint=0x2FF) | st.sampled_from("aAzZ'.%\n ́"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_words_are_encoded_as_the_whole_text(text):
    e = tokens.encoder(WORDS)
    for t in (text, text + "<|endoftext|>", text.upper()):
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_read_back(spark, odd, none):
    path = scratch(spark, "tokens")
    tokens.write_tokens(odd, path, WORDS, shards=4)
    got = sorted(tuple(r) for r in tokens.document_digests(tokens.read_tokens(spark, path)).collect() if r.doc_id is not None)
    t, want, start = tokens.encoder(WORDS).tokenizer, [], 0
    unknown = [x for d, x, *_ in rows() if d is None]
    start = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in unknown)
    for d, x in sorted((r[0], r[1] or "") for r in rows() if r[0] is not None):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    path = scratch(spark, "tokens")
    tokens.write_tokens(none, path, WORDS)
    assert tokens.document_digests(tokens.read_tokens(spark, path)).count() == 0


# --- top-k


def brute_topk(vectors, queries, k):
    sound = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in sound:
        if queries(q):
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in sound if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("block, try_every", [(16_384, 64), (40, 4)])
def test_topk_equals_brute_force(spark, monkeypatch, block, try_every):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "TRY_EVERY", try_every)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 12)]) for i in range(300)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [vectors[5], (500, None), (501, [0.1, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, vectors[1][1]), (504, [0.5, 0.5]), (505, [0.5, -0.5]), (506, []), (600, [0.0] * 12), (700, [0.0] * 12)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, block int")
    got = topk.search(table, table.filter("vec_id % 10 = 0"), k=5)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(vectors, lambda q: q % 10 == 0, 5)
    assert topk.search(table.limit(0), table.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """Sums beyond 2^53 stay exact; those that might not fit 64 bits are refused."""
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.integers(-1_000_000, 1_000_000, 12) + rng.random(12)]) for i in range(120)]
    vectors += [(200 + i, [x + (i % 3) * 2.0**-8 for x in vectors[0][1]]) for i in range(9)]  # scores a few units apart near 2^58
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.search(table, table.filter("vec_id % 10 = 0"), k=5)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(vectors, lambda q: q % 10 == 0, 5)
    for large in (1e8, 1e30, -1e300):
        wild = table.union(spark.createDataFrame([(999, [large] * 12)], table.schema))
        with pytest.raises(ValueError, match="64 bits"):
            topk.search(wild, wild)


def test_proof_ends_early():
    """On clustered vectors the proof comes before all segments are added, with the same result."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (40, 16))
    x = np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 3, (4000, 16))).astype(np.int64)
    block = topk.Block(topk.build(np.arange(4000), x))
    ids, scores = block.search(7, x[7], 5)
    want = sorted(((-int(s), i) for i, s in enumerate(x @ x[7]) if i != 7))[:5]
    assert list(zip(-scores, ids, strict=True)) == want


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies a lot.</p></div>
<header><h2>Site</h2></header><aside><p>Side text that is long enough to be prose.</p></aside><%s><h1>The &amp; title</h1><p>First <b>bold
 text</b><br>here &copy; &#233; &lt;p&gt;<p>Second<script>var t="</p>";</script> one.<ul><li>a<li>b</ul><form><p>Search</p></form><div class="ad"><p>Buy</p></div>
<table><tr><td>c<td>d</table><section id="comments"><p>A reader says a lot of things here, more than all the rest of the page together.</p></section></%s><footer>&copy; me</footer></body></html>"""
TEXT = "The & title\n\nFirst bold text here © é <p>\n\nSecond one.\n\na\n\nb\n\nc\n\nd"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"'])
def test_main_text(tag):
    assert html_main.extract(PAGE % (tag, tag.split()[0])) == TEXT


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</p>b", "a\n\nb"), ("<!-- x", ""), ("<script>never closed", ""), ("<div" * 3000, ""), ("<div>" * 3000 + "deep", "deep"), ("&nbsp;&#32;", ""), ("a<br>b", "a b")])
def test_odd_pages(page, text):
    assert html_main.extract(page) == text


def test_hosts_agree(spark):
    """A page whose own best container is a teaser list follows its host's path."""
    normal = "<body><div class='c1'><p>%s</p></div><div class='x'><p>%s</p></div>"
    pages = [(i, f"http://u@A.example:80/{i}", normal % ("main " * 50, "other " * 10)) for i in range(5)]
    pages += [(9, "https://a.example/9#x", normal % ("main " * 30, "other " * 60)), (10, None, None), (11, "not a url", ""), (11, "not a url", "")]
    table = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in html_main.main_text(table).collect()}
    assert got[9].text == ("main " * 30).strip() and got[9].n_chars == 149 and got[10].text == "" and got[11].n_chars == 0
    assert html_main.main_text(table).count() == len(pages) and html_main.main_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("silent", ["<embed src=a>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<button>Menu", "<object data=a>", "<video src=a>", "<canvas>", "<map name=m>", "<svg><svg/>x</svg>", "<button>a<p>b</p></button>"])
def test_silent_elements_end(silent):
    """What has no end tag doesn't take the rest of the page along."""
    page = f"<body><div>{silent}</div><article><p>First text.</p><div>{silent}</div><p>Second text.</p></article></body>"
    assert html_main.extract(page) == "First text.\n\nSecond text."
    assert html_main.extract(f"<body>{silent}<p>First text.</p>{silent}<p>Second text.</p>") == "First text.\n\nSecond text."


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="content no-ads"', "form action=/", 'div id="sidebar"'])
@pytest.mark.parametrize("inner", ["article", "div", "main"])
def test_wrappers_are_not_apart(wrapper, inner):
    side = "<div class='sidebar'><p>Aside.</p></div>"
    page = f"<body><{wrapper}><{inner}><p>{'main text ' * 20}</p></{inner}>{side}</{wrapper.split()[0]}></body>"
    assert html_main.extract(page) == ("main text " * 20).strip()


@pytest.mark.parametrize("one, two", [("div", "div"), ("section", "div"), ("div class=post", "div class=post"), ("div class=story", "section class=body-text"), ("article", "article")])
def test_an_article_in_several_containers_is_kept_whole(one, two):
    page = f"<body><{one}><p>{'first ' * 100}</p></{one.split()[0]}><{two}><p>{'second ' * 60}</p></{two.split()[0]}></body>"
    assert html_main.extract(page) == f"{('first ' * 100).strip()}\n\n{('second ' * 60).strip()}"


# --- classifiers


def held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return spark.read.parquet(f"{sf}/documents.parquet"), labels.filter("doc_id % 3 <> 0"), {r.doc_id: r for r in labels.filter("doc_id % 3 = 0").collect()}


SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    docs, known, test = held_out(spark, SF)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect() if r.doc_id in test}
    toxic = [got[d].toxic for d, r in test.items() if r.toxic]
    clean = [got[d].toxic for d, r in test.items() if not r.toxic]
    # One row in fourteen is labelled toxic without a toxic word in it.
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.005


def test_quality_on_held_out_rows(spark):
    docs, known, test = held_out(spark, SF)
    got = {r.doc_id: r for r in quality.quality(docs, known).collect() if r.doc_id in test}
    good = [got[d].good for d, r in test.items() if r.quality]
    bad = [got[d].good for d, r in test.items() if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_chain_learns_from_out_of_fold_probabilities():
    """Rows that only their own model remembers don't mislead the next one."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    x = rng.normal(0, 1, (400, 3))
    fold = linear.folds(rng.integers(0, 10**6, 400), 5)
    p = linear.out_of_fold(x, y, fold, 5)
    for k in range(5):
        assert np.allclose(p[fold == k], linear.fit(x[fold != k], y[fold != k]).predict(x[fold == k]))
    seen = np.zeros((400, 2))
    seen[:, 0], seen[:, 1] = rng.random(400) < 0.5, rng.random(400) < 0.5
    both = np.c_[seen[:, 0], seen.max(axis=1)]
    seen = np.c_[seen, np.full(400, 50.0)]  # the last column counts words
    chain = toxicity.Chain(["a", "b"]).fit(seen, both, np.arange(400))
    assert ((chain.predict(seen) > 0.5) == both).all() and chain.models[1].w.shape[0] == len(chain.columns[1]) + 3


def test_classifiers_on_odd_rows(spark, odd, none, odd_labels):
    for f in (toxicity.toxicity, quality.quality):
        assert Counter(str(r.doc_id) for r in f(odd, odd_labels).collect()) == Counter(str(r[0]) for r in rows())
        assert f(none, odd_labels).count() == 0
        assert f(odd, odd_labels.limit(0)).count() == len(rows())
    assert quality.keep_good(odd, odd_labels).columns == odd.columns


def test_views_exchange_labels(spark):
    """The text view learns a pattern that only the metadata view has labels for."""
    docs = [(i, ("plain words here " if i % 2 else "odd*** words### here ") * 5, "en", "good" if i % 2 else "bad", 80) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.quality(table, labels).collect()
    assert all(r.good == bool(r.doc_id % 2) for r in got)


# --- pipeline and SQL


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[1][0]] == [5, "MinHash near-dedup"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0


@pytest.mark.parametrize("name", ["op4_decontaminate", "op9_exact_topk", "op10_mix_sources"])
def test_query_equals_sql(spark, sf, name):
    assert compare.spark_rows(entry.queries()[name](spark, sf)) == compare.duck_rows(compare.connect(sf), entry.oracle_sql()[name])


def test_registered():
    found = [re.match(r"op(\d+)_", n)[1] for n in entry.queries() if n.startswith("op")]
    assert sorted(map(int, found)) == list(range(1, 11)) and "pipeline" in entry.queries()
