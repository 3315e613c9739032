"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is a set of word shingles. For full containment the necessary prefix is one token: a document
that holds the window holds its rarest shingle. So the corpus is joined on shingles, each window is tried only
where its rarest shingle stands, the shingle's place in the window gives the one possible start (positional
bound), windows that would leave the document are dropped (length bound), and the words left are compared.
Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscope.llm.common import ASCII_UPPER, packed, row_key, sha256_of
from foldscope.runtime import cut

# ASCII letters and digits and everything beyond ASCII, after lower-casing A-Z; and the same before it. Plain
# ranges and a possessive run are several times as fast in Java as the negated class they equal.
WORD = r"[0-9a-z\x80-\x{10FFFF}]++"
ANY_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
# Words of an item window, words of a shingle, and one word in so many hit words makes a document contaminated.
WINDOW, SHINGLE, SHARE = 13, 5, 20


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.col(text), ASCII_UPPER, ASCII_UPPER.lower()), F.lit(WORD), F.lit(0))


def count_words(text: str) -> Column:
    """Words of a text without lower-casing it; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(ANY_WORD)), F.lit(0)).cast("long")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and window (words joined by a blank) with n words: every run of ``size`` words, or a shorter item whole."""
    w = items.select("item_id", words_of("text").alias("_w")).filter("size(_w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))
    w = w.select("item_id", "_w", F.explode(starts).alias("_i"))
    return w.select("item_id", F.array_join(F.slice("_w", F.col("_i") + 1, F.lit(size)), " ").alias("window"), F.least(F.size("_w"), F.lit(size)).alias("n")).distinct()


def _shingles(rows: DataFrame, words: Column, lengths: list[int], *keep: str) -> DataFrame:
    """keep, pos, hash: every shingle of the given lengths (a length takes part in its hash)."""
    h = rows.select(*keep, F.transform(words, lambda x: F.xxhash64(x)).alias("_h")).select(*keep, "_h", F.posexplode("_h").alias("pos", "_x"))

    def shingle(n: int) -> Column:
        return F.when(F.col("pos") + n <= F.size("_h"), F.xxhash64(F.lit(n), *[F.get("_h", F.col("pos") + k) for k in range(n)]))

    if len(lengths) == 1:
        return h.select(*keep, "pos", shingle(lengths[0]).alias("hash")).filter("hash is not null")
    return h.select(*keep, "pos", F.explode(F.array(*map(shingle, lengths))).alias("hash")).filter("hash is not null")


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Keys of the documents that hold a window: _a, _b (of doc_id and text), n_hit, items (ids as sorted strings).

    n_hit counts the words inside any occurrence of a window. A NULL item_id hits words but isn't listed; items
    or documents without words match nothing.
    """
    docs = docs.select(*row_key("doc_id", "text"), "text")
    windows = cut(windows_of(items, size))
    # At most ``shingle`` lengths: that of long windows and those of items shorter than a shingle.
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect()) or [shingle]
    parts = windows.select("window", "n").distinct()
    own = _shingles(parts, F.split("window", " "), lengths, "window", "n")
    # A window of n words is made of shingles of min(n, shingle) words; others of its length list are left out.
    whole = F.array(*[F.lit(x) for x in lengths])
    own = cut(own.withColumn("_l", F.least("n", F.lit(shingle))).filter(F.array_contains(whole, F.col("_l")) & (F.col("pos") + F.col("_l") <= F.col("n"))))
    found = cut(_shingles(docs, words_of("text"), lengths, "_a", "_b").join(own.select("hash").distinct(), "hash"))
    # Rarity over the whole corpus; a window one of whose shingles never occurs is dropped here.
    seen = found.groupBy("hash").agg(F.count("*").alias("_seen"))
    rated = own.join(seen, "hash", "left")
    prefix = rated.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("seen"), "hash", "pos")).alias("_p")).filter("_p.seen > 0")
    prefix = prefix.select("window", "n", F.col("_p.hash").alias("hash"), F.col("_p.pos").alias("_off"))
    tried = found.join(prefix, "hash").withColumn("start", F.col("pos") - F.col("_off")).filter("start >= 0")
    tried = tried.groupBy("_a", "_b").agg(F.collect_set(F.struct("start", "n", "window")).alias("_c"))
    # The words are bound as a lambda's variable, so that they are found once for a document, not once for a window.
    fits = lambda w: F.filter("_c", lambda c: (c.start + c.n <= F.size(w)) & (F.array_join(F.slice(w, c.start + 1, c.n), " ") == c.window))
    held = docs.join(tried, ["_a", "_b"]).select("_a", "_b", F.element_at(F.transform(F.array(words_of("text")), fits), 1).alias("_c"))
    held = cut(held).filter("size(_c) > 0").dropDuplicates(["_a", "_b"])
    covered = F.array_distinct(F.flatten(F.transform("_c", lambda c: F.sequence(c.start, c.start + c.n - 1))))
    held = cut(held.select("_a", "_b", F.size(covered).cast("long").alias("n_hit"), F.array_distinct("_c.window").alias("_c")))
    of = held.select("_a", "_b", F.explode("_c").alias("window")).join(windows, "window")
    of = of.groupBy("_a", "_b").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return held.select("_a", "_b", "n_hit").join(of, ["_a", "_b"])


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per document.

    A document is contaminated if at least one word in ``share`` is hit. NULL and empty texts have no words and
    are never contaminated; repeated rows are reported each.
    """
    own = docs.select("doc_id", *row_key("doc_id", "text"), count_words("text").alias("n_words"))
    found = own.join(hits(docs, items, size, shingle), ["_a", "_b"], "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), sha256_of(listed).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    d = packed(docs, "doc_id", "text")
    bad = cut(hits(d.select("doc_id", "text"), items, size, shingle).select("_a", "_b", "n_hit"))
    d = d.select("_row", *row_key("doc_id", "text"), count_words("text").alias("n_words"))
    return d.join(bad, ["_a", "_b"], "left").filter(F.col("n_hit").isNull() | (share * F.col("n_hit") < F.col("n_words"))).select("_row.*")
