"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Similarity is the weighted Jaccard of (1 + ln tf) * idf over word 5-shingles. Document frequencies are taken over
all documents in 2^18 hash buckets, so the table that every task needs is 2 MB whatever the corpus. idf runs from
``IDF_FLOOR`` to 1: without a floor the shingles of a group that holds a third of the corpus would weigh so little
that one changed word parted its members.

Texts with the same words are one *content*. Contents that share a band meet their bucket's pivot, not each
other; pairs are verified on the exact vectors. A bucket is done when its contents are one component. For what
is left, either all pairs between different components are few (then they are verified) or more pivots are
tried: no candidate is dropped, and no round makes more than a few pairs a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscope.llm.common import packed, row_key
from foldscope.runtime import cut

SHINGLE, THRESHOLD = 5, 0.8
# A pair at the threshold meets in one of 20 bands of 4 with probability 1 - (1 - 0.8^4)^20 > 0.99997.
BANDS, ROWS = 20, 4
BUCKET_BITS, DRAW_BITS, SEED = 18, 14, 20260
IDF_FLOOR = 0.6
# Pairs between components are compared by weight once there are at most so many of them for each content, and
# all verified once at most so many for each content may have a link.
COMPARED_PER_CONTENT, PAIRS_PER_CONTENT = 256, 12


# Bytes of words: ASCII letters (in one case), digits and underscore, and all of UTF-8 beyond ASCII.
_IN_WORD = np.array([chr(b).isalnum() or chr(b) == "_" or b >= 128 for b in range(256)])
_VALUE = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint64) + np.uint64(1)
# Powers of an odd base modulo 2^64 and of its inverse turn running sums into hashes of any word at once.
_BASE, _REACH = 0x9E3779B97F4A7C15, 1 << 16
_POWERS = np.cumprod(np.full(_REACH, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(_REACH, pow(_BASE, -1, 1 << 64), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a whole text, in order. Long texts go piece by piece, cut between words."""
    import xxhash

    raw = np.frombuffer((text or "").encode(), np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + _REACH, side="right")))
        size = int(ends[to - 1] - first)
        if size > _REACH:  # one endless word
            h = np.array([xxhash.xxh3_64_intdigest(raw[first : ends[at]].tobytes().lower())], np.uint64)
        else:
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_VALUE[raw[first : first + size]] * _POWERS[:size], out=sums[1:])
            a, b = starts[at:to] - first, ends[at:to] - first
            h = _mixed((sums[b] - sums[a]) * _INVERSES[a] + (b - a).astype(np.uint64))
        out.append(h)
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(distinct shingle hashes ascending, their counts, the words' hashes in order); a shorter text is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h, np.zeros(0, np.int64), b""
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[k : len(h) - size + 1 + k]
    out = np.sort(_mixed(out))
    new = np.flatnonzero(np.r_[True, out[1:] != out[:-1]])
    return out[new], np.diff(new, append=len(out)), h.tobytes()


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each hash bucket, and how many have words at all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found, _, _ = shingles(text.as_py())
                n += len(found) > 0
                total[buckets(found)] += 1  # once for a document, however often the bucket stands there
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[total[used], n])], ["bucket", "n"])

    # At most 2^18 + 1 rows reach the driver, at any corpus size.
    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BUCKET_BITS)
    real = rows[rows.bucket >= 0]
    df[real.bucket.to_numpy(np.int64)] = real.n
    return df, int(rows.n[rows.bucket < 0].sum())


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """idf of each hash bucket, from the floor (in every document) to 1 (in one)."""
    return IDF_FLOOR + (1 - IDF_FLOOR) * np.log1p(n / np.maximum(df, 1.0)) / np.log1p(max(n, 1))


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[buckets(hashes)]


class Sampler:
    """Improved consistent weighted sampling: ``BANDS * ROWS`` draws (shingle, step) of a weighted set.

    For each shingle and draw: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln w / r + b); the least
    ln c - r (t - b + 1) wins. The variates stand in a table that a hash of (shingle, draw) points into.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        n = 1 << DRAW_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        log_w = np.log(w).astype(np.float32)
        best = np.full(BANDS * ROWS, np.inf, np.float32)
        pick = np.zeros(BANDS * ROWS, np.uint64)
        step = np.zeros(BANDS * ROWS, np.float32)
        all_draws = np.arange(BANDS * ROWS)
        for at in range(0, len(hashes), 2048):
            h = hashes[at : at + 2048]
            where = ((self.odd[:, None] * h[None, :]) >> np.uint64(64 - DRAW_BITS)).astype(np.intp)
            r, b = self.r[where], self.b[where]
            t = np.floor(log_w[None, at : at + 2048] / r + b)
            key = self.log_c[where] - r * (t - b + np.float32(1))
            won = key.argmin(axis=1)
            value = key[all_draws, won]
            better = value < best
            best[better], pick[better], step[better] = value[better], h[won][better], t[all_draws, won][better]
        sample = _mixed(pick * np.uint64(0xD6E8FEB86659FD93) + step.astype(np.int64).astype(np.uint64)).reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + sample[:, k])
        return out.view(np.int64)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, _a, _b, content (hash of the words; NULL without words), weight (sum of the vector), bands."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), "text")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64())]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sampler = Sampler()
        for batch in batches:
            content, weight, keys = [], [], []
            for text in batch.column(3):
                found, counts, words = shingles(text.as_py())
                if not len(found):
                    content, weight, keys = [*content, None], [*weight, None], [*keys, None]
                    continue
                w = weights(found, counts, idf.value)
                content.append(xxhash.xxh3_128_digest(words))
                weight.append(float(w.sum()))
                keys.append(sampler.bands(found, w))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip((content, weight, keys), kinds[3:], strict=True)]], ["doc_id", "_a", "_b", "content", "weight", "bands"])

    return rows.mapInArrow(sign, "doc_id long, _a long, _b long, content binary, weight double, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The rows x, y of ``pairs`` whose weighted Jaccard reaches the threshold, computed from both whole texts."""
    t = texts.select(F.col("content").alias("x"), F.col("text").alias("_tx"))
    p = pairs.join(t, "x").join(t.toDF("y", "_ty"), "y").select("x", "y", "_tx", "_ty")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                fx, cx, _ = shingles(batch.column(2)[i].as_py())
                wx = weights(fx, cx, idf.value)
                if batch.column(1)[i].as_py() != last:  # rows of one pivot follow each other
                    last = batch.column(1)[i].as_py()
                    fy, cy, _ = shingles(batch.column(3)[i].as_py())
                    held = fy, weights(fy, cy, idf.value)
                fy, wy = held
                _, ix, iy = np.intersect1d(fx, fy, assume_unique=True, return_indices=True)
                shared = np.minimum(wx[ix], wy[iy]).sum()
                keep.append(bool(shared >= threshold * (wx.sum() + wy.sum() - shared) - 1e-9))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["x", "y"])

    return p.mapInArrow(check, "x binary, y binary")


def components(links: DataFrame, node: str = "content") -> DataFrame:
    """(node, comp) for the nodes of the undirected ``links`` (x, y): comp is the least node it is joined to.

    Least labels spread along links and by pointer jumping; every round is written, so nothing is recomputed.
    """
    edges = cut(links.union(links.select("y", "x")).distinct())
    labels = cut(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("comp")).withColumnRenamed("x", node))
    while True:
        near = edges.join(labels.select(F.col(node).alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("_near"))
        new = labels.join(near.withColumnRenamed("x", node), node).select(node, F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        jump = labels.select(F.col(node).alias("comp"), F.col("comp").alias("_next"))
        new = cut(new.join(jump, "comp", "left").select(node, "_old", F.least("comp", "_next").alias("comp")))
        changed = new.filter("comp <> _old").limit(1).count()
        labels = new.select(node, "comp")
        if not changed:
            return labels


def similar(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(signatures of all documents, components of the contents that have links)."""
    spark: SparkSession = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(inverse(df, n))
    signed = cut(signatures(docs, idf))
    contents = signed.filter("content is not null").groupBy("content").agg(F.min(F.struct("_a", "_b")).alias("_k"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    banded = contents.select("content", "weight", F.explode("bands").alias("bucket"))
    met = banded.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    members = cut(banded.join(met, "bucket"))
    # The pivot of a bucket is its content with the most bucket mates: the one nearest to a group's middle.
    mates = members.groupBy("content").agg(F.sum("_n").alias("_d"))
    members = cut(members.join(mates, "content"))
    pivot = F.max(F.struct("_d", "content", "weight")).alias("_p")
    pivots = members.groupBy("bucket").agg(pivot)
    members = cut(members.join(pivots, "bucket").select("bucket", "content", "weight", F.col("_p.content").alias("pivot"), F.col("_p.weight").alias("_pw")))
    of = members.select("content").distinct()
    keys = signed.join(of, "content").groupBy("content").agg(F.min(F.struct("_a", "_b")).alias("_k")).select("content", "_k._a", "_k._b")
    texts = docs.select(*row_key("doc_id", "text"), "text").join(keys, ["_a", "_b"]).select("content", "text")
    texts = cut(texts.dropDuplicates(["content"]))

    pairs = members.filter((F.col("content") != F.col("pivot")) & _near("weight", "_pw", threshold)).select(F.col("content").alias("x"), F.col("pivot").alias("y")).distinct()
    links = cut(verified(pairs, texts, idf, threshold))
    members, tries, count = members.select("bucket", "content", "weight"), 2, of.count()
    comp = components(links)
    while True:
        m = _unresolved(members, comp)
        if m.limit(1).count():
            m = _unresolved(_linkable(m.select("bucket", "content", "weight"), texts, idf, threshold), comp)
        left = m.groupBy("bucket").agg(F.first("_cross").alias("_x")).agg(F.sum("_x")).first()[0] or 0
        if not left:
            break
        whole = left <= COMPARED_PER_CONTENT * count
        if whole:
            fresh = cut(_cross_pairs(m, m, threshold, halved=True))
            whole = fresh.count() <= PAIRS_PER_CONTENT * count
        if not whole:
            # Members of small components first; each pivot meets every member of the other components.
            order = Window.partitionBy("bucket").orderBy("_c", F.xxhash64("content", F.lit(tries)), "content")
            pivots = m.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= tries)
            fresh = _cross_pairs(m, pivots, threshold).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
            tries *= 2
        more = cut(verified(fresh, texts, idf, threshold))
        if more.limit(1).count():
            links = cut(links.union(more))
            comp = components(links)
        if whole:
            break
        # Pivots have met all they could meet in their buckets.
        members = cut(m.select("bucket", "content", "weight").join(pivots.select("bucket", "content"), ["bucket", "content"], "left_anti"))
    return signed, comp


def _near(x: str, y: str, threshold: float):
    """Whether weights allow a link."""
    return F.least(x, y) >= F.lit(threshold) * F.greatest(x, y) - F.lit(1e-9)


def _cross_pairs(members: DataFrame, pivots: DataFrame, threshold: float, halved: bool = False) -> DataFrame:
    """x, y: contents of one bucket but two components whose weights, and what either could share, allow a link.

    ``halved`` gives each pair once, where both tables are the same.
    """
    a, b = members.alias("a"), pivots.alias("b")
    cross = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.comp") != F.col("b.comp")) & _near("a.weight", "b.weight", threshold)
    for one in ("a.shared", "b.shared"):
        cross = cross & (F.col(one) >= F.lit(threshold / (1 + threshold)) * (F.col("a.weight") + F.col("b.weight")) - F.lit(1e-6))
    if halved:
        cross = cross & (F.col("a.content") < F.col("b.content"))
    # Two contents may share several buckets: only the least of them gives the pair.
    cross = cross & (F.col("a.bucket") == F.array_min(F.array_intersect("a.buckets", "b.buckets")))
    return a.join(b, cross).select(F.col("a.content").alias("x"), F.col("b.content").alias("y"))


def _unresolved(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``members`` of buckets that hold several components, with comp, its size _c there and the bucket's pairs _cross
    between components."""
    m = members.join(comp, "content", "left").withColumn("comp", F.coalesce("comp", "content"))
    sizes = m.groupBy("bucket", "comp").agg(F.count("*").alias("_c"))
    crossed = sizes.groupBy("bucket").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_s"), F.count("*").alias("_k")).filter("_k > 1")
    crossed = crossed.select("bucket", ((F.col("_m") * F.col("_m") - F.col("_s")) / 2).cast("double").alias("_cross"))
    sizes = sizes.join(crossed, "bucket")
    return cut(m.join(sizes, ["bucket", "comp"]))


def _linkable(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """``members`` that may still have a link in their bucket, with ``shared``, the most weight they could share.

    A shingle that no other member has can't be shared. A link needs a shared weight of at least
    t / (1 + t) of both weights together, so a member that can't reach this with the bucket's least weight has
    no link there. This is exact: in a group of edited copies it drops those whose own edits part them from all.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, counts, _ = shingles(batch.column(1)[i].as_py())
                who = pa.array([batch.column(0)[i].as_py()] * len(found), pa.binary())
                yield pa.RecordBatch.from_arrays([who, pa.array(found.view(np.int64)), pa.array(weights(found, counts, idf.value))], ["content", "shingle", "w"])

    t = texts.join(members.select("content").distinct(), "content", "left_semi")
    parts = t.select("content", "text").mapInArrow(explode, "content binary, shingle long, w double")
    alone = parts.groupBy("shingle").agg(F.count("*").alias("_n"), F.first("content").alias("content"), F.first("w").alias("w")).filter("_n = 1")
    alone = alone.groupBy("content").agg(F.sum("w").alias("_own"))
    m = members.join(alone, "content", "left").withColumn("shared", F.col("weight") - F.coalesce("_own", F.lit(0.0))).drop("_own")
    least = m.groupBy("bucket").agg(F.min("weight").alias("_w"))
    share = threshold / (1 + threshold)
    m = m.join(least, "bucket").filter(F.col("shared") >= F.lit(share) * (F.col("weight") + F.col("_w")) - F.lit(1e-6))
    m = cut(m.drop("_w"))
    return m.join(m.groupBy("content").agg(F.collect_set("bucket").alias("buckets")), "content")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _a, _b, class_id, class_size, kept: a row per document.

    A class is the documents joined by links of weighted Jaccard >= ``threshold``, directly or through others;
    its id is its least doc_id (NULL if all are NULL), and the row of least (doc_id, key), NULL ids last, is kept.
    Documents without words (NULL, empty, only signs) are classes of their own. Rows that repeat an id and text
    are of one class and are all marked like their first.
    """
    return _classes(docs, threshold).drop("worded")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``classes`` with ``worded``: whether the text has words."""
    signed, comp = similar(docs, threshold)
    named = signed.select("doc_id", "_a", "_b", "content").join(comp, "content", "left")
    alone = F.concat(F.lit(b"-"), F.encode(F.concat_ws(",", F.col("_a").cast("string"), F.col("_b").cast("string")), "UTF-8"))
    named = cut(named.select("doc_id", "_a", "_b", F.coalesce("comp", "content", alone).alias("comp"), F.col("content").isNotNull().alias("worded")))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_a", "_b")
    heads = named.groupBy("comp").agg(F.min(order).alias("_first"), F.count("*").alias("class_size"))
    first = (F.col("_a") == F.col("_first._a")) & (F.col("_b") == F.col("_first._b"))
    return named.join(heads, "comp").select("doc_id", "_a", "_b", F.col("_first.doc_id").alias("class_id"), "class_size", first.alias("kept"), "worded")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one document of each class, with all its columns.

    Of rows that repeat an id and text one stays, and documents without words all stay.
    """
    d = packed(docs, "doc_id", "text")
    kept = cut(_classes(d.select("doc_id", "text"), threshold).filter("kept").select("_a", "_b", "worded").distinct())
    d = d.select("_row", *row_key("doc_id", "text")).join(kept, ["_a", "_b"])
    one = Window.partitionBy("_a", "_b").orderBy(F.xxhash64("_row"))
    return d.withColumn("_n", F.row_number().over(one)).filter("_n = 1 or not worded").select("_row.*")
