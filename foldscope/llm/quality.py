"""Quality by co-training two views of a document.

The text view sees the content, the metadata view only lang, source and n_chars. In each round either view labels
the unlabelled documents of the whole corpus of which it is surest, and the other learns from them. Both are
calibrated on labelled rows that neither was fitted on, and their odds are combined.

Texts are read once, into some 50 numbers a document; rounds and scoring run on that table.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscope.llm import linear, tokens
from foldscope.llm.common import packed, row_key
from foldscope.runtime import cut

# Labelled rows for the fit, one in so many of them held out for calibration, rounds, and the documents of each
# class that a view may label in a round, if it is at least so sure.
SAMPLE, HELD_OUT, ROUNDS, GROW, SURE = 10_000, 4, 3, 400, 0.98
THRESHOLD = 0.5
LANGS, SOURCES = 8, 48
SIGNS = string.punctuation.encode()
TEXT_SIZE, META_SIZE = len(SIGNS) + 15, LANGS + SOURCES + 3


def text_view(text: str | None) -> np.ndarray:
    """Numbers of the content of a whole text; an empty or NULL text gives zeros."""
    out = np.zeros(TEXT_SIZE, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    count = max(len(words), 1)
    upper, lower, digits = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    out[: len(SIGNS)] = np.log1p(100.0 * n[list(SIGNS)] / count)
    out[len(SIGNS) :] = (
        math.log1p(count), len(set(words)) / count, size / count, upper / max(upper + lower, 1), digits / size, n[128:].sum() / size, n[10] / count, n[:32].sum() / size,
        sum(map(str.isupper, words)) / count, sum(map(str.isalpha, words)) / count, max(map(len, words), default=0) ** 0.5,
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(count / max(len(lines), 1)), len(zlib.compress(raw, 1)) / size, sum(w[-1:].isalnum() for w in words) / count,
    )
    return out


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """One-hot buckets of lang and source, and the size; NULLs have a bucket like other values."""
    out = np.zeros((len(langs), META_SIZE))
    rows = np.arange(len(langs))
    out[rows, [zlib.crc32(repr(x).encode()) % LANGS for x in langs]] = 1
    out[rows, [LANGS + zlib.crc32(repr(x).encode()) % SOURCES for x in sources]] = 1
    size = np.log1p(np.array([max(x or 0, 0) for x in sizes], float))
    out[:, -3], out[:, -2], out[:, -1] = size, size**2, [x is None for x in sizes]
    return out


@dataclass
class Views:
    """A model of each view with its calibration, and the odds of the class."""

    text: linear.Logistic
    meta: linear.Logistic
    text_scale: linear.Logistic
    meta_scale: linear.Logistic
    prior: float

    def predict(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views and of both: their odds multiply, the prior counts once."""
        pt, pm = self.text_scale.predict(self.text.score(xt)[:, None]), self.meta_scale.predict(self.meta.score(xm)[:, None])
        return pt, pm, linear.sigmoid(linear.logit(pt) + linear.logit(pm) - self.prior)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, _a, _b, lang, source, n_chars, x (text view as 32-bit floats): a row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # a worker may have encoded texts before, and the words it remembers are of no use here
        for batch in batches:
            x = [text_view(t.as_py()).tobytes() for t in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(x, pa.binary())], [*batch.schema.names[:6], "x"])

    return rows.mapInArrow(read, "doc_id long, _a long, _b long, lang string, source string, n_chars long, x binary")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    xt = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, TEXT_SIZE).astype(float)
    return xt, meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def sure(unlabelled: DataFrame, views: Views, grow: int, least: float) -> DataFrame:
    """The rows that a view is surest of, at most ``grow`` for each view and class, from all of ``unlabelled``.

    view (0 text, 1 meta), y, p, and the row. Each batch first keeps its own best; ties go to the smaller key.
    """
    kind = unlabelled.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pt, pm, _ = views.predict(*_views(batch))
            a = np.array(batch.column("_a"))
            for view, p in enumerate((pt, pm)):
                for y, conf in ((1, p), (0, 1 - p)):
                    best = np.lexsort((a, -conf))[:grow]
                    best = best[conf[best] >= least]
                    took = batch.take(pa.array(best))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), view, np.int32)), pa.array(np.full(len(best), y, np.int32)), pa.array(conf[best]), *took.columns], ["view", "y", "p", *batch.schema.names])

    rows = unlabelled.mapInArrow(pick, f"view int, y int, p double, {kind}")
    parts = [rows.filter((F.col("view") == v) & (F.col("y") == y)).orderBy(F.desc("p"), "_a", "_b").limit(grow) for v in (0, 1) for y in (0, 1)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def train(table: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, rounds: int = ROUNDS, grow: int = GROW, least: float = SURE) -> Views:
    """Co-trained views from the ``features`` of all documents and labels (doc_id, 0/1).

    At most ``rows`` labelled documents are fitted on, by hash of the id. NULL labels and ids are no labels; of
    labels that repeat an id the least counts.
    """
    sound = labels.select("doc_id", label).dropna().groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    some = F.broadcast(cut(sound.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)))  # at most ``rows`` rows
    known = table.join(some, "doc_id").toPandas().sort_values(["doc_id", "_a", "_b"], kind="stable")
    pool = cut(table.join(sound.select("doc_id"), "doc_id", "left_anti"))
    batch = pa.RecordBatch.from_pandas(known[["lang", "source", "n_chars", "x"]].astype({"n_chars": "Int64"}), preserve_index=False)
    xt, xm = _views(batch)
    y = known["y"].to_numpy(float)
    held = linear.folds(known["_a"].to_numpy(), HELD_OUT) == 0 if len(y) > 2 * HELD_OUT else np.zeros(len(y), bool)
    test = held if held.any() else np.ones(len(y), bool)
    prior = float(linear.logit(np.array((y.sum() + 0.5) / (len(y) + 1.0))))
    given = {0: [], 1: []}  # (text view, meta view, y) that the view was given by the other
    used: set[tuple[int, int, int]] = set()
    for turn in range(rounds + 1):
        models = []
        for view, x in enumerate((xt, xm)):
            extra = given[view]
            fx = np.vstack([x[~held], *[g[view] for g in extra]])
            fy = np.concatenate([y[~held], *[g[2] for g in extra]])
            models.append(linear.fit(fx, fy))
        scales = [linear.calibrated(m.score(x[test]), y[test]) for m, x in zip(models, (xt, xm), strict=True)]
        views = Views(*models, *scales, prior)
        if turn == rounds:
            return views
        got = sure(pool, views, grow, least).toPandas()  # at most 4 * grow rows
        if len(got):
            fresh = [(int(v), int(a), int(b)) not in used for v, a, b in zip(got["view"], got["_a"], got["_b"], strict=True)]
            got = got[fresh]
            used |= {(int(v), int(a), int(b)) for v, a, b in zip(got["view"], got["_a"], got["_b"], strict=True)}
        for view in (0, 1):
            mine = got[got["view"] == view]
            if len(mine):
                part = pa.RecordBatch.from_pandas(mine[["lang", "source", "n_chars", "x"]].astype({"n_chars": "Int64"}), preserve_index=False)
                given[1 - view].append((*_views(part), mine["y"].to_numpy(float)))
    raise AssertionError("unreachable")


def score(table: DataFrame, views: Views, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _a, _b, p_text, p_meta, quality, good (quality reaches the threshold): a row per row of ``table``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pt, pm, p = views.predict(*_views(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "_a", "_b")], pa.array(pt), pa.array(pm), pa.array(p), pa.array(p >= threshold)], ["doc_id", "_a", "_b", "p_text", "p_meta", "quality", "good"])

    return table.mapInArrow(judge, "doc_id long, _a long, _b long, p_text double, p_meta double, quality double, good boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` of all documents (doc_id, text, lang, source, n_chars) by views trained on ``labels``.

    NULL and empty texts have a text view of zeros, NULL metadata values of their own; repeated rows are scored
    each; without labels every score is near one half; other columns are ignored.
    """
    table = cut(features(docs))
    return score(table, train(table, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    bad = cut(quality(docs, labels, threshold).filter("not good").select("_a", "_b").distinct())
    return packed(docs, "doc_id", "text").select("_row", *row_key("doc_id", "text")).join(bad, ["_a", "_b"], "left_anti").select("_row.*")
