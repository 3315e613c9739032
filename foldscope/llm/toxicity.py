"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; the probability of each is a feature of all later ones. In training
those probabilities are out-of-fold, so that a later model never learns from an earlier one's memory of a row.

Features are words and word beginnings of 3 to 6 letters (for families of inflected words), chosen greedily on the
labelled sample: each next one covers the most positive rows not yet covered. Fitting uses a bounded sample of
labelled rows; scoring reads every whole text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscope.llm import linear
from foldscope.runtime import cut

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
# Labelled rows for the fit, candidates and features of a category, least rows of a candidate, folds.
SAMPLE, CANDIDATES, FEATURES, SUPPORT, FOLDS = 10_000, 256, 64, 5, 5
# What a negative row of a feature costs in positive ones, and the positive rows that it must add beyond that.
NEGATIVE_COST, LEAST_GAIN = 0.2, 3
THRESHOLD = 0.5
# Seed words that divide rows labelled toxic into categories; the chain ends in the label itself.
SEEDS = {
    "insult": "idiot moron stupid loser clown scum fool jerk".split(),
    "contempt": "worthless pathetic trash disgusting garbage useless".split(),
}
LAST = "toxic"
MEMO_WORDS = 300_000


def parts_of(word: str) -> list[str]:
    """A word (written with an end mark) and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) > k)]


def _hash(part: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(part.encode()) >> 1


class _Parts(dict):
    """Bytes of the hashes of a word's parts, remembered; with ``known``, of the numbers of the known ones."""

    def __init__(self, known: dict[int, int] | None = None) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        hashes = [_hash(p) for p in parts_of(word)]
        if self.known is None:
            out = np.array(hashes, np.int64).tobytes()
        else:
            out = np.array([self.known[h] for h in hashes if h in self.known], np.int32).tobytes()
        self[word] = out
        return out


def sample_of(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = SAMPLE) -> DataFrame:
    """doc_id, text and label columns of at most ``rows`` labelled documents, by hash of the id.

    Rows with a NULL id or label are no labels; of labels that repeat an id the least values count.
    """
    sound = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(*[F.min(c).cast("int").alias(c) for c in columns])
    some = sound.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(texts.join(F.broadcast(some), "doc_id"))  # at most ``rows`` rows


def categories(text: str, label: str) -> dict[str, Column]:
    """Category labels of a labelled row: the label and, for each category, one of its seed words."""
    out = {c: ((F.col(label) == 1) & F.lower(text).rlike(rf"(?<!\p{{L}})({'|'.join(words)})(?!\p{{L}})")).cast("int") for c, words in SEEDS.items()}
    return out | {LAST: F.col(label).cast("int")}


def candidates(sample: DataFrame, names: list[str], per: int = CANDIDATES, support: int = SUPPORT) -> list[int]:
    """Hashes of the parts that stand out most in the positive rows of some category (z score of their count)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts()
        for batch in batches:
            y = np.array([batch.column(k + 1).to_pylist() for k in range(len(names))], np.int64).T.reshape(-1, len(names))
            found = [np.unique(np.frombuffer(b"".join(map(parts.__getitem__, set(WORD.findall(t.as_py().lower())))), np.int64)) for t in batch.column(0)]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            hashes, where = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
            sums = [np.bincount(where, weights=y[rows, k] if k >= 0 else None, minlength=len(hashes)).astype(np.int64) for k in range(-1, len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *map(pa.array, sums)], ["part", "n", *names])

    counts = sample.select("text", *names).mapInArrow(count, ", ".join(["part long", "n long", *[f"{c} long" for c in names]]))
    counts = cut(counts.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).filter(F.col("n") >= support))
    total = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    out: dict[int, None] = {}
    for c in names:
        rate = total[c] / max(total["n"], 1)
        if 0 < rate < 1:
            z = (F.col(c) - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate))
            out |= dict.fromkeys(r[0] for r in counts.orderBy(z.desc(), "part").limit(per).collect())
    return list(out)


def vectors(known: list[int]):
    """The numbers of the known parts, and a function from a text to its counts of them and of all words."""
    number = {h: i for i, h in enumerate(known)}

    def count(parts: _Parts, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        hit = np.frombuffer(b"".join(map(parts.__getitem__, words)), np.int32)
        return np.r_[np.bincount(hit, minlength=len(known))[: len(known)], len(words)].astype(np.float32)

    return number, count


def chosen(x: np.ndarray, y: np.ndarray, most: int, least: float = LEAST_GAIN) -> list[int]:
    """Columns picked one by one: each has the most positive rows not yet covered, less a cost for negative ones.

    When none adds enough, all positive rows count as uncovered again, so that a word that always stands beside
    others is found as well.
    """
    hit, left, out = x > 0, y == 1, []
    cost = NEGATIVE_COST * hit[y == 0].sum(axis=0)
    while len(out) < most and x.shape[1]:
        gain = hit[left].sum(axis=0) - cost
        gain[out] = -np.inf
        best = int(gain.argmax())
        if gain[best] < least:
            if (left == (y == 1)).all():
                break
            left = y == 1
            continue
        out.append(best)
        left &= ~hit[:, best]
    return out


def own_features(x: np.ndarray, columns: list[int], earlier: np.ndarray) -> np.ndarray:
    """Log counts of a category's parts, their share of all words, and the earlier categories' probabilities."""
    counts = x[:, columns]
    return np.c_[np.log1p(counts), np.log1p(300 * counts.sum(axis=1) / np.maximum(x[:, -1], 1)), earlier]


class Chain:
    """One model for each category, in order; each sees its features and the earlier probabilities."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.columns, self.models = names, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray, n_folds: int = FOLDS) -> Chain:
        fold = linear.folds(keys, n_folds)
        earlier = np.zeros((len(x), 0))
        for k in range(len(self.names)):
            self.columns.append(chosen(x[:, :-1], y[:, k], FEATURES))
            own = own_features(x, self.columns[k], earlier)
            self.models.append(linear.fit(own, y[:, k]))
            earlier = np.c_[earlier, linear.out_of_fold(own, y[:, k], fold, n_folds)]
        self.held_out = earlier
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for columns, model in zip(self.columns, self.models, strict=True):
            p = np.c_[p, model.predict(own_features(x, columns, p))]
        return p


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Chain, list[int]]:
    """The chain and its parts, from at most ``rows`` labelled documents."""
    sample = sample_of(docs, labels, [LAST], rows)
    kinds = categories("text", LAST)
    names = list(kinds)
    sample = sample.select("doc_id", "text", *[v.alias(c) for c, v in kinds.items()])
    known = candidates(sample, names)
    number, count = vectors(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(number)
        for batch in batches:
            x = [count(parts, t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), *batch.columns[2:]], ["doc_id", "x", *names])

    got = sample.mapInArrow(read, ", ".join(["doc_id long", "x binary", *[f"{c} int" for c in names]])).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), len(known) + 1).astype(np.float64)
    return Chain(names).fit(x, got[names].to_numpy(float), got["doc_id"].to_numpy()), known


def score(docs: DataFrame, chain: Chain, known: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last reaches the threshold): a row per document."""
    number, count = vectors(known)
    names = [f"p_{c}" for c in chain.names]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(number)
        for batch in batches:
            x = np.stack([count(parts, t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(known) + 1))
            p = chain.predict(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, ", ".join(["doc_id long", *[f"{c} double" for c in names], "toxic boolean"]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` of ``docs`` by a chain fitted on ``labels`` (doc_id, toxic 0/1).

    NULL and empty texts have no features and get the base rate of texts without any. Without labels, or with
    labels of one class, every document gets a rate near it. Repeated rows are scored each; other columns are
    ignored.
    """
    chain, known = train(docs, labels, rows)
    return score(docs, chain, known, threshold)
