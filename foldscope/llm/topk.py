"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors are dealt to blocks. A block's index keeps, for each dimension, its vectors in order of quantised value:
a posting segment is the vectors of one (dimension, quantised value). For a query each segment has an impact,
the most that its values can add over the dimension's least. Segments are added to the accumulators by
descending impact. What is left can add no more than the next impact of every dimension; once that proves all
but a few vectors of the block to be below k exact scores already known, the possible members are rescored from
the vectors themselves. Without a proof all segments are added; nothing is ever dropped on a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope.llm.common import partitions
from foldscope.runtime import cut

# Rows of an index block and of a query block; low bits that the quantised value leaves out.
BLOCK_ROWS, QUERY_ROWS, SHIFT = 16_384, 2_048, 4
# A proof is tried after every so many segments, and rescoring begins below this share of the block.
TRY_EVERY, FEW = 64, 32

INDEX = "block int, dim int, vec_ids binary, x binary, postings binary, seg_dim binary, seg_start binary, seg_low binary, seg_high binary"


def quantised(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, or NULL for a vector that is NULL or holds NULL, NaN or infinity."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """The index of one block: vectors (n, dim), and per dimension the rows sorted by quantised value in segments."""
    n, dim = x.shape
    postings, seg_dim, seg_start, low, high = [], [], [], [], []
    for d in range(dim):
        level = x[:, d] >> SHIFT
        order = np.argsort(level, kind="stable").astype("<i4")
        starts = np.flatnonzero(np.r_[True, np.diff(level[order]) > 0])
        values = x[order, d]
        postings.append(order)
        seg_dim.append(np.full(len(starts), d, "<i4"))
        seg_start.append((starts + d * n).astype("<i4"))
        low.append(np.minimum.reduceat(values, starts))
        high.append(np.maximum.reduceat(values, starts))
    joined = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()
    return {"dim": dim, "vec_ids": ids.astype("<i8").tobytes(), "x": x.astype("<i8").tobytes(), "postings": joined(postings, "<i4"), "seg_dim": joined(seg_dim, "<i4"), "seg_start": joined(seg_start, "<i4"), "seg_low": joined(low, "<i8"), "seg_high": joined(high, "<i8")}


class Block:
    """One block's index, opened for queries."""

    def __init__(self, row: dict) -> None:
        self.dim, self.ids = row["dim"], np.frombuffer(row["vec_ids"], "<i8")
        self.x = np.frombuffer(row["x"], "<i8").reshape(len(self.ids), self.dim)
        self.largest = float(np.abs(self.x.astype(np.float64)).max(initial=0.0))
        self.floats: np.ndarray | None = None
        self.postings, self.seg_dim, self.start = (np.frombuffer(row[c], "<i4") for c in ("postings", "seg_dim", "seg_start"))
        self.low, self.high = (np.frombuffer(row[c], "<i8") for c in ("seg_low", "seg_high"))
        self.end = np.r_[self.start[1:], len(self.postings)] if len(self.start) else self.start
        self.segments = [self.postings[a:b] for a, b in zip(self.start, self.end, strict=True)]
        self.first = np.searchsorted(self.seg_dim, np.arange(self.dim)) if self.dim else np.zeros(0, int)

    def factors(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and query for products: doubles where every sum is exact in them, else integers."""
        if self.dim * self.largest * float(np.abs(q.astype(np.float64)).max(initial=0.0)) >= 2.0**53:
            return self.x, q
        if self.floats is None:
            self.floats = self.x.astype(np.float64)
        return self.floats, q.astype(np.float64)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id ``own``: by score, ties to the smaller id."""
        n, q = len(self.ids), q.astype(np.int64)
        gains = np.maximum(q[self.seg_dim] * self.low, q[self.seg_dim] * self.high)
        least = np.minimum.reduceat(gains, self.first) if self.dim else np.zeros(0, np.int64)
        gains = gains - least[self.seg_dim]
        order = np.argsort(-gains, kind="stable")
        order = order[gains[order] > 0]
        added, base = np.zeros(n, np.int64), int(least.sum())
        # Impacts still to come, by dimension, after each segment: the next one of the same dimension.
        ahead = np.zeros(self.dim, np.int64)
        np.maximum.at(ahead, self.seg_dim, gains)
        following = np.zeros(len(gains), np.int64)
        by_dim = order[np.argsort(self.seg_dim[order], kind="stable")]
        same = self.seg_dim[by_dim[1:]] == self.seg_dim[by_dim[:-1]]
        following[by_dim[:-1][same]] = gains[by_dim[1:][same]]
        others, (x, factor) = self.ids != own, self.factors(q)
        for at in range(0, len(order), TRY_EVERY):
            for s in order[at : at + TRY_EVERY]:
                added[self.segments[s]] += gains[s]
                ahead[self.seg_dim[s]] = following[s]
            possible = self._possible(added, base + int(ahead.sum()), others, x, factor, k)
            if FEW * len(possible) <= n:
                break
        else:
            possible = self._possible(added, base, others, x, factor, k)
        scores = (x[possible] @ factor).astype(np.int64)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]

    def _possible(self, added: np.ndarray, rest: int, others: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Rows whose bound reaches the k-th of some exact scores; all rows if there are fewer than k."""
        lead = np.argpartition(-added, min(len(added) - 1, 2 * k))[: 2 * k + 1]
        lead = lead[others[lead]]
        if len(lead) < k:
            return np.flatnonzero(others)
        sure = np.sort(x[lead] @ q)[-k]
        return np.flatnonzero(others & (added + rest >= sure))


def largest(rows: DataFrame) -> tuple[float, int]:
    """The largest absolute component and the most dimensions of the quantised vectors."""
    ends = [F.abs(f("x").cast("double")) for f in (F.array_max, F.array_min)]
    found = rows.agg(F.coalesce(F.max(F.greatest(*ends)), F.lit(0.0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    return found[0], found[1]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` with the highest integer inner product.

    Both tables have vec_id and embedding. Rows with a NULL id or an unsound vector take no part; vectors of other
    lengths than the query's aren't compared with it; rows that repeat an id and vector count once, and rows with
    the query's id are its own. Queries and vectors meet in blocks of bounded size, each pair of blocks once.
    Scores are exact 64-bit integers; vectors so large that a sum might not fit are an error, not a wrong score.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("x"))
        return rows.filter("vec_id is not null and x is not null").dropDuplicates(["vec_id", "x"])

    v, q = cut(sound(vectors)), cut(sound(queries))
    (big, dim), (asked_big, _) = largest(v), largest(q)
    if 2 * dim * big * asked_big >= 2.0**63:
        raise ValueError(f"components up to {big:g} and {asked_big:g} in {dim} dimensions: inner products may not fit 64 bits")
    blocks, groups = max(1, -(-v.count() // BLOCK_ROWS)), max(1, -(-q.count() // QUERY_ROWS))

    def index(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy()).astype(np.int64).reshape(len(rows), -1)
        return pd.DataFrame([{"block": key[0], **build(rows["vec_id"].to_numpy(), x)}])

    def bundle(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy()).astype("<i8").reshape(len(rows), -1)
        return pd.DataFrame([{"part": key[0], "dim": key[1], "query_ids": rows["vec_id"].to_numpy().astype("<i8").tobytes(), "q": x.tobytes()}])

    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")).withColumn("dim", F.size("x"))
    held = cut(dealt(v, blocks, "block").groupBy("block", "dim").applyInPandas(index, INDEX))
    asked = cut(dealt(q, groups, "part").groupBy("part", "dim").applyInPandas(bundle, "part int, dim int, query_ids binary, q binary"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = held.join(asked, ["block", "part", "dim"]).repartition(max(partitions(spark), min(blocks * groups, 100_000)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                fields = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                block, ids = Block(fields), np.frombuffer(fields["query_ids"], "<i8")
                asked_for = np.frombuffer(fields["q"], "<i8").reshape(len(ids), block.dim)
                found = [block.search(own, x, k) for own, x in zip(ids, asked_for, strict=True)]
                sizes = [len(f[0]) for f in found]
                columns = (np.repeat(ids, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    # A query's block winners carry no vectors; ranks above k are dropped before the exchange as well.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
