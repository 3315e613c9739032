"""Substring dedup by sliding sentence spans.

A text is cut into sentences. A sentence of more than ``LONGEST`` words is cut into pieces before words whose hash is
the least of their neighbourhood, so that copies of a passage are cut alike whatever stands before them, and no
passage of 50 words is a single sentence. Every run of ``RUN`` consecutive sentences is hashed; runs are joined over
the whole corpus by hash; each occurrence but the first covers its sentences, and covered sentences are removed.

Texts are cut in Arrow batches with numpy: each word is hashed once, by prefix sums over the code points of many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from foldscope.llm.common import packed, row_key
from foldscope.runtime import cut

# Sentences of a run, the fewest words that make a run worth removing, and the most words of a piece.
RUN, FEWEST_WORDS, LONGEST = 3, 8, 16
# A cut stands before a word whose hash is the least among so many words on either side.
NEAR = 2
# End marks that need white space after them, wide ones that need none, and line breaks, which end a sentence too.
ENDS, WIDE_ENDS, BREAKS = ".!?", "。！？", "\n\r\v\f\x85\u2028\u2029"
# Characters that are words of their own, as ranges.
CJK = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
# Odd multipliers of the hashes, modulo 2^64, and the last code point of Unicode.
BASE, INVERSE, LAST = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0x10FFFF
# Code points whose words are hashed at once; a longer text is taken alone.
SLICE_CHARS = 1 << 20
WHITE, END, WIDE, BREAK, WORD = 1, 2, 4, 8, 16


class Sentences(NamedTuple):
    """Sentences of several texts, one after another."""

    text: np.ndarray  # number of the text
    start: np.ndarray  # first code point, counted from the first of all texts
    words: np.ndarray
    hash: np.ndarray  # of the words, whatever white space is between them


@cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(LAST + 1, np.uint8)
    blanks = "".join(filter(str.isspace, map(chr, range(0x3001))))
    for chars, bit in ((blanks, WHITE), (ENDS, END), (WIDE_ENDS, WIDE), (BREAKS, BREAK)):
        for c in chars:
            kinds[ord(c)] |= bit
    for a, b in CJK:
        kinds[a : b + 1] |= WORD
    return kinds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _span_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of value * BASE^place within each span [first, end), modulo 2^64, mixed."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, len(values)), dtype=np.uint64)]
    return mixed((sums[end] - sums[first]) * _powers(INVERSE, len(values) + 1)[first])


def cut_up(points: np.ndarray, ends: np.ndarray, longest: int = LONGEST) -> Sentences:
    """Sentences of texts given as code points one after another; ``ends`` are where the texts end.

    A word is a run of other characters than white space, or one CJK character with the end marks behind it. A
    sentence ends after a word that ends in a wide mark, in ``.!?`` before white space, before a line break, and at the
    end of its text. One of more than ``longest`` words is cut before each word whose hash is less than those of the
    ``NEAR`` words before it and not more than those of the ``NEAR`` after it, within the sentence; a piece that is
    still too long is cut after every ``longest // 2`` words.
    """
    n = len(points)
    none = Sentences(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    if not n:
        return none
    kind = _kinds()[points]
    white, wide, cjk = kind & WHITE != 0, kind & WIDE != 0, kind & WORD != 0
    opens = np.zeros(n + 1, bool)  # a text starts here
    opens[np.r_[0, ends]] = True
    before = lambda flags: np.r_[False, flags[:-1]]
    starts = ~white & (opens[:-1] | before(white) | ((cjk | before(cjk) | before(wide)) & ~wide))
    first = np.flatnonzero(starts)
    m = len(first)
    if not m:
        return none
    text = np.searchsorted(ends, first, side="right")
    limit = np.minimum(np.r_[first[1:], n], ends[text])  # the word and the white space behind it
    stop = first + _leading(~white, first, limit)
    word = _span_hashes(points.astype(np.uint64) + np.uint64(1), first, stop)
    breaks = np.r_[0, np.cumsum(kind & BREAK != 0)]
    last = np.r_[text[1:] != text[:-1], True]
    mark = (kind[stop - 1] & END != 0) & (limit > stop)
    over = last | wide[stop - 1] | mark | (breaks[limit] > breaks[stop])
    # Cuts inside long sentences.
    sentence = np.r_[0, np.cumsum(over)[:-1]]
    size = np.bincount(sentence)
    head = np.cumsum(size) - size
    at = np.arange(m) - head[sentence]
    long = size[sentence] > longest
    cuts = at == 0
    inner = long & (at > 0)
    for k in range(1, NEAR + 1):
        same = sentence[k:] == sentence[:-k]
        inner[k:] &= ~same | (word[k:] < word[:-k])
        inner[:-k] &= ~same | (word[:-k] <= word[k:])
    cuts |= inner
    piece = np.cumsum(cuts) - 1
    size = np.bincount(piece)
    at = np.arange(m) - (np.cumsum(size) - size)[piece]
    cuts |= (size[piece] > longest) & (at % max(longest // 2, 1) == 0)
    where = np.flatnonzero(cuts)
    return Sentences(text[where], first[where], np.diff(np.r_[where, m]), _span_hashes(word, where, np.r_[where[1:], m]))


def _leading(flags: np.ndarray, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the flags of each span are set; in a word's span the set ones come first."""
    sums = np.r_[0, np.cumsum(flags)]
    return sums[limit] - sums[first]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Texts in slices: number of the first, code points one after another, where each text ends, and the texts. NULL is empty."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + SLICE_CHARS, side="right")))
        held = [t or "" for t in texts[start:stop].to_pylist()]
        yield start, np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32), total[start:stop] - base, held
        start = stop


def _starts(s: Sentences, ends: np.ndarray) -> list[np.ndarray]:
    """For each text, where its sentences start in it."""
    begin = np.r_[0, ends[:-1]]
    bounds = np.searchsorted(s.text, np.arange(len(ends) + 1))
    return [s.start[a:b] - begin[i] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def sentences(text: str, longest: int = LONGEST) -> Column:
    """Sentences of a text in order; with leading white space put back they join to the text. NULL gives none."""

    @F.arrow_udf(ArrayType(StringType()))
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for _, points, ends, held in slices(texts):
            for t, at in zip(held, _starts(cut_up(points, ends, longest), ends), strict=True):
                cuts = [*at, len(t)]
                out.append([t[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.array(out, pa.list_(pa.string()))

    return split(F.col(text))


def runs(docs: DataFrame, run: int = RUN, fewest: int = FEWEST_WORDS, longest: int = LONGEST) -> DataFrame:
    """_h, _g (128 bits of the run's words), doc_id, _a, _b (row key), pos (first sentence)."""
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    schema = StructType([StructField(c, LongType()) for c in ("_h", "_g")] + keyed.select("doc_id", "_a", "_b").schema.fields + [StructField("pos", IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points, ends, _ in slices(batch.column(3)):
                s = cut_up(points, ends, longest)
                k = len(s.text) - run + 1
                if k <= 0:
                    continue
                words = np.r_[0, np.cumsum(s.words)]
                fit = np.flatnonzero((s.text[:k] == s.text[run - 1 :]) & (words[run:] - words[:-run] >= fewest))
                pos = fit - np.searchsorted(s.text, s.text[fit])
                h, g = np.zeros(len(fit), np.uint64), np.ones(len(fit), np.uint64)
                for j in range(run):
                    h, g = mixed(h * np.uint64(BASE) + s.hash[fit + j]), mixed(g * np.uint64(BASE) + s.hash[fit + run - 1 - j])
                rows = pa.array(s.text[fit] + at)
                kept = [batch.column(c).take(rows) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), *kept, pa.array(pos.astype(np.int32))], schema.names)

    return keyed.mapInArrow(find, schema)


REMOVED = StructType([StructField("text", StringType()), StructField("n_sentences", LongType()), StructField("removed", ArrayType(IntegerType()))])


def without(text: Column, first: Column, run: int = RUN, longest: int = LONGEST) -> Column:
    """Struct of text without the runs that start at the sentences ``first`` (NULL where none goes), n_sentences and removed."""

    @F.arrow_udf(REMOVED)
    def remove(texts: pa.Array, positions: pa.Array) -> pa.Array:
        out, counts, gone = [], [], []
        for start, points, ends, held in slices(texts):
            for i, (t, at) in enumerate(zip(held, _starts(cut_up(points, ends, longest), ends), strict=True), start):
                drop = np.zeros(len(at), bool)
                if positions[i].is_valid:
                    for p in positions[i].as_py():
                        drop[p : p + run] = True
                kept = None
                if drop.any():
                    cuts = [*at, len(t)]
                    kept = t[: at[0]] + "".join(t[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~drop))
                out.append(kept)
                counts.append(len(at))
                gone.append(np.flatnonzero(drop))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], REMOVED.names)

    return remove(text, first)


def repeats(docs: DataFrame, run: int = RUN, fewest: int = FEWEST_WORDS, longest: int = LONGEST) -> DataFrame:
    """_a, _b and for each run that isn't the first of its kind a struct (pos, first_doc_id) in ``repeats``.

    The first occurrence is the one with the least (doc_id, key, pos), NULL ids first; a run that overlaps its
    own copy in the text is an occurrence like any other. A run held by a third of the corpus is one row on one
    side of the join, so Spark can split the other side.
    """
    r = runs(docs, run, fewest, longest)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("_known"), "doc_id", "_a", "_b", "pos")).alias("_f")
    again = r.groupBy("_h", "_g").agg(first, F.count("*").alias("_n")).filter("_n > 1")
    met = r.join(again.select("_h", "_g", "_f"), ["_h", "_g"])
    later = ~((F.col("_a") == F.col("_f._a")) & (F.col("_b") == F.col("_f._b")) & (F.col("pos") == F.col("_f.pos")))
    met = met.filter(later).select("_a", "_b", F.struct("pos", F.col("_f.doc_id").alias("first_doc_id")).alias("_r"))
    return met.groupBy("_a", "_b").agg(F.collect_set("_r").alias("repeats"))


def dedup_spans(docs: DataFrame, run: int = RUN, fewest: int = FEWEST_WORDS, longest: int = LONGEST) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut out of ``text``, and four more columns.

    n_sentences; n_removed (sentences removed); removed (their numbers, ascending); first_doc_ids (documents that
    hold first occurrences, ascending, NULL ids left out). A column of ``docs`` with one of these names is
    replaced. NULL texts stay NULL; empty ones and those of fewer than ``run`` sentences stay as they are, as
    does white space before the first sentence. Rows that agree in doc_id and text are one document, and each
    gets its result.
    """
    d = packed(docs, "doc_id", "text")
    found = cut(repeats(d.select("doc_id", "text"), run, fewest, longest))
    d = d.select("_row", *row_key("doc_id", "text")).join(found, ["_a", "_b"], "left")
    d = d.withColumn("_r", without(F.col("_row.text"), F.col("repeats.pos"), run, longest))
    firsts = F.array_sort(F.array_distinct(F.filter("repeats.first_doc_id", lambda x: x.isNotNull())))
    own = {
        "text": F.coalesce("_r.text", "_row.text"),
        "n_sentences": F.col("_r.n_sentences"),
        "n_removed": F.size("_r.removed").cast("long"),
        "removed": F.col("_r.removed"),
        "first_doc_ids": F.coalesce(firsts, F.array().cast("array<bigint>")),
    }
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in own], *[v.alias(k) for k, v in own.items()])
