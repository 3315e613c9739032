"""Token-ID files in patched frame-of-reference blocks.

``write_tokens`` encodes whole texts and writes them in ascending id order; ``read_tokens`` gives each
document's position and ids back. A file row is a *chunk*: a run of whole documents. Its payload is

    u32 number of ids n, u32 block length b, then for the ceil(n / b) blocks
    u32 minimum[], u8 width[], u16 exception count[], u32 start of the packed bits[],
    the packed bits, u16 exception positions, u32 exception values

Each block stores id - minimum in ``width`` bits, the width that holds ``percentile`` per cent of its
values; larger values are exceptions, stored whole. The starts let a reader open one block alone.
Chunks are rows of a Parquet table, so Spark's committer makes a retried task harmless and any store will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscope.llm.common import ASCII_UPPER, partitions, text_hash

# Ids of one chunk, unless a single document has more.
CHUNK_IDS = 1 << 18
# Ids of one block; positions of exceptions fit 16 bits.
BLOCK_IDS = 256
# A worker's memo of words is emptied beyond this size, that of word stems stops growing; they only save work.
MEMO_WORDS, MEMO_STEMS = 400_000, 500_000

CHUNKS = "shard int, chunk int, chunk_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"


def _bits(width: int) -> int:
    return (BLOCK_IDS * width + 7) // 8


def pack(ids: np.ndarray, percentile: int = 90) -> bytes:
    """Payload of ``ids`` (unsigned 32-bit); empty input gives a payload without blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    grid = np.zeros(blocks * BLOCK_IDS, "<u4")
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK_IDS)
    low = grid.min(axis=1).astype("<u4") if blocks else np.zeros(0, "<u4")
    delta = grid - low[:, None]
    at = min(BLOCK_IDS - 1, BLOCK_IDS * percentile // 100)
    typical = np.partition(delta, at, axis=1)[:, at] if blocks else np.zeros(0, "<u4")
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype("<u1")
    odd = delta >> width[:, None].astype(np.uint64) > 0
    counts = odd.sum(axis=1).astype("<u2")
    sizes = (BLOCK_IDS * width.astype(np.int64) + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype("<u4") if blocks else np.zeros(0, "<u4")
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(np.ascontiguousarray(delta[rows]).astype("<u4").reshape(-1, 1).view(np.uint8), axis=1, count=int(w), bitorder="little")
            lines = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            packed[starts[rows][:, None].astype(np.int64) + np.arange(lines.shape[1])] = lines
    where = np.nonzero(odd)
    head = np.array([n, BLOCK_IDS], "<u4")
    return b"".join(x.tobytes() for x in (head, low, width, counts, starts, packed, where[1].astype("<u2"), grid[where].astype("<u4")))


def unpack(payload: bytes) -> np.ndarray:
    """The ids that ``pack`` was given."""
    n, block = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    blocks, at = -(-n // block), 8

    def section(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    low, width, counts, starts = section("<u4", blocks), section("<u1", blocks), section("<u2", blocks), section("<u4", blocks)
    packed = section("<u1", int(((block * width.astype(np.int64) + 7) // 8).sum()))
    position, value = section("<u2", int(counts.sum(dtype=np.int64))), section("<u4", int(counts.sum(dtype=np.int64)))
    grid = np.zeros((blocks, block), "<u4")
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            lines = packed[starts[rows][:, None].astype(np.int64) + np.arange((block * int(w) + 7) // 8)]
            bits = np.unpackbits(lines, axis=1, count=block * int(w), bitorder="little").reshape(-1, int(w))
            whole = np.zeros((len(bits), 4), np.uint8)
            short = np.packbits(bits, axis=1, bitorder="little")
            whole[:, : short.shape[1]] = short
            grid[rows] = whole.view("<u4").reshape(len(rows), block)
    grid += low[:, None]
    grid[np.repeat(np.arange(blocks), counts), position] = value
    return grid.reshape(-1)[:n]


class Encoder(dict):
    """Encodes texts word by word (between ASCII blanks), remembering the words it has met.

    The tokenizers must drop white space before it splits words (as ``word_bpe_49k.json`` does), so that the ids of
    a text are the ids of its words one after another. A word of small letters, with ASCII punctuation behind it or
    not, is one or two of its pieces and goes to its BPE model as it is; probes at the start check that.
    """

    # UTF-8 lead bytes of combining marks, before which lower-casing could change what composes.
    MARKS = (b"\xcc", b"\xcd")
    BEHIND = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        t = self.tokenizer = Tokenizer.from_file(path)
        if self._encode("a b\nc") != self._encode("a") + self._encode("b") + self._encode("c"):
            raise ValueError("the tokenizers must drop white space")
        lower = self._encode("AZ") == self._encode("az")
        same = bytes(range(256)).translate(bytes.maketrans(b"\n", b" "))
        self.blanks = same
        self.folded = same.translate(bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())) if lower else same
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        self.letters = str.maketrans({chr(b): chr(b if b in shown else next(rest)) for b in range(256)})
        self.model = t.model
        self.stems: dict[str, bytes] = {}
        if any(self._direct(w) != self._encode(w) for w in ("word", "straße", "élève", "ñandú", "zzqx")):
            self.model = None

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _direct(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return np.array([x.id for x in found], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(self.BEHIND)
        coded = self.stems.get(stem)
        if coded is None:
            if self.model is not None and stem.isalpha() and stem == stem.lower() and max(stem) < "\u0180":
                coded = self._direct(stem)
                if len(self.stems) < MEMO_STEMS:
                    self.stems[stem] = coded
            else:
                stem, coded = text, self._encode(text)
        if stem != text:
            tail = text[len(stem) :]
            coded += self.stems.get(tail) or self.stems.setdefault(tail, self._encode(tail))
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = coded
        return coded

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        plain = any(m in raw for m in self.MARKS) or b"<|" in raw  # control strings are matched before folding
        return b"".join(map(self.__getitem__, raw.translate(self.blanks if plain else self.folded).split(b" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, whose memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Free this worker's memos, where other work follows in it."""
    _encoders.clear()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, percentile: int = 90, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into a table of chunks at ``path``.

    Rows are dealt to range shards by (doc_id, text hash) and sorted there; NULL ids come first, a NULL or
    empty text has the end id alone, rows with one id follow each other by text hash. Other columns are ignored.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        chunk, start, held, ids, lens, shard = 0, 0, 0, [], [], 0
        parts: list[bytes] = []

        def out() -> pa.RecordBatch:
            nonlocal chunk, start, held, ids, lens, parts
            row = [[shard], [chunk], [start], [held], [ids], [lens], [pack(np.frombuffer(b"".join(parts), "<u4"), percentile)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            chunk, start, held, ids, lens, parts = chunk + 1, start + held, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, where, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    coded = encode(text or "")
                    n, shard = len(coded) // 4 + 1, where
                    if held and held + n > CHUNK_IDS:
                        yield out()
                    held += n
                    ids.append(doc)
                    lens.append(n)
                    parts += (coded, end)
        if held:
            yield out()

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", text_hash("text"))
    dealt = kept.repartitionByRange(shards or partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(chunks, CHUNKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``base``, the number of ids in all shards before: joined from one row per shard."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    bases = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))
    return chunks.join(F.broadcast(bases), "shard")  # a row per written shard, so bounded by the shard count


def document_digests(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the chunks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, ids, lens, payload = (batch.column(c)[row] for c in range(4))
                values, lens = unpack(payload.as_py()), np.array(lens.as_py(), np.int64)
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(values[b - n : b].tobytes()) for b, n in zip(ends, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(base.as_py() + ends - lens), pa.array(lens), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = chunks.select((F.col("base") + F.col("chunk_start")).alias("base"), "doc_ids", "doc_lens", "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
