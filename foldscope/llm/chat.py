"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with character offsets. The spans of its assistant texts are
sorted by construction, so each token finds its span by binary search over the span starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: a turn is START role SEP text END and a line break.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)
LEARNED = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    r"""Text without ``<|``: a backslash becomes two, and one is put between ``<`` and ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of its learned texts, ascending, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END, "\n"]
        at += len(head)
        if role == learned and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
    return "".join(parts), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the spans. Control strings stand on both sides of a text, so none straddles."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (ends <= last[at]) & (starts < ends)


def tokenizer_for(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False) for x in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep their blanks
    return t


def format_conversations(rows: DataFrame, tokenizer: str, learned: str = LEARNED) -> DataFrame:
    """A row per conv_id of ``rows`` (conv_id, turn, role, text): see ``FORMATTED``.

    Turns are ordered by turn, ties by role and text, NULLs first; repeated rows are turns of their own. NULL
    roles and texts are empty, NULL ids are one conversation, other columns are ignored. A conversation is one
    text and so one row; many conversations of one key are never gathered.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    names = [c.split()[0] for c in FORMATTED.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pairs = [[(r or "", x or "") for r, x in zip(a, b, strict=True)] for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                drawn = [render(p, learned) for p in pairs]
                ids, starts, ends, masks = [], [], [], []
                for (_, spans), found in zip(drawn, t.encode_batch([d[0] for d in drawn], add_special_tokens=False), strict=True):
                    offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                    ids.append(found.ids)
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(loss_mask(offsets[:, 0], offsets[:, 1], spans))
                ints = pa.list_(pa.int32())
                columns = [part.column(0), pa.array([len(p) for p in pairs], pa.int64()), pa.array([d[0] for d in drawn], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, ints), pa.array(starts, ints), pa.array(ends, ints), pa.array(masks, pa.list_(pa.bool_()))], names)

    return whole.mapInArrow(encode, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask: characters that any masked token covers, each once, in order."""
    starts, ends = np.asarray(starts)[mask], np.asarray(ends)[mask]
    if not len(starts):
        return ""
    breaks = np.flatnonzero(starts[1:] > ends[:-1]) + 1  # tokens of one character's bytes share its offsets
    first, last = starts[np.r_[0, breaks]], ends[np.r_[breaks - 1, len(ends) - 1]]
    return "".join(unescape(formatted[a:b]) for a, b in zip(first, last, strict=True))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(formatted: DataFrame) -> DataFrame:
    """Lengths and hashes of turns and learned text, read back from the output of ``format_conversations``."""
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, starts, ends, mask in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                turns, mask = read_turns(text), np.array(mask, bool)
                loss = read_loss(text, starts, ends, mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
            kinds = [pa.string() if k.endswith("string") else pa.int64() for k in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(digest, DIGESTS)
