"""Asking about keys of a chunk of documents and getting one answer for each, without moving the rows.

Documents are dealt into chunks of a few MB. A chunk sends its distinct 64-bit keys in order, cut into slices of the
key space, one packed array per slice; the task of a slice sees that slice of every chunk, and replies to each chunk
with an array in the order of the keys it sent. So a key that a third of all rows hold is sent once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pack, unpack

CHUNK_BYTES = 4 << 20
MAX_SLICE_BITS = 14
ASK = "kind int, slice int, chunk int, keys binary, a binary, b binary"
REPLY = "chunk int, kind int, slice int, reply binary, total long, distinct long"


def text_size(docs: DataFrame) -> int:
    return docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def chunk_count(text_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-text_bytes // chunk_bytes))


def slice_bits(chunks: int) -> int:
    """As many slices as chunks, about, so that a slice's task is as large as a chunk's."""
    return min(MAX_SLICE_BITS, max(0, (chunks - 1).bit_length()))


def chunk_of(chunks: int) -> Column:
    """A row's chunk, by a hash of id and text, so equal texts, one source's rows, and rows of one id or of none spread out."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, text and the chunk."""
    return docs.select("doc_id", "text", chunk_of(chunks))


def sorted_chunk(rows: pa.Table) -> pa.Table:
    """A chunk's rows in one order, whichever order the shuffle gave: keys and their answers must line up."""
    return rows.sort_by("doc_id")


def unique_sorted(keys: np.ndarray) -> np.ndarray:
    """Where the distinct values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each slice of sorted uint64 keys begins, and the end."""
    if bits == 0:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def asks(kind: int, chunk: int, bits: int, keys: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> list:
    """One row for each slice that has keys; `a` and `b` go along with the keys."""
    at = cuts(keys, bits)
    part = lambda x, s: b"" if x is None else pack(x[at[s] : at[s + 1]])
    return [(kind, s, chunk, part(keys, s), part(a, s), part(b, s)) for s in np.flatnonzero(np.diff(at)).tolist()]


def ask_table(rows: list) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 6
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("kind", "slice", "chunk", "keys", "a", "b")
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})


def merged(rows: pa.Table, a_type=None, b_type=None) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list, list]:
    """A slice's rows: chunks, all keys one chunk after another, the order that sorts them, the group of each key in
    that order, and the payloads."""
    rows = rows.sort_by("chunk")
    keys = [unpack(x, np.uint64) for x in rows["keys"].to_pylist()]
    a = [unpack(x, a_type) for x in rows["a"].to_pylist()] if a_type else []
    b = [unpack(x, b_type) for x in rows["b"].to_pylist()] if b_type else []
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    first = unique_sorted(ranked)
    return list(zip(rows["chunk"].to_pylist(), map(len, keys))), order, ranked, first, a, b


def reply_table(kind: int, piece: int, chunks: list, answers: np.ndarray, total: int = 0, distinct: int = 0) -> pa.Table:
    """`answers`, in the order in which the chunks' keys came, dealt back to the chunks."""
    ends = np.cumsum([n for _, n in chunks])
    blobs = [pack(answers[e - n : e]) for (_, n), e in zip(chunks, ends.tolist())]
    k = len(chunks)
    return pa.table(
        {
            "chunk": pa.array([c for c, _ in chunks], pa.int32()),
            "kind": pa.array([kind] * k, pa.int32()),
            "slice": pa.array([piece] * k, pa.int32()),
            "reply": pa.array(blobs, pa.binary()),
            "total": pa.array([total] * k, pa.int64()),
            "distinct": pa.array([distinct] * k, pa.int64()),
        }
    )


def answered(replies: pa.Table, kind: int, dtype) -> np.ndarray:
    """The answers to a chunk's keys of one kind, in the keys' order."""
    own = replies.filter(pc.equal(replies["kind"], kind)).sort_by("slice")
    parts = [unpack(x, dtype) for x in own["reply"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def round_trip(chunks: DataFrame, ask: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What the slices reply to the chunks' questions."""
    return chunks.groupBy("chunk").applyInArrow(ask, ASK).groupBy("kind", "slice").applyInArrow(answer, REPLY)
