"""Substring dedup: words of a document that a smaller document already has, in windows of consecutive words.

Method: a count-min prefilter. Every chunk of documents makes the rows of a count-min sketch of its windows (sparse:
the cells it touches, each with whether one or more of its documents touch it). The sketches are merged by slices of
the cells; a cell's merged count is never below a window's number of documents, so a window whose cells count two or
more in every sketch row is estimated repeated, and no repeated window is lost. Only those windows go to the second
pass, which groups them exactly, by 128 bits of hash, and finds the smallest document of each.

The sketch widens with the input (`CELLS` cells per window and row), and nothing is broadcast or collected.

Results for odd input: null and empty texts have no words; a text of fewer words than a window loses nothing; of
equal texts the smallest doc_id keeps its words; rows that repeat a doc_id count as one document's separate texts
and never remove each other's words; a null doc_id is larger than every other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import pack, unpack
from .words import SECOND_BASE, WINDOW_BASE, Words, mix, window_hashes, window_starts, word_hashes, words_of

WINDOW = 13
ROWS = 2
CELLS = 8
NO_ID = np.iinfo(np.int64).max


def _windows(rows: pa.Table, size: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the windows' first words, their documents' ids, and two hashes of each."""
    words = words_of(rows["text"])
    first = window_starts(words, size)
    ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
    hashes = word_hashes(words)
    one = window_hashes(hashes, first, size, WINDOW_BASE)
    two = window_hashes(mix(hashes ^ np.uint64(SECOND_BASE)), first, size, SECOND_BASE)
    return words, first, ids[words.doc[first]], ids, one, two


def _cells(one: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each window in one row of the sketch, spread over all 64 bits so that slices are even."""
    bits = width.bit_length() - 1
    return mix(one + np.uint64(row)) >> np.uint64(64 - bits) << np.uint64(64 - bits)


def sketch(rows: pa.Table, size: int, width: int, bits: int) -> pa.Table:
    """The cells that a chunk touches, with 1 if one of its documents does and 2 if more do."""
    rows = X.sorted_chunk(rows)
    _, _, ids, _, one, _ = _windows(rows, size)
    chunk, out = rows["chunk"][0].as_py(), []
    for row in range(ROWS):
        cells, many = _touched(one, ids, row, width)
        out += X.asks(row, chunk, bits, cells, many)
    return _narrow(X.ask_table(out), width)


def _touched(one: np.ndarray, ids: np.ndarray, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(one):  # no text of the chunk has a window
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    cells = _cells(one, row, width)
    order = np.argsort(cells, kind="stable")  # stable: a cell's ids stay in ascending order
    cells, ids = cells[order], ids[order]
    first = X.unique_sorted(cells)
    last = np.append(first[1:], len(cells)) - 1
    return cells[first], (ids[first] != ids[last]).astype(np.uint8) + np.uint8(1)


def _narrow(rows: pa.Table, width: int) -> pa.Table:
    """Cells as gaps between neighbours: 16 bits where they fit, 64 elsewhere."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    blobs = []
    for x in rows["keys"].to_pylist():
        cells = unpack(x, np.uint64) >> shift
        gaps = np.diff(cells)
        wide = np.flatnonzero(gaps >= 65535)
        short = gaps.copy()
        short[wide] = 65535
        parts = [cells[:1].tobytes(), np.int64(len(wide)).tobytes(), gaps[wide].tobytes(), short.astype(np.uint16).tobytes()]
        blobs.append(b"".join(parts))
    return rows.set_column(rows.column_names.index("keys"), "keys", pa.array(blobs, pa.binary()))


def _wide(blob: bytes, width: int) -> np.ndarray:
    shift = np.uint64(64 - (width.bit_length() - 1))
    n = int(np.frombuffer(blob, np.int64, 1, 8)[0])
    gaps = np.frombuffer(blob, np.uint16, -1, 16 + 8 * n).astype(np.uint64)
    gaps[gaps == 65535] = np.frombuffer(blob, np.uint64, n, 16)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1), gaps])) << shift


def merge(rows: pa.Table, width: int) -> pa.Table:
    """Merged sketches of one slice: to each chunk, as bits, which of its cells count two documents or more."""
    rows = rows.sort_by("chunk")
    keys = [_wide(x, width) for x in rows["keys"].to_pylist()]
    counts = np.concatenate([unpack(x, np.uint8) for x in rows["a"].to_pylist()])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    first = X.unique_sorted(flat[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    repeated = np.empty(len(flat), np.uint8)
    repeated[order] = np.repeat(total > 1, np.diff(np.append(first, len(flat))))
    chunks = list(zip(rows["chunk"].to_pylist(), map(len, keys)))
    return X.reply_table(rows["kind"][0].as_py(), rows["slice"][0].as_py(), chunks, repeated)


def _estimated(rows: pa.Table, flags: pa.Table, size: int, width: int):
    words, first, ids, _, one, two = _windows(rows, size)
    repeated = np.ones(len(one), bool)
    for row in range(ROWS):
        cells, _ = _touched(one, ids, row, width)
        flag = X.answered(flags, row, np.uint8).astype(bool)
        repeated &= np.isin(_cells(one, row, width), cells[flag]) if len(cells) else False
    return words, first[repeated], ids[repeated], one[repeated], two[repeated]


def repeated_windows(rows: pa.Table, flags: pa.Table, size: int, width: int, bits: int) -> pa.Table:
    """The second pass's questions: a chunk's distinct windows that are estimated repeated, each with its second hash
    and the smallest document of the chunk that has it."""
    if not len(rows):
        return X.ask_table([])
    rows = X.sorted_chunk(rows)
    _, _, ids, one, two = _estimated(rows, flags, size, width)
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    first = _pairs(one, two)
    return X.ask_table(X.asks(0, rows["chunk"][0].as_py(), bits, one[first], two[first], ids[first]))


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return np.flatnonzero(fresh)


def smallest(rows: pa.Table) -> pa.Table:
    """The smallest document of each window, exactly; to each chunk, in the order of its windows."""
    rows = rows.sort_by("chunk")
    one, two, ids = (
        [unpack(x, t) for x in rows[c].to_pylist()] for c, t in (("keys", np.uint64), ("a", np.uint64), ("b", np.int64))
    )
    chunks = list(zip(rows["chunk"].to_pylist(), map(len, one)))
    one, two, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
    order = np.lexsort((ids, two, one))
    first = _pairs(one[order], two[order])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(ids))))
    return X.reply_table(0, rows["slice"][0].as_py(), chunks, least)


def _removed(rows: pa.Table, flags: pa.Table, least: pa.Table, size: int, width: int) -> tuple[Words, np.ndarray]:
    """Which words of a chunk go."""
    words, first, ids, one, two = _estimated(rows, flags, size, width)
    order = np.lexsort((ids, two, one))
    start = _pairs(one[order], two[order])
    answer = np.empty(len(ids), np.int64)
    answer[order] = np.repeat(X.answered(least, 0, np.int64), np.diff(np.append(start, len(ids))))
    change = np.zeros(len(words.start) + 1, np.int64)
    late = first[answer < ids]
    np.add.at(change, late, 1)
    np.add.at(change, late + size, -1)
    return words, np.cumsum(change[:-1]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, source_md5 string"


def kept(rows: pa.Table, replies: pa.Table, size: int, width: int) -> pa.Table:
    if not len(rows):
        return pa.table({"doc_id": pa.array([], pa.int64())})
    rows = X.sorted_chunk(rows)
    flags = replies.filter(pc.less(replies["kind"], ROWS))
    least = replies.filter(pc.equal(replies["kind"], ROWS))
    least = least.set_column(1, "kind", pa.array([0] * len(least), pa.int32()))
    words, gone = _removed(rows, flags, least, size, width)
    gone_before = np.concatenate([[0], np.cumsum(gone)])
    removed = np.diff(gone_before[words.ptr])
    texts, digests, sources = [], [], []
    for d, (old, n) in enumerate(zip(rows["text"].to_pylist(), removed.tolist())):
        sources.append(None if old is None else hashlib.md5(old.encode()).hexdigest())
        if n:
            a, b = words.ptr[d], words.ptr[d + 1]
            # A kept word takes along the white space up to the next word, and the first one what stands before it.
            begin = words.start[a:b].copy()
            begin[0] = words.offset[d]
            stop = np.append(begin[1:], words.offset[d + 1])
            old = words.buf[begin[0] : stop[-1]][np.repeat(~gone[a:b], stop - begin)].tobytes().decode()
        texts.append(old)
        digests.append(hashlib.sha256(b" ".join((old or "").encode().split())).hexdigest())
    return pa.table(
        {
            "doc_id": rows["doc_id"].cast(pa.int64()),
            "n_words": pa.array(np.diff(words.ptr), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "text": pa.array(texts, pa.string()),
            "source_md5": pa.array(sources, pa.string()),
        }
    )


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), the text that is left and source_md5, of the text that was."""
    size = X.text_size(docs)
    chunks = X.chunk_count(size, chunk_bytes)
    bits = X.slice_bits(chunks)
    # A window needs two bytes of text at least; five per word is usual, and a wider sketch only errs less.
    width = 1 << max(20, bits + 2, (CELLS * max(1, size // 5)).bit_length())
    dealt = X.chunked(docs, chunks)
    flags = X.round_trip(dealt, lambda t: sketch(t, window, width, bits), lambda t: merge(t, width))
    least = (
        dealt.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInArrow(lambda t, f: repeated_windows(t, f, window, width, bits), X.ASK)
        .groupBy("slice")
        .applyInArrow(smallest, X.REPLY)
        .withColumn("kind", F.lit(ROWS))
    )
    return (
        dealt.groupBy("chunk")
        .cogroup(flags.unionByName(least).groupBy("chunk"))
        .applyInArrow(lambda t, r: kept(t, r, window, width), RESULT)
    )


def substring_filter(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, with the text that is left (n_chars, where there is one, follows it), less those of
    which no word is left. Rows that repeat a doc_id are told apart by their texts; equal texts of one id lose the same."""
    report = substring_dedup(docs, **how).where("n_removed > 0")
    none = (F.col("n_removed") == F.col("n_words")).alias("__none")
    report = report.select(F.col("doc_id").alias("__id"), F.col("source_md5").alias("__source"), F.col("text").alias("__left"), none, F.lit(True).alias("__found")).dropDuplicates(["__id", "__source"])
    rows = docs.select(F.col("doc_id").alias("__key"), F.md5("text").alias("__hash"), F.struct(*docs.columns).alias("__doc"))
    joined = rows.join(report, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__source")), "left")
    text = F.when(F.col("__found"), F.col("__left")).otherwise(F.col("__doc.text"))
    kept = joined.where(~F.coalesce("__none", F.lit(False)))
    fresh = {"text": text, "n_chars": F.when(F.col("__found"), F.length("__left").cast("long")).otherwise(F.col("__doc.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return kept.select(*[fresh.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns])
