"""Prediction by partial matching: the log-probability of each text under a byte-context model of the training texts.

The model is a trie of byte contexts up to `ORDER` bytes. A symbol is coded in the longest context that has been seen;
if it has not been seen there, an escape is coded and the next shorter context is tried, without the symbols that the
longer one has (symbol exclusion: contexts are nested, so those are all that need to go). Escapes are estimated by half
a count for every different symbol of a context. Below the empty context every byte is equally likely. A text is the
stream of its lower-cased words, with one space between words and a line end (which no word holds) as the end.

A symbol's probability depends only on itself and the `ORDER` bytes before it, so the corpus is reduced to counts of
(context, symbol) strings. Chunks of documents send their distinct strings with counts; the counts are added up per
string; the trie's statistics are worked out per context, grouped by its last two bytes (all longer contexts of a
string are in its group; shorter ones come from a table of at most 65,536 byte pairs); and each chunk gets one
log-probability back for each string it sent. The strings after a frequent pair of bytes (`HOT_PAIR`) are dealt by the
byte before the pair too, and get the pair's own counts of symbols along; such a group has 2**24 strings at most. Words and their counts, for the base score, travel the same way. What is
gathered so grows with the corpus; nothing of it passes through the driver but the table of byte pairs.

Words are counted under 63 bits of hash.

Results for odd input: null and empty texts are one end; rows that repeat a doc_id are scored each, and learned from
each; a null doc_id is the empty text in the split and so belongs to the training texts; without training texts N and V
are zero, the base score of a token is zero, and every byte of a text is equally likely; an empty table gives an empty result; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import pack, unpack
from .words import WINDOW_BASE, mix, pieces_of, spans

ORDER = 5
END = 0x0A
WORDS, STRINGS = 0, 1
#: Bytes of training texts that follow a pair beyond which the pair's strings are split by one more byte of context.
HOT_PAIR = 1 << 26
SPLIT = 1 << 24


@dataclass
class Stream:
    """A chunk's texts as one stream: `order` line ends before each text, one after it; scored[i] is the place of a
    scored byte, doc[i] its text, of `docs` texts."""

    bytes: np.ndarray
    scored: np.ndarray
    doc: np.ndarray
    docs: int


def stream_of(texts: list[str | None], order: int) -> Stream:
    bodies = [b" ".join((t or "").encode().lower().split()) for t in texts]
    pad = bytes([END]) * max(order, 1)
    raw = np.frombuffer(b"".join([pad[:order], *(b + pad for b in bodies)]), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = order + np.concatenate([[0], np.cumsum(sizes + len(pad))[:-1]]) if len(bodies) else sizes
    doc = np.repeat(np.arange(len(bodies)), sizes + 1)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    scored = np.arange(first[-1]) + np.repeat(begin - first[:-1], sizes + 1)
    return Stream(raw, scored, doc, len(bodies))


def tokens_of(stream: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the text of each. Tokens end at a space or at the text's end; the text's end is a token
    of its own besides."""
    text = stream.bytes[stream.scored]
    stop = np.flatnonzero((text == 0x20) | (text == END))
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    real = stop > start
    hashes = spans(text.astype(np.uint64) + np.uint64(1), start[real], stop[real], WINDOW_BASE)
    ends = np.full(stream.docs, mix(np.array([END], np.uint64))[0])
    tokens = np.concatenate([hashes, ends]) >> np.uint64(1) << np.uint64(1)
    return tokens, np.concatenate([stream.doc[stop[real]], np.arange(stream.docs)])


def strings_of(stream: Stream, order: int) -> np.ndarray:
    """Context and symbol at each scored place, as one number: the symbol is its last byte."""
    whole = np.zeros(max(len(stream.bytes) - order, 0), np.uint64)  # of every place that has `order` bytes before it
    for begin in range(order + 1):
        whole <<= np.uint64(8)
        whole |= stream.bytes[begin : begin + len(whole)]
    return whole[stream.scored - order]


def log_probabilities(strings: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int, after: np.ndarray | None = None) -> np.ndarray:
    """log10 P(symbol | context) for each string (distinct, ascending), given the counts of all strings that have the
    same last two context bytes, and the counts of all byte pairs. after: how often each byte follows these two; then the
    strings are all that have the same last three context bytes."""
    shift, mask = np.uint64(8), lambda k: np.uint64((1 << 8 * (k + 1)) - 1)
    sym = (strings & np.uint64(255)).astype(np.int64)
    prev = (strings >> shift & np.uint64(255)).astype(np.int64)
    levels = []  # longest context first: count of the symbol, total, distinct, and total of its symbols one level down
    codes, held, at = strings, counts.astype(np.int64), np.arange(len(strings))
    for k in range(order, 1, -1):
        context = codes >> shift
        start = X.unique_sorted(context)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))
        seen = held > 0
        total, distinct = np.bincount(group, held, len(start)), np.bincount(group, seen, len(start))
        if k == 3 and after is not None:
            lower, back, below = (codes[0] & mask(2)) >> shift << shift | np.arange(256, dtype=np.uint64), (codes & np.uint64(255)).astype(np.int64), after
            down = below[back]
        elif k > 2:
            lower, back = np.unique(codes & mask(k - 1), return_inverse=True)
            below = np.bincount(back, held, len(lower)).astype(np.int64)
            down = below[back]
        else:
            down = pairs[(codes >> shift & np.uint64(255)).astype(np.int64), (codes & np.uint64(255)).astype(np.int64)]
        excluded = np.bincount(group, np.where(seen, down, 0), len(start))
        levels.append((held[at], total[group][at], distinct[group][at], excluded[group][at]))
        if k > 2:
            at, codes, held = back[at], lower, below
    singles = pairs.sum(0)
    excluded = ((pairs > 0) * singles[None, :]).sum(1)
    levels.append((pairs[prev, sym], pairs.sum(1)[prev], (pairs > 0).sum(1)[prev], excluded[prev]))
    everything, kinds = singles.sum(), int((singles > 0).sum())
    levels.append((singles[sym], np.full(len(sym), everything), np.full(len(sym), kinds), np.zeros(len(sym))))

    out, open_ = np.zeros(len(strings)), np.ones(len(strings), bool)
    gone, gone_kinds = np.zeros(len(strings)), np.zeros(len(strings))
    for count, total, kinds_here, excluded in levels:
        rest, rest_kinds = total - gone, kinds_here - gone_kinds
        hit = open_ & (count > 0)
        out[hit] += np.log10((2 * count[hit] - 1) / (2 * rest[hit]))
        miss = open_ & (count == 0) & (rest > 0)
        out[miss] += np.log10(rest_kinds[miss] / (2 * rest[miss]))
        open_ &= count == 0
        gone, gone_kinds = excluded, kinds_here
    out[open_] -= np.log10(256 - kinds)
    return out


def learns() -> Column:
    """Whether a document is one of those that the model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1


def byte_pairs(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each other byte in the training texts' streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(1 << 16, np.int64)
            for piece in pieces_of(batch["text"], X.CHUNK_BYTES):
                total += np.bincount(strings_of(stream_of(batch["text"][piece].to_pylist(), 1), 1).astype(np.int64), minlength=1 << 16)
            used = np.flatnonzero(total)
            yield pa.record_batch({"pair": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    rows = docs.where(learns()).select("text").mapInArrow(count, "pair int, n long").groupBy("pair").sum("n").collect()
    table = np.zeros(1 << 16, np.int64)
    for pair, n in rows:  # at most 65,536 rows
        table[pair] = n
    return table.reshape(256, 256)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (lowest bit free) in order, and how many of each are in training texts."""
    ranked = np.sort(keys | train.astype(np.uint64))
    plain = ranked >> np.uint64(1) << np.uint64(1)
    first = X.unique_sorted(plain)
    return plain[first], np.add.reduceat((ranked & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _stream(rows: pa.Table, order: int) -> tuple[pa.Table, Stream, np.ndarray]:
    rows = X.sorted_chunk(rows)
    return rows, stream_of(rows["text"].to_pylist(), order), rows["train"].to_numpy(zero_copy_only=False).astype(bool)


def ask_words(rows: pa.Table, bits: int) -> pa.Table:
    rows, stream, train = _stream(rows, 0)
    tokens, text = tokens_of(stream)
    keys, n = _counted(tokens, train[text])
    return X.ask_table(X.asks(WORDS, rows["chunk"][0].as_py(), bits, keys, n.astype(np.int64)))


def add_words(rows: pa.Table, chunks: int) -> pa.Table:
    """Training counts of one slice's words to the chunks that sent them; the slice's totals to every chunk."""
    sent, order, ranked, first, n, _ = X.merged(rows, np.int64)
    total = np.add.reduceat(np.concatenate(n)[order], first)
    answer = np.empty(len(ranked), np.int64)
    answer[order] = np.repeat(total, np.diff(np.append(first, len(ranked))))
    have = {c for c, _ in sent}
    sent += [(c, 0) for c in range(chunks) if c not in have]
    return X.reply_table(WORDS, rows["slice"][0].as_py(), sent, answer, int(total.sum()), int((total > 0).sum()))


def _by_slice(strings: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices by a hash, as frequent beginnings would make slices by value uneven; in order of value within a slice."""
    piece = (mix(strings) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(strings), np.int64)
    order = np.argsort(piece, kind="stable")
    return order, np.searchsorted(piece[order], np.arange((1 << bits) + 1))


def ask_strings(rows: pa.Table, bits: int, depth: int) -> pa.Table:
    rows, stream, train = _stream(rows, depth)
    keys, n = _counted(strings_of(stream, depth) << np.uint64(1), train[stream.doc])
    keys >>= np.uint64(1)
    order, at = _by_slice(keys, bits)
    keys, n, chunk = keys[order], n[order], rows["chunk"][0].as_py()
    cut = [(s, slice(at[s], at[s + 1])) for s in np.flatnonzero(np.diff(at)).tolist()]
    return X.ask_table([(STRINGS, s, chunk, _gaps(keys[p]), pack(n[p]), b"") for s, p in cut])


def _gaps(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _from_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


SUMS = "slice int, grp int, string long, n long"


def add_strings(rows: pa.Table, hot: np.ndarray) -> pa.Table:
    """The distinct strings of one slice with their training counts and their group: the last two bytes of the context,
    or the last three after the pairs that are `hot`."""
    keys = np.concatenate([_from_gaps(x) for x in rows["keys"].to_pylist()])
    n = np.concatenate([unpack(x, np.int64) for x in rows["a"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = X.unique_sorted(ranked)
    strings = ranked[first]
    pair, third = ((strings >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((8, 0xFFFF), (24, 0xFF)))
    return pa.table(
        {
            "slice": pa.array(np.full(len(first), rows["slice"][0].as_py()), pa.int32()),
            "grp": pa.array(np.where(hot[pair], SPLIT | third << 16 | pair, pair).astype(np.int32)),
            "string": pa.array(strings.astype(np.int64)),
            "n": pa.array(np.add.reduceat(n[order], first)),
        }
    )


MODEL = "slice int, string long, lp double"


def model(rows: pa.Table, pairs: np.ndarray, depth: int, symbols: pa.Table | None = None) -> pa.Table:
    """Log-probabilities of all strings of one group; symbols: the counts of what follows the pair of a split group."""
    if not len(rows):
        return pa.table({"slice": pa.array([], pa.int32()), "string": pa.array([], pa.int64()), "lp": pa.array([], pa.float64())})
    rows, after = rows.sort_by("string"), None
    if symbols is not None and len(symbols):
        after = np.zeros(256, np.int64)
        after[symbols["symbol"].to_numpy()] = symbols["n"].to_numpy()
    lp = log_probabilities(rows["string"].to_numpy().astype(np.uint64), rows["n"].to_numpy(), pairs, depth, after)
    return pa.table({"slice": rows["slice"], "string": rows["string"], "lp": pa.array(lp)})


def tell_strings(rows: pa.Table, lps: pa.Table) -> pa.Table:
    rows, lps = rows.sort_by("chunk"), lps.sort_by("string")
    strings, lp = lps["string"].to_numpy().astype(np.uint64), lps["lp"].to_numpy()
    keys = [_from_gaps(x) for x in rows["keys"].to_pylist()]
    sent = list(zip(rows["chunk"].to_pylist(), map(len, keys)))
    answer = lp[np.searchsorted(strings, np.concatenate(keys))].astype(np.float32)
    return X.reply_table(STRINGS, rows["slice"][0].as_py(), sent, answer)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(rows: pa.Table, replies: pa.Table, bits: int, depth: int) -> pa.Table:
    if not len(rows):
        return pa.table({"doc_id": pa.array([], pa.int64())})
    rows, stream, train = _stream(rows, depth)
    docs = len(rows)
    totals = replies.filter(pa.array(replies["kind"].to_numpy() == WORDS))
    n, v = int(totals["total"].to_numpy().sum()), int(totals["distinct"].to_numpy().sum())
    tokens, text = tokens_of(stream)
    _, back = np.unique(tokens, return_inverse=True)
    known = X.answered(replies, WORDS, np.int64)[back]
    base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))

    strings = strings_of(stream, depth)
    order = np.argsort(strings)
    ranked = strings[order]
    first = X.unique_sorted(ranked)
    by_slice, _ = _by_slice(ranked[first], bits)
    lp = np.empty(len(first))
    lp[by_slice] = X.answered(replies, STRINGS, np.float32)
    score = np.bincount(stream.doc[order], np.repeat(lp, np.diff(np.append(first, len(ranked)))), docs)
    return pa.table(
        {
            "doc_id": rows["doc_id"].cast(pa.int64()),
            "held_out": pa.array(~train),
            "n_tokens": pa.array(np.bincount(text, minlength=docs), pa.int64()),
            "n_known": pa.array(np.bincount(text, known > 0, docs).astype(np.int64)),
            "train_tokens": pa.array(np.full(docs, n), pa.int64()),
            "base_score": pa.array(np.bincount(text, base, docs)),
            "score": pa.array(score),
        }
    )


def probabilities(sums: DataFrame, pairs: np.ndarray, depth: int, split: bool) -> DataFrame:
    """The model: one log-probability for each string of `sums`."""
    if not split:
        return sums.groupBy("grp").applyInArrow(lambda t: model(t, pairs, depth), MODEL)
    hot = sums.where(F.col("grp") >= SPLIT).select(F.col("grp").bitwiseAND(0xFFFF).alias("pair"), F.col("string").bitwiseAND(255).cast("int").alias("symbol"), "n")
    symbols = hot.groupBy("pair", "symbol").agg(F.sum("n").alias("n"))
    every = symbols.select("symbol", "n", "pair", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("third"))
    told = every.select(F.shiftleft("third", 16).bitwiseOR(F.col("pair")).bitwiseOR(F.lit(SPLIT)).alias("grp"), "symbol", "n")
    return sums.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(lambda t, s: model(t, pairs, depth, s), MODEL)


def ppm_scores(docs: DataFrame, depth: int = ORDER, chunk_bytes: int = X.CHUNK_BYTES, hot_pair: int = HOT_PAIR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each text."""
    if not 2 <= depth <= 6:
        raise ValueError("contexts have two to six bytes, so that a string fits 63 bits with a mark")
    chunks = X.chunk_count(X.text_size(docs), chunk_bytes)
    bits = X.slice_bits(chunks)
    pairs = byte_pairs(docs)
    hot = pairs.ravel() > hot_pair if depth > 2 else np.zeros(1 << 16, bool)
    dealt = docs.select("doc_id", "text", learns().alias("train"), X.chunk_of(chunks))
    words = dealt.groupBy("chunk").applyInArrow(lambda t: ask_words(t, bits), X.ASK).groupBy("slice").applyInArrow(lambda t: add_words(t, chunks), X.REPLY)
    asked = dealt.groupBy("chunk").applyInArrow(lambda t: ask_strings(t, bits, depth), X.ASK)
    sums = asked.groupBy("slice").applyInArrow(lambda t: add_strings(t, hot), SUMS)
    strings = asked.groupBy("slice").cogroup(probabilities(sums, pairs, depth, bool(hot.any())).groupBy("slice")).applyInArrow(tell_strings, X.REPLY)
    return dealt.groupBy("chunk").cogroup(words.unionByName(strings).groupBy("chunk")).applyInArrow(lambda t, r: scored(t, r, bits, depth), RESULT)
