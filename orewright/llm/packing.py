"""Packing by optimal length buckets.

Texts are cut into pieces of at most `max_len` tokens, so there are at most `max_len` different lengths, and the
global histogram of lengths is a table of proven size. Dynamic programming over it chooses the bucket boundaries with
the least padding. Inside a bucket every batch holds as many pieces as its token budget allows, each padded to the
bucket's boundary. Pieces are numbered within (bucket, share), and the counts of the shares are added up, so a bucket
that holds most of the rows is spread over as many tasks as it needs.

A token is a word `[^\\x20\\x09-\\x0D]+`, and a piece holds its words joined by one space; or any column of arrays gives the
tokens (such as the ids of `bpe_encode`), and a piece holds its part of the array. Either way a document's pieces, in
order, hold all its tokens. Lengths are counted first; the contents move once, to the batch's task.

Results for odd input: texts without tokens (null, empty, blank; null or empty arrays) have no piece; very long texts have
many pieces and lose nothing; rows that repeat a doc_id, or have none, are packed each and dealt by their contents (rows
alike in id and contents share a task); an empty
table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 32768
#: Pieces and tokens of a share at most, about, so that a (bucket, share) is a task of some 30 MB.
SHARE_ROWS = 50_000
SHARE_TOKENS = 4_000_000

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most `buckets` buckets that hold all lengths with the least padding.

    lengths: ascending and distinct. Of equally good choices, the one whose last bucket begins earliest, and so on down.
    """
    m = len(lengths)
    if m == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)])
    # pad[i, j]: padding of one bucket that holds lengths i to j (j included)
    pad = lengths[None, :] * (rows[1:][None, :] - rows[:-1][:, None]) - (tokens[1:][None, :] - tokens[:-1][:, None])
    huge = np.iinfo(np.int64).max // 4
    pad = np.where(np.arange(m)[:, None] <= np.arange(m)[None, :], pad, huge)
    best, begins = pad[0].copy(), [np.zeros(m, np.int64)]
    for _ in range(1, min(buckets, m)):
        before = np.concatenate([[0], best[:-1]])
        cost = before[:, None] + pad
        begins.append(cost.argmin(axis=0))
        best = cost.min(axis=0)
    ends, j = [], m - 1
    for begin in reversed(begins):
        if j < 0:
            break
        ends.append(int(lengths[j]))
        j = int(begin[j]) - 1
    return ends[::-1]


def row_hash(tokens: Column | None) -> Column:
    """`row`: a hash of the id and of what is packed, so that rows of one id, or of none, are told apart by their contents."""
    return F.xxhash64(F.col("doc_id"), F.col("text") if tokens is None else tokens).alias("row")


def pieces(docs: DataFrame, tokens: Column | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece (from 0), n_tokens, `spread` (a hash of the row and the piece) and the contents of each piece: `text` of
    words, or `tokens`."""
    found = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)) if tokens is None else tokens
    made = docs.select("doc_id", row_hash(tokens), found.alias("all")).where(F.size("all") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(all) - 1) div {max_len} as int)")), lambda i: F.slice("all", i * max_len + 1, max_len))
    cut_up = made.select("doc_id", "row", F.posexplode(parts).alias("piece", "tokens"))
    body = F.array_join("tokens", " ").alias("text") if tokens is None else F.col("tokens")
    return cut_up.select("doc_id", "piece", F.size("tokens").alias("n_tokens"), F.xxhash64("row", "piece").alias("spread"), body)


def piece_lengths(docs: DataFrame, tokens: Column | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece, n_tokens and `spread` of the same pieces, without their contents."""
    n = (word_count() if tokens is None else F.coalesce(F.size(tokens), F.lit(0))).cast("long")
    cutting = docs.select("doc_id", row_hash(tokens), n.alias("n")).where("n > 0")
    numbered = cutting.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {max_len} as int)"))).alias("piece"))
    length = F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("int").alias("n_tokens")
    return numbered.select("doc_id", "piece", length, F.xxhash64("row", "piece").alias("spread"))


def pack(docs: DataFrame, tokens: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket (from 0), pad_to, batch and slot (both from 0), padding, and its
    contents (`text`, or `tokens` where a column of them is given)."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest piece")
    counted = cut(piece_lengths(docs, tokens, max_len))
    histogram = sorted((r.n_tokens, r["count"]) for r in counted.groupBy("n_tokens").count().collect())  # at most `max_len` rows
    lengths, counts = np.array(histogram, np.int64).reshape(-1, 2).T
    ends = boundaries(lengths, counts, buckets) or [max_len]
    shares = max(1, -(-int(counts.sum()) // SHARE_ROWS), -(-int(lengths @ counts) // SHARE_TOKENS))
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], i).otherwise(bucket)
    share = F.pmod("spread", F.lit(shares)).cast("int")
    upto = Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    begin = counted.groupBy(bucket.alias("bucket"), share.alias("share")).count().select("bucket", "share", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("begin"))
    whole = pieces(docs, tokens, max_len)
    body = whole.columns[-1]
    within = Window.partitionBy("bucket", "share").orderBy("doc_id", "piece", "n_tokens", F.xxhash64(body))
    numbered = whole.withColumns({"bucket": bucket, "share": share}).withColumn("nth", F.row_number().over(within)).join(begin, ["bucket", "share"])
    pad_to = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1)
    room = F.floor(F.lit(budget) / pad_to)
    place = F.col("begin") + F.col("nth") - 1
    return numbered.select(
        "doc_id", "piece", "n_tokens", "bucket", pad_to.alias("pad_to"), F.floor(place / room).alias("batch"), (place % room).cast("int").alias("slot"), (pad_to - F.col("n_tokens")).alias("padding"), body
    )
