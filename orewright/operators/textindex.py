"""A kept text index: segments of postings on shared storage, replaced per document, searched by merging positions.

Every `put` writes one generation. A task cuts its chunks into segments of bounded size and writes, without a shuffle, one row per
term of a segment (numbers of chunks, counts and positions, as differences) and one per chunk (its number, key and
length). Rows lie in a folder per bucket of terms, ordered by term, so a search reads the folders of its own terms, and of them
only the row groups that can hold these. What a put or a delete replaces is told by a row per document (a tombstone), and the
corpus numbers by a row per generation with what came and went, which is written last: a generation without it does not
exist for readers, so a failed put leaves nothing behind.

Scores are those of `search.bm25` over the chunks that live: a phrase counts where its words stand side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import cut
from ..sources.registry import exists
from .search import IDF_FLOOR, K1, B

BUCKETS = 64
#: Words of one segment, unless a single chunk has more.
SEGMENT_WORDS = 2_000_000
CHUNKS = -1  # the folder of the chunks' own rows
ROW = "bucket int, term string, segment string, chunks array<int>, counts array<int>, positions array<int>, number int, chunk_id string, doc_id string, len int, classification string, parent_id string"
FOUND = "query_id string, segment string, number int, f int"


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))


def _deltas(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each value less the one before it; the first of a stretch as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def segment(chunks: pa.Table) -> pa.Table:
    """One segment: a row per term and a row per chunk. `chunks` has chunk_id, doc_id, words, classification, parent_id."""
    name = uuid.uuid4().hex
    words = chunks["words"].combine_chunks()
    n = len(chunks)
    length = np.asarray(pa.compute.list_value_length(words).fill_null(0))
    coded = words.flatten().dictionary_encode()
    code = np.asarray(coded.indices)
    order = np.argsort(code, kind="stable")  # by term, then by chunk and place
    number = np.repeat(np.arange(n), length)[order]
    place = (np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length))[order]
    term = code[order]
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_chunk = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    edges = np.append(np.searchsorted(new_chunk, new_term), len(new_chunk))
    counts = np.diff(np.append(new_chunk, len(term)))
    found = pa.table(
        {
            "term": coded.dictionary.take(pa.array(term[new_term])) if len(term) else pa.array([], pa.string()), "segment": pa.array([name] * len(new_term), pa.string()),
            "chunks": _lists(_deltas(number[new_chunk], edges[:-1]), edges), "counts": _lists(counts, edges),
            "positions": _lists(_deltas(place, new_chunk), np.append(new_term, len(term))),
        }
    )
    own = {"segment": pa.array([name] * n, pa.string()), "number": pa.array(np.arange(n), pa.int32()), "len": pa.array(length, pa.int32())}
    return pa.concat_tables([found, pa.table(own | {c: chunks[c] for c in ("chunk_id", "doc_id", "classification", "parent_id")})], promote_options="default")


_FIELDS = ["term", "segment", "chunks", "counts", "positions", "number", "chunk_id", "doc_id", "len", "classification", "parent_id"]


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            for b in segment(pa.Table.from_batches(held)).select(_FIELDS).to_batches(max_chunksize=20_000):
                yield b

        for batch in batches:
            at = 0
            length = np.asarray(pa.compute.list_value_length(batch["words"]).fill_null(0))
            for i, w in enumerate(length.tolist()):
                if size + w > most and (i > at or held):
                    held += [batch.slice(at, i - at)] if i > at else []
                    yield from flush()
                    held, size, at = [], 0, i
                size += w
            held += [batch.slice(at)] if at < batch.num_rows else []
        if held:
            yield from flush()

    return run


def _keys(chunks: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A term's places in a segment as sorted numbers: the chunk's number above 32 bits of the place in it."""
    number = np.cumsum(chunks).astype(np.int64)
    total, first = np.cumsum(positions).astype(np.int64), np.cumsum(counts) - counts
    place = total - np.repeat(total[first] - positions[first], counts)  # sums begin anew in each chunk
    return np.repeat(number, counts) << 32 | place


def _answers(questions: list[tuple[str, list[str]]]):
    """Questions to one segment: chunks in which all words of one stand in order, and how often. A question's rarest word gives
    the places to begin with, which are looked up among those of the other words; a list is decoded when first needed."""

    def run(rows: pa.Table) -> pa.Table:
        lists = [rows[c].combine_chunks() for c in ("chunks", "counts", "positions")]
        at = {t: i for i, t in enumerate(rows["term"].to_pylist())}
        size = np.asarray(pa.compute.list_value_length(rows["positions"]))
        keys: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in keys:
                keys[i] = _keys(*[np.asarray(x[i].values) for x in lists])
            return keys[i]

        out: list[tuple[str, np.ndarray, np.ndarray]] = []
        for query, words in questions:
            own = [at.get(w) for w in words]
            if None in own:
                continue
            order = sorted(range(len(words)), key=lambda o: size[own[o]])
            starts = of(own[order[0]]) - order[0]
            for o in order[1:]:
                other = of(own[o]) - o
                place = np.minimum(np.searchsorted(other, starts), len(other) - 1)
                starts = starts[other[place] == starts]
                if not len(starts):
                    break
            if len(starts):
                out.append((query, *np.unique(starts >> 32, return_counts=True)))
        name = rows["segment"][0].as_py()
        n = sum(len(x) for _, x, _ in out)
        joined = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array([q for q, x, _ in out for _ in range(len(x))], pa.string()), "segment": pa.array([name] * n, pa.string()), "number": pa.array(joined(1), pa.int32()), "f": pa.array(joined(2), pa.int32())})

    return run


#: Words of the questions that one pass over their postings takes along.
ASKED_WORDS = 200_000


class TextIndex:
    """The index under a path of shared storage. Chunks have chunk_id, doc_id, a text column, and may have parent_id and
    classification; a chunk_id is held once per document. Null texts count as chunks without words."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, segment_words: int = SEGMENT_WORDS):
        self.spark, self.path, self.buckets, self.segment_words = spark, path, buckets, segment_words

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame:
        """A row per generation: what its put or delete added to the numbers of chunks and words."""
        return self._read("log", "gen long, n long, words long")

    def numbers(self) -> tuple[int, int, int]:
        """Living chunks, their words, and the last generation; read from the log alone."""
        r = self._log().agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("gen"), F.lit(0))).first()
        return tuple(r)

    def _rows(self) -> DataFrame:
        return self._read("postings", f"{ROW}, gen long").join(F.broadcast(self._log().select("gen")), "gen", "left_semi")  # a row per put

    def _dead(self) -> DataFrame:
        """doc_id and the generation before which its chunks no longer count."""
        known = self._read("tombstones", "doc_id string, gen long").join(F.broadcast(self._log().select("gen")), "gen", "left_semi")
        return known.groupBy("doc_id").agg(F.max("gen").alias("dead_before"))

    def _living(self, rows: DataFrame) -> DataFrame:
        """Chunk rows that no later generation replaced."""
        met = rows.join(self._dead(), "doc_id", "left")
        return met.where("dead_before is null or gen >= dead_before").drop("dead_before")

    def chunks(self) -> DataFrame:
        """The living chunks: segment, number, chunk_id, doc_id, len, classification, parent_id and generation."""
        rows = self._rows().where(F.col("bucket") == CHUNKS)
        return self._living(rows.select("segment", "number", "chunk_id", "doc_id", "len", "classification", "parent_id", "gen"))

    def _commit(self, gen: int, docs: DataFrame, added: tuple[int, int]) -> None:
        """Tombstones of the documents that a generation replaces, then the log's row, which makes it visible."""
        gone = self.chunks().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{self.path}/tombstones/gen={gen}")  # over those of a put that failed
        row = (gen, added[0] - gone[0], added[1] - gone[1])
        self.spark.createDataFrame([row], "gen long, n long, words long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def put(self, chunks: DataFrame, text: str = "indexed_text") -> None:
        """Adds chunks; the documents they belong to lose all that earlier generations hold of them. One writer at a time."""
        gen = self.numbers()[2] + 1
        have = lambda c: F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string")
        cutup = chunks.select(have("chunk_id").alias("chunk_id"), have("doc_id").alias("doc_id"), tokens(F.col(text)).alias("words"), have("classification").alias("classification"), have("parent_id").alias("parent_id"))
        made = cutup.mapInArrow(_segments(self.segment_words), ROW.replace("bucket int, ", "")).withColumn("bucket", F.when(F.col("term").isNull(), CHUNKS).otherwise(bucket_of("term", self.buckets)))
        made.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        own = self._read(f"postings/gen={gen}", ROW).where(F.col("bucket") == CHUNKS)
        self._commit(gen, own.select("doc_id"), tuple(own.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()))

    def delete(self, docs: DataFrame) -> None:
        """Takes documents (doc_id) out."""
        self._commit(self.numbers()[2] + 1, docs.select(F.col("doc_id").cast("string").alias("doc_id")), (0, 0))

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of some terms: only their folders and row groups are read."""
        names = self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of("t", self.buckets)).distinct()
        folders = [r[0] for r in names.collect()]  # at most `buckets`
        return self._rows().where(F.col("bucket").isin(folders) & F.col("term").isin(terms)).select("term", "segment", "chunks", "counts", "positions")

    def search_many(self, queries: DataFrame) -> DataFrame:
        """query_id, chunk_id, doc_id, classification, parent_id, score: all chunks that hold a whole question (query_id, query) as a phrase.
        Questions go to the segments in passes of `ASKED_WORDS` words, and each segment's lists come together once per pass."""
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), tokens(F.col("query")).alias("w")).where(F.size("w") > 0)
        asked = cut(asked.dropDuplicates(["query_id"]))
        passes = -(-(asked.agg(F.sum(F.size("w"))).first()[0] or 0) // ASKED_WORDS)
        found = self.spark.createDataFrame([], FOUND)
        for k in range(passes):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).collect()  # bounded by the pass
            rows = self.postings(sorted({w for r in part for w in r.w}))
            found = found.unionByName(rows.groupBy("segment").applyInArrow(_answers([(r.query_id, r.w) for r in part]), FOUND))
        n_chunks, n_words, _ = self.numbers()
        live = cut(found.join(self.chunks().drop("gen"), ["segment", "number"]))
        df = live.groupBy("query_id").agg(F.count("*").alias("n"))
        idf = F.greatest(F.ln((F.lit(n_chunks) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
        f, mean = F.col("f").cast("double"), n_words / max(n_chunks, 1)
        score = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        return live.join(df, "query_id").select("query_id", "chunk_id", "doc_id", "classification", "parent_id", score.alias("score"))

    def search(self, query: str, k: int = 5, classifications: list[str] | None = None) -> DataFrame:
        """The k best chunks for one question, of those a caller may see."""
        found = self.search_many(self.spark.createDataFrame([("q", query)], "query_id string, query string")).drop("query_id")
        if classifications is not None:
            found = found.where(F.col("classification").isin(*classifications))
        return found.orderBy(F.desc("score"), "chunk_id").limit(k)
