"""Chunks, phrase search by BM25, and vector search."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import cut, stored
from .headers import TABLE

# Fixed: the ranking function's constants.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def build_chunks(registry: DataFrame, texts: DataFrame, tables: DataFrame, cells: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Text chunks, and for tables a parent chunk of the headers with one child per data row that has text."""
    reg = registry.select("doc_id", "classification", F.format_string("Document: %s. Publisher: %s.", "title", "publisher").alias("about"))
    none = F.lit(None).cast("string")

    def made(df, chunk_id, parent, level, raw, prefix, table_ref, cell_ref, element, candidate=none):
        source = F.struct(F.col("page_no"), table_ref.alias("table_ref"), cell_ref.alias("cell_ref"), element.alias("element_id"))
        return df.select(chunk_id.alias("chunk_id"), "doc_id", parent.alias("parent_id"), F.lit(level).alias("level"), raw.alias("raw_text"), prefix.alias("context_prefix"), F.concat_ws(" ", prefix, raw).alias("indexed_text"), source.alias("source"), candidate.alias("candidate_id"), "classification")

    t = texts.join(reg, "doc_id")
    text_prefix = F.concat(F.col("about"), F.format_string(" Page %d.", "page_no"))
    out = made(t, F.concat_ws(":", "doc_id", F.lit("text"), "element_id"), none, 0, F.col("text"), text_prefix, none, none, F.col("element_id"))

    filled = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("row", "col", "text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), " ")
    head_rows = cells.groupBy(*TABLE, "row").agg(F.bool_or("column_header").alias("is_head"))
    marked = cells.join(head_rows, [*TABLE, "row"])
    heads = marked.where("is_head").groupBy(*TABLE).agg(joined(filled).alias("header_text"))
    parents = tables.select(*TABLE, "page_no").join(heads, TABLE, "left").withColumn("header_text", F.coalesce("header_text", F.lit(""))).join(reg, "doc_id")
    prefix = F.concat(F.col("about"), F.format_string(" Table on page %d, columns: %s.", "page_no", "header_text"))
    parent_id = F.concat_ws(":", "doc_id", F.lit("table"), "element_id")
    out = out.unionByName(made(parents, parent_id, none, 0, F.col("header_text"), prefix, F.col("element_id"), none, none))

    rows = marked.where("not is_head").groupBy(*TABLE, "row").agg(joined(filled).alias("row_text")).where("row_text <> ''").join(parents, TABLE)
    link = none
    if candidates is not None:
        row = F.regexp_extract("cell_ref", r"^r(\d+)c", 1).cast("int")
        first = candidates.groupBy("doc_id", F.col("table_ref").alias("element_id"), row.alias("row")).agg(F.min("candidate_id").alias("link"))
        rows, link = rows.join(first, [*TABLE, "row"], "left"), F.col("link")
    child_id = F.concat_ws(":", "doc_id", F.lit("row"), "element_id", F.col("row").cast("string"))
    return out.unionByName(made(rows, child_id, parent_id, 1, F.col("row_text"), prefix, F.col("element_id"), F.format_string("r%d", "row"), none, link))


def postings(chunks: DataFrame, text: str = "indexed_text") -> DataFrame:
    """The inverted index: term, chunk_id, tf, positions."""
    spread = chunks.select("chunk_id", F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    return spread.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def phrase_count(words: Column, phrase: Column) -> Column:
    """How often the words of a phrase stand side by side; places are looked at only where all words occur."""
    starts = F.sequence(F.lit(1), F.size(words) - F.size(phrase) + 1)
    hits = F.size(F.filter(starts, lambda i: F.slice(words, i, F.size(phrase)) == phrase))
    some = (F.size(phrase) > 0) & (F.size(words) >= F.size(phrase)) & (F.size(F.array_except(phrase, words)) == 0)
    return F.when(some, hits).otherwise(0)


def bm25(chunks: DataFrame, query: str, text: str = "indexed_text", key: str = "chunk_id") -> DataFrame:
    """Each chunk that has the whole query as a phrase, with its score. Numbers and lengths are those of all chunks.

    One pass makes the three corpus numbers (one row); a second one scores. Both read only the text column.
    """
    # The query's words are literals, and a text's words a lambda's variable: as a column they would be put back into
    # the counting when its filter is pushed down, and cut again at every place.
    phrase = F.array(*map(F.lit, re.findall(r"[^\W_]+", query.lower()))).cast("array<string>")
    counted = chunks.select("*", F.size(tokens(F.col(text))).alias("__len"), F.get(F.transform(F.array(tokens(F.col(text))), lambda w: phrase_count(w, phrase)), F.lit(0)).alias("__f"))
    corpus = counted.agg(F.count("*").alias("__big"), F.avg("__len").alias("__avg"), F.count_if(F.col("__f") > 0).alias("__n"))
    idf = F.greatest(F.ln((F.col("__big") - F.col("__n") + 0.5) / (F.col("__n") + 0.5)), F.lit(IDF_FLOOR))
    f = F.col("__f").cast("double")
    score = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    found = counted.where("__f > 0").crossJoin(F.broadcast(corpus))  # one row
    return found.select(*chunks.columns, score.alias("score"))


#: The questions go to every executor while they have so many different runs of words at most; beyond, they meet the texts by a shuffle.
ASKED_WORDS = 100_000


def _runs(words: Column) -> Column:
    """All runs of two words side by side, as text; a single word stands for itself."""
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) == 1, words).otherwise(two)


def bm25_many(chunks: DataFrame, queries: DataFrame, text: str = "indexed_text", key: str = "chunk_id") -> DataFrame:
    """query_id, chunk_id, score for many queries (query_id, query) at once: chunks meet the queries through the
    query's rarest run of two words (or its one word), so no chunk is compared with a query whose runs it lacks, and one of two
    words is counted by its run alone. Texts are cut into words once, and only the questions' own runs leave them."""
    words = stored(chunks.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("chunk_id"), tokens(F.col(text)).alias("words")).withColumn("len", F.size("words")))
    corpus = words.agg(F.count("*").alias("big"), F.avg("len").alias("avg"))
    asked = cut(queries.select("query_id", tokens(F.col("query")).alias("phrase")).where(F.size("phrase") > 0))
    wanted = cut(asked.select(F.explode(_runs(F.col("phrase"))).alias("term")).distinct())
    small = (lambda df: F.broadcast(df)) if wanted.count() <= ASKED_WORDS else (lambda df: df)
    own = _runs(F.col("words")) if asked.where(F.size("phrase") == 1).isEmpty() else F.concat(F.when(F.size("words") > 1, F.col("words")).otherwise(F.array().cast("array<string>")), _runs(F.col("words")))
    spread = words.select("row", "chunk_id", "len", F.explode(own).alias("term")).join(small(wanted), "term", "left_semi")
    held = stored(spread.groupBy("row", "chunk_id", "len", "term").agg(F.count("*").cast("double").alias("f")))

    df = held.groupBy("term").agg(F.count("*").alias("df"))
    runs = F.array_distinct(_runs(F.col("phrase")))
    rare = asked.withColumn("term", F.explode(runs)).join(df, "term").groupBy("query_id", "phrase").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("known"))
    rare = cut(rare.where(F.col("known") == F.size(runs)).drop("known"))
    met = held.join(small(rare.where(F.size("phrase") <= 2).select("term", "query_id")), "term").select("query_id", "chunk_id", "len", "f")
    # Of longer ones, which chunks hold the rarest run: ids alone; then their words, once for each such question.
    longer = rare.where(F.size("phrase") > 2)
    pairs = held.join(small(longer.select("term", "query_id")), "term").select("row", "query_id")
    more = words.join(pairs, "row").join(small(longer.select("query_id", "phrase")), "query_id")
    more = more.withColumn("f", phrase_count(F.col("words"), F.col("phrase")).cast("double")).where("f > 0")
    met = stored(met.unionByName(more.select("query_id", "chunk_id", "len", "f")))
    n = met.groupBy("query_id").agg(F.count("*").alias("n"))
    scored = met.join(n, "query_id").crossJoin(F.broadcast(corpus))  # one row
    idf = F.greatest(F.ln((F.col("big") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return scored.select("query_id", "chunk_id", score.alias("score"))


def search_evidence(chunks: DataFrame, query: str, k: int = 5, classifications: list[str] | None = None) -> DataFrame:
    """The k best chunks a caller may see, with their parent's text. Classification is filtered before the ranking; the
    corpus numbers stay those of all chunks."""
    found = bm25(chunks, query)
    if classifications is not None:
        found = found.where(F.col("classification").isin(*classifications))
    top = found.orderBy(F.desc("score"), "chunk_id").limit(k)
    parents = chunks.select(F.col("chunk_id").alias("__p"), F.col("raw_text").alias("__text"))
    return top.join(parents, F.col("parent_id") == F.col("__p"), "left").select(*top.columns, F.coalesce("__text", "raw_text").alias("text")).orderBy(F.desc("score"), "chunk_id")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


#: Vectors and queries that meet in one task.
HELD, ASKING = 4096, 1024


def best_of_block(held: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """The k most similar vectors of a block for each query of a block; at ties the smaller vec_id."""
    stack = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    out = [[], [], []]
    if len(held) and len(asking):
        ids, qids = held["vec_id"].to_numpy(), asking["query_id"].to_numpy()
        near = np.round(stack(asking["unit"]) @ stack(held["unit"]).T, 12)
        for row, q in zip(near, qids):
            part = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
            best = part[np.lexsort((ids[part], -row[part]))[:k]]
            out = [a + b for a, b in zip(out, ([q] * len(best), ids[best].tolist(), row[best].tolist()))]
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})


def units(df: DataFrame, name: str, column: str) -> DataFrame:
    """`name`, dim and the vector of length one; vectors that are null, empty or zero, or hold nulls, are left out."""
    x = F.transform(column, lambda c: c.cast("double"))
    made = df.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias(name), x.alias("x"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)).alias("norm")).where("norm > 0 and norm < double('Infinity')")
    return cut(made.select(name, F.size("x").alias("dim"), F.transform("x", lambda c: c / F.col("norm")).alias("unit")))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, similarity (to twelve digits), rank: the k most similar vectors of each query (query_id, q).

    Vectors are normalised once and dealt into blocks, queries too; each two blocks are one task and one matrix product,
    which keeps k per query. Vectors that are null, empty or zero, or hold nulls, and those of another length are no one's neighbours.
    """
    return _exact(units(vectors, "vec_id", "embedding"), units(queries, "query_id", "q"), k)


def _exact(held: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """`knn` of vectors that are `units` already."""
    i, j = max(1, -(-held.count() // HELD)), max(1, -(-asking.count() // ASKING))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = held.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(i)).cast("int").alias("i"), every(j).alias("j"))
    two = asking.select("*", every(i).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(j)).cast("int").alias("j"))
    return _best(one, two, ["dim", "i", "j"], k)


def _best(held: DataFrame, asking: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k most similar vectors of each query among those that it meets by `key`; who meet twice count once."""
    found = held.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(lambda h, a: best_of_block(h, a, k), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Hyperplane tables, the buckets that a query visits in each at least, and vectors of a bucket in mean.
PLANE_TABLES, PROBES, BUCKET = 8, 8, 256

#: Queries that are asked of all vectors first, to fit planes and probes to, and how many of their neighbours must be met.
FITTED, MET = 256, 0.95

#: Rows that a task makes at once.
MADE = 1 << 14


def _by_dim(batch: pa.RecordBatch, rows: int):
    """The batch's rows of each dimension, at most `rows` at once, with the dimension."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        for first in range(0, len(at), rows):
            yield dim, batch.take(pa.array(at[first : first + rows]))


def _sides(unit: pa.Array, dim: int, tables: int, drawn: int, seed: int) -> np.ndarray:
    """row, table, plane: how far on which side of each of the `drawn` planes of a table a vector is."""
    x = unit.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    planes = np.random.default_rng([seed, dim]).normal(size=(dim, tables * drawn))
    return (x @ planes).reshape(len(x), tables, drawn)


def _own(side: np.ndarray) -> np.ndarray:
    return ((side > 0) * (1 << np.arange(side.shape[2]))).sum(2)


def _probed(side: np.ndarray, probes: int) -> np.ndarray:
    """row, table, probe: the likeliest codes, which differ from a vector's own in the bits that it hardly decides. Probes as
    many as there are codes give all of them."""
    near = min(side.shape[2], probes.bit_length())
    flips = np.array([[f >> b & 1 for b in range(near)] for f in range(1 << near)], float)
    loose = np.argsort(np.abs(side), axis=2)[:, :, :near]
    cost = np.take_along_axis(np.abs(side), loose, 2) @ flips.T
    best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    change = (1 << loose) @ flips.T.astype(np.int64)
    return _own(side)[:, :, None] ^ np.take_along_axis(change, best, 2)


def _codes(name: str, tables: int, drawn: int, bits: int, probes: int, seed: int):
    """name, dim, unit, table and code of each vector, by the first `bits` planes of each table: one code per table, or for a
    query `probes` of them."""

    def run(batches):
        for batch in batches:
            for dim, own in _by_dim(batch, max(1, MADE // (tables * probes))):
                codes = _probed(_sides(own["unit"], dim, tables, drawn, seed)[:, :, :bits], probes)
                n = codes.shape[1] * codes.shape[2]
                taken = own.take(pa.array(np.repeat(np.arange(len(codes)), n)))
                table = np.tile(np.repeat(np.arange(tables), codes.shape[2]), len(codes))
                yield pa.RecordBatch.from_arrays([taken[name], taken["dim"], taken["unit"], pa.array(table, pa.int32()), pa.array(codes.reshape(-1), pa.int64())], names=[name, "dim", "unit", "table", "code"])

    return run


def _met(tables: int, drawn: int, seed: int, choices: list[tuple[int, int]]):
    """bits, probes, n, hits: how many of pairs of a query (unit) and a vector (other) there are, and meet, for each choice."""

    def run(batches):
        for batch in batches:
            for dim, own in _by_dim(batch, MADE // 64):
                asking, held = (_sides(own[c], dim, tables, drawn, seed) for c in ("unit", "other"))
                hits = [int((_probed(asking[:, :, :b], p) == _own(held[:, :, :b])[:, :, None]).any((1, 2)).sum()) for b, p in choices]
                bits, probes = zip(*choices)
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int32()), pa.array(probes, pa.int32()), pa.array([len(own)] * len(hits), pa.int64()), pa.array(hits, pa.int64())], names=["bits", "probes", "n", "hits"])

    return run


def _fitted(held: DataFrame, asking: DataFrame, k: int, tables: int, drawn: int, probes: int, seed: int) -> tuple[int, int]:
    """How many planes of each table, and probes, meet `MET` of the exact neighbours of `FITTED` queries with the fewest vectors
    visited; probes up to eight times as many. Few enough planes have all codes among the probes, so some choice meets all."""
    share = lambda c: (min(1.0, c[1] / 2 ** c[0]), c[1])
    choices = sorted(((b, probes * m) for b in range(1, drawn + 1) for m in (1, 2, 4, 8) if m == 1 or probes * m <= 2**b), key=share)
    some = cut(asking.orderBy(F.xxhash64("query_id"), "query_id").limit(FITTED))
    pairs = _exact(held, some, k).select("query_id", "vec_id").join(some, "query_id").join(held.select("vec_id", "dim", F.col("unit").alias("other")), ["vec_id", "dim"])
    met = pairs.mapInArrow(_met(tables, drawn, seed, choices), "bits int, probes int, n long, hits long").groupBy("bits", "probes").agg((F.sum("hits") / F.sum("n")).alias("met"))
    found = {(x.bits, x.probes): x.met for x in met.collect()}  # a row per choice
    return next((c for c in choices if found.get(c, 1.0) >= MET), choices[-1]) if found else (drawn, probes)


def approximate_knn(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = PLANE_TABLES, probes: int = PROBES, bucket: int = BUCKET, seed: int = 7) -> DataFrame:
    """As `knn`, but a query meets only vectors on its side of random hyperplanes: `tables` times as many planes as put some
    `bucket` vectors in one bucket, or fewer, with the `probes` likeliest buckets of each table, or more, as the exact neighbours
    of some queries ask for (`_fitted`). Every vector is in every table; a bucket of more than `HELD` vectors is dealt in parts
    that all its visitors meet, so none is left out for its size."""
    held, asking = units(vectors, "vec_id", "embedding"), units(queries, "query_id", "q")
    drawn = min(40, max(1, int(np.ceil(np.log2(max(held.count() / bucket, 1)))) + 1))
    bits, probes = _fitted(held, asking, k, tables, drawn, probes, seed)
    made = lambda df, name, n: df.mapInArrow(_codes(name, tables, drawn, bits, n, seed), f"{name} long, dim int, unit array<double>, table int, code long")
    key = ["dim", "table", "code"]
    one, two = made(held, "vec_id", 1), made(asking, "query_id", probes)
    sizes = one.groupBy(*key).agg(F.ceil(F.count("*") / HELD).cast("int").alias("parts")).where("parts > 1")
    sizes = cut(sizes)  # large buckets only
    one = one.join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    two = two.join(sizes, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return _best(one, two, [*key, "part"], k)


def upsert_vectors(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The vectors after more of them: one that is there already is replaced. Of several new ones under an id the last by
    `embedding` stays."""
    one = fresh.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return store.join(one.select("vec_id"), "vec_id", "left_anti").select("vec_id", "embedding").unionByName(one)


def _phrase() -> Column:
    """What questions of the same words have in common."""
    return F.array_join(tokens(F.col("query")), " ")


def _found(chunks: DataFrame, questions: DataFrame, most: int, text: str) -> DataFrame:
    """phrase, chunk_id, rank: the best chunks of the questions' different phrases, at most `most` of each."""
    phrases = questions.select(_phrase().alias("query_id")).distinct().withColumn("query", F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = bm25_many(chunks, phrases, text).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return cut(ranked.select(F.col("query_id").alias("phrase"), "chunk_id", "rank"))


def _hits(chunks: DataFrame, questions: DataFrame, found: DataFrame, k: int, text: str, rerank: bool = False, parents: bool = False) -> DataFrame:
    """`hit_at_k` by what `_found` gave."""
    top = found.where(F.col("rank") <= (4 * k if rerank else k))
    own = chunks.select("chunk_id", F.col(text).alias("shown"))
    if parents:
        above = chunks.select(F.col("chunk_id").alias("__p"), F.col(text).alias("__text"))
        own = chunks.join(above, F.col("parent_id") == F.col("__p"), "left").select("chunk_id", F.coalesce("__text", text).alias("shown"))
    shown = top.join(own, "chunk_id")
    if rerank:
        words = tokens(F.col("shown"))
        shared = F.size(F.array_intersect(F.split("phrase", " "), words))
        again = Window.partitionBy("phrase").orderBy(F.desc("shared"), "n_words", "rank")
        shown = shown.withColumns({"shared": shared, "n_words": F.size(words)}).withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    asked = questions.select("query_id", "expected", _phrase().alias("phrase"))
    hits = asked.join(shown, "phrase").groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.contains("shown", "expected")).alias("found"))
    return questions.join(hits, "query_id", "left").select("query_id", F.when(F.col("expected").isNull(), F.col("n").isNull()).otherwise(F.coalesce("found", F.lit(False))).alias("hit"))


def hit_at_k(chunks: DataFrame, questions: DataFrame, k: int = 5, text: str = "indexed_text", rerank: bool = False, parents: bool = False) -> DataFrame:
    """Per question (query_id, query, expected): whether a chunk among the k best holds the expected text; without an
    expected text, whether nothing was found. rerank: four times as many chunks are found, and of these those that hold
    most of the question's different words, then the shorter ones, come first. parents: a chunk shows its parent's text."""
    return _hits(chunks, questions, _found(chunks, questions, 4 * k if rerank else k, text), k, text, rerank, parents)


def ablation(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Hits of each arm over the same questions: the bare text, reranked, with the context's prefix, and with the parent's
    text. Each of the two texts is searched once. arm, hits, questions."""
    bare, full = _found(chunks, questions, 4 * k, "raw_text"), _found(chunks, questions, k, "indexed_text")
    arms = {
        "lexical": _hits(chunks, questions, bare, k, "raw_text"),
        "rerank": _hits(chunks, questions, bare, k, "raw_text", rerank=True),
        "prefix": _hits(chunks, questions, full, k, "indexed_text"),
        "parent": _hits(chunks, questions, full, k, "indexed_text", parents=True),
    }
    rows = [df.agg(F.count_if("hit").alias("hits"), F.count("*").alias("questions")).select(F.lit(name).alias("arm"), "hits", "questions") for name, df in arms.items()]
    return reduce(DataFrame.unionByName, rows)
