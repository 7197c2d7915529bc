"""Importance resampling towards a target distribution, in DataFrame expressions alone.

Texts become runs of lo to hi consecutive words, and each run falls in one of `buckets` by its crc32. A bucket's gain is
the logarithm of how much likelier it is in the target than in the documents, in thousandths, rounded down; a document's
weight is the sum of its runs' gains. A Gumbel value drawn from a hash of the doc_id is added to it, and the highest sums
are a sample without replacement in which documents are chosen in proportion to exp(weight).

Plan: an array of runs per document is exploded twice, first for the counts of buckets, then joined with the gains for the
sums of documents. Both aggregate where the runs are made, so a frequent run or a very long text leaves a task as some
`buckets` counts or one sum, and no text is shuffled. The gain table has one row per bucket, a parameter, and is broadcast.
Ranks come from one range-partitioned sort: each row's place in its partition plus the number of rows in those before it.

Results for odd input: null and empty texts, and texts without words, have no features, weight 0 and no rank; a null doc_id
stands in the hash as nothing; equal scores go to the smaller doc_id (null last), then by a hash of the text; rows that repeat a
doc_id are ranked each on its own, and rows alike get a row each; an empty table of documents gives an empty result, an empty
target table gains from no counts; other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: the ASCII characters that are neither digits nor letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: A document's key: its id and two independent hashes of its text, so that rows sharing an id stay apart.
KEY = ["doc_id", "h1", "h2"]


def words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def runs(w: Column, lo: int, hi: int) -> Column:
    """All runs of lo to hi consecutive words of an array, joined by one space."""
    made, longer = [], w
    for n in range(1, hi + 1):
        if n > 1:  # each run of n - 1 words with the word after it: whole arrays are shifted once, not cut per run
            shifted = F.slice(w, F.lit(n), F.greatest(F.size(w) - (n - 1), F.lit(0)))
            longer = F.zip_with(F.slice(longer, F.lit(1), F.size(shifted)), shifted, lambda a, b: F.concat_ws(" ", a, b))
        if n >= lo:
            made.append(longer)
    return F.concat(*made)


def bucket(run: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, lo: int = 1, hi: int = 1) -> DataFrame:
    """bucket, n: how many runs of all texts fall in each bucket that has any."""
    each = texts.select(words(F.col("text")).alias("words")).select(F.explode(runs(F.col("words"), lo, hi)).alias("run"))
    return each.groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, lo: int = 1, hi: int = 1) -> DataFrame:
    """bucket, gain: one row for every bucket."""
    own = bucket_counts(docs, buckets, lo, hi).withColumnRenamed("n", "s")
    aim = bucket_counts(target, buckets, lo, hi).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(own, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # over one row per bucket
    both = counts.select("bucket", *[F.col(c).cast("double") for c in "st"], *[F.sum(c).over(whole).cast("double").alias(c.upper() * 2) for c in "st"])
    ratio = (F.col("t") + 1) * (F.col("SS") + buckets) / ((F.col("s") + 1) * (F.col("TT") + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, lo: int = 1, hi: int = 1) -> DataFrame:
    """doc_id, h1, h2, n_words, n_features and weight of each document, a row per row of `docs`."""
    table = stored(gains(docs, target, buckets, lo, hi))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), words(F.col("text")).alias("words"))
    each = keyed.select(*KEY, F.size("words").alias("n_words"), F.posexplode_outer(runs(F.col("words"), lo, hi)).alias("at", "run"))
    met = each.withColumn("bucket", bucket(F.col("run"), buckets)).join(F.broadcast(table), "bucket", "left")  # one row per bucket
    # Rows alike fall together here: as many as have a first run, or none.
    copies = F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0)
    summed = met.groupBy(*KEY).agg(copies.alias("n"), F.max("n_words").cast("long").alias("n_words"), F.count("run").alias("f"), F.coalesce(F.sum("gain"), F.lit(0)).alias("w"))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return summed.select(*KEY, "n_words", F.expr("f div n").alias("n_features"), F.expr("w div n").alias("weight"), one.alias("copy")).drop("copy")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel value in thousandths, from the first 32 bits of sha256(`seed:doc_id`)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their place (from 1) in an order over all of them: one range-partitioned sort, written down, then the
    partitions' offsets, which are as many rows as there are partitions."""
    within = F.col("__at").bitwiseAND((1 << 33) - 1)  # the id's lower 33 bits; the partition stands above them
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition of the sort
    return placed.withColumn(name, F.col("offset") + within + 1).drop("__part", "__at", "offset")


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, lo: int = 1, hi: int = 1, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, h1, h2, n_words, n_features, weight, score, rank: of the N documents of `least_words` words or more the
    floor(percent * N / 100) of highest score have a rank, others null."""
    scored = weights(docs, target, buckets, lo, hi).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    placed = ranked(scored, [fit.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("h1"), F.asc("h2")])
    drawn = placed.agg(F.count_if(fit).alias("n")).select(F.expr(f"n * {percent} div 100").alias("drawn"))
    out = placed.crossJoin(F.broadcast(drawn))  # one row
    return out.withColumn("rank", F.when(fit & (F.col("place") <= F.col("drawn")), F.col("place"))).drop("place", "drawn")


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, all their columns. Rows alike are drawn together, as often as they stand in `docs`."""
    chosen = importance_ranks(docs, target, **how).where("rank is not null").select(*[F.col(k).alias(f"__{k}") for k in KEY]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__h1")) & (F.xxhash64(F.lit(1), "text") == F.col("__h2"))
    return docs.join(chosen, same, "left_semi")


#: Without crc32 in DuckDB: its table of 256 entries by eight steps each, and a fold over a word's bytes.
CRC_SQL = """
steps AS (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), range(8)::UBIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM steps)
"""


def crc_sql(text: str, tab: str = "tab") -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB, given the table of `CRC_SQL` as `tab`."""
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i - 1, 2)) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, {tab}[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT)"


RESAMPLE_SQL = f"""
WITH {CRC_SQL},
c AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
cb AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
d AS (SELECT doc_id, unnest(ws) AS w FROM c), b AS (SELECT unnest(ws) AS w FROM cb),
k AS (SELECT w, CAST({crc_sql('w')} % 10000 AS INT) AS k FROM (SELECT w FROM d UNION SELECT w FROM b), crc_table),
s AS (SELECT k, count(*) AS s FROM d JOIN k USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k),
g AS (SELECT i AS k, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM d)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM b)::DOUBLE + 10000)))) AS BIGINT) AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN k USING (w) JOIN g USING (k) GROUP BY doc_id),
y AS (SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || c.doc_id), 1, 8) AS UBIGINT)::DOUBLE + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM c LEFT JOIN x USING (doc_id)),
z AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM y WHERE n_features >= 20) THEN place END AS rank FROM z
"""
