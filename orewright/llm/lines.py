"""Line dedup by winnowing over line hashes.

Every line has a hash, and of each `run` consecutive lines the one with the least hash (the rightmost, at ties) is a
fingerprint, so any two equal runs of that length have a fingerprint at the same place: no repeated run is missed.
Positions that share a fingerprint are brought together, each is extended both ways to every run of lines that holds
it, and a run goes where the same lines stand at an earlier position (a smaller doc_id, or earlier in the document).
What overlapping runs cover together is the longest match. A position meets the first place of its run, not every
other place, so a line that a third of all documents hold makes one row per place and no pairs.

All of it is DataFrame expressions. Runs are grouped by 128 bits of hash.

Results for odd input: null counts as the empty text, which is one empty line, and stays null; texts of fewer lines
than a run lose nothing; blank lines are lines; of equal texts the smallest doc_id keeps its lines; of several texts under
one doc_id, that of the least hash stands first, and rows alike in both are judged as one row and lose the same lines; rows
without doc_id lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _marks(docs: DataFrame, run: int) -> DataFrame:
    """One row per fingerprint: its hash h, document (d and t, its id and its text's hash), place p, the lines around it as
    hashes, and the number of the first of them."""
    hashed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("hs")
    )
    hashed = hashed.where(F.size("hs") >= run).select("d", "t", "hs", F.size("hs").alias("n"))

    def least(i: Column) -> Column:
        window = F.slice("hs", i + 1, run)
        return i + run - F.array_position(F.reverse(window), F.array_min(window)).cast("int")

    def around(p: Column) -> Column:
        lo = F.greatest(p - (run - 1), F.lit(0))
        return F.struct(p.alias("p"), F.get("hs", p).alias("h"), lo.alias("lo"), F.slice("hs", lo + 1, F.least(p + run, F.col("n")) - lo).alias("near"))

    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - run), least))
    return hashed.select("d", "t", F.explode(F.transform(picked, around)).alias("m")).select("d", "t", "m.*")


def late_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """d, t and start: each run of lines that also stands at an earlier position.

    No row is joined by a fingerprint or a run: fingerprints that stand at one place, and then the first places of runs, are
    found by aggregates, which meet in part before the shuffle, and taken away by their places. A line that every document
    holds so burdens no task.
    """
    marks = _marks(docs, run)
    spot = F.struct("d", "t", "p")
    places_of = marks.groupBy("h").agg(F.min(spot).alias("least"), F.max(spot).alias("most"))
    lone = places_of.where("least = most").select("least.*")
    places = F.transform(F.sequence(F.lit(0), F.size("near") - run), lambda j: F.struct((F.col("lo") + j).alias("start"), F.slice("near", j + 1, run).alias("lines")))
    runs = cut(
        marks.join(lone, ["d", "t", "p"], "left_anti")
        .select("d", "t", F.explode(places).alias("p"))
        .select("d", "t", "p.start", F.xxhash64("p.lines").alias("k1"), F.xxhash64(F.lit(1), F.reverse("p.lines")).alias("k2"))
    )
    first = runs.groupBy("k1", "k2").agg(F.min(F.struct("d", "t", "start")).alias("first")).select("first.*")
    return runs.select("d", "t", "start").join(first, ["d", "t", "start"], "left_anti")


def _judged(docs: DataFrame, run: int) -> DataFrame:
    """The documents as one struct, their lines, and the numbers of the lines that go."""
    late = late_runs(docs, run).groupBy("d", "t").agg(F.collect_set("start").alias("starts"))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.struct(*docs.columns).alias("doc"))
    covered = F.transform("starts", lambda s: F.sequence(s, s + (run - 1)))
    gone = F.coalesce(F.array_distinct(F.flatten(covered)), F.array().cast("array<int>"))
    return rows.join(late, ["d", "t"], "left").select("doc", _lines(F.col("doc.text")).alias("lines"), gone.alias("gone"))


def _left() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents, all columns, with the text that is left (n_chars, where there is one, follows it), less those of
    which lines went and no word is left."""
    text = F.when(F.size("gone") > 0, _left()).otherwise(F.col("doc.text"))
    out = _judged(docs, run).withColumn("left", text).where((F.size("gone") == 0) | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.size("gone") > 0, F.length("left").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select(*[(fresh.get(c, F.col("doc")[c])).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the lines that are left, joined by line ends)."""
    return _judged(docs, run).select(
        "doc.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.sha2(_left(), 256).alias("kept_sha256")
    )


REPORT_SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     x AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line, len(ls) AS n FROM l),
     w AS (SELECT doc_id, i, n, line,
                  lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c
           FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS nth FROM w WHERE i + {RUN} <= n),
     gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1)
SELECT x.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN gone USING (doc_id, i) GROUP BY x.doc_id
"""
