"""Exact top-k by inner product over a pivot-distance index.

Scaled vectors x and queries q become points of one metric space: x gets one more coordinate, sqrt(M - |x|^2) with M
the greatest squared norm, and q gets zero, so |q' - x'|^2 = |q|^2 + M - 2 q.x and the nearest points are the highest
scores. The index keys each point by its nearest pivot and its distance to it, and cuts every pivot's points, sorted by
that distance, into annuli of bounded size. A query first searches the annuli next to its own distance, which gives a
radius that holds k points at least; it then visits, pivot by pivot, only annuli that the triangle inequality leaves
(|d(q, p) - d(x, p)| <= radius), and inside each it expands from its own distance outwards and stops by the same bound,
with the radius shrinking as points are found. What comes out of an annulus is at most k rows per query.

There are at most `PIVOTS` pivots, a bounded sample by a hash of vec_id; every vector is indexed, and every score is an
exact integer. Queries are joined to annuli by key, in blocks of bounded size; there is no cross join.

Whole numbers whose squared norm stays below 2**60 are indexed. Vectors beyond that ("wide" ones, of components of some
100,000 and more) would overflow 64 bits, so their scores are worked out apart, in whole numbers of any size: wide queries
against all rows and all queries against wide rows, in blocks.

Results for odd input: vectors that are null, empty, or hold null or non-finite components take no part, as query or
candidate; a candidate of another length than the query is none of its candidates; equal scores go to the smaller vec_id;
a score beyond 64 bits is given as the nearest long, but ranked by its exact value; a query with fewer than k candidates
gets all of them; rows that repeat a vec_id are one candidate each, except for the query of that id, and as a query the
least vector of them stands for the id; rows without vec_id take no part; an empty table gives an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut

K = 10
SCALE = 1024
PIVOTS = 64
ANNULUS = 2048
QUERY_BLOCK = 512
SPAN = 1024
WIDE = 2.0**60


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (doubles) and dim of the vectors that take part, and whether they are wide."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))
    wide = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c * SCALE * SCALE) >= WIDE
    return rows.select("vec_id", "x", F.size("x").alias("dim"), wide.alias("wide"))


def _scaled(rows: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers), dim, and norm2 of rows that are not wide."""
    v = rows.where("not wide").select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"), "dim")
    return v.select("vec_id", "v", "dim", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c).alias("norm2"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floating point while no sum can pass 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def visit(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best k of one annulus for each query that visits it, among those that can beat the query's radius."""
    points = points.sort_by("dist")
    dist, norm2, ids, x = points["dist"].to_numpy(), points["norm2"].to_numpy(), points["vec_id"].to_numpy(), _stack(points["v"])
    qids, q, at, floor = queries["query_id"].to_numpy(), _stack(queries["v"]), queries["at"].to_numpy(), queries["floor"].to_numpy()
    reach = queries["reach"].to_numpy()
    lo = np.searchsorted(dist, at - reach, "left")
    hi = np.searchsorted(dist, at + reach, "right")
    out = []
    # Queries that may use the same stretch are scored together; each takes from it what its own bound leaves.
    for a in range(0, len(qids), 128):
        part = slice(a, a + 128)
        left, right = int(lo[part].min()), int(hi[part].max())
        if left >= right:
            continue
        scores = _dots(q[part], x[left:right])
        for row, i in enumerate(range(a, min(a + 128, len(qids)))):
            near = np.arange(lo[i], hi[i])
            s = scores[row, near - left]
            fit = (s >= floor[i]) & (ids[near] != qids[i])
            near, s = near[fit], s[fit]
            if len(s) > k:
                worst = np.partition(s, len(s) - k)[len(s) - k]
                near, s = near[s >= worst], s[s >= worst]
            best = np.lexsort((ids[near], -s))[:k]
            out.append((np.full(len(best), qids[i]), ids[near[best]], s[best]))
    made = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"query_id": pa.array(made[0], pa.int64()), "vec_id": pa.array(made[1], pa.int64()), "score": pa.array(made[2], pa.int64())})


def _whole(x: float) -> int:
    """floor(1024 * x), whatever its size."""
    return int(x) * SCALE if abs(x) > 2.0**60 else math.floor(x * SCALE)


def _sortable(score: int) -> str:
    """A string that sorts as the number does, for scores beyond 64 bits; the empty one for others."""
    if -(1 << 63) <= score < 1 << 63:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def exact_block(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best k of a block of candidates for each query of a block, in whole numbers of any size."""
    by_dim: dict[int, list[tuple[int, list[int]]]] = {}
    for i, x in zip(points["vec_id"].to_pylist(), points["x"].to_pylist()):
        by_dim.setdefault(len(x), []).append((i, [_whole(c) for c in x]))
    out: list[tuple[int, int, int]] = []
    for qid, x in zip(queries["query_id"].to_pylist(), queries["x"].to_pylist()):
        q = [_whole(c) for c in x]
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in by_dim.get(len(q), ()) if i != qid)
        out += [(qid, i, -s) for s, i in scored[:k]]
    q, i, s = zip(*out) if out else ((), (), ())
    near = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in s]
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(near, pa.int64()), "beyond": pa.array([_sortable(x) for x in s], pa.string())})


FOUND = "query_id long, vec_id long, score long"


def _exact(points: DataFrame, asking: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """The best k candidates in each block of `points` for each query, by exact whole numbers."""
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((points, block), (asking, query_block)))
    held = points.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    sent = asking.select("query_id", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("j"))
    return held.groupBy("i", "j").cogroup(sent.groupBy("i", "j")).applyInArrow(lambda x, q: exact_block(x, q, k), FOUND + ", beyond string")


def _ranked(found: DataFrame, k: int, *beyond: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *beyond, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = K, annulus: int = ANNULUS, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest scores of each vector for which `queries` holds."""
    rows = cut(_usable(vectors))
    asking = rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("x", "dim", "wide")).alias("q")).select("query_id", "q.*")
    found = indexed_top_k(_scaled(rows), _scaled(asking.withColumnRenamed("query_id", "vec_id")), k, annulus, pivots, query_block)
    if rows.where("wide").limit(1).count():
        asking = cut(asking)
        far = _exact(rows.where("wide"), asking, k, annulus, query_block).unionByName(_exact(rows.where("not wide"), asking.where("wide"), k, annulus, query_block))
        found = _ranked(found.drop("rank").withColumn("beyond", F.lit("")).unionByName(far), k, F.desc("beyond"))
    return found.select("query_id", "rank", "vec_id", "score")


def indexed_top_k(scaled: DataFrame, asking: DataFrame, k: int, annulus: int, pivots: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score and rank of each query's best k of the points, through the index."""
    scaled = cut(scaled)
    top = cut(scaled.groupBy("dim").agg(F.max("norm2").alias("most")))  # one row for each length of vector
    longest = top.agg(F.coalesce(F.max("dim"), F.lit(0))).first()[0]
    space = attach(scaled, top, ["dim"], "vec_id").withColumn("point", F.concat(F.transform("v", lambda c: c.cast("double")), F.array(F.sqrt(F.col("most") - F.col("norm2")))))
    # At most `pivots` vectors of each length: of each hash class the least vec_id.
    chosen = space.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(pivots)).alias("class")).agg(F.min_by("point", F.struct("vec_id", "point")).alias("pivot"))
    frames = cut(chosen.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("class", "pivot"))).alias("pivots")))
    frame_bytes = pivots * 8 * (longest + 4)

    near = F.array_min(F.transform("pivots", lambda p: F.struct(_distance(F.col("point"), p["pivot"]).alias("dist"), p["class"].alias("pivot"))))
    keyed = attach(space, frames, ["dim"], "vec_id", frame_bytes).select("vec_id", "v", "dim", "norm2", near.alias("key"))
    keyed = cut(keyed.select("vec_id", "v", "dim", "norm2", "key.pivot", "key.dist"))
    # Annuli: each pivot's distances in steps that hold about `annulus` points; a step with more is split by a hash.
    ring = F.floor(F.col("dist") / F.col("step")).cast("int")
    extent = keyed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("dist").alias("far"), F.min("dist").alias("close"))
    steps = cut(extent.select("dim", "pivot", (F.greatest(F.col("far") - F.col("close"), F.lit(1e-9) * (1 + F.col("far"))) / F.ceil(F.col("n") / annulus) * 1.000001).alias("step")))
    ringed = attach(keyed, steps, ["dim", "pivot"], "vec_id").withColumn("ring", ring).drop("step")
    crowd = ringed.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"))
    annuli = cut(crowd.withColumn("parts", F.ceil(F.col("n") / annulus).cast("int")))
    indexed = attach(ringed, annuli.select("dim", "pivot", "ring", "parts"), ["dim", "pivot", "ring"], "vec_id", 64)
    indexed = cut(indexed.withColumn("part", F.pmod(F.xxhash64("vec_id", "dist"), F.col("parts")).cast("int")).drop("parts"))

    # A query meets each pivot's annuli as lists, so only those that it may visit become rows.
    point = F.concat(F.transform("v", lambda c: c.cast("double")), F.array(F.lit(0.0)))
    framed = attach(attach(asking.withColumnRenamed("vec_id", "query_id"), top, ["dim"], "query_id"), frames, ["dim"], "query_id", frame_bytes)
    spread = framed.select("query_id", "v", "dim", "norm2", "most", point.alias("point"), F.explode("pivots").alias("p"))
    placed = spread.select("query_id", "v", "dim", "norm2", "most", F.col("p.class").alias("pivot"), _distance(F.col("point"), F.col("p.pivot")).alias("at"))
    lists = annuli.groupBy("dim", "pivot", F.floor(F.col("ring") / SPAN).alias("span")).agg(F.collect_list(F.struct("near", "far", "ring", "parts", "n")).alias("rings"))

    def gap(r: Column) -> Column:
        return F.greatest(r["near"] - F.col("at"), F.col("at") - r["far"], F.lit(0.0))

    ways = cut(placed).join(lists, ["dim", "pivot"])

    def search(visits: DataFrame) -> DataFrame:
        sent = visits.select("query_id", "v", "dim", "pivot", "ring", "at", "floor", "reach", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        # A block of queries meets one part of an annulus; a part goes to as many blocks as it has visitors for.
        key = ["dim", "pivot", "ring", "part"]
        blocks = cut(sent.groupBy(*key).agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")))
        sent = attach(sent, blocks, key, "query_id", 64).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        held = attach(indexed, blocks, key, "vec_id", 64).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held, sent = held.toDF(*held.columns), sent.toDF(*sent.columns)  # columns of their own, though both know `blocks`
        pairs = held.groupBy(*key, "block").cogroup(sent.groupBy(*key, "block"))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pairs.applyInArrow(lambda x, q: visit(x, q, k) if len(x) and len(q) else empty, FOUND)

    # First: the least and next annuli by distance until k other points are sure to be in them.
    lowest, endless = F.lit(np.iinfo(np.int64).min), F.lit(float("inf"))
    closest = F.slice(F.array_sort(F.transform("rings", lambda r: F.struct(gap(r).alias("gap"), r["ring"].alias("ring"), r["parts"].alias("parts"), r["n"].alias("n")))), 1, k + 1)
    order = Window.partitionBy("query_id").orderBy("gap", "pivot", "ring").rowsBetween(Window.unboundedPreceding, -1)
    tried = ways.select("query_id", "v", "dim", "pivot", "at", F.explode(closest).alias("r")).select("query_id", "v", "dim", "pivot", "at", "r.*")
    first = tried.withColumn("held", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("held") < k + 1)
    seeds = _ranked(search(first.withColumn("floor", lowest).withColumn("reach", endless)), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("have"))
    # Then every annulus that can hold a score as high: |q' - x'| <= radius, with a margin for rounding.
    radius = F.sqrt(F.greatest(F.col("norm2") + F.col("most") - 2 * F.col("least"), F.lit(0)).cast("double")) * 1.000001 + 0.001
    bound = ways.join(seeds.where(F.col("have") >= k).drop("have"), "query_id", "left")
    bound = bound.withColumn("reach", F.when(F.col("least").isNull(), endless).otherwise(radius)).withColumn("floor", F.coalesce("least", lowest))
    fit = F.explode(F.filter("rings", lambda r: gap(r) <= F.col("reach")))
    found = search(bound.select("query_id", "v", "dim", "pivot", "at", "floor", "reach", fit.alias("r")).select("query_id", "v", "dim", "pivot", "at", "floor", "reach", "r.ring", "r.parts"))
    return _ranked(found, k)
