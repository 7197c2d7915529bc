"""Lloyd's clustering of whole-number vectors, each round by Exponion search.

Every vector keeps an upper bound on the distance to its own centroid and a lower bound on that to the second nearest. Where
the bounds meet nothing is computed. Else, with u the distance to its centroid a and s the distance from a to the centroid next to
it, the nearest two centroids lie in the ball around a of radius 2u + s, so only that beginning of a's list of centroids by
distance is scanned; vectors are handled together by the power of two that their balls' sizes fall under. Distances are whole
numbers and exact. Bounds are floats, rounded outwards, a ball takes what lies on its surface, and nothing is left out at equal
bounds, so ties reach the scan and go to the smaller number.

Vectors are packed into blocks, dealt by block into a bucketed table once, and never move again: a round joins that table with
the blocks' bounds (some 17 bytes per vector), which alone are written anew. Sums of components leave a task as one row per
cluster, in limbs of 32 bits, and are added up by Spark; the driver sees k rows per round. A cluster that holds most vectors, or a
vector that repeats, changes no task's size, as blocks are dealt without regard to clusters.

Results for odd input: vectors that are null, of another length than `dim`, or hold null or non-finite components take no part;
rows that repeat a vec_id are vectors of their own, a null vec_id included (last among the candidates for first centroids);
with fewer vectors than k there are as many centroids as vectors; an empty table gives an empty result; components of any finite size are
exact (beyond 64 bits by Python's whole numbers, slower), and a distance or inertia beyond 64 bits is given as the greatest
long; other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, shared_folder, stored, unpack

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 4096
#: Vectors of one bucket of the table, and the most buckets that Spark allows.
BUCKET, BUCKETS = 1 << 19, 100_000
LIMB = 32
UP, DOWN = 1 + 1e-9, 1 - 1e-9
GREATEST = (1 << 63) - 1
STATE = "block long, own binary, upper binary, lower binary, sums array<struct<cluster: int, n: bigint, limbs: array<array<bigint>>>>"


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and x (doubles) of the vectors that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.where((F.size("embedding") == dim) & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))


def room(dim: int) -> int:
    """Components below this leave 64 bits enough for distances of `dim` of them."""
    return 1 << (29 - (dim.bit_length() + 1) // 2)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): 64-bit where all fit with room for a distance, else Python's whole numbers."""
    if float(np.abs(x).max(initial=0)) * SCALE < room(x.shape[1]) - 1:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) > 2.0**60 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `x` from those of `c`."""
    if x.dtype == object or c.dtype == object:
        return np.array([[sum((p - q) ** 2 for p, q in zip(a, b)) for b in c.tolist()] for a in x.tolist()], object).reshape(len(x), len(c))
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * x.shape[1] * top * top < 2**53:  # every partial sum is a whole number that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def roots(d: np.ndarray) -> np.ndarray:
    """Square roots as floats; what passes them is infinite."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))

    def root(v: int) -> float:
        try:
            return math.sqrt(v)
        except OverflowError:
            return math.inf

    return np.array([root(v) for v in d.ravel().tolist()], np.float64).reshape(d.shape)


class Ball:
    """The centroids of a round, and for each its list of all centroids by distance (itself first)."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(v) >= room(len(c)) for c in centroids for v in c)
        self.c = np.array(centroids, object if wide else np.int64).reshape(len(centroids), -1)
        between = roots(squared(self.c, self.c)) if len(centroids) else np.zeros((0, 0))
        np.fill_diagonal(between, -1.0)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.reach = np.take_along_axis(between, self.order, 1)
        self.reach[:, 0] = 0
        self.next = self.reach[:, 1] if len(centroids) > 1 else np.full(len(centroids), math.inf)

    def _scan(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest of the centroids `among` (the smaller number at ties) for each row, its distance, the second distance."""
        among = np.sort(among)  # so that the first least is the smallest number
        d = squared(x, self.c[among])
        at = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64) if d.dtype == object else d.argmin(1)
        best = np.take_along_axis(d, at[:, None], 1)[:, 0]
        if len(among) == 1:
            return among[at], best, np.full(len(x), math.inf)
        rest = roots(d)
        np.put_along_axis(rest, at[:, None], math.inf, 1)
        return among[at], best, rest.min(1)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Puts the nearest centroid and the bounds of each row into `own`, `upper` and `lower`."""
        k = len(self.c)
        for fresh in (True, False):  # first by the bounds as they are, then with the exact distance to the own centroid
            open_ = np.flatnonzero(~(upper < np.maximum(lower, self.next[own] / 2 * DOWN)))
            if fresh and len(open_):
                for a in np.unique(own[open_]).tolist():
                    part = open_[own[open_] == a]
                    upper[part] = roots(squared(x[part], self.c[a : a + 1])[:, 0]) * UP
        if not len(open_):
            return
        was = own[open_]
        for a in np.unique(was).tolist():
            part = open_[was == a]
            radius = (2 * upper[part] + self.next[a]) * UP
            inside = np.searchsorted(self.reach[a], radius, "right")
            size = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), k)
            for n in np.unique(size).tolist():
                rows = part[size == n]
                near, best, second = self._scan(x[rows], self.order[a][:n])
                own[rows], upper[rows], lower[rows] = near, roots(best) * UP, second * DOWN

    def moved(self, before: Ball | None, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Widens bounds that held for the centroids of `before`."""
        if before is None:
            return
        d = (self.c.astype(object) - before.c.astype(object)) if object in (self.c.dtype, before.c.dtype) else self.c - before.c
        step = roots((d * d).sum(1)) * UP
        far = np.argsort(step)[::-1]
        others = np.full(len(step), step[far[0]])
        others[far[0]] = step[far[1]] if len(step) > 1 else 0.0
        upper += step[own]
        lower -= others[own]
        upper *= UP
        lower *= np.where(lower > 0, DOWN, UP)


def _limbs(total: list[int]) -> list[list[int]]:
    """Whole numbers as rows of limbs, the last with the sign."""
    out = []
    while True:
        last = all(-(1 << LIMB) <= v < 1 << LIMB for v in total)
        out.append(list(total) if last else [v & ((1 << LIMB) - 1) for v in total])
        if last:
            return out
        total = [v >> LIMB for v in total]


def _blocks(size: int):
    """vec_ids and x of up to `size` vectors a row; those of great components stand in rows of their own, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            big = np.abs(x).max(axis=1, initial=0) * SCALE >= room(x.shape[1]) - 1
            for wide in (False, True):
                rows = np.flatnonzero(big == wide)
                for i in range(0, len(rows), size):
                    part = rows[i : i + size]
                    v = x[part] if wide else whole(x[part])
                    if not wide:
                        v = v.astype(np.int16 if np.abs(v).max(initial=0) < 2**15 else np.int32)
                    ids = batch["vec_id"].take(pa.array(part)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.ascontiguousarray(v).ravel())], pa.binary()), pa.array([v.dtype.str])], names=["vec_ids", "x", "kind"])

    return run


def _vectors(blob: bytes, kind: str, dim: int) -> np.ndarray:
    x = unpack(blob, np.dtype(kind)).reshape(-1, dim)
    return whole(x) if kind == "<f8" else x.astype(np.int64)


def _bounds(row: dict, ball: Ball, before: Ball | None, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors, with their centroids and bounds of this round."""
    x = _vectors(row["x"], row["kind"], dim)
    if row["own"] is None:
        own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), math.inf), np.zeros(len(x))
    else:
        own = unpack(row["own"], np.int32).astype(np.int64)
        upper, lower = (np.frombuffer(row[n], np.float64).copy() for n in ("upper", "lower"))
    ball.moved(before, own, upper, lower)
    ball.assign(x, own, upper, lower)
    return x, own, upper, lower


def _round(ball: Ball, before: Ball | None, dim: int):
    """The state of each block after a round; the last row of a task holds the sums of its vectors by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("limbs", pa.list_(pa.list_(pa.int64())))])))])
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, own, upper, lower = _bounds(row, ball, before, dim)
                for a in np.unique(own).tolist():
                    part = x[own == a]  # small in 64 bits, so a block's sums fit
                    n, have = total.get(a, (0, [0] * dim))
                    total[a] = n + len(part), [p + q for p, q in zip(have, part.sum(0).tolist())]
                made = {"block": row["block"], "own": pack(own.astype(np.int32)), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": None}
                yield pa.RecordBatch.from_pylist([made], schema)
        sums = [{"cluster": a, "n": n, "limbs": _limbs(v)} for a, (n, v) in total.items()]
        if sums:
            yield pa.RecordBatch.from_pylist([{"block": None, "own": None, "upper": None, "lower": None, "sums": sums}], schema)

    return run


def _last(ball: Ball, before: Ball | None, dim: int):
    """Each vector with its centroid and exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, own, *_ = _bounds(row, ball, before, dim)
                each = [(part, squared(x[part], ball.c[a : a + 1])[:, 0]) for a in np.unique(own).tolist() for part in [np.flatnonzero(own == a)]]
                distance = np.zeros(len(x), np.int64)
                for part, d in each:
                    distance[part] = d if d.dtype != object else [min(v, GREATEST) for v in d.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _means(sums: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: at most one row per cluster and limb comes to the driver."""
    each = sums.select(F.explode("sums").alias("s")).select("s.cluster", "s.n", F.posexplode("s.limbs").alias("limb", "v"))
    dim = len(centroids[0])
    added = each.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dim)]).collect()
    total, n = {}, {}
    for r in added:
        if r.limb == 0:
            n[r.cluster] = r.n  # every row has a first limb
        have = total.setdefault(r.cluster, [0] * dim)
        total[r.cluster] = [h + (r[f"v{i}"] << (LIMB * r.limb)) for i, h in enumerate(have)]
    return [[v // n[a] for v in total[a]] if a in n else c for a, c in enumerate(centroids)]


def first_centroids(rows: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The k vectors of the smallest sha256 of `seed:vec_id`; at ties the smaller vector."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select("vec_id", "x", place.alias("h")).orderBy(F.asc_nulls_last("h"), "vec_id", "x").limit(k).collect()
    return [whole(np.array([r.x], np.float64))[0].tolist() for r in best]


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each vector after `rounds` rounds and one more assignment, and the final centroids."""
    spark = vectors.sparkSession
    rows = kept(vectors, dim)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    folder, name = shared_folder(spark), f"vector_blocks_{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(_blocks(BLOCK), "vec_ids array<bigint>, x binary, kind string").withColumn("block", F.monotonically_increasing_id())
    packed = stored(blocks)  # so that a block's number and its vectors are settled
    buckets = min(max(-(-packed.agg(F.sum(F.size("vec_ids"))).first()[0] // BUCKET), 2 * spark.sparkContext.defaultParallelism), BUCKETS)
    packed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", f"{folder}/{name}").saveAsTable(name)
    held = spark.table(name)
    state = spark.createDataFrame([], STATE)
    ball, before = Ball(centroids), None
    for _ in range(rounds):
        met = held.select("block", "x", "kind").join(state.drop("sums").hint("shuffle_hash"), "block", "left")
        done = stored(met.mapInArrow(_round(ball, before, dim), STATE))
        state, centroids = done.where("block is not null"), _means(done.where("block is null"), centroids)
        before, ball = ball, Ball(centroids)
    found = stored(held.join(state.drop("sums").hint("shuffle_hash"), "block", "left").mapInArrow(_last(ball, before, dim), "vec_id long, cluster int, distance long"))
    spark.sql(f"DROP TABLE {name}")
    return found, centroids


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    found, centroids = lloyd(vectors, k, rounds, dim, seed)
    digests = [(a, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for a, c in enumerate(centroids)]
    names = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    clip = lambda c: F.least(c, F.lit(GREATEST).cast("decimal(38,0)")).cast("long")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("sum"))
    total = each.agg(F.sum("sum").cast("decimal(38,0)").alias("all"))
    about = each.crossJoin(total).join(names, "cluster").select("cluster", clip(F.col("sum")).alias("cluster_inertia"), clip(F.col("all")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def lloyd_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The same in SQL: every vector against every centroid, round by round."""
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
             WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id) - 1 AS INT) AS k, v AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := CAST({near} AS BIGINT), k := k)) AS m FROM v, c{i} GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT m.k AS k, list_transform(range(1, {dim} + 1), lambda j: CAST(list_sum(list_transform(list(v), lambda x: x[j])) AS BIGINT)) AS s, count(*) AS n FROM a{i} GROUP BY m.k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN n IS NULL THEN c ELSE list_transform(s, lambda x: (x - ((x % n) + n) % n) // n) END AS c FROM c{i} LEFT JOIN s{i} USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, m.k AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = m.k"""
