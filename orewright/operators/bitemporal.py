"""Two times per fact: when a value holds (valid) and when it was recorded (system), whatever the order of arrival.

A claim says that a fact has a value from `valid_from` until the next valid time known; of claims on one fact and valid time the one
recorded last counts. What the ledger believed is then a tiling of the plane of both times by rectangles: a claim begins
one when it is recorded, from its own valid time to that of the next claim known then; a claim that comes late cuts
the rectangle of the one before it, and a correction closes that of the claim it replaces. So the tiling follows from two
neighbours of every claim, the next lower and the next higher valid time among claims recorded no later.

Plan: one range-partitioned sort by fact and valid time. Each partition finds the neighbours inside it from a linked list in
order of valid time, taking claims out from the last recorded to the first. Only a partition's first and last fact can go
over its ends, and of these only running extremes (in order of recording) matter beyond it, so these few rows meet by fact in
a second pass. A fact with a third of all claims is spread over as many partitions as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

NEAR = "fact_identity string, v bigint, s bigint, before bigint, after bigint, low boolean, high boolean"


def neighbours(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For claims in order of recording with different valid times: the places of the next lower and next higher among
    earlier claims; -1 for none."""
    n = len(valid)
    order = np.argsort(valid, kind="stable")
    left, right = [-1] * n, [-1] * n
    by = order.tolist()
    for a, b in zip(by, by[1:]):
        right[a], left[b] = b, a
    lower, upper = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        a, b = lower[i], upper[i] = left[i], right[i]
        if a >= 0:
            right[a] = b
        if b >= 0:
            left[b] = a
    return np.array(lower, np.int64), np.array(upper, np.int64)


def _of_fact(v: np.ndarray, s: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Valid times next to each claim among those recorded before it (at one time the lower valid time is first), and whether
    there is none; claims in any order."""
    order = np.lexsort((v, s))
    back = np.empty(len(v), np.int64)
    back[order] = np.arange(len(v))
    lower, upper = (at[back] for at in neighbours(v[order]))
    value = lambda at: [None if x < 0 else int(v[order[x]]) for x in at.tolist()]
    return value(lower), value(upper), lower < 0, upper < 0


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours inside one partition; low and high tell rows that may have theirs beyond it."""
    if not (parts := [b for b in batches if b.num_rows]):
        return
    held = pa.Table.from_batches(parts).combine_chunks()
    v, s = held["v"].to_numpy(), held["s"].to_numpy()
    code = held["fact_identity"].chunk(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    before, after, low, high = [], [], np.zeros(len(v), bool), np.zeros(len(v), bool)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        x, y, none_below, none_above = _of_fact(v[a:b], s[a:b])
        before += x
        after += y
        low[a:b] = none_below & (i == 0)
        high[a:b] = none_above & (i == len(edges) - 2)
    yield pa.RecordBatch.from_arrays([held["fact_identity"].chunk(0), pa.array(v), pa.array(s), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(low), pa.array(high)], names=["fact_identity", "v", "s", "before", "after", "low", "high"])


def _over_edges(rows: pa.Table) -> pa.Table:
    """Neighbours among the running extremes of all partitions that hold a fact."""
    before, after, *_ = _of_fact(rows["v"].to_numpy(), rows["s"].to_numpy())
    return pa.table({"fact_identity": rows["fact_identity"], "v": rows["v"], "far_before": pa.array(before, pa.int64()), "far_after": pa.array(after, pa.int64())})


def rectangles(claims: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """The tiling of claims (claim_id, fact_identity, valid_from, recorded_at and `columns`): fact_identity, claim_id,
    `columns`, valid_from, valid_to, system_from, system_to; null ends are open. claim_id is unique and orders claims
    recorded at one time. Claims without fact, valid or recorded time take no part; rows alike are one claim."""
    usable = claims.where("fact_identity is not null and valid_from is not null and recorded_at is not null").dropDuplicates(["claim_id"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = usable.select("fact_identity", "claim_id", micros("valid_from").alias("v"), micros("recorded_at").alias("s"), *columns)
    last = rows.groupBy("fact_identity", "v", "s").agg(F.max("claim_id").alias("claim_id"))  # of claims alike in both times the last
    rows = cut(rows.join(last, ["fact_identity", "v", "s", "claim_id"], "left_semi"))
    # Only the first claim on a valid time changes what lies next to what; a correction leaves that as it is.
    first = rows.groupBy("fact_identity", "v").agg(F.min("s").alias("s"))
    place = ["fact_identity", "v", "s"]
    near = cut(first.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(_near, NEAR))
    edge = near.where("low or high")
    far = edge.groupBy("fact_identity").applyInArrow(_over_edges, "fact_identity string, v bigint, far_before bigint, far_after bigint")
    inner = near.where("not (low or high)").select(*place, "before", "after")
    whole = edge.join(far, ["fact_identity", "v"]).select(*place, F.when(F.col("low"), F.col("far_before")).otherwise(F.col("before")).alias("before"), F.when(F.col("high"), F.col("far_after")).otherwise(F.col("after")).alias("after"))
    known = cut(inner.unionByName(whole))

    # Events of a valid time's row of the plane: it is opened up to `after`, cut by a claim next to it, and claimed.
    none = F.lit(None).cast("string").alias("claim_id")
    opened = known.select(*place, none, "after")
    cuts = known.where("before is not null").select("fact_identity", F.col("before").alias("v"), "s", none, F.col("v").alias("after"))
    claimed = rows.select(*place, "claim_id", F.lit(None).cast("long").alias("after"))
    events = opened.unionByName(cuts).unionByName(claimed).groupBy(*place).agg(F.max("claim_id").alias("claim_id"), F.min("after").alias("after"))
    line = Window.partitionBy("fact_identity", "v").orderBy("s")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    told = events.select(*place, F.last("claim_id", ignorenulls=True).over(upto).alias("claim_id"), F.min("after").over(upto).alias("after"), F.lead("s").over(line).alias("until"))
    tiles = told.join(rows.select("claim_id", *columns), "claim_id")
    time = lambda c: F.timestamp_micros(c)
    return tiles.select("fact_identity", "claim_id", *columns, time("v").alias("valid_from"), time("after").alias("valid_to"), time("s").alias("system_from"), time("until").alias("system_to"))


def covers(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (end > at))


def believed(tiles: DataFrame, valid_at: Column, system_at: Column) -> DataFrame:
    """The tiles that hold a valid time, as the ledger knew it at a system time."""
    return tiles.where(covers(F.col("valid_from"), F.col("valid_to"), valid_at) & covers(F.col("system_from"), F.col("system_to"), system_at))


def corrections(tiles: DataFrame) -> DataFrame:
    """What is no longer believed: tiles that were closed, and how long they had stood (microseconds)."""
    closed = tiles.where("system_to is not null")
    return closed.withColumn("stood", F.unix_micros("system_to") - F.unix_micros("system_from"))


#: Asked times that go to every task at once; more of them are asked in as many passes as it takes.
ASKED = 1 << 20


def _sweep(times: np.ndarray, start: str, end: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            micros = lambda c: batch[c].cast(pa.int64())  # noqa: B023,E731
            lo = np.searchsorted(times, micros(start).to_numpy(zero_copy_only=False), "left")
            ends = micros(end)
            hi = np.where(np.asarray(ends.is_null()), len(times), np.searchsorted(times, ends.fill_null(0).to_numpy(zero_copy_only=False), "left"))
            n = np.maximum(hi - lo, 0)
            step = max(1, 100_000 // max(1, int(n.max(initial=1))))
            for a in range(0, len(n), step):  # output batches of bounded size
                part = n[a : a + step]
                row = np.repeat(np.arange(a, a + len(part)), part)
                if len(row):
                    at = times[np.arange(len(row)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(lo[a : a + step], part)]
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at).cast(pa.timestamp("us", tz="UTC"))], names=[*batch.schema.names, "at"])

    return run


def sweep(versions: DataFrame, times: DataFrame, start: str = "system_from", end: str = "system_to") -> DataFrame:
    """Every version with each asked time (at) that it covers: start <= at < end, a null end being open. The times are sorted,
    and a version finds its stretch of them by its two ends; nothing but what is asked becomes a row."""
    spark = versions.sparkSession
    asked = times.select(F.unix_micros(F.col("at").cast("timestamp")).alias("t")).where("t is not null").distinct()
    n = asked.count()
    schema = versions.drop("at").schema.add("at", "timestamp")
    rows, out = versions.drop("at"), None
    for k in range(max(1, -(-n // ASKED))):  # times of one pass at most `ASKED` in mean, by a hash
        part = asked.where(F.pmod(F.xxhash64("t"), F.lit(max(1, -(-n // ASKED)))) == k)
        own = np.sort(np.array([r.t for r in part.collect()], np.int64))  # bounded by the pass
        met = rows.mapInArrow(_sweep(own, start, end), schema)
        out = met if out is None else out.unionByName(met)
    return out
