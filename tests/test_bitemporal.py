"""Claims in two times against a plain ledger that is asked point by point, and as-of questions by sweep."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from orewright.operators import bitemporal as T

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "claim_id string, fact_identity string, value long, valid_from timestamp, recorded_at timestamp, extra string"


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def some_claims(seed, n=120, facts=3):
    r = random.Random(seed)
    rows = [(f"c{i:04d}", f"f{r.randrange(facts)}", r.randrange(9), r.randrange(30), r.randrange(30)) for i in range(n)]
    rows += [(f"d{i:04d}", "backwards", i, 40 - i, i) for i in range(40)]  # each claim comes before all that are known
    rows += [("e1", "late", 1, 0, 0), ("e2", "late", 2, 10, 1), ("e3", "late", 3, 5, 2), ("e4", "late", 4, 5, 3), ("e5", "late", 5, 5, 3)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(c, f, v, at(a), at(b), "x") for c, f, v, a, b in rows], SCHEMA).repartition(parts)


def plain(rows, fact, valid, system):
    """The claim that is believed at a point."""
    known = [(a, b, c) for c, f, _, a, b in rows if f == fact and a is not None and b is not None and a <= valid and b <= system]
    return max(known)[2] if known else None


@pytest.mark.parametrize("parts", [1, 9])
def test_tiles_answer_every_point(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rows = some_claims(parts) + [("n1", None, 1, 1, 1), ("n2", "f0", 1, None, 1), ("n3", "f0", 1, 1, None)]
    try:
        got = T.rectangles(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    day = lambda t: None if t is None else (t.replace(tzinfo=timezone.utc) - DAY).days
    tiles = [(x.fact_identity, x.claim_id, day(x.valid_from), day(x.valid_to), day(x.system_from), day(x.system_to)) for x in got]
    inside = lambda a, b, t: a <= t and (b is None or t < b)
    for fact in {r[1] for r in rows if r[1]}:
        own = [t for t in tiles if t[0] == fact]
        for valid in range(-1, 42, 2):
            for system in range(-1, 42, 3):
                hits = [t[1] for t in own if inside(t[2], t[3], valid) and inside(t[4], t[5], system)]
                want = plain(rows, fact, valid, system)
                assert hits == ([want] if want else []), (fact, valid, system)


def test_a_late_value_closes_the_right_rectangle(spark):
    got = {(x.claim_id, x.valid_from.day, x.valid_to and x.valid_to.day, x.system_from.day, x.system_to and x.system_to.day) for x in T.rectangles(frame(spark, [x for x in some_claims(1) if x[1] == "late"])).collect()}
    # e1 holds until the 11th, then, from the third day of recording, until the 6th only; e5 replaces e3 at once with e4.
    assert got == {("e1", 1, None, 1, 2), ("e1", 1, 11, 2, 3), ("e1", 1, 6, 3, None), ("e2", 11, None, 2, None), ("e3", 6, 11, 3, 4), ("e5", 6, 11, 4, None)}
    tiles = T.rectangles(frame(spark, [x for x in some_claims(1) if x[1] == "late"]))
    assert [x.claim_id for x in T.believed(tiles, F.lit(at(7)), F.lit(at(1))).collect()] == ["e1"]
    assert sorted(x.claim_id for x in T.corrections(tiles).collect()) == ["e1", "e1", "e3"]


def test_repeated_and_no_claims(spark):
    rows = some_claims(2, 20)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(T.rectangles(frame(spark, rows + rows))) == key(T.rectangles(frame(spark, rows)))
    assert T.rectangles(frame(spark, [])).count() == 0


def test_neighbours_against_search():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 40):
        v = g.permutation(n)
        lower, upper = T.neighbours(v)
        for i in range(n):
            below, above = [x for x in v[:i] if x < v[i]], [x for x in v[:i] if x > v[i]]
            assert (v[lower[i]] if lower[i] >= 0 else None) == (max(below) if below else None)
            assert (v[upper[i]] if upper[i] >= 0 else None) == (min(above) if above else None)


@pytest.mark.parametrize("pass_size", [1 << 20, 4])
def test_sweep(spark, monkeypatch, pass_size):
    monkeypatch.setattr(T, "ASKED", pass_size)
    r = random.Random(4)
    rows = [(i, at(a), at(a + n) if n < 9 else None, {"k": str(i)}) for i in range(60) for a, n in [(r.randrange(20), r.randrange(12))]]
    versions = spark.createDataFrame(rows, "id long, system_from timestamp, system_to timestamp, at map<string,string>").repartition(3)
    times = spark.createDataFrame([(at(n),) for n in [*range(0, 30, 3), 3, None]], "at timestamp")
    got = sorted((x.id, (x.at.replace(tzinfo=timezone.utc) - DAY).days) for x in T.sweep(versions, times).collect())
    assert got == sorted((i, n) for i, a, b, _ in rows for n in range(0, 30, 3) if a <= at(n) and (b is None or at(n) < b))
    assert T.sweep(versions, times.limit(0)).count() == 0 and T.sweep(versions.limit(0), times).count() == 0
