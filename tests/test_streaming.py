"""The ledger as a stream: versions, late values inside and beyond the horizon, restarts, and the batch operator as definition."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from orewright.operators import ledger as L
from orewright.streaming import ledger as stream

DAY = datetime(2026, 1, 1)
SCHEMA = "fact_identity string, value string, unit string, observed_at timestamp"


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches one by one, each by a query of its own over the same checkpoint (so each is a restart)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS)
    n = [0]

    def feed(rows, **how):
        n[0] += 1
        data = [(f, v, u, None if d is None else DAY + timedelta(days=d)) for f, v, u, d in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = stream.ledger_stream(source, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        return spark.read.schema(stream.VERSION).parquet(str(tmp_path / "out"))

    yield feed
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def told(df):
    return sorted((x.op, x.value, (x.system_from - DAY).total_seconds() / 86400, x.version) for x in df.collect())


def test_versions_corrections_and_late_values(run):
    out = run([("f", "1", "m", 1), ("f", "1", "m", 2), ("f", "2", "m", 4), (None, "9", "m", 1), ("f", None, "m", 3), ("f", "7", "m", None)])
    assert told(out) == [("assert", "1", 1.0, 1), ("assert", "2", 4.0, 2)]
    out = run([("f", "3", "m", 3)])  # late by a day: what came after it is told anew
    assert told(out) == sorted([("assert", "1", 1.0, 1), ("assert", "2", 4.0, 2), ("retract", "2", 4.0, 2), ("assert", "3", 3.0, 2), ("assert", "2", 4.0, 3)])
    out = run([("f", "4", "m", 20)])  # settles what is a week older
    out = run([("f", "5", "m", 2), ("f", "2", "m", 21)])
    assert [x for x in told(out) if x[0] == "late"] == [("late", "5", 2.0, None)]
    assert {x[1:] for x in told(out) if x[0] == "assert"} >= {("4", 20.0, 4), ("2", 21.0, 5)}


def test_stream_agrees_with_the_batch(spark, run):
    r = random.Random(12)
    batches = [[(f"f{r.randrange(3)}", str(r.randrange(3)), "m", 3 * k + r.randrange(6) + r.random()) for _ in range(12)] for k in range(4)]
    for b in batches:
        out = run(b, horizon="100 days")
    net = out.withColumn("n", F.when(F.col("op") == "assert", 1).otherwise(-1)).groupBy("fact_identity", "value", "system_from", "version").agg(F.sum("n").alias("n")).where("n <> 0")
    got = sorted((x.fact_identity, x.value, x.system_from, x.version) for x in net.collect())
    rows = [(f, f"c{i}", "m", float(v), v, u, DAY + timedelta(days=d)) for i, (f, v, u, d) in enumerate(x for b in batches for x in b)]
    observed = spark.createDataFrame(rows, "entity_id string, candidate_id string, metric_key string, value double, value_text string, unit string, observed_at timestamp")
    observed = observed.withColumns({"qualifiers": F.create_map().cast("map<string,string>"), "period": F.lit(None).cast("string"), "value_kind": F.lit("point")})
    want = sorted((x.entity_id, x.value_text, x.system_from, x.version) for x in L.publish(observed).collect())
    assert got == want and out.where("op = 'retract'").count() > 0 and all(x.n == 1 for x in net.collect())


def test_idle_facts_are_settled_by_a_timer(spark, tmp_path):
    """Processing-time timers run while a query does, so this one runs on."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS)
    put = lambda *rows: spark.createDataFrame([(f, v, "m", DAY + timedelta(days=d)) for f, v, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("f", "1", 1), ("f", "2", 2))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stream.ledger_stream(source, idle_ms=1).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()

    def wait(n):
        end = time.time() + 60
        while spark.table("settled").count() < n and time.time() < end:
            time.sleep(0.3)
        return told(spark.table("settled"))

    try:
        assert wait(2) == [("assert", "1", 1.0, 1), ("assert", "2", 2.0, 2)]
        time.sleep(4)  # some batches, in which the timer comes due
        put(("f", "3", 1.5), ("f", "4", 3))
        assert wait(4)[-1] == ("late", "3", 1.5, None) and ("assert", "4", 3.0, 3) in told(spark.table("settled"))
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_and_log(spark, tmp_path):
    events = [("a", datetime(2026, 1, 1, 0, m, tzinfo=timezone.utc)) for m in (1, 2, 12)]
    spark.createDataFrame(events, "kind string, at timestamp").write.parquet(str(tmp_path / "e"))
    counts = stream.windowed_counts(spark.readStream.schema("kind string, at timestamp").parquet(str(tmp_path / "e")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(x.n for x in spark.table("counts").collect()) == [1, 2]
    log = spark.readStream.schema("kind string, at timestamp").parquet(str(tmp_path / "e"))
    for _ in range(2):  # a restart adds nothing
        stream.append_sink(log, str(tmp_path / "log"), str(tmp_path / "lc")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
