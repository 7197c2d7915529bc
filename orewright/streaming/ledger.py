"""The ledger and the logs as streams. The batch operators are the definition; these keep state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

VERSION = "fact_identity string, op string, value string, unit string, system_from timestamp, supersedes_from timestamp, version long"
HORIZON = "7 days"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LedgerProcessor(StatefulProcessor):
    """One fact's versions. What is older than `horizon` before the fact's last observation is settled: of it only the last version
    stays, as `base`. Observations inside the horizon are kept, so a value that comes late among them takes its place: versions
    it makes wrong are retracted and told anew. A value older than the base is given out as late. After `idle_ms` without
    values (processing time, a timer) all is settled, and the state is one row."""

    def __init__(self, horizon: str, idle_ms: int):
        self.horizon, self.idle_ms = pd.Timedelta(horizon), idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "value string, unit string, since timestamp, before timestamp, version long")
        self.recent = handle.getListState("recent", "value string, unit string, at timestamp")
        self.alarm = handle.getValueState("alarm", "at long")

    @staticmethod
    def _versions(base, recent: list[tuple]) -> list[tuple]:
        """(value, unit, since, before, version) of each version after the base; `before` is since when the one before it holds."""
        out = []
        value, unit, since, version = (base[0], base[1], base[2], base[4]) if base else (None, None, None, 0)
        for v, u, at in recent:
            if version and (v, u) == (value, unit):
                continue
            out.append((v, u, at, since, version + 1))
            value, unit, since, version = v, u, at, version + 1
        return out

    def _load(self) -> tuple[tuple | None, list[tuple]]:
        base = tuple(self.base.get()) if self.base.exists() else None
        return base, [tuple(x) for x in self.recent.get()] if self.recent.exists() else []

    def _keep(self, base: tuple | None, versions: list[tuple], recent: list[tuple], last) -> None:
        """Settles what left the horizon."""
        old = [v for v in versions if last - v[2] > self.horizon]
        if old:
            base = old[-1]
            recent = [r for r in recent if r[2] > base[2]]
        if base:
            self.base.update(base)
        self.recent.clear()
        if recent:
            self.recent.put(recent)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, recent = self._load()
        before = self._versions(base, recent)
        fresh = [(r.value, r.unit, r.observed_at) for part in rows for r in part.itertuples()]
        taken = [r for r in fresh if not base or r[2] > base[2] or (r[2] == base[2] and (r[0], r[1]) == (base[0], base[1]))]
        late = [r for r in fresh if r not in taken]
        recent = sorted({*recent, *taken}, key=lambda r: (r[2], r[0]))
        after = self._versions(base, recent)
        out = [(key[0], "retract", *v) for v in before if v not in after] + [(key[0], "assert", *v) for v in after if v not in before]
        out += [(key[0], "late", v, u, at, None, None) for v, u, at in late]
        last = max([r[2] for r in recent] + ([base[2]] if base else []))
        self._keep(base, after, recent, last)
        if self.idle_ms:
            if self.alarm.exists():
                self.handle.deleteTimer(self.alarm.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.alarm.update((at,))
        if out:
            yield pd.DataFrame(out, columns=["fact_identity", "op", "value", "unit", "system_from", "supersedes_from", "version"]).astype({"version": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base, recent = self._load()
        versions = self._versions(base, recent)
        if versions:
            self.base.update(versions[-1])
        self.recent.clear()
        self.alarm.clear()
        return iter([])

    def close(self) -> None:
        pass


def ledger_stream(observed: DataFrame, horizon: str = HORIZON, idle_ms: int = 0) -> DataFrame:
    """Versions of facts from a stream of (fact_identity, value, unit, observed_at), as they become known: op `assert` for one
    that holds from now on, `retract` for one that a late value made wrong, `late` for a value that came after its time was
    settled (a side output: filter by op). The last word on a version is the last row with its number. Values of one time are taken
    in order of the value; rows without fact or time are left out. State lives in RocksDB, so set `spark.sql.streaming.stateStore.providerClass`
    to `ROCKS`."""
    rows = observed.where("fact_identity is not null and observed_at is not null and value is not null")
    rows = rows.select("fact_identity", F.col("value").cast("string").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), "observed_at")
    return rows.groupBy("fact_identity").transformWithStateInPandas(LedgerProcessor(horizon, idle_ms), VERSION, "Append", "ProcessingTime" if idle_ms else "None")


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per window and kind; rows later than the watermark are left out by it."""
    return events.withWatermark("at", late).groupBy(F.window("at", every), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log (audit, lineage) as files; `checkpoint` is a shared folder."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
