"""What several operators share: reading, cutting lineage, packing arrays, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where `spark.checkpoint.dir` is unset, a plain local master (as in tests) gets
    a temporary folder; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder, so that a lost executor costs a re-read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df`, written as Parquet to the shared folder (or to `path`) and read again."""
    path = path or fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A table goes to every executor only up to this size, which is worked out from its row count.
BROADCAST_BYTES = 16 << 20
SALTS = 64


def attach(rows: DataFrame, small: DataFrame, on: list[str], spread: str, row_bytes: int = 256) -> DataFrame:
    """`rows` joined with a table of one row per key. That is broadcast if its size is within bounds; else each key's
    rows are dealt over `SALTS` tasks by the column `spread`, so a frequent key burdens no task alone either way."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on)
    every = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(every, [*on, "__salt"]).drop("__salt")


def split_off(rows: DataFrame, heavy: DataFrame, on: list[str], spread: str) -> tuple[DataFrame, DataFrame | None]:
    """`rows` whose key is not in `heavy` (a row per key), and those whose key is (None if there are no such keys). As in
    `attach`, the rows of one key are met where they lie or dealt over `SALTS` tasks."""
    n = heavy.count()
    if not n:
        return rows, None
    if n * 64 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(heavy), on, "left_anti"), rows.join(F.broadcast(heavy), on, "left_semi")
    every = heavy.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return tuple(salted.join(every, [*on, "__salt"], how).drop("__salt") for how in ("left_anti", "left_semi"))


def widened(schema: StructType, **columns: str) -> StructType:
    """A schema with more columns at its end: names and types."""
    return StructType([*schema.fields, *(StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in columns.items())])


def pack(values: np.ndarray) -> bytes:
    """An array as zstd over its byte planes: sorted keys and small counts have planes that are nearly constant."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return np.int64(planes.size).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    size = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


#: Links that one task contracts before the rounds of `components` begin.
CONTRACTED = 500_000


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What some links connect, as links from each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        # The component of a label's own node sinks too, so that whole components move at once.
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _contract(batches):
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if parts:
        u, v = spanning_stars(*map(np.concatenate, zip(*parts)))
        yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})


def contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v) that connect what `edges` connect: each share of them becomes stars around the smallest nodes."""
    held = cut(edges.where("u <> v").select("u", "v"))
    return held.repartition(max(4, -(-held.count() // CONTRACTED))).mapInArrow(_contract, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node of `edges` (u, v; longs): node, component.

    Shares of the links, of at most `CONTRACTED`, are contracted to stars where they are; if all links are one such share,
    that is the result. Else each round takes the least
    label among a node's neighbours and follows labels twice, so the distance that a label travels more than doubles per
    round. All state stays in DataFrames; the driver reads one count per round, and no side is broadcast through it. A node
    with very many neighbours is pre-aggregated by the minimum before the shuffle.
    """

    held = cut(edges.where("u <> v").select("u", "v"))
    shares = -(-held.count() // CONTRACTED)
    if shares <= 1:
        stars = cut(held.coalesce(1).mapInArrow(_contract, "u long, v long"))
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    stars = held.repartition(shares).mapInArrow(_contract, "u long, v long")
    both = cut(stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")))
    for _ in range(max_rounds):
        seen = labels.select(F.col("node").alias("v"), F.col("component").alias("least"))
        near = both.join(seen.hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("least").alias("least"))
        lowered = labels.join(near.hint("merge"), "node").select("node", "component", F.least("component", "least").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        moved = cut(lowered.join(up.hint("merge"), "low").select("node", F.least("low", "jump").alias("next"), "component"))
        changed = not moved.where("next != component").isEmpty()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")
