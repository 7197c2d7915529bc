"""Registering files, manifests, and stores keyed by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import schema


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with the hash of their content: path, size, content, artifact_id."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("artifact_id"))


def vault_path(artifact_id: str = "artifact_id"):
    return F.concat_ws("/", F.substring(artifact_id, 1, 2), F.col(artifact_id))


def vault_put(files: DataFrame, root: str) -> None:
    """Content by its hash, one directory per first two digits; what is there already is left out."""
    spark = files.sparkSession
    fresh = files.select("artifact_id", "content", F.substring("artifact_id", 1, 2).alias("shard")).dropDuplicates(["artifact_id"])
    if exists(spark, root):
        fresh = fresh.join(spark.read.parquet(root).select("artifact_id"), "artifact_id", "left_anti")
    fresh.write.mode("append").partitionBy("shard").parquet(root)


def vault_get(spark: SparkSession, root: str, artifact_id: str) -> DataFrame:
    return spark.read.parquet(root).where((F.col("shard") == artifact_id[:2]) & (F.col("artifact_id") == artifact_id)).select("artifact_id", "content")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def register(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after more documents: same content is a no-op, other content under a doc_id replaces it."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("registered_at"), "artifact_id")
    latest = incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    changed = latest.join(registry.select("doc_id", "artifact_id"), ["doc_id", "artifact_id"], "left_anti")
    return registry.join(changed.select("doc_id"), "doc_id", "left_anti").select(*registry.columns).unionByName(changed.select(*registry.columns))


def plan_manifest(manifest: DataFrame, registry: DataFrame, asts: DataFrame) -> DataFrame:
    """Each entry (doc_id, title, source_url, page_range) in one bucket: skipped (read already), no_source, or ready."""
    done, known = asts.select("doc_id", F.lit(True).alias("done")).distinct(), registry.select("doc_id", F.lit(True).alias("known")).distinct()
    joined = manifest.join(done, "doc_id", "left").join(known, "doc_id", "left")
    bucket = F.when(F.col("done"), "skipped").when(F.col("known").isNull() & F.col("source_url").isNull(), "no_source").otherwise("ready")
    return joined.withColumn("bucket", bucket).drop("done", "known")


def run_manifest(plan: DataFrame, ingest: Callable[[dict], None]) -> DataFrame:
    """Runs `ingest` on the ready entries, inside the tasks; one that fails does not stop the others. Buckets: ingested,
    failed (with the error), skipped, no_source."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema.fields)

    def run(batches):
        for batch in batches:
            errors, buckets = [], []
            for row in batch.to_dict("records"):
                error = None
                if row["bucket"] == "ready":
                    try:
                        ingest(row)
                        row["bucket"] = "ingested"
                    except Exception as e:  # isolated by contract: any failure is this entry's own
                        row["bucket"], error = "failed", f"{type(e).__name__}: {e}"
                buckets.append(row["bucket"])
                errors.append(error)
            yield batch.assign(bucket=buckets, error=errors)

    return plan.mapInPandas(run, f"{columns}, error string")


def buckets(results: DataFrame) -> DataFrame:
    return results.groupBy("bucket").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count("*").alias("n"))


TREE = "struct<schema_name: string, version: string, doc_id: string, texts: array<struct<element_id: string, page_no: int, text: string, bbox: struct<page_no: int, l: double, t: double, r: double, b: double, coord_origin: string>>>, tables: array<struct<element_id: string, page_no: int, num_rows: int, num_cols: int, tier: int, confidence: double, bbox: struct<page_no: int, l: double, t: double, r: double, b: double, coord_origin: string>, cells: array<struct<row: int, col: int, text: string, column_header: boolean, confidence: double, bbox: struct<page_no: int, l: double, t: double, r: double, b: double, coord_origin: string>>>>>>"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Document trees, one JSON file each: doc_id, ast_hash (of the text) and the parsed tree."""
    raw = spark.read.text(path, wholetext=True)
    tree = F.from_json("value", TREE)
    return raw.select(tree.alias("tree"), F.sha2("value", 256).alias("ast_hash")).select("tree.doc_id", "ast_hash", "tree")


def tree_tables(trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long tables ast_text, ast_table and ast_cell of document trees."""
    texts = trees.select("doc_id", F.posexplode("tree.texts").alias("pos", "t")).select("doc_id", "t.element_id", "t.page_no", "pos", "t.text", "t.bbox")
    each = trees.select("doc_id", F.explode("tree.tables").alias("t"))
    tables = each.select("doc_id", "t.element_id", "t.page_no", "t.num_rows", "t.num_cols", "t.bbox", "t.tier", "t.confidence")
    cells = each.select("doc_id", "t.element_id", F.explode("t.cells").alias("c")).select("doc_id", "element_id", "c.*")
    return texts, tables, cells


def overwrite_documents(df: DataFrame, path: str) -> None:
    """Writes rows partitioned by doc_id; only the partitions of documents in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
