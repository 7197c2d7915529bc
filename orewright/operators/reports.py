"""Dashboards, explorers and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_dashboard(registry: DataFrame, asts: DataFrame, runs: DataFrame, queue: DataFrame) -> DataFrame:
    """Each document with its tree, its latest run and its number of rows in review."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("started_at"), "run_id")
    latest = runs.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "tier_counts", "duration_s")
    flagged = queue.groupBy("doc_id").agg(F.count("*").alias("n_review"))
    wide = registry.join(asts.select("doc_id", "table_count", "element_count", "ast_hash"), "doc_id", "left").join(latest, "doc_id", "left").join(flagged, "doc_id", "left")
    return wide.withColumn("n_review", F.coalesce("n_review", F.lit(0)))


def dense_grid(cells: DataFrame) -> DataFrame:
    """A table's rows as arrays of texts, one element per column, null where there is no cell."""
    size = cells.groupBy("doc_id", "element_id").agg((F.max("col") + 1).alias("n"))
    rows = cells.groupBy("doc_id", "element_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(size, ["doc_id", "element_id"])
    return rows.select("doc_id", "element_id", "row", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("m", i)).alias("texts"))


def admission(planned: DataFrame, max_ram_gb: float, max_vram_gb: float, available_ram_gb: float, available_vram_gb: float) -> DataFrame:
    """Whether models (model, ram, vram in GB) fit the budget and what is free; the first reason against.
    A budget without graphics memory spends none."""
    vram = F.coalesce(F.sum("vram"), F.lit(0.0)) if max_vram_gb > 0 else F.lit(0.0)
    total = planned.agg(F.coalesce(F.sum("ram"), F.lit(0.0)).alias("ram"), vram.alias("vram"))
    reason = (
        F.when(F.col("vram") > max_vram_gb, "graphics memory over budget").when(F.col("ram") > max_ram_gb, "memory over budget")
        .when(F.col("ram") > available_ram_gb, "memory not available").when(F.col("vram") > available_vram_gb, "graphics memory not available").otherwise("within budget")
    )
    return total.select("ram", "vram", (reason == "within budget").alias("admitted"), reason.alias("reason"))
