"""Page profiles, routing and review rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY_FLOOR = 0.55
TABLE_FLOOR = 0.80


def profile_pages(pages: DataFrame) -> DataFrame:
    """Adds has_text_layer, text_coverage, aspect_anomaly, is_scanned and quality to (text, image_count, width, height)."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    ratio = F.when(F.col("height") == 0, 1.0).otherwise(F.try_divide(F.col("width"), F.col("height")))
    layer = size > 20
    scanned = ~layer & (F.coalesce("image_count", F.lit(0)) > 0)
    return pages.select(
        "*",
        layer.alias("has_text_layer"),
        F.round(F.least(F.lit(1.0), size / 2000.0), 3).alias("text_coverage"),
        ((ratio > 2.0) | (ratio < 0.35)).alias("aspect_anomaly"),
        scanned.alias("is_scanned"),
        F.when(layer, 1.0).when(scanned, 0.2).otherwise(0.5).alias("quality"),
    )


def route(profiles: DataFrame, floor: float = QUALITY_FLOOR) -> DataFrame:
    """Adds tier (null: to review) and the reason."""
    good = F.col("has_text_layer") & (F.col("quality") >= floor)
    reason = (
        F.when(F.col("aspect_anomaly"), F.lit("aspect anomaly"))
        .when(good, F.lit("text layer"))
        .otherwise(F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" without a usable text layer")))
    )
    return profiles.select("*", F.when(~F.col("aspect_anomaly") & good, 1).alias("tier"), reason.alias("route_reason"))


def review_rows(routed: DataFrame, tables: DataFrame | None = None, floor: float = TABLE_FLOOR) -> DataFrame:
    """Pages without a tier and tables below the confidence floor, as review queue rows."""
    pages = routed.where("tier is null").select("doc_id", "page_no", F.lit(None).cast("string").alias("element_id"), F.col("route_reason").alias("reason"))
    if tables is None:
        return pages
    low = tables.where(F.col("confidence") < floor).select("doc_id", "page_no", "element_id", F.concat(F.lit("table confidence "), F.col("confidence").cast("string")).alias("reason"))
    return pages.unionByName(low)


def read_pages(pages: DataFrame, read: Callable[[dict], str]) -> DataFrame:
    """Pages with `text`, what `read` makes of each row inside the tasks, and `error`. A page that fails is its own failure:
    it has no text, and the other pages of its document go on."""
    kept = [c for c in pages.columns if c not in ("text", "error")]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for row in batch.to_dict("records"):
                text = error = None
                try:
                    text = read(row)
                except Exception as e:  # isolated by contract: any failure is this page's own
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield batch[kept].assign(text=texts, error=errors)

    return pages.mapInPandas(run, f"{columns}, text string, error string")


def failed_pages(read: DataFrame) -> DataFrame:
    """Review queue rows of the pages that could not be read."""
    element = F.concat(F.lit("page-"), F.col("page_no").cast("string"), F.lit("-failed"))
    return read.where("error is not null").select("doc_id", "page_no", element.alias("element_id"), F.col("error").alias("reason"))


def tier_histogram(routed: DataFrame) -> DataFrame:
    """One map per document: tier (or "none") to pages."""
    tier = F.coalesce(F.col("tier").cast("string"), F.lit("none")).alias("tier")
    counts = routed.groupBy("doc_id", tier).count()
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "count")))).alias("tier_counts"))


def text_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of a page's text (parted by blank lines); numbered before blank ones go."""
    blocks = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "text"))
    named = blocks.withColumn("element_id", F.format_string("p%d-text-%d", "page_no", "pos"))
    return named.where(F.trim("text") != "").select("doc_id", "element_id", "page_no", "pos", F.trim("text").alias("text"))


def table_confidence(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Grid consistency, and the least confidence of a table's filled data cells (0.95 if it has none)."""
    filled = ~F.col("column_header") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    per = cells.groupBy("doc_id", "element_id").agg(F.count("*").alias("n"), F.min(F.when(filled, F.col("confidence"))).alias("least"))
    grid = F.when(F.col("n") == F.col("num_rows") * F.col("num_cols"), 1.0).otherwise(0.5)
    return tables.drop("confidence").join(per, ["doc_id", "element_id"], "left").select(
        *[c for c in tables.columns if c != "confidence"], F.coalesce(grid, F.lit(0.5)).alias("grid"), F.coalesce("least", F.lit(0.95)).alias("confidence")
    )


def element_confidence(text: Column, tier: Column, grid: Column, has_header: Column, ocr: Column | None = None) -> Column:
    """The weakest of the tier's prior, the grid, the header and the reader's own confidence; 0 for blank text."""
    parts = [F.when(tier == 1, 0.95).otherwise(0.5), grid, F.when(has_header, 1.0).otherwise(0.3), *([ocr] if ocr is not None else [])]
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.0).otherwise(F.round(F.least(*parts), 3))
