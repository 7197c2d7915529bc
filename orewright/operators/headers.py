"""Header rows, header chains and tables that continue over pages. Cells are long: (doc_id, element_id, row, col, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_numeric

TABLE = ["doc_id", "element_id"]


def header_counts(cells: DataFrame, threshold: float = 0.3) -> DataFrame:
    """header_rows of each table: rows before the first whose filled cells are numeric to `threshold`; at least one."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    rows = cells.groupBy(*TABLE, "row").agg(F.count_if(filled).alias("filled"), F.count_if(filled & is_numeric(F.col("text"))).alias("numeric"))
    data = F.when((F.col("filled") > 0) & (F.col("numeric") >= threshold * F.col("filled")), F.col("row"))
    return rows.groupBy(*TABLE).agg(F.greatest(F.coalesce(F.min(data), F.count("*").cast("int")), F.lit(1)).cast("int").alias("header_rows"))


def column_ranges(cells: DataFrame) -> DataFrame:
    """Each column's narrowest box; the first row wins ties."""
    boxed = cells.where("bbox is not null")
    narrow = F.min_by(F.struct("bbox.l", "bbox.r"), F.struct((F.col("bbox.r") - F.col("bbox.l")).alias("w"), F.col("row")))
    return boxed.groupBy(*TABLE, "col").agg(narrow.alias("x")).select(*TABLE, "col", F.col("x.l").alias("l"), F.col("x.r").alias("r"))


def header_chains(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """The headers above each column, outermost first, without repeats in a row. A cell without text takes the text of
    the header in its row whose box holds the middle of the column."""
    cells = cells.select(*TABLE, "row", "col", F.nullif(F.trim("text"), F.lit("")).alias("text"), "bbox")
    heads = cells.join(counts, TABLE).where("row < header_rows")
    middle = column_ranges(cells).select(*TABLE, "col", ((F.col("l") + F.col("r")) / 2).alias("mid"))
    spans = heads.where("text is not null and bbox is not null").select(*TABLE, "row", F.col("col").alias("at"), F.col("text").alias("span_text"), "bbox.l", "bbox.r")
    # A range join whose equality keys (table, row) leave only one row's headers to compare.
    covered = (
        heads.where("text is null").select(*TABLE, "row", "col").join(middle, [*TABLE, "col"]).join(spans, [*TABLE, "row"]).where("mid between l and r")
        .groupBy(*TABLE, "row", "col").agg(F.min_by("span_text", "at").alias("span_text"))
    )
    full = heads.select(*TABLE, "row", "col", "text").join(covered, [*TABLE, "row", "col"], "left").select(*TABLE, "row", "col", F.coalesce("text", "span_text").alias("text"))
    chain = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("row", "text")))), lambda x: x["text"])
    chains = full.groupBy(*TABLE, "col").agg(chain.alias("all"))
    apart = F.filter("all", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("all", i - 1)))
    return chains.select(*TABLE, "col", apart.alias("chain"))


def merge_continued(tables: DataFrame, cells: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables whose header equals that of the table on the page before join it: their header rows go, their rows move
    down, and the confidence is the least. Returns tables and cells; boxes keep their own page."""
    heads = cells.join(counts, TABLE).where("row < header_rows").groupBy(*TABLE).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce("text", F.lit("")).alias("text"))))).alias("signature")
    )
    w = Window.partitionBy("doc_id").orderBy("page_no", "element_id")
    known = tables.join(counts, TABLE, "left").join(heads, TABLE, "left").withColumn("header_rows", F.coalesce("header_rows", F.lit(1)))
    fresh = ~((F.lag("signature").over(w) == F.col("signature")) & (F.col("page_no") - F.lag("page_no").over(w) == 1))
    islands = known.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    own = Window.partitionBy("doc_id", "island").orderBy("page_no", "element_id")
    before = F.coalesce(F.sum(F.col("num_rows") - F.col("header_rows")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = islands.withColumn("moved", before).withColumn("into", F.first("element_id").over(own)).withColumn("head", F.col("fresh") == 1)
    merged = placed.groupBy("doc_id", F.col("into").alias("element_id")).agg(
        F.min("page_no").alias("page_no"), F.max("page_no").alias("last_page"),
        (F.sum(F.col("num_rows") - F.col("header_rows")) + F.max(F.when(F.col("head"), F.col("header_rows")))).cast("int").alias("num_rows"),
        F.max("num_cols").alias("num_cols"), F.min("tier").alias("tier"), F.min("confidence").alias("confidence"),
    )
    moved = cells.join(placed.select(*TABLE, "into", "moved", "head", "header_rows"), TABLE).where(F.col("head") | (F.col("row") >= F.col("header_rows")))
    row = F.when(F.col("row") < F.col("header_rows"), F.col("row")).otherwise(F.col("row") + F.col("moved")).cast("int")
    out = moved.withColumn("row", row).withColumn("element_id", F.col("into")).select(*cells.columns)
    return merged, out
