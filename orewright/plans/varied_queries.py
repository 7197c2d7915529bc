"""Reading and typing over tables that differ: one to three header rows, headers over several columns, a column that some lack,
rows that go on from the row above, tables of no known type, cells that were hard to read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ColumnRule, EntityPattern, Pack, TableType
from ..operators import headers as H
from ..operators import profile as P
from ..operators import typing as Y
from .base import table
from .reading_queries import BOX

PACK = Pack(
    "ranges",
    3,
    (
        TableType("unmet_table", ("never said",), ("omega",), 1, ()),
        TableType("range_table", ("ranges of",), ("name", "min", "max"), 2, (
            ColumnRule(("name",), "entity", entity_type="account"),
            ColumnRule(("segment",), "qualifier", qualifier_key="segment"),
            ColumnRule(("min", "max"), "metric", metric_key="balance", expect_unit="EUR", unit_from_header=True, stat_from_header=True),
            ColumnRule(("share",), "metric", metric_key="share", expect_unit="pct", stat_from_header=True),
        )),
    ),
    {"account": EntityPattern(r"\bCustomer#(\d+)\b", "account:{number}", ("number",)), "borehole": EntityPattern(r"\b([A-Z]{3})-(\d+)\b", "{area}-{number}", ("area", "number"))},
)


def _grid(spark, sf_dir):
    """tables, texts and cells: a nation is a document with one table, its customers the rows."""
    c = table(spark, sf_dir, "customer")
    nk = F.col("nk")
    nth = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    depth, untyped, shares = (nk % 3 + 1).cast("int"), nk % 6 == 5, nk % 2 == 0
    rows = c.select(F.col("c_nationkey").alias("nk"), nth.alias("nth"), "c_custkey", "c_name", "c_mktsegment", F.floor("c_acctbal").alias("low"))
    doc = F.concat(F.lit("nation:"), nk.cast("string")).alias("doc_id")
    page = (nk % 4 + 1).cast("int")
    nobox = F.lit(None).cast(BOX)
    box = lambda l, r: F.struct(page, F.lit(float(l)), F.lit(10.0), F.lit(float(r)), F.lit(20.0), F.lit("TOPLEFT")).cast(BOX)

    def cell(row, col, text, where, confidence=F.lit(0.9)):
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"), (row < depth).alias("column_header"), confidence.alias("confidence"), where.alias("bbox"))

    # Every tenth row but a table's first has no identity and names a borehole: it goes on from the row above.
    more = (F.col("c_custkey") % 10 == 0) & (F.col("nth") > 0)
    own = lambda x: F.when(~more, x.cast("string"))
    at = F.col("nth") + depth
    hard = F.when((nk % 7 == 3) & (F.col("nth") == 0), 0.6).otherwise(0.9)
    share = F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%"))
    hole = F.concat(F.lit("MSM-"), (F.col("c_custkey") % 40).cast("string"))
    data = [
        cell(at, 0, own(F.col("c_name")), nobox), cell(at, 1, own(F.col("c_mktsegment")), nobox), cell(at, 2, F.when(more, hole).otherwise(F.col("low").cast("string")), nobox, hard),
        F.when(~((nk % 5 == 1) & (F.col("nth") == 1)), cell(at, 3, own(F.col("low") + 5), nobox)), F.when(shares, cell(at, 4, own(share), nobox)),
    ]
    body = rows.select("nk", F.explode(F.array_compact(F.array(*data))).alias("c"))

    n = rows.groupBy("nk").agg(F.count("*").alias("n"))
    name, least, most = F.when(untyped, "Who").otherwise("Name"), F.when(untyped, "Low").otherwise("Min"), F.when(untyped, "High").otherwise("Max")
    last, above, none = depth - 1, depth - 2, F.lit(None).cast("string")
    heads = [cell(last, i, F.lit(t) if isinstance(t, str) else t, box(100 * i, 100 * i + 100)) for i, t in enumerate((name, "Segment", least, most))]
    heads += [F.when(depth > 1, x) for x in (cell(above, 0, name, box(0, 100)), cell(above, 1, F.lit("Segment"), box(100, 200)), cell(above, 2, F.lit("Balance (USD)"), box(200, 400)), cell(above, 3, none, nobox))]
    heads += [F.when(depth > 2, cell(F.lit(0), i, F.lit("Accounts") if i == 0 else none, box(0, 500) if i == 0 else nobox)) for i in range(4)]
    heads += [F.when(shares, cell(last, 4, F.lit("Share %"), box(400, 500))), F.when(shares & (depth > 1), cell(above, 4, F.lit("Share %"), box(400, 500))), F.when(shares & (depth > 2), cell(F.lit(0), 4, none, nobox))]
    cells = n.select("nk", F.explode(F.array_compact(F.array(*heads))).alias("c")).unionByName(body).select(doc, F.lit("v0").alias("element_id"), "c.*")
    width = F.when(shares, 5).otherwise(4)
    tables = n.select(doc, F.lit("v0").alias("element_id"), page.alias("page_no"), (F.col("n") + depth).cast("int").alias("num_rows"), width.alias("num_cols"), box(0, 500).alias("bbox"), F.lit(1).alias("tier"), F.lit(0.95).alias("confidence"))
    block = lambda pos, text, b: F.struct(F.lit(pos).alias("pos"), F.lit(text).alias("text"), F.lit(b).alias("b"))
    texts = n.select("nk", F.explode(F.array_compact(F.array(block(0, "Introduction", 2.0), F.when((nk % 4 != 0) & ~untyped, block(1, "Ranges of accounts", 8.0)), block(2, "Below it", 90.0)))).alias("x"))
    texts = texts.select(doc, F.format_string("text-%d", "x.pos").alias("element_id"), page.alias("page_no"), "x.pos", "x.text", F.struct(page, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("x.b"), F.lit("TOPLEFT")).cast(BOX).alias("bbox"))
    return tables, texts, cells


VARIED_SQL = """
n AS (SELECT c_nationkey AS nk, 'nation:' || c_nationkey AS doc_id, count(*) AS n, CAST(c_nationkey % 3 + 1 AS INT) AS depth, c_nationkey % 6 = 5 AS untyped, c_nationkey % 2 = 0 AS shares FROM customer GROUP BY 1),
r AS (SELECT *, c_custkey % 10 = 0 AND nth > 0 AS more FROM (SELECT n.*, c_custkey, c_name, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS low, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer JOIN n ON nk = c_nationkey)),
h AS (SELECT n.*, col, CASE WHEN depth > 2 THEN 'Accounts > ' ELSE '' END || CASE WHEN depth > 1 AND col IN (2, 3) THEN 'Balance (USD) > ' ELSE '' END
             || CASE col WHEN 0 THEN CASE WHEN untyped THEN 'Who' ELSE 'Name' END WHEN 1 THEN 'Segment' WHEN 2 THEN CASE WHEN untyped THEN 'Low' ELSE 'Min' END WHEN 3 THEN CASE WHEN untyped THEN 'High' ELSE 'Max' END ELSE 'Share %' END AS chain
      FROM n, (VALUES (0), (1), (2), (3), (4)) v(col) WHERE col < 4 OR shares)
"""


def varied_header_rows(spark, sf_dir):
    return H.header_counts(_grid(spark, sf_dir)[2]).select("doc_id", "header_rows")


def varied_header_chains(spark, sf_dir):
    cells = _grid(spark, sf_dir)[2]
    return H.header_chains(cells, H.header_counts(cells)).select("doc_id", "col", F.array_join("chain", " > ").alias("chain"))


def varied_table_types(spark, sf_dir):
    tables, texts, cells = _grid(spark, sf_dir)
    return Y.classify_tables(tables, texts, cells, H.header_counts(cells), PACK).select("doc_id", "caption", "table_type", F.col("type_confidence").cast("double").alias("type_confidence"))


def varied_columns(spark, sf_dir):
    tables, texts, cells = _grid(spark, sf_dir)
    counts = H.header_counts(cells)
    found = Y.match_columns(H.header_chains(cells, counts), Y.classify_tables(tables, texts, cells, counts, PACK), PACK)
    return found.select("doc_id", "col", F.col("rule.role").alias("role"), F.col("rule.metric_key").alias("metric_key"), F.col("rule.qualifier_key").alias("qualifier_key"))


def varied_candidates(spark, sf_dir):
    """Facts with their ends (min, max), units, qualifiers, and the boreholes of the rows that go on."""
    c = Y.emit_candidates(*_grid(spark, sf_dir), PACK)
    q = lambda k: F.try_element_at("qualifiers", F.lit(k)).alias(k)
    return c.select("doc_id", "cell_ref", "entity_id", "metric_key", F.col("value").cast("long").alias("value"), "unit", "unit_source", "value_kind", q("segment"), q("source_boreholes"), "page_no")


def varied_review(spark, sf_dir):
    """Tables under the floor of confidence become review rows, beside pages that no tier can read."""
    tables, _, cells = _grid(spark, sf_dir)
    graded = P.table_confidence(cells, tables)
    pages = tables.select("doc_id", "page_no", F.lit("t" * 30).alias("text"), F.lit(0).alias("image_count"), F.when(F.col("page_no") == 2, 900.0).otherwise(100.0).alias("width"), F.lit(100.0).alias("height"))
    rows = P.review_rows(P.route(P.profile_pages(pages)), graded)
    return rows.join(graded.select("doc_id", "grid"), "doc_id").select("doc_id", "element_id", "reason", F.col("grid").cast("double").alias("grid"))


QUERIES = {f.__name__: f for f in (varied_header_rows, varied_header_chains, varied_table_types, varied_columns, varied_candidates, varied_review)}

ORACLES = {
    "varied_header_rows": f"WITH {VARIED_SQL} SELECT doc_id, depth AS header_rows FROM n",
    "varied_header_chains": f"WITH {VARIED_SQL} SELECT doc_id, col, chain FROM h",
    "varied_table_types": f"WITH {VARIED_SQL} SELECT doc_id, CASE WHEN nk % 4 <> 0 AND NOT untyped THEN 'Ranges of accounts' ELSE 'Introduction' END AS caption, CASE WHEN NOT untyped THEN 'range_table' END AS table_type, CASE WHEN untyped THEN 0.0 WHEN nk % 4 <> 0 THEN 0.95 ELSE 0.85 END::DOUBLE AS type_confidence FROM n",
    "varied_columns": f"WITH {VARIED_SQL} SELECT doc_id, col, CASE col WHEN 0 THEN 'entity' WHEN 1 THEN 'qualifier' ELSE 'metric' END AS role, CASE WHEN col IN (2, 3) THEN 'balance' WHEN col = 4 THEN 'share' END AS metric_key, CASE col WHEN 1 THEN 'segment' END AS qualifier_key FROM h WHERE NOT untyped",
    "varied_candidates": f"""WITH {VARIED_SQL}, o AS (SELECT *, max(CASE WHEN NOT more THEN nth END) OVER (PARTITION BY nk ORDER BY nth) AS owner FROM r WHERE NOT untyped),
        b AS (SELECT nk, owner AS nth, string_agg(DISTINCT 'MSM-' || (c_custkey % 40), ';' ORDER BY 'MSM-' || (c_custkey % 40)) AS refs FROM o WHERE more GROUP BY 1, 2),
        f AS (SELECT o.*, col, refs FROM o LEFT JOIN b USING (nk, nth), (VALUES (2), (3), (4)) v(col) WHERE NOT more AND (col < 4 OR shares) AND NOT (col = 3 AND nk % 5 = 1 AND nth = 1))
        SELECT doc_id, 'r' || (nth + depth) || 'c' || col AS cell_ref, 'account:' || regexp_extract(c_name, '(\\d+)', 1) AS entity_id, CASE WHEN col < 4 THEN 'balance' ELSE 'share' END AS metric_key, CASE col WHEN 2 THEN low WHEN 3 THEN low + 5 END AS value,
               CASE WHEN col = 4 THEN 'pct' WHEN depth > 1 THEN 'USD' ELSE 'EUR' END AS unit, CASE WHEN col < 4 AND depth > 1 THEN 'column_header' ELSE 'rulebook_default' END AS unit_source, CASE col WHEN 2 THEN 'min' WHEN 3 THEN 'max' ELSE 'point' END AS value_kind,
               c_mktsegment AS segment, refs AS source_boreholes, CAST(nk % 4 + 1 AS INT) AS page_no FROM f""",
    "varied_review": f"""WITH {VARIED_SQL}, g AS (SELECT *, CASE WHEN nk % 5 = 1 AND n > 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS grid FROM n)
        SELECT doc_id, NULL AS element_id, 'aspect anomaly' AS reason, grid FROM g WHERE nk % 4 = 1 UNION ALL SELECT doc_id, 'v0', 'table confidence 0.6', grid FROM g WHERE nk % 7 = 3""",
}
