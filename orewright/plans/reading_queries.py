"""Reading and typing. Customers of a nation are the rows of tables that go on over pages, under two header rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ColumnRule, EntityPattern, Pack, TableType
from ..functions import text as T
from ..operators import headers as H
from ..operators import profile as P
from ..operators import reports as R
from ..operators import search as S
from ..operators import typing as Y
from ..sources.registry import plan_manifest
from .base import table

PAGE_ROWS = 40
BOX = "struct<page_no: int, l: double, t: double, r: double, b: double, coord_origin: string>"
PACK = Pack(
    "accounts",
    1,
    (
        TableType("other_table", ("no such caption",), ("alpha", "beta"), 2, ()),
        TableType("balance_table", ("balances? of",), ("name", "balance", "share"), 2, (
            ColumnRule(("name",), "entity", entity_type="account"),
            ColumnRule(("balance",), "metric", metric_key="balance", expect_unit="EUR", unit_from_header=True),
            ColumnRule(("share",), "metric", metric_key="share", expect_unit="pct", stat_from_header=True),
        )),
    ),
    {"account": EntityPattern(r"\bCustomer#(\d+)\b", "account:{number}", ("number",))},
)


def _box(page, l, r):
    return F.struct(page.cast("int"), F.lit(float(l)), F.lit(10.0), F.lit(float(r)), F.lit(20.0), F.lit("TOPLEFT")).cast(BOX)


def _rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    page = F.floor(F.col("nth") / PAGE_ROWS).cast("int") + 1
    return c.withColumn("nth", nth).select(
        F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("doc_id"), F.format_string("p%03d-t0", page).alias("element_id"), page.alias("page_no"), (F.col("nth") % PAGE_ROWS + 2).cast("int").alias("row"), "c_custkey", "c_name", "c_acctbal",
    )


def grid(spark, sf_dir):
    """tables, texts and cells."""
    rows = _rows(spark, sf_dir)
    page = F.col("page_no")
    none, nobox = F.lit(None).cast("string"), F.lit(None).cast(BOX)
    cell = lambda row, col, text, box: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("text"), (row < 2).alias("column_header"), F.lit(0.9).alias("confidence"), box.alias("bbox"))
    balance = F.concat(F.floor("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "*").otherwise(""))
    share = F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%"))
    data = rows.select("doc_id", "element_id", F.explode(F.array(cell(F.col("row"), 0, F.col("c_name"), nobox), cell(F.col("row"), 1, balance, nobox), cell(F.col("row"), 2, share, nobox))).alias("c"))
    tables = rows.groupBy("doc_id", "element_id", "page_no").agg((F.max("row") + 1).alias("num_rows")).select("doc_id", "element_id", "page_no", "num_rows", F.lit(3).alias("num_cols"), _box(page, 50, 300).alias("bbox"), F.lit(1).alias("tier"), F.lit(0.95).alias("confidence"))
    zero, one = F.lit(0), F.lit(1)
    heads = tables.select("doc_id", "element_id", F.explode(F.array(
        cell(zero, 0, F.lit("Name"), _box(page, 0, 100)), cell(zero, 1, F.lit("Account"), _box(page, 100, 300)), cell(zero, 2, none, nobox),
        cell(one, 0, F.lit("Name"), _box(page, 0, 100)), cell(one, 1, F.lit("Balance (USD)"), _box(page, 100, 200)), cell(one, 2, F.lit("Share max"), _box(page, 200, 300)),
    )).alias("c"))
    cells = heads.unionByName(data).select("doc_id", "element_id", "c.*")
    texts = tables.select("doc_id", "page_no", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("Introduction").alias("text"), F.lit(2.0).alias("b")), F.struct(F.lit(1).alias("pos"), F.lit("Balances of accounts").alias("text"), F.lit(8.0).alias("b")))).alias("x"))
    texts = texts.where((F.col("page_no") == 1) | (F.col("x.pos") == 0)).select("doc_id", F.format_string("p%d-text-%d", "page_no", "x.pos").alias("element_id"), "page_no", "x.pos", "x.text", F.struct(F.col("page_no"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("x.b"), F.lit("TOPLEFT")).cast(BOX).alias("bbox"))
    return tables, texts, cells


ROWS_SQL = f"""
r AS (SELECT *, 'nation:' || c_nationkey AS doc_id, nth // {PAGE_ROWS} + 1 AS page_no, printf('p%03d-t0', nth // {PAGE_ROWS} + 1) AS element_id, nth % {PAGE_ROWS} + 2 AS row
      FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer)),
t AS (SELECT doc_id, element_id, page_no, count(*) AS n FROM r GROUP BY ALL)
"""


def header_detect(spark, sf_dir):
    return H.header_counts(grid(spark, sf_dir)[2])


def header_chain(spark, sf_dir):
    cells = grid(spark, sf_dir)[2]
    return H.header_chains(cells, H.header_counts(cells)).select("doc_id", "element_id", "col", F.array_join("chain", " > ").alias("chain"))


def table_continuation(spark, sf_dir):
    tables, _, cells = grid(spark, sf_dir)
    merged, moved = H.merge_continued(tables, cells, H.header_counts(cells))
    rows = moved.groupBy("doc_id", "element_id").agg(F.countDistinct("row").alias("distinct_rows"), F.max("row").alias("last_row"))
    return merged.join(rows, ["doc_id", "element_id"]).select("doc_id", "element_id", "page_no", "last_page", "num_rows", "distinct_rows", "last_row")


def table_classify(spark, sf_dir):
    tables, texts, cells = grid(spark, sf_dir)
    return Y.classify_tables(tables, texts, cells, H.header_counts(cells), PACK).select("doc_id", "element_id", "caption", "table_type", "type_confidence")


def column_match(spark, sf_dir):
    tables, texts, cells = grid(spark, sf_dir)
    counts = H.header_counts(cells)
    found = Y.match_columns(H.header_chains(cells, counts), Y.classify_tables(tables, texts, cells, counts, PACK), PACK)
    return found.select("doc_id", "element_id", "col", F.col("rule.role").alias("role"), F.col("rule.metric_key").alias("metric_key"))


def unpivot_candidates(spark, sf_dir):
    tables, texts, cells = grid(spark, sf_dir)
    return Y.emit_candidates(tables, texts, cells, PACK).select("candidate_id", "entity_id", "metric_key", "value_raw", F.col("value").cast("long").alias("value"), "unit", "unit_source", "value_kind", "page_no")


def dense_rows(spark, sf_dir):
    return R.dense_grid(grid(spark, sf_dir)[2]).select("doc_id", "element_id", "row", F.array_join("texts", "|", "").alias("line"))


def table_confidences(spark, sf_dir):
    tables, _, cells = grid(spark, sf_dir)
    return P.table_confidence(cells, tables).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("grid").alias("grid"), F.min("confidence").alias("confidence"))


def chunk_parent_child(spark, sf_dir):
    tables, texts, cells = grid(spark, sf_dir)
    registry = tables.select("doc_id").distinct().select("doc_id", F.lit("T").alias("title"), F.lit("P").alias("publisher"), F.lit("public").alias("classification"))
    return S.build_chunks(registry, texts, tables, cells).select("chunk_id", "parent_id", "level", "indexed_text")


def _profiles(spark, sf_dir):
    """Documents are pages, with their whole texts; sources hold them."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    pages = d.select(F.coalesce("source", F.lit("none")).alias("doc_id"), k.alias("page_no"), "text", (k % 3).cast("int").alias("image_count"), (100.0 + k % 400).alias("width"), F.lit(200.0).alias("height"))
    return P.route(P.profile_pages(pages))


def _read_title(row: dict) -> str:
    """The page's title; a page whose title has an accent is one that this reader cannot read."""
    title = row["html"].partition("<title>")[2].partition("</title>")[0]
    title.encode("ascii")
    return title


def page_failures(spark, sf_dir):
    """Pages that cannot be read become review rows; the others of their site have their text."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("site:"), (F.col("page_id") % 7).cast("string")).alias("doc_id"), F.col("page_id").alias("page_no"), "html")
    read = P.read_pages(p, _read_title)
    failed = P.failed_pages(read).select("doc_id", "element_id", F.substring_index("reason", ":", 1).alias("reason"))
    return failed.unionByName(read.where("error is null").select("doc_id", F.format_string("page-%d", "page_no").alias("element_id"), F.col("text").alias("reason")))


def page_profile_route(spark, sf_dir):
    return _profiles(spark, sf_dir).select("page_no", "has_text_layer", "text_coverage", "aspect_anomaly", "is_scanned", "quality", "tier")


def tier_histogram(spark, sf_dir):
    return P.tier_histogram(_profiles(spark, sf_dir)).select("doc_id", F.explode("tier_counts").alias("tier", "n"))


def review_rows(spark, sf_dir):
    return P.review_rows(_profiles(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


def entity_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("see "), F.col("c_name"), F.lit("!")).alias("raw"))
    return c.select("id", T.resolve_entity(F.col("raw"), PACK.entity_patterns["account"]).alias("entity_id"))


def seam_resolution(spark, sf_dir):
    """Seam names made from keys, under the default pattern."""
    from ..config import GEOLOGY

    k = F.col("p_partkey")
    numeral, letter, place = F.element_at(F.array(*map(F.lit, ("i", "II", "iv", "7", "XL"))), (k % 5 + 1).cast("int")), F.when(k % 3 == 0, "a").otherwise(""), F.element_at(F.array(*map(F.lit, ("", " top", "  Middle", " x"))), (k % 4 + 1).cast("int"))
    raw = F.concat(F.lit("Seam no. "), numeral, letter, place)
    return table(spark, sf_dir, "part").select("p_partkey", T.resolve_entity(raw, GEOLOGY.entity_patterns["seam"]).alias("entity_id"))


def footnotes_and_decimals(spark, sf_dir):
    """Texts with and without marks, some of them no numbers."""
    k, v = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.element_at(F.array(v, F.concat(v, F.lit("*")), F.concat(v, F.lit(" (a)")), F.concat(F.lit("1,"), v), F.concat(v, F.lit(".50 **")), F.lit("n/a")), (k % 6 + 1).cast("int"))
    plain = T.strip_footnote(raw)
    return table(spark, sf_dir, "part").select("p_partkey", T.footnote(raw).alias("mark"), plain.alias("plain"), T.is_numeric(plain).alias("is_number"), F.floor(T.to_decimal(plain) * 100).cast("long").alias("hundredths"))


def unit_from_header(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("Thickness (m)", "Ash %", "Grade", "GCV (kcal/kg) max"))), (k % 4 + 1).cast("int"))
    unit, source = T.unit_of(F.array(F.lit("Group"), head), F.when(k % 3 == 0, "each"), k % 5 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), source.alias("unit_source"))


def manifest_plan(spark, sf_dir):
    """Documents are wanted; labelled ones are read already, sources 0 to 9 are registered."""
    d = table(spark, sf_dir, "documents")
    manifest = d.select("doc_id", F.lit("t").alias("title"), F.when(F.col("doc_id") % 4 == 0, F.lit("http://x")).alias("source_url"))
    registry = d.where(F.length("source") == 4).select("doc_id")
    return plan_manifest(manifest, registry, table(spark, sf_dir, "labels").select("doc_id")).groupBy("bucket").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (header_detect, header_chain, table_continuation, table_classify, column_match, unpivot_candidates, dense_rows, table_confidences, chunk_parent_child, page_profile_route, page_failures, tier_histogram, review_rows, entity_resolution, seam_resolution, footnotes_and_decimals, unit_from_header, manifest_plan)}

PROFILE_SQL = """
p AS (SELECT doc_id AS page_id, coalesce(source, 'none') AS doc_id, coalesce(text, '') AS text, doc_id % 3 AS images, (100.0 + doc_id % 400) / 200.0 AS ratio FROM documents),
q AS (SELECT *, length(trim(text)) > 20 AS has_text_layer, ratio > 2.0 OR ratio < 0.35 AS aspect_anomaly FROM p),
v AS (SELECT *, NOT has_text_layer AND images > 0 AS is_scanned FROM q),
z AS (SELECT *, CASE WHEN has_text_layer THEN 1.0 WHEN is_scanned THEN 0.2 ELSE 0.5 END AS quality, CASE WHEN NOT aspect_anomaly AND has_text_layer THEN 1 END AS tier FROM v)
"""
ORACLES = {
    "header_detect": f"WITH {ROWS_SQL} SELECT doc_id, element_id, 2 AS header_rows FROM t",
    "header_chain": f"WITH {ROWS_SQL} SELECT doc_id, element_id, col, chain FROM t, (VALUES (0, 'Name'), (1, 'Account > Balance (USD)'), (2, 'Account > Share max')) h(col, chain)",
    "table_continuation": f"WITH {ROWS_SQL} SELECT doc_id, min(element_id) AS element_id, min(page_no) AS page_no, max(page_no) AS last_page, CAST(sum(n) + 2 AS INT) AS num_rows, CAST(sum(n) + 2 AS BIGINT) AS distinct_rows, CAST(sum(n) + 1 AS INT) AS last_row FROM t GROUP BY doc_id",
    "table_classify": f"WITH {ROWS_SQL} SELECT doc_id, element_id, CASE WHEN page_no = 1 THEN 'Balances of accounts' ELSE 'Introduction' END AS caption, 'balance_table' AS table_type, CASE WHEN page_no = 1 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS type_confidence FROM t",
    "column_match": f"WITH {ROWS_SQL} SELECT doc_id, element_id, col, role, metric_key FROM t, (VALUES (0, 'entity', NULL), (1, 'metric', 'balance'), (2, 'metric', 'share')) h(col, role, metric_key)",
    "unpivot_candidates": f"""WITH {ROWS_SQL}, x AS (SELECT *, regexp_extract(c_name, 'Customer#(\\d+)', 1) AS num FROM r)
        SELECT 'cand_' || substr(sha256(doc_id || '-' || element_id || '-' || row || '-' || col), 1, 10) AS candidate_id, 'account:' || num AS entity_id, m AS metric_key, raw AS value_raw, TRY_CAST(raw AS BIGINT) AS value, unit, unit_source, kind AS value_kind, page_no
        FROM (SELECT *, 1 AS col, 'balance' AS m, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS raw, 'USD' AS unit, 'column_header' AS unit_source, 'point' AS kind FROM x
              UNION ALL SELECT *, 2, 'share', (c_custkey % 100) || '%', 'pct', 'rulebook_default', 'point' FROM x)""",
    "dense_rows": f"""WITH {ROWS_SQL} SELECT doc_id, element_id, CAST(row AS INT) AS row, c_name || '|' || CAST(floor(c_acctbal) AS BIGINT) || CASE WHEN c_custkey % 5 = 0 THEN '*' ELSE '' END || '|' || (c_custkey % 100) || '%' AS line FROM r
        UNION ALL SELECT doc_id, element_id, h.row, h.line FROM t, (VALUES (0, 'Name|Account|'), (1, 'Name|Balance (USD)|Share max')) h(row, line)""",
    "table_confidences": f"WITH {ROWS_SQL} SELECT doc_id, count(*) AS n, 1.0::DOUBLE AS grid, 0.9::DOUBLE AS confidence FROM t GROUP BY 1",
    "chunk_parent_child": f"""WITH {ROWS_SQL}, pre AS (SELECT *, 'Document: T. Publisher: P. Table on page ' || page_no || ', columns: Name Account Name Balance (USD) Share max.' AS prefix FROM t)
        SELECT doc_id || ':table:' || element_id AS chunk_id, NULL AS parent_id, 0 AS level, prefix || ' Name Account Name Balance (USD) Share max' AS indexed_text FROM pre
        UNION ALL SELECT doc_id || ':row:' || element_id || ':' || row, doc_id || ':table:' || element_id, 1, prefix || ' ' || c_name || ' ' || CAST(floor(c_acctbal) AS BIGINT) || CASE WHEN c_custkey % 5 = 0 THEN '*' ELSE '' END || ' ' || (c_custkey % 100) || '%' FROM r JOIN pre USING (doc_id, element_id)
        UNION ALL SELECT doc_id || ':text:p' || page_no || '-text-' || pos, NULL, 0, 'Document: T. Publisher: P. Page ' || page_no || '. ' || txt FROM t, (VALUES (0, 'Introduction'), (1, 'Balances of accounts')) x(pos, txt) WHERE page_no = 1 OR pos = 0""",
    "page_profile_route": f"WITH {PROFILE_SQL} SELECT page_id AS page_no, has_text_layer, CAST((least(2000, length(trim(text))) + 1) // 2 AS DOUBLE) / 1000 AS text_coverage, aspect_anomaly, is_scanned, quality::DOUBLE AS quality, tier FROM z",
    "page_failures": """WITH t AS (SELECT page_id, 'site:' || (page_id % 7) AS doc_id, split_part(split_part(html, '<title>', 2), '</title>', 1) AS title FROM pages)
        SELECT doc_id, CASE WHEN strlen(title) = length(title) THEN 'page-' || page_id ELSE 'page-' || page_id || '-failed' END AS element_id, CASE WHEN strlen(title) = length(title) THEN title ELSE 'UnicodeEncodeError' END AS reason FROM t""",
    "tier_histogram": f"WITH {PROFILE_SQL} SELECT doc_id, coalesce(CAST(tier AS VARCHAR), 'none') AS tier, count(*) AS n FROM z GROUP BY ALL",
    "review_rows": f"WITH {PROFILE_SQL} SELECT doc_id, count(*) AS n FROM z WHERE tier IS NULL GROUP BY 1",
    "entity_resolution": "SELECT c_custkey AS id, 'account:' || regexp_extract(c_name, 'Customer#(\\d+)', 1) AS entity_id FROM customer",
    "seam_resolution": """WITH x AS (SELECT p_partkey, ['I', 'II', 'IV', NULL, 'XL'][p_partkey % 5 + 1] AS numeral, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE '' END AS letter, ['', ' top', ' Middle', ''][p_partkey % 4 + 1] AS place FROM part)
        SELECT p_partkey, CASE WHEN numeral IS NOT NULL THEN numeral || letter || place WHEN p_partkey % 4 = 3 THEN 'X' END AS entity_id FROM x""",
    "footnotes_and_decimals": """SELECT p_partkey, [NULL, '*', '(a)', NULL, '**', NULL][p_partkey % 6 + 1] AS mark, [v, v, v, '1,' || v, v || '.50', 'n/a'][p_partkey % 6 + 1] AS plain,
        p_partkey % 6 IN (0, 1, 2, 4) AS is_number, [p_size * 100, p_size * 100, p_size * 100, NULL, p_size * 100 + 50, NULL][p_partkey % 6 + 1]::BIGINT AS hundredths FROM (SELECT *, CAST(p_size AS VARCHAR) AS v FROM part)""",
    "unit_from_header": """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN ['m', '%', NULL, 'kcal/kg'][p_partkey % 4 + 1] END AS h, CASE WHEN p_partkey % 3 = 0 THEN 'each' END AS e FROM part)
        SELECT p_partkey, coalesce(h, e) AS unit, CASE WHEN h IS NOT NULL THEN 'column_header' WHEN e IS NOT NULL THEN 'rulebook_default' END AS unit_source FROM x""",
    "manifest_plan": """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN doc_id % 4 <> 0 AND length(source) <> 4 THEN 'no_source' ELSE 'ready' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
}
