"""Every tool of the guarded query layer over whole tables, and the audit of a log of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.broker import PUBLIC, TOOLS, Broker, Principal, audit_calls, office
from .base import table
from .evidence_queries import CURRENT_SQL, DOCS_SQL, LINEAGE_SQL, PHRASE, _bm25_sql, _documents, _lineage, _registry
from .ledger_queries import book

READER = Principal("reader", ("public", "restricted"))


def _guarded(spark, sf_dir, who=PUBLIC):
    """Facts rest on seven documents, of which every third is restricted."""
    registry = spark.createDataFrame([(f"doc:{i}", "restricted" if i % 3 == 0 else "public") for i in range(7)], "doc_id string, classification string")
    return Broker(spark, who, {"fact": book(spark, sf_dir), "source_registry": registry, "chunk": _documents(spark, sf_dir)})


SEEN_SQL = "CAST(doc_id[5:] AS INT) % 3 <> 0"


def broker_get_fact(spark, sf_dir):
    return _guarded(spark, sf_dir).get_fact("click").select("fact_id", "entity_id", "metric_key", "value_text", "period")


def broker_compute_metric(spark, sf_dir):
    """An office that sees two documents only."""
    found = _guarded(spark, sf_dir, office(["doc:1", "doc:3"])).compute_metric("error")
    return found.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def broker_check_coverage(spark, sf_dir):
    b = _guarded(spark, sf_dir)
    return b.check_coverage("click").unionByName(b.check_coverage("never")).unionByName(b.check_coverage("error", "user:7")).select("metric_key", "entity_id", "covered", "fact_count", "reason")


def broker_search(spark, sf_dir):
    """The best passages that anyone may see, and the edges that finding them left; every second document has a candidate."""
    b = _guarded(spark, sf_dir)
    key = F.substring("doc_id", 2, 20).cast("long")
    b.tables["chunk"] = b.tables["chunk"].withColumn("candidate_id", F.when(key % 2 == 0, F.concat(F.lit("c"), key.cast("string"))))
    hits = b.search_evidence(PHRASE, 10).select("chunk_id", F.round("score", 6).alias("score"))
    edges = b.tables["lineage_edge"].where("activity = 'retrieved'").select(F.col("from_id").alias("chunk_id"), F.col("to_id").alias("candidate_id"))
    return hits.join(edges, "chunk_id", "left")


def _numbered(spark, sf_dir):
    """Edges whose order is told by a hash of what they lead to, alike in both engines."""
    digits = F.substring(F.sha2(F.concat_ws("|", "to_kind", "to_id"), 256), 1, 12)
    return _lineage(spark, sf_dir).withColumn("id", F.conv(digits, 16, 10).cast("long"))


def broker_provenance(spark, sf_dir):
    """The first-edge trace of the answer with the least id."""
    edges = _numbered(spark, sf_dir)
    start = edges.where("from_kind = 'answer'").agg(F.min("from_id")).first()[0]
    b = Broker(spark, PUBLIC, {"lineage_edge": edges})
    return b.get_provenance("answer", start).select("depth", "kind", "id")


def broker_revision_impact(spark, sf_dir):
    """What rests on the fact with the least id if its value went up by five."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.floor("l_quantity")).alias("q"))
    facts = l.select(F.concat_ws("/", "l_partkey", "l_suppkey").alias("fact_id"), F.col("q").cast("decimal(38,18)").alias("value"), F.lit(None).cast("timestamp").alias("system_to"), F.struct(F.lit("d").alias("doc_id")).alias("source"))
    first = facts.orderBy("fact_id").first()
    b = Broker(spark, PUBLIC, {"lineage_edge": _numbered(spark, sf_dir), "fact": facts})
    return b.revision_impact(first.fact_id, str(first.value + 5)).select("fact_id", F.col("delta").cast("double").alias("delta"), "verdict", "n_affected")


def broker_review_queue(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    queue = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_no"), F.col("lang").alias("reason"))
    b = Broker(spark, PUBLIC, {"review_queue": queue, "source_registry": _registry(spark, sf_dir)})
    return b.list_review_queue().groupBy("reason").agg(F.count("*").alias("n"))


def broker_tables(spark, sf_dir):
    """Line items as candidates in three tables of their supplier's document."""
    l = table(spark, sf_dir, "lineitem")
    source = F.struct(F.concat(F.lit("t"), (F.col("l_orderkey") % 3).cast("string")).alias("table_ref"), F.format_string("r%dc%d", F.col("l_orderkey") % 50, "l_linenumber").alias("cell_ref"))
    c = l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("doc_id"), source.alias("source"), F.lit("lines").alias("domain_type"))
    return Broker(spark, PUBLIC, {"candidate_fact": c}).list_geological_tables("s7").select("doc_id", "element_id", "n_rows")


def broker_conformance(spark, sf_dir):
    """The latest run of the customer with the least number, of those that have orders."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"), F.format_string("%012d", "o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    least = o.agg(F.min("o_custkey")).first()[0]
    return Broker(spark, PUBLIC, {"assay_run": runs}).get_conformance_report(f"c{least}").select("doc_id", "run_id", "status")


def broker_answer_trace(spark, sf_dir):
    """A recorded answer leads to its package, its facts and its passages: for who sealed it, and for anyone."""
    high = _guarded(spark, sf_dir, READER)
    high.record_answer("a1", high.seal_evidence_package("clicks", PHRASE, ["click"]))
    low = Broker(spark, PUBLIC, high.tables)
    told = lambda b, who: b.get_trace_graph("answer", "a1").groupBy("kind").agg(F.count("*").alias("n")).withColumn("caller", F.lit(who))
    return told(high, "reader").unionByName(told(low, "anyone"))


ASKED = (*TOOLS, "drop_tables", "export_all")


def audit_counts(spark, sf_dir):
    """Events as a log of calls: each user may call all tools, two of them, or one; some names are no tools."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), F.element_at(F.array(*map(F.lit, ASKED)), (F.col("event_id") % len(ASKED) + 1).cast("int")).alias("tool"))
    kind = F.col("user_id") % 4
    scopes = F.when(kind == 0, F.array(*map(F.lit, TOOLS))).when(kind == 1, F.array(F.lit("get_fact"), F.lit("compute_metric"))).when(kind == 2, F.array(F.lit("replay")))
    principals = e.where(kind != 3).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), scopes.alias("scopes")).distinct()
    return audit_calls(calls, principals).groupBy("tool", "allowed", "reason").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"))


QUERIES = {
    f.__name__: f
    for f in (broker_get_fact, broker_compute_metric, broker_check_coverage, broker_search, broker_provenance, broker_revision_impact, broker_review_queue, broker_tables, broker_conformance, broker_answer_trace, audit_counts)
}

_FIRST = "(SELECT min(fi) FROM le WHERE fk = 'answer')"
_TOP = f"top AS (SELECT chunk_id, score FROM sc WHERE classification = 'public' ORDER BY score DESC, chunk_id LIMIT 10)"
ORACLES = {
    "broker_get_fact": f"WITH {CURRENT_SQL} SELECT fact_id, entity_id, metric_key, CAST(value AS VARCHAR) AS value_text, period FROM cur WHERE metric_key = 'click' AND {SEEN_SQL}",
    "broker_compute_metric": f"WITH {CURRENT_SQL} SELECT entity_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM cur WHERE metric_key = 'error' AND doc_id IN ('doc:1', 'doc:3') GROUP BY 1",
    "broker_check_coverage": f"""WITH {CURRENT_SQL}, v AS (SELECT * FROM cur WHERE {SEEN_SQL}), n AS (SELECT 'click' AS metric_key, NULL AS entity_id, (SELECT count(*) FROM v WHERE metric_key = 'click') AS c UNION ALL SELECT 'never', NULL, 0
        UNION ALL SELECT 'error', 'user:7', (SELECT count(*) FROM v WHERE metric_key = 'error' AND entity_id = 'user:7')) SELECT metric_key, entity_id, c > 0 AS covered, c AS fact_count, CASE WHEN c = 0 THEN 'NOT_DIGITISED' END AS reason FROM n""",
    "broker_search": f"WITH {DOCS_SQL}, {_bm25_sql('docs', repr(PHRASE.split()))}, {_TOP} SELECT chunk_id, round(score, 6) AS score, CASE WHEN CAST(chunk_id[2:] AS INT) % 2 = 0 THEN 'c' || chunk_id[2:] END AS candidate_id FROM top",
    "broker_provenance": f"""WITH {LINEAGE_SQL}, b AS MATERIALIZED (SELECT fk, fi, tk, ti, CAST('0x' || substr(sha256(tk || '|' || ti), 1, 12) AS BIGINT) AS o FROM le),
        s1 AS (SELECT arg_min(ti, o) AS ti FROM b WHERE fk = 'answer' AND fi = {_FIRST}), s2 AS (SELECT arg_min(ti, o) AS ti FROM b WHERE fk = 'package' AND fi = (SELECT ti FROM s1)), s3 AS (SELECT arg_min(ti, o) AS ti FROM b WHERE fk = 'fact' AND fi = (SELECT ti FROM s2))
        SELECT 0 AS depth, 'answer' AS kind, {_FIRST} AS id UNION ALL SELECT 1, 'package', ti FROM s1 UNION ALL SELECT 2, 'fact', ti FROM s2 WHERE ti IS NOT NULL UNION ALL SELECT 3, 'candidate', ti FROM s3 WHERE ti IS NOT NULL""",
    "broker_revision_impact": f"""WITH {LINEAGE_SQL}, f AS (SELECT min(l_partkey || '/' || l_suppkey) AS id FROM lineitem), p AS (SELECT DISTINCT fi FROM le, f WHERE tk = 'fact' AND ti = f.id), a AS (SELECT DISTINCT le.fi FROM le JOIN p ON tk = 'package' AND ti = p.fi)
        SELECT id AS fact_id, 5.0::DOUBLE AS delta, 'material' AS verdict, (SELECT count(*) FROM p) + (SELECT count(*) FROM a) AS n_affected FROM f""",
    "broker_review_queue": "SELECT lang AS reason, count(*) AS n FROM documents WHERE doc_id % 10 = 9 OR doc_id % 3 <> 0 GROUP BY 1",
    "broker_tables": "SELECT 's7' AS doc_id, 't' || (l_orderkey % 3) AS element_id, count(DISTINCT l_orderkey % 50) AS n_rows FROM lineitem WHERE l_suppkey = 7 GROUP BY 2",
    "broker_conformance": "SELECT 'c' || o_custkey AS doc_id, printf('%012d', o_orderkey) AS run_id, o_orderstatus AS status FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, 2 LIMIT 1",
    "broker_answer_trace": f"""WITH {CURRENT_SQL}, {DOCS_SQL}, {_bm25_sql('docs', repr(PHRASE.split()))}, top AS (SELECT chunk_id FROM sc WHERE classification IN ('public', 'restricted') ORDER BY score DESC, chunk_id LIMIT 5)
        SELECT 'answer' AS kind, 1 AS n, c AS caller FROM (VALUES ('reader'), ('anyone')) x(c) UNION ALL SELECT 'package', 1, 'reader' UNION ALL SELECT 'fact', count(*), 'reader' FROM cur WHERE metric_key = 'click' UNION ALL SELECT 'passage', count(*), 'reader' FROM top""",
    "audit_counts": f"""WITH c AS (SELECT user_id, [{', '.join(repr(t) for t in ASKED)}][event_id % {len(ASKED)} + 1] AS tool FROM events),
        a AS (SELECT *, NOT tool IN ('drop_tables', 'export_all') AND (user_id % 4 = 0 OR (user_id % 4 = 1 AND tool IN ('get_fact', 'compute_metric')) OR (user_id % 4 = 2 AND tool = 'replay')) AS allowed FROM c)
        SELECT tool, allowed, CASE WHEN allowed THEN NULL WHEN tool IN ('drop_tables', 'export_all') THEN 'unknown tool' WHEN user_id % 4 = 3 THEN 'unknown caller' ELSE 'not in scope' END AS reason, count(*) AS n, count(DISTINCT user_id) AS n_subjects FROM a GROUP BY 1, 2, 3""",
}
