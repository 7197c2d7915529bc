"""Ledger, coverage, statements: facts are daily figures in events (user, event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from .base import as_micros, table

#: Values are whole hundredths, so both engines compare the same numbers.
EVENTS_SQL = """
e AS (SELECT 'user:' || user_id AS entity_id, event_type AS metric_key, strftime(ts, '%Y-%m') AS period,
             CAST(floor(value * 100) AS BIGINT) AS value, ts, event_id FROM events WHERE value IS NOT NULL),
i AS (SELECT *, substr(sha256(entity_id || '|' || metric_key || '|' || '{}' || '|' || period || '|' || 'point'), 1, 16) AS fact_identity FROM e),
c AS (SELECT *, lag(value) OVER w IS NOT DISTINCT FROM value AND lag(value) OVER w IS NOT NULL AS same FROM i WINDOW w AS (PARTITION BY fact_identity ORDER BY ts, event_id)),
led AS (SELECT fact_identity, entity_id, metric_key, period, value, ts AS system_from,
               lead(ts) OVER w AS system_to, lag(value) OVER w AS old_value, row_number() OVER w AS version
        FROM c WHERE NOT same WINDOW w AS (PARTITION BY fact_identity ORDER BY ts, event_id))
"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.format_string("%019d", "event_id").alias("candidate_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("metric_key"),
        F.create_map().cast("map<string,string>").alias("qualifiers"), F.date_format(at, "yyyy-MM").alias("period"), F.lit("point").alias("value_kind"),
        F.floor(F.col("value") * 100).cast("decimal(38,18)").alias("value"), F.floor(F.col("value") * 100).cast("string").alias("value_text"), F.lit(None).cast("string").alias("unit"),
        F.struct(F.concat(F.lit("doc:"), (F.col("event_id") % 7).cast("string")).alias("doc_id")).alias("source"), at.alias("observed_at"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.publish(observed(spark, sf_dir))


def _number(name: str = "value"):
    return F.col(name).cast("long").alias(name)


def ledger_scd2(spark, sf_dir):
    return book(spark, sf_dir).select("fact_identity", "entity_id", "metric_key", "period", _number(), as_micros("system_from"), as_micros("system_to"), "version", F.col("supersedes").isNotNull().alias("has_previous"))


def ledger_current(spark, sf_dir):
    return L.current_facts(book(spark, sf_dir)).select("fact_identity", "entity_id", "metric_key", "period", _number())


def ledger_as_of(spark, sf_dir):
    return L.as_of(book(spark, sf_dir), "2024-01-15 00:00:00").select("fact_identity", "entity_id", "metric_key", "period", _number())


def month_ends(spark, sf_dir):
    months = table(spark, sf_dir, "events").select(F.trunc(F.col("ts").cast("timestamp"), "MM").alias("m")).distinct()
    return months.select(F.add_months("m", 1).cast("timestamp").alias("at"))


def ledger_as_of_grid(spark, sf_dir):
    each = L.as_of_each(book(spark, sf_dir).select("metric_key", "value", "system_from", "system_to"), month_ends(spark, sf_dir))
    return each.groupBy(F.date_format("at", "yyyy-MM-dd").alias("at_day"), "metric_key").agg(F.count("*").alias("n_facts"), F.sum(F.col("value").cast("long")).alias("total"))


def ledger_history(spark, sf_dir):
    b = book(spark, sf_dir)
    longest = b.groupBy("fact_identity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fact_identity").limit(1).select("fact_identity")
    return b.join(F.broadcast(longest), "fact_identity", "left_semi").select("fact_identity", "version", _number(), as_micros("system_from"))


def metric_lookup(spark, sf_dir):
    return L.compute_metric(book(spark, sf_dir), "click", "user:7").select("entity_id", "period", _number())


def _candidates(spark, sf_dir):
    failed = F.when(F.col("event_id") % 3 == 0, "G2").when(F.col("event_id") % 3 == 1, "G5")
    o = table(spark, sf_dir, "events")
    return o.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"), F.concat(F.lit("raw_"), "event_type").alias("metric_key"),
        F.when(F.col("event_id") % 3 == 2, "published").otherwise("soft_rejected").alias("state"), failed.alias("failed_gate"), F.when(failed.isNotNull(), F.concat(F.lit("reason "), failed)).alias("failure_reason"),
    )


def coverage_reason(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id")).distinct()
    users = users.unionByName(spark.createDataFrame([("user:none",)], "entity_id string"))
    wanted = users.withColumn("metric_key", F.explode(F.array(F.lit("click"), F.lit("raw_click"), F.lit("never"))))
    return L.coverage(wanted, _candidates(spark, sf_dir), book(spark, sf_dir)).select("metric_key", "entity_id", "covered", "fact_count", "reason")


COVERAGE_SQL = f"""
WITH {EVENTS_SQL},
cand AS (SELECT 'user:' || user_id AS entity_id, 'raw_' || event_type AS metric_key, CASE event_id % 3 WHEN 0 THEN 'G2' WHEN 1 THEN 'G5' END AS gate FROM events),
wanted AS (SELECT u.entity_id, m.metric_key FROM (SELECT DISTINCT 'user:' || user_id AS entity_id FROM events UNION ALL SELECT 'user:none') u,
           (VALUES ('click'), ('raw_click'), ('never')) m(metric_key)),
n AS (SELECT entity_id, metric_key, count(*) AS fact_count FROM led WHERE system_to IS NULL GROUP BY ALL),
h AS (SELECT entity_id, metric_key, count(*) AS held, count(gate) AS open FROM cand GROUP BY ALL),
t AS (SELECT entity_id, metric_key, gate || ' — reason ' || gate AS why, row_number() OVER (PARTITION BY entity_id, metric_key ORDER BY count(*) DESC, gate) AS r
      FROM cand WHERE gate IS NOT NULL GROUP BY entity_id, metric_key, gate)
SELECT w.metric_key, w.entity_id, coalesce(n.fact_count, 0) > 0 AS covered, coalesce(n.fact_count, 0) AS fact_count,
       CASE WHEN n.fact_count > 0 THEN NULL
            WHEN w.metric_key NOT IN (SELECT metric_key FROM cand) THEN 'NOT_DIGITISED'
            WHEN h.held IS NULL THEN 'NO_SOURCE' WHEN h.open = 0 THEN 'NOT_VALIDATED' ELSE 'NOT_VALIDATED: ' || t.why END AS reason
FROM wanted w LEFT JOIN n USING (entity_id, metric_key) LEFT JOIN h USING (entity_id, metric_key) LEFT JOIN t ON t.entity_id = w.entity_id AND t.metric_key = w.metric_key AND t.r = 1
"""


def _claims(spark, sf_dir):
    """Statements: each supplier says a quantity band of a part, by ship year."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.concat(F.lit("doc:"), F.col("l_suppkey").cast("string")).alias("doc_id"), F.lit("quantity").alias("metric_key"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity_id"),
        F.year("l_shipdate").cast("string").alias("period"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("qualifiers"), F.lit("point").alias("value_kind"), F.lit("each").alias("unit"),
        F.floor("l_quantity").cast("decimal(38,18)").alias("value"), F.floor("l_quantity").cast("string").alias("value_text"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"),
    )


def contradictions(spark, sf_dir):
    return L.contradictions(_claims(spark, sf_dir)).select("entity_id", "period", F.get_json_object("qualifier_key", "$.flag").alias("flag"), "n_docs", "n_values", "n_members")


def statements_per_document(spark, sf_dir):
    return L.statements(book(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


QUERIES = {f.__name__: f for f in (ledger_scd2, ledger_current, ledger_as_of, ledger_as_of_grid, ledger_history, metric_lookup, coverage_reason, contradictions, statements_per_document)}

ORACLES = {
    "ledger_scd2": f"WITH {EVENTS_SQL} SELECT fact_identity, entity_id, metric_key, period, value, epoch_us(system_from) AS system_from, epoch_us(system_to) AS system_to, version, old_value IS NOT NULL AS has_previous FROM led",
    "ledger_current": f"WITH {EVENTS_SQL} SELECT fact_identity, entity_id, metric_key, period, value FROM led WHERE system_to IS NULL",
    "ledger_as_of": f"WITH {EVENTS_SQL} SELECT fact_identity, entity_id, metric_key, period, value FROM led WHERE system_from <= TIMESTAMP '2024-01-15' AND (system_to IS NULL OR system_to > TIMESTAMP '2024-01-15')",
    "ledger_as_of_grid": f"WITH {EVENTS_SQL}, t AS (SELECT DISTINCT date_trunc('month', ts) + INTERVAL 1 MONTH AS asked FROM events) SELECT strftime(asked, '%Y-%m-%d') AS at_day, metric_key, count(*) AS n_facts, CAST(sum(value) AS BIGINT) AS total FROM led JOIN t ON system_from <= asked AND (system_to IS NULL OR system_to > asked) GROUP BY ALL",
    "ledger_history": f"WITH {EVENTS_SQL} SELECT fact_identity, version, value, epoch_us(system_from) AS system_from FROM led WHERE fact_identity = (SELECT fact_identity FROM led GROUP BY 1 ORDER BY count(*) DESC, fact_identity LIMIT 1)",
    "metric_lookup": f"WITH {EVENTS_SQL} SELECT entity_id, period, value FROM led WHERE system_to IS NULL AND metric_key = 'click' AND entity_id = 'user:7'",
    "coverage_reason": COVERAGE_SQL,
    "contradictions": """SELECT 'part:' || l_partkey AS entity_id, CAST(year(l_shipdate) AS VARCHAR) AS period, l_returnflag AS flag, count(DISTINCT l_suppkey) AS n_docs, count(DISTINCT floor(l_quantity)) AS n_values, count(*) AS n_members
        FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_suppkey) > 1 AND count(DISTINCT floor(l_quantity)) > 1""",
    "statements_per_document": f"WITH {EVENTS_SQL}, f AS (SELECT led.*, 'doc:' || (e.event_id % 7) AS doc_id FROM led JOIN events e ON e.ts = led.system_from AND 'user:' || e.user_id = led.entity_id AND e.event_type = led.metric_key WHERE system_to IS NULL) SELECT doc_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM f GROUP BY 1",
}
