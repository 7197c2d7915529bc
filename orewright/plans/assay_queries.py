"""Rules and gates: line items are candidate facts. A row has no key of its own, so queries count or use all columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EntityPattern, Pack, Rule
from ..operators import assay as A
from ..shared import cut
from .base import table

RULES = [
    Rule("quantity_range", "range", "block", "{metric_key} {value} not in {min}..{max} {unit}", applies_to=("quantity",), min=2, max=48, unit="each"),
    Rule("tax_le_discount", "pair", "block", "tax {a_value} over discount {b_value}", metric_a="tax", metric_b="discount", relation="le", match_on=("entity_id", "qualifiers.flag")),
    Rule("price_high", "pair", "warn", "high", metric_a="quantity", metric_b="discount", relation="gt", match_on=("entity_id", "period")),
]


def candidates(spark, sf_dir):
    """Three facts of each order: least quantity, tax and discount over its lines, in whole numbers."""
    l = table(spark, sf_dir, "lineitem")
    o = l.groupBy("l_orderkey").agg(
        F.min(F.floor("l_quantity")).alias("quantity"), F.min(F.floor(F.col("l_tax") * 100 + 0.5)).alias("tax"), F.min(F.floor(F.col("l_discount") * 100 + 0.5)).alias("discount"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line_status")
    )
    long = o.select("l_orderkey", "flag", "line_status", F.explode(F.array(*[F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("v")) for m in ("quantity", "tax", "discount")])).alias("m"))
    return long.select(
        F.concat_ws(":", "l_orderkey", "m.metric_key").alias("candidate_id"), F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))).alias("entity_id"),
        F.concat_ws("-", F.lit("o"), F.col("l_orderkey").cast("string")).alias("entity_raw"), F.col("m.metric_key").alias("metric_key"), F.col("m.v").cast("decimal(38,18)").alias("value"), F.col("m.v").cast("string").alias("value_text"),
        F.when(F.col("l_orderkey") % 7 != 0, "each").alias("unit"), F.when(F.col("l_orderkey") % 2 == 0, "column_header").otherwise("rulebook_default").alias("unit_source"),
        F.create_map(F.lit("flag"), F.col("flag")).alias("qualifiers"), F.col("line_status").alias("period"), F.lit("final").alias("status"), F.lit(0.95).alias("extraction_confidence"), F.lit(0).alias("reeval_count"),
    )


CAND_SQL = """
o AS (SELECT l_orderkey, min(CAST(floor(l_quantity) AS BIGINT)) AS quantity, min(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS tax, min(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS discount,
             min(l_returnflag) AS flag, min(l_linestatus) AS line_status FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey || ':' || metric_key AS candidate_id, CASE WHEN l_orderkey % 11 <> 0 THEN 'order:' || l_orderkey END AS entity_id, metric_key, v, flag, line_status AS period, l_orderkey,
             CASE WHEN l_orderkey % 7 <> 0 THEN 'each' END AS unit, CASE WHEN l_orderkey % 2 = 0 THEN 'column_header' ELSE 'rulebook_default' END AS unit_source
      FROM (SELECT l_orderkey, flag, line_status, 'quantity' AS metric_key, quantity AS v FROM o UNION ALL SELECT l_orderkey, flag, line_status, 'tax', tax FROM o UNION ALL SELECT l_orderkey, flag, line_status, 'discount', discount FROM o)),
rf AS (SELECT candidate_id, 'block' AS severity, 'quantity_range' AS rule_id FROM x WHERE metric_key = 'quantity' AND (v < 2 OR v > 48)),
pf AS (SELECT a.candidate_id, 'block' AS severity, 'tax_le_discount' AS rule_id FROM x a JOIN x b ON a.entity_id = b.entity_id AND a.flag IS NOT DISTINCT FROM b.flag WHERE a.metric_key = 'tax' AND b.metric_key = 'discount' AND a.v > b.v
       UNION ALL SELECT a.candidate_id, 'block', 'tax_le_discount' FROM (SELECT * FROM x WHERE metric_key = 'tax' AND entity_id IS NULL) a JOIN (SELECT flag, v FROM x WHERE metric_key = 'discount' AND entity_id IS NULL) b ON a.flag IS NOT DISTINCT FROM b.flag AND a.v > b.v
       UNION ALL SELECT a.candidate_id, 'warn', 'price_high' FROM x a JOIN x b ON a.entity_id IS NOT DISTINCT FROM b.entity_id AND a.period IS NOT DISTINCT FROM b.period WHERE a.metric_key = 'quantity' AND b.metric_key = 'discount' AND NOT a.v > b.v),
f AS (SELECT * FROM rf UNION ALL SELECT * FROM pf),
pc AS (SELECT candidate_id, count(*) FILTER (severity = 'block') AS blocks, count(*) FILTER (severity = 'warn') AS warns FROM f GROUP BY 1),
g AS (SELECT x.*, coalesce(blocks, 0) AS blocks, coalesce(warns, 0) AS warns,
             least(0.95, CASE WHEN unit IS NULL THEN 0.3 WHEN unit_source = 'column_header' THEN 0.9 ELSE 0.6 END, CASE WHEN entity_id IS NULL THEN 0.5 ELSE 1.0 END) AS confidence
      FROM x LEFT JOIN pc USING (candidate_id)),
v AS (SELECT *, CASE WHEN entity_id IS NULL OR unit IS NULL THEN 'G2' WHEN metric_key = 'discount' THEN 'G3' WHEN blocks > 0 THEN 'G5' WHEN confidence < 0.85 OR warns > 0 THEN 'G7' END AS failed_gate FROM g),
s AS (SELECT *, CASE WHEN failed_gate IS NULL THEN 'auto_passed' WHEN failed_gate = 'G7' THEN 'pending_review' ELSE 'soft_rejected' END AS state FROM v)
"""
METRICS = ["quantity", "tax"]


def judged(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return A.run_gates(c, A.findings(c, RULES), METRICS)


def rule_range(spark, sf_dir):
    return A.range_findings(candidates(spark, sf_dir), RULES).select("candidate_id", "rule_id", "severity")


def rule_pair_nullsafe(spark, sf_dir):
    return A.pair_findings(candidates(spark, sf_dir), RULES).select("candidate_id", "rule_id", "severity", "n")


def rule_messages(spark, sf_dir):
    return A.range_findings(candidates(spark, sf_dir), RULES).select("candidate_id", "message")


def gates_verdict(spark, sf_dir):
    return judged(spark, sf_dir).select("candidate_id", "state", "failed_gate", F.col("confidence").cast("double").alias("confidence"), F.size("gate_results").cast("long").alias("n_gates"))


def state_histogram(spark, sf_dir):
    return A.state_counts(judged(spark, sf_dir))


def gate_histogram(spark, sf_dir):
    return A.failure_counts(judged(spark, sf_dir))


def review_queue_topk(spark, sf_dir):
    return A.review_queue(judged(spark, sf_dir)).select("candidate_id", F.col("confidence").cast("double").alias("confidence")).limit(20)


WIDER = Pack("orders", 2, (), {"order": EntityPattern(r"\b(o)[\s.\-]+(\d+)\b", "order:{number}", ("letter", "number"))})


def reeval_recovery(spark, sf_dir):
    """Candidates without an entity get one from the wider pattern; how many change state, by old and new state."""
    before = cut(judged(spark, sf_dir))
    after = A.reeval(before, [r for r in RULES if r.type == "range"], METRICS, WIDER)
    return before.select("candidate_id", F.col("state").alias("old_state")).join(after.select("candidate_id", F.col("state").alias("new_state"), "reeval_count"), "candidate_id").groupBy("old_state", "new_state", "reeval_count").agg(F.count("*").alias("n"))


def prune_preserve_decided(spark, sf_dir):
    """A first run over early orders, a second over late ones; what was decided (every tenth) stays."""
    o = table(spark, sf_dir, "orders")
    row = lambda df, state: df.select(F.col("o_orderkey").alias("candidate_id"), state.alias("state"))
    old = row(o.where("o_orderdate < timestamp '1996-01-01'"), F.when(F.col("o_orderkey") % 10 == 0, "published").otherwise("pending_review"))
    new = row(o.where("o_orderdate >= timestamp '1994-01-01'"), F.lit("auto_passed"))
    return A.merge_run(old, new)


def gate_trace(spark, sf_dir):
    return judged(spark, sf_dir).select("candidate_id", F.posexplode("gate_results").alias("step", "g")).groupBy("g.gate", "g.passed").agg(F.count("*").alias("n"))


def assay_run_summary(spark, sf_dir):
    """One row per flag, which stands for a document here: candidates, and a map of states and of failed gates."""
    rows = judged(spark, sf_dir).withColumn("doc_id", F.try_element_at("qualifiers", F.lit("flag")))
    run = A.run_summary(rows, "r1", 1, "2026-01-01 00:00:00")
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return run.select("run_id", "doc_id", "candidate_count", flat("state_counts").alias("states"), flat("failure_counts").alias("failures"))


def decisions_latest(spark, sf_dir):
    """Orders are candidates; their line items are decisions at ship date."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("state"), F.lit(None).cast("string").alias("approver"))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_returnflag").alias("state"), F.lit("p").alias("approver"), F.struct("l_shipdate", "l_returnflag").alias("at"))
    return A.decide(c, d).select("candidate_id", "state", "approver")


QUERIES = {f.__name__: f for f in (rule_range, rule_pair_nullsafe, rule_messages, gates_verdict, state_histogram, gate_histogram, review_queue_topk, reeval_recovery, prune_preserve_decided, gate_trace, decisions_latest, assay_run_summary)}

_RUN = "CASE failed_gate WHEN 'G2' THEN 2 WHEN 'G3' THEN 3 WHEN 'G5' THEN 5 ELSE 7 END"
ORACLES = {
    "rule_range": f"WITH {CAND_SQL} SELECT candidate_id, rule_id, severity FROM rf",
    "rule_pair_nullsafe": f"WITH {CAND_SQL} SELECT candidate_id, rule_id, severity, count(*) AS n FROM pf GROUP BY ALL",
    "rule_messages": "SELECT l_orderkey || ':quantity' AS candidate_id, 'quantity ' || q || ' not in 2..48 each' AS message FROM (SELECT l_orderkey, CAST(min(floor(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1) WHERE q < 2 OR q > 48",
    "gates_verdict": f"WITH {CAND_SQL} SELECT candidate_id, state, failed_gate, CAST(confidence AS DOUBLE) AS confidence, CAST({_RUN} AS BIGINT) AS n_gates FROM s",
    "state_histogram": f"WITH {CAND_SQL} SELECT state, count(*) AS n FROM s GROUP BY 1",
    "gate_histogram": f"WITH {CAND_SQL} SELECT failed_gate, count(*) AS n FROM s WHERE failed_gate IS NOT NULL GROUP BY 1",
    "review_queue_topk": f"WITH {CAND_SQL} SELECT candidate_id, CAST(confidence AS DOUBLE) AS confidence FROM s WHERE state = 'pending_review' ORDER BY confidence, candidate_id LIMIT 20",
    "reeval_recovery": f"""WITH {CAND_SQL},
        r AS (SELECT state AS old_state, 1 AS reeval_count, CASE WHEN unit IS NULL OR metric_key = 'discount' OR candidate_id IN (SELECT candidate_id FROM rf) THEN 'soft_rejected'
                     WHEN unit_source = 'column_header' THEN 'auto_passed' ELSE 'pending_review' END AS new_state FROM s WHERE state = 'soft_rejected')
        SELECT old_state, new_state, reeval_count, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT state, state, 0, count(*) FROM s WHERE state <> 'soft_rejected' GROUP BY state""",
    "prune_preserve_decided": """WITH old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'published' ELSE 'pending_review' END AS state FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
        d AS (SELECT * FROM old WHERE state = 'published') SELECT o_orderkey AS candidate_id, state FROM d UNION ALL SELECT o_orderkey, 'auto_passed' FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM d)""",
    "gate_trace": f"WITH {CAND_SQL}, t AS (SELECT 'G' || k AS gate, NOT (failed_gate IS NOT NULL AND 'G' || k = failed_gate) AS passed, k, {_RUN} AS n_run FROM s, range(1, 8) r(k)) SELECT gate, passed, count(*) AS n FROM t WHERE k <= n_run GROUP BY 1, 2",
    "assay_run_summary": f"""WITH {CAND_SQL}, a AS (SELECT flag, state, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT flag, failed_gate, count(*) AS n FROM s WHERE failed_gate IS NOT NULL GROUP BY 1, 2),
        a1 AS (SELECT flag, CAST(sum(n) AS BIGINT) AS total, string_agg(state || '=' || n, ';' ORDER BY state) AS states FROM a GROUP BY 1), b1 AS (SELECT flag, string_agg(failed_gate || '=' || n, ';' ORDER BY failed_gate) AS failures FROM b GROUP BY 1)
        SELECT 'r1-' || a1.flag AS run_id, a1.flag AS doc_id, total AS candidate_count, states, coalesce(failures, '') AS failures FROM a1 LEFT JOIN b1 USING (flag)""",
    "decisions_latest": "SELECT o_orderkey AS candidate_id, coalesce(arg_max(l_returnflag, (l_shipdate, l_returnflag)), any_value(o_orderstatus)) AS state, CASE WHEN count(l_orderkey) > 0 THEN 'p' END AS approver FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
}
