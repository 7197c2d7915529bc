"""What is kept and brought up to date: claims in two times, the text index, neighbours by hyperplanes, closures, the graph and
the assay after changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assay as A
from ..operators import bitemporal as T
from ..operators import graph as G
from ..operators import lineage as X
from ..operators import search as S
from ..operators.ledger import fact_identity
from ..operators.textindex import TextIndex
from ..shared import cut, dropped, fresh_path, shared_folder, stored
from . import assay_queries
from .base import as_micros, table
from .evidence_queries import GRAPH_SQL, LINEAGE_SQL, ORACLES as EVIDENCE, _answers, _bm25_sql, _count, _documents, _graph_input, _lineage, _tokens
from .ledger_queries import observed

#: How long after it holds a value is recorded: every fifth comes 40 days late, every seventh 3 days.
DELAY = "CASE WHEN event_id % 5 = 0 THEN 40 WHEN event_id % 7 = 0 THEN 3 ELSE 0 END"


def _claims(spark, sf_dir):
    """Values of events hold from the beginning of their day; late ones correct what was known."""
    late = F.col("candidate_id").cast("long")
    days = F.when(late % 5 == 0, 40).when(late % 7 == 0, 3).otherwise(0)
    o = observed(spark, sf_dir).withColumn("fact_identity", fact_identity())
    return o.select(F.col("candidate_id").alias("claim_id"), "fact_identity", "metric_key", F.col("value").cast("long").alias("value"), F.date_trunc("day", "observed_at").alias("valid_from"), (F.col("observed_at") + F.make_dt_interval(days)).alias("recorded_at"))


CLAIMS_SQL = f"""
cl AS (SELECT printf('%019d', event_id) AS claim_id, substr(sha256('user:' || user_id || '|' || event_type || '|' || '{{}}' || '|' || strftime(ts, '%Y-%m') || '|' || 'point'), 1, 16) AS f, event_type AS metric_key,
              CAST(floor(value * 100) AS BIGINT) AS value, date_trunc('day', ts)::TIMESTAMP AS v, ts + to_days(CAST({DELAY} AS INT)) AS s FROM events WHERE value IS NOT NULL)
"""


def bitemporal_tiles(spark, sf_dir):
    tiles = T.rectangles(_claims(spark, sf_dir))
    return tiles.select("fact_identity", "claim_id", "value", *[as_micros(c) for c in ("valid_from", "valid_to", "system_from", "system_to")])


def _days(spark, sf_dir, later: int = 0):
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).distinct()
    return days.select((F.col("d") + F.make_dt_interval(F.lit(1 + later))).alias("at"))


def bitemporal_grid(spark, sf_dir):
    """What was believed at the end of each day, and 40 days later, about the end of each day: numbers and sums by metric."""
    tiles = T.rectangles(_claims(spark, sf_dir), ("value", "metric_key")).select("metric_key", "value", "valid_from", "valid_to", "system_from", "system_to")
    known = T.sweep(tiles, _days(spark, sf_dir).union(_days(spark, sf_dir, 40))).withColumnRenamed("at", "known_at")
    told = T.sweep(known, _days(spark, sf_dir), "valid_from", "valid_to")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return told.groupBy(day("known_at").alias("known_day"), day("at").alias("valid_day"), "metric_key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bitemporal_corrections(spark, sf_dir):
    """How many tiles were closed by later knowledge, and how long they had stood, by metric."""
    closed = T.corrections(T.rectangles(_claims(spark, sf_dir), ("value", "metric_key")))
    return closed.groupBy("metric_key").agg(F.count("*").alias("n_closed"), F.sum("stood").alias("stood"), F.count_if(F.col("valid_to").isNull()).alias("n_open_ended"))


TILES_SQL = f"""
WITH {CLAIMS_SQL}, o AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY f, v, s ORDER BY claim_id DESC) = 1),
r AS (SELECT f, v, min(s) AS s0 FROM o GROUP BY f, v), t AS (SELECT DISTINCT f, s FROM o),
n AS (SELECT r.f, r.v, t.s, min(x.v) AS after FROM r JOIN t ON t.f = r.f AND t.s >= r.s0 LEFT JOIN r x ON x.f = r.f AND x.v > r.v AND x.s0 <= t.s GROUP BY ALL),
c AS (SELECT n.f, n.v, n.s, n.after, arg_max(o.claim_id, (o.s, o.claim_id)) AS claim_id FROM n JOIN o ON o.f = n.f AND o.v = n.v AND o.s <= n.s GROUP BY ALL),
d AS (SELECT * FROM c WINDOW w AS (PARTITION BY f, v ORDER BY s) QUALIFY lag(claim_id) OVER w IS DISTINCT FROM claim_id OR lag(after) OVER w IS DISTINCT FROM after),
tiles AS (SELECT d.*, lead(s) OVER (PARTITION BY f, v ORDER BY s) AS until FROM d)
"""


def _index(spark, sf_dir):
    """All documents, then every third again with other words in front, and every eleventh taken out."""
    docs = _documents(spark, sf_dir)
    key = F.substring("doc_id", 2, 20).cast("long")
    index = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(docs)
    index.put(docs.where(key % 3 == 0).withColumn("indexed_text", F.concat(F.lit("again the that "), F.coalesce("indexed_text", F.lit("")))))
    index.delete(docs.where(key % 11 == 0).select("doc_id"))
    return index


REPLACED_SQL = """docs AS (SELECT 'd' || doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'again the that ' || coalesce(text, '') ELSE text END AS indexed_text,
    ['restricted', 'internal', 'public'][doc_id % 3 + 1] AS classification FROM documents WHERE doc_id % 11 <> 0)"""


def text_index_phrase(spark, sf_dir):
    """A phrase's scores after a replacement and a deletion."""
    return _index(spark, sf_dir).search_many(spark.createDataFrame([("q", "the that")], "query_id string, query string")).select("chunk_id", F.round("score", 6).alias("score"), "classification")


def text_index_questions(spark, sf_dir):
    """The passages of the benchmark as questions to the index: how many chunks hold each, and the best one."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    found = _index(spark, sf_dir).search_many(asked)
    best = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("chunk_id", F.struct(-F.round("score", 9), "chunk_id")).alias("best"))
    return best.select(F.col("query_id").cast("long").alias("item_id"), "n", "best")


def vector_lsh_recall(spark, sf_dir):
    """Five neighbours of every twentieth vector by hyperplanes, against the exact ones: how many questions, and whether nine of
    ten of the exact neighbours are found."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact, near = cut(S.knn(e, q, 5)), S.approximate_knn(e, q, 5)
    found = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_ok"))


def lineage_reach(spark, sf_dir):
    """How much rests on each fact, by sketches of distinct counts handed along the edges."""
    reach = X.reach_counts(_lineage(spark, sf_dir), forward=True, kinds=("fact",))
    return reach.select(F.col("id").alias("fact_id"), F.round("reach").cast("long").alias("n"))


def lineage_upkeep(spark, sf_dir):
    """The closure of a third of the edges, brought up to date by a second and a third batch: as from all edges at once."""
    ends = _lineage(spark, sf_dir).select("from_kind", "from_id", "to_kind", "to_id")
    edges = stored(ends.withColumn("batch", F.pmod(F.crc32(F.concat_ws("|", "from_id", "to_id").cast("binary")), F.lit(3))))
    part = lambda n: edges.where(F.col("batch") == n)
    pairs = X.closure(part(0), _answers(spark, sf_dir))
    pairs = X.extend_closure(pairs, part(0), part(1))
    pairs = X.extend_closure(pairs, edges.where("batch <= 1"), part(2))
    return pairs.groupBy("start_id", "kind", "depth").agg(F.count("*").alias("n"))


def graph_upkeep(spark, sf_dir):
    """A graph put whole; then every third document again without its open lines, and every seventh taken out."""
    registry, c, facts = _graph_input(spark, sf_dir)
    key = F.substring("doc_id", 2, 20).cast("long")
    edges = lambda r, rows: G.build_edges(r, rows, facts, bag=True).select(*G.CountedGraph.LINK, "doc_id")
    nodes = lambda e: e.select(F.explode(F.array("src", "dst")).alias("node_id"), "doc_id").withColumn("label", F.substring_index("node_id", ":", 1))
    store = G.CountedGraph(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    whole = stored(edges(registry, c), path := fresh_path(spark))
    store.put(nodes(whole), whole, registry)
    dropped(spark, path)
    stays = registry.where((key % 7 != 0) & (key % 3 == 0))
    fewer = stored(edges(stays, c.where((key % 7 != 0) & (key % 3 == 0)).where("state = 'auto_passed'")))
    store.put(nodes(fewer), fewer, registry.where((key % 3 == 0) | (key % 7 == 0)))
    told = lambda df, what: df.groupBy(F.col(what).alias("what")).agg(F.count("*").alias("n"), F.sum("n_docs").alias("n_docs"))
    return told(store.nodes(), "label").unionByName(told(store.edges(), "rel"))


def assay_upkeep(spark, sf_dir):
    """A run over older values without every thirteenth order, then what came and changed: as a whole run over all."""
    c = cut(assay_queries.candidates(spark, sf_dir))
    order = F.split("candidate_id", ":")[0].cast("long")
    older = c.where(order % 13 != 0).withColumn("value", F.when(order % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(38,18)"))
    found = cut(A.findings(older, assay_queries.RULES))
    before = cut(A.run_gates(older, found, assay_queries.METRICS))
    after, _ = A.assay_after(before, found, c.where((order % 5 == 0) | (order % 13 == 0)), assay_queries.RULES, assay_queries.METRICS)
    return after.select("candidate_id", "state", "failed_gate", F.col("confidence").cast("double").alias("confidence"), F.size("gate_results").cast("long").alias("n_gates"))


def assay_observed(spark, sf_dir):
    """The totals of a run, out of the pass that writes its verdicts."""
    rows, seen = A.observed_run(assay_queries.judged(spark, sf_dir))
    rows.select("candidate_id", "state", "failed_gate").write.parquet(f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex}")
    return spark.createDataFrame([(k, v) for k, v in seen.get.items() if v], "what string, n long")


QUERIES = {
    f.__name__: f
    for f in (bitemporal_tiles, bitemporal_grid, bitemporal_corrections, text_index_phrase, text_index_questions, vector_lsh_recall, lineage_reach, lineage_upkeep, graph_upkeep, assay_upkeep, assay_observed)
}

ORACLES = {
    "bitemporal_tiles": TILES_SQL + "SELECT f AS fact_identity, tiles.claim_id, value, epoch_us(tiles.v) AS valid_from, epoch_us(after) AS valid_to, epoch_us(tiles.s) AS system_from, epoch_us(until) AS system_to FROM tiles JOIN (SELECT claim_id, value FROM cl) USING (claim_id)",
    "bitemporal_grid": f"""WITH {CLAIMS_SQL}, m AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS ends FROM events), kn AS (SELECT ends FROM m UNION SELECT ends + INTERVAL 40 DAY FROM m),
        b AS (SELECT k.ends AS known, w.ends AS valid, f, any_value(metric_key) AS metric_key, arg_max(value, (v, s, claim_id)) AS value FROM cl, kn k, m w WHERE cl.s <= k.ends AND cl.v <= w.ends GROUP BY 1, 2, 3)
        SELECT strftime(known, '%Y-%m-%d') AS known_day, strftime(valid, '%Y-%m-%d') AS valid_day, metric_key, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM b GROUP BY ALL""",
    "bitemporal_corrections": TILES_SQL + "SELECT metric_key, count(*) AS n_closed, CAST(sum(epoch_us(until) - epoch_us(tiles.s)) AS BIGINT) AS stood, count(*) FILTER (after IS NULL) AS n_open_ended FROM tiles JOIN (SELECT claim_id, metric_key FROM cl) USING (claim_id) WHERE until IS NOT NULL GROUP BY 1",
    "text_index_phrase": f"WITH {REPLACED_SQL}, {_bm25_sql('docs', repr(['the', 'that']))} SELECT chunk_id, round(score, 6) AS score, classification FROM sc",
    "text_index_questions": f"""WITH {REPLACED_SQL}, q AS (SELECT item_id, {_tokens("text")} AS phrase FROM benchmark), k AS (SELECT *, {_tokens('indexed_text')} AS w FROM docs), g AS (SELECT count(*) AS big, avg(len(w)) AS av FROM k),
        m AS (SELECT item_id, chunk_id, len(w) AS n, {_count('w', 'phrase')} AS f FROM k, q WHERE list_has_all(w, phrase)), d AS (SELECT item_id, count(*) AS df FROM m WHERE f > 0 GROUP BY 1),
        s AS (SELECT m.*, df, greatest(ln((big - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)) AS score FROM m JOIN d USING (item_id), g WHERE f > 0)
        SELECT item_id, any_value(df) AS n, arg_min(chunk_id, (-round(score, 9), chunk_id)) AS best FROM s GROUP BY 1""",
    "vector_lsh_recall": "SELECT count(*) FILTER (vec_id % 20 = 0) AS n_queries, count(*) FILTER (vec_id % 20 = 0) * least(5, count(*)) AS n_exact, true AS recall_ok FROM embeddings",
    "lineage_reach": f"""WITH {LINEAGE_SQL}, p AS (SELECT DISTINCT ti AS fact_id, fi AS pack FROM le WHERE fk = 'package'), a AS (SELECT DISTINCT fact_id, fi FROM p JOIN le ON fk = 'answer' AND ti = pack)
        SELECT fact_id, n + coalesce(m, 0) AS n FROM (SELECT fact_id, count(*) AS n FROM p GROUP BY 1) LEFT JOIN (SELECT fact_id, count(*) AS m FROM a GROUP BY 1) USING (fact_id)""",
    "lineage_upkeep": EVIDENCE["lineage_full"],
    "graph_upkeep": f"""WITH {GRAPH_SQL.replace("FROM supplier)", "FROM supplier WHERE s_suppkey % 7 <> 0)").replace("WHERE l_returnflag IN ('A', 'N')", "WHERE l_suppkey % 7 <> 0 AND (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_suppkey % 3 <> 0))")},
        d AS (SELECT DISTINCT src, dst, rel, doc_id FROM ge), n AS (SELECT src AS id, doc_id FROM d UNION SELECT dst, doc_id FROM d)
        SELECT rel AS what, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_docs FROM (SELECT src, dst, rel, count(*) AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1
        UNION ALL SELECT split_part(id, ':', 1), count(*), CAST(sum(c) AS BIGINT) FROM (SELECT id, count(*) AS c FROM n GROUP BY 1) GROUP BY 1""",
    "assay_upkeep": assay_queries.ORACLES["gates_verdict"],
    "assay_observed": f"""WITH {assay_queries.CAND_SQL} SELECT 'candidates' AS what, count(*) AS n FROM s UNION ALL SELECT 'state_' || state, count(*) FROM s GROUP BY state
        UNION ALL SELECT 'failed_' || failed_gate, count(*) FROM s WHERE failed_gate IS NOT NULL GROUP BY failed_gate""",
}
