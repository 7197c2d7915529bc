"""Graph, lineage, search, language and the broker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import language as N
from ..operators import lineage as X
from ..operators import reports as R
from ..operators import search as S
from ..operators.agents import answer_questions
from ..operators.broker import PUBLIC, AccessDenied, Broker, Principal, exportable, office, visible
from ..shared import cut
from .base import table
from .ledger_queries import EVENTS_SQL, book



def _edges(spark, sf_dir):
    """supplier and customer in nation, nation in region; suppliers' edges are of a lower trust."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    node = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    e = lambda df, a, b, rel, trust: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"), F.lit(trust).alias("trust_layer"))
    return (
        e(n, node("nation", "n_nationkey"), node("region", "n_regionkey"), "IN_REGION", "authoritative")
        .unionByName(e(s, node("supplier", "s_suppkey"), node("nation", "s_nationkey"), "IN_NATION", "derived"))
        .unionByName(e(c, node("customer", "c_custkey"), node("nation", "c_nationkey"), "IN_NATION", "validated"))
    )


EDGES_SQL = """
ed AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS rel, 'authoritative' AS trust FROM nation
       UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', 'derived' FROM supplier
       UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION', 'validated' FROM customer),
b AS (SELECT src, dst, rel, trust FROM ed UNION SELECT dst, src, rel, trust FROM ed)
"""


def graph_neighbours(spark, sf_dir):
    near = G.neighbours(_edges(spark, sf_dir), "nation:3")
    return near.groupBy("rel", "trust_layer").agg(F.count("*").alias("n"))


def graph_multi_hop(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    paths = G.multi_hop(_edges(spark, sf_dir), starts, max_hops=3)
    return paths.select("start", "node", "hops", F.array_join("path", ">").alias("path"))


def graph_trust_filter(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    paths = G.multi_hop(_edges(spark, sf_dir), starts, rels=["IN_REGION", "IN_NATION"], max_hops=2, trust_layers=["authoritative", "validated"])
    return paths.groupBy("start", "hops", F.substring_index("node", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def _graph_input(spark, sf_dir):
    """Suppliers are documents; their line items candidates: the part is the seam, two orders its boreholes."""
    s, l = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    doc = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    registry = s.select(doc("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"), F.lit("P").alias("publisher"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("coalfield"), F.lit(None).cast("string").alias("block"), F.lit("G2").alias("stage"))
    c = l.select(
        doc("l_suppkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"), F.lit("quantity").alias("metric_key"), F.lit("point").alias("value_kind"), F.lit("seam_range_summary_table").alias("domain_type"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id"), F.when(F.col("l_returnflag") == "A", "auto_passed").when(F.col("l_returnflag") == "N", "pending_review").otherwise("soft_rejected").alias("state"),
        F.create_map(F.lit("source_boreholes"), F.concat_ws(";", F.concat(F.lit("b"), (F.col("l_orderkey") % 50).cast("string")), F.concat(F.lit("b"), (F.col("l_orderkey") % 7).cast("string")))).alias("qualifiers"),
    )
    facts = c.where("state = 'auto_passed'").select("candidate_id", F.concat(F.lit("f"), "candidate_id").alias("fact_id"), F.lit(None).cast("timestamp").alias("system_to")).distinct()
    return registry, c, facts


def graph_build(spark, sf_dir):
    return G.build_edges(*_graph_input(spark, sf_dir)).groupBy("rel", "trust_layer").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def graph_nodes(spark, sf_dir):
    return G.build_nodes(*_graph_input(spark, sf_dir)).groupBy("label", "graph").agg(F.count("*").alias("n"), F.sum(F.size("props")).alias("n_props"))


def _lineage(spark, sf_dir):
    """answer (customer) -> package (order) -> fact (line's part and supplier) -> candidate (part)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    text = lambda *c: F.concat_ws("/", *c)
    e = X.edge_rows(o, "answer", text("o_custkey"), "package", text("o_orderkey"), "answered_from")
    e = e.unionByName(X.edge_rows(l, "package", text("l_orderkey"), "fact", text("l_partkey", "l_suppkey"), "cites"))
    e = e.unionByName(X.edge_rows(l, "fact", text("l_partkey", "l_suppkey"), "candidate", text("l_partkey"), "published"))
    key = F.xxhash64("from_kind", "from_id", "to_kind", "to_id")
    return e.distinct().withColumn("id", key)


LINEAGE_SQL = """
le AS (SELECT DISTINCT 'answer' AS fk, CAST(o_custkey AS VARCHAR) AS fi, 'package' AS tk, CAST(o_orderkey AS VARCHAR) AS ti FROM orders
       UNION ALL SELECT DISTINCT 'package', CAST(l_orderkey AS VARCHAR), 'fact', l_partkey || '/' || l_suppkey FROM lineitem
       UNION ALL SELECT DISTINCT 'fact', l_partkey || '/' || l_suppkey, 'candidate', CAST(l_partkey AS VARCHAR) FROM lineitem)
"""


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit("answer").alias("kind"), F.col("o_custkey").cast("string").alias("id")).distinct()


def lineage_full(spark, sf_dir):
    trace = X.closure(_lineage(spark, sf_dir), _answers(spark, sf_dir))
    return trace.groupBy("start_id", "kind", "depth").agg(F.count("*").alias("n"))


def lineage_back(spark, sf_dir):
    """How far the first-edge trace of each answer goes, and where it ends; edges stand in the order of what they lead to."""
    edges = _lineage(spark, sf_dir).withColumn("id", F.concat_ws("|", "to_kind", "to_id"))
    trace = X.trace_back(edges, _answers(spark, sf_dir))
    return trace.groupBy("start_id").agg(F.max("depth").alias("depth"), F.max_by("kind", "depth").alias("last_kind"))


def lineage_forward(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lit("candidate").alias("kind"), F.col("p_partkey").cast("string").alias("id"))
    trace = X.closure(_lineage(spark, sf_dir), parts, forward=True)
    return trace.groupBy("start_id", "kind").agg(F.count("*").alias("n"))


def revision_impact(spark, sf_dir):
    """Facts are (part, supplier) with the greatest quantity; every fact is revised."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.floor("l_quantity")).alias("q"))
    fact = F.concat_ws("/", "l_partkey", "l_suppkey").alias("fact_id")
    ledger = l.select(fact, F.col("q").cast("decimal(38,18)").alias("value"))
    revised = l.select(fact, (F.col("q") + F.when(F.col("l_suppkey") % 3 == 0, 0.0).when(F.col("l_suppkey") % 3 == 1, 0.01).otherwise(5.0)).cast("decimal(38,18)").alias("new_value"))
    return X.revision_impact(ledger, revised, _lineage(spark, sf_dir)).select("fact_id", F.round(F.col("delta").cast("double"), 4).alias("delta"), "verdict", "n_affected")


PHRASE = "the that"


def _documents(spark, sf_dir):
    k = F.col("doc_id")
    level = F.when(k % 3 == 0, "restricted").when(k % 3 == 1, "internal").otherwise("public")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), k.cast("string")).alias("chunk_id"), none.alias("parent_id"), F.concat(F.lit("d"), k.cast("string")).alias("doc_id"), F.col("text").alias("indexed_text"), F.col("text").alias("raw_text"), level.alias("classification"), none.alias("candidate_id"))


def bm25_phrase(spark, sf_dir):
    return S.bm25(_documents(spark, sf_dir), PHRASE).select("chunk_id", F.round("score", 6).alias("score"))


def bm25_classified(spark, sf_dir):
    return S.search_evidence(_documents(spark, sf_dir), PHRASE, 20, ["public", "internal"]).select("chunk_id", F.round("score", 6).alias("score"), "classification")


def _turns(spark, sf_dir):
    """Conversations as chunks: the first turn is the parent of the others."""
    t = table(spark, sf_dir, "conversations")
    child = F.concat_ws(":", F.lit("c"), "conv_id", "turn")
    return t.select(child.alias("chunk_id"), F.when(F.col("turn") > 0, F.concat(F.lit("c:"), F.col("conv_id").cast("string"), F.lit(":0"))).alias("parent_id"), F.col("text").alias("indexed_text"), F.col("text").alias("raw_text"), F.lit("public").alias("classification")).dropDuplicates(["chunk_id"])


def bm25_parent(spark, sf_dir):
    found = S.search_evidence(_turns(spark, sf_dir), "of the", 10)
    return found.select("chunk_id", F.round("score", 6).alias("score"), F.length("text").alias("n"))


def postings_top(spark, sf_dir):
    return S.postings(_turns(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min(F.get("positions", F.lit(0))).cast("long").alias("first"))


def hit_at_k(spark, sf_dir):
    """Benchmark passages are questions, and their first six words what should be found."""
    words = F.split("text", " ")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 5 != 0, F.array_join(F.slice(words, 1, 6), " ")).alias("expected"))
    return S.hit_at_k(_documents(spark, sf_dir), q)


def vector_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.knn(e, q, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _registry(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 9")
    level = F.when(F.col("doc_id") % 3 == 0, "restricted").otherwise("public")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), level.alias("classification"))


def upserted_vectors(spark, sf_dir):
    """All vectors, then every third anew with its parts doubled: how many there are, and what they add up to."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    more = e.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float")))
    store = S.upsert_vectors(e, more)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.agg(F.count("*").alias("n"), F.round(F.sum(total), 6).alias("total"))


def rls_classification(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "lang")
    return visible(rows, _registry(spark, sf_dir), PUBLIC).groupBy("lang").agg(F.count("*").alias("n"))


def rls_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string"))).alias("doc_id"), "event_type")
    officer = office(["d1", "d3", "d7"])
    return visible(rows, _registry(spark, sf_dir), officer).groupBy("doc_id", "event_type").agg(F.count("*").alias("n"))


def export_guard(spark, sf_dir):
    return exportable(_documents(spark, sf_dir)).select("chunk_id")


def _broker(spark, sf_dir, who=PUBLIC):
    """Over a stored ledger, as several tools read it."""
    return Broker(spark, who, {"fact": cut(book(spark, sf_dir)), "chunk": _documents(spark, sf_dir)})


def _contents(b):
    packages = b.tables["sealed_package"].select("package_id", "intent", "n_members")
    kinds = b.tables["package_member"].groupBy("package_id", "kind").agg(F.count("*").alias("n"), F.min("member_id").alias("least_id"))
    return packages.join(kinds, "package_id").select("intent", "n_members", "kind", "n", "least_id")


def seal_package(spark, sf_dir):
    """Sealing the same evidence twice gives one package: its members by kind."""
    b = _broker(spark, sf_dir)
    first = b.seal_evidence_package("clicks and errors", "the that", ["click", "error"])
    again = b.seal_evidence_package("clicks and errors", "the that", ["error", "click"])
    return _contents(b).withColumn("same", F.lit(first == again))


def merge_packages(spark, sf_dir):
    """Two packages and the one of both, merged twice."""
    b = _broker(spark, sf_dir)
    parts = [b.seal_evidence_package(m, None, [m]) for m in ("click", "error")]
    merged = b.merge_packages(parts, "both")
    b.merge_packages(parts, "both")
    return _contents(b).withColumn("n_sources", F.lit(b.tables["lineage_edge"].where((F.col("activity") == "merged_from") & (F.col("from_id") == merged)).select("to_id").distinct().count()))


def replay_check(spark, sf_dir):
    """A package of one classification is refused to a caller of a lower one."""
    b = _broker(spark, sf_dir, Principal("reviewer", ("public", "restricted")))
    package = b.seal_evidence_package("i", None, ["click"])
    low = Broker(spark, PUBLIC, b.tables)
    try:
        low.replay(package)
        refused = False
    except AccessDenied:
        refused = True
    return b.replay(package).groupBy("intent", "kind").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def agent_answers(spark, sf_dir):
    """One question for each user and kind of event, and one for a user without any: from evidence to answers."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("metric_key")).distinct()
    e = e.unionByName(spark.createDataFrame([("user:none", "click")], "entity_id string, metric_key string"))
    asked = e.select(F.concat_ws("/", "entity_id", "metric_key").alias("question_id"), F.concat_ws(" of ", "metric_key", "entity_id").alias("title"), "metric_key", "entity_id")
    b = _broker(spark, sf_dir)
    answers = answer_questions(b, asked)
    recorded = b.tables["lineage_edge"].where("activity = 'answered_from'").select(F.col("from_id").alias("question_id"), F.lit(True).alias("recorded"))
    return answers.join(recorded, "question_id", "left").select("question_id", "status", "reason", "n_facts", F.col("total").cast("long").alias("total"), F.size(F.split("text", "; ")).cast("long").alias("n_figures"), F.coalesce("recorded", F.lit(False)).alias("recorded"))


def agent_pages(spark, sf_dir):
    """All figures of each event type, over all users, told in pages of twenty."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("question_id"), F.col("event_type").alias("title"), F.col("event_type").alias("metric_key"), F.lit(None).cast("string").alias("entity_id")).distinct()
    b = _broker(spark, sf_dir)
    answer_questions(b, asked)
    return b.tables["answer_page"].select("question_id", F.col("page").cast("long").alias("page"), "n_figures", F.sha2("text", 256).alias("text_sha256"))


def trace_visible(spark, sf_dir):
    """What a caller of the lowest class reaches from answers, when the documents of every third fact are restricted."""
    facts = book(spark, sf_dir)
    registry = spark.createDataFrame([(f"doc:{i}", "restricted" if i % 3 == 0 else "public") for i in range(7)], "doc_id string, classification string")
    high = Broker(spark, Principal("r", ("public", "restricted")), {"fact": facts, "source_registry": registry})
    current = high._facts().select("fact_id", "metric_key")
    high._add_edges(current.select(F.lit("answer").alias("from_kind"), F.col("metric_key").alias("from_id"), F.lit("fact").alias("to_kind"), F.col("fact_id").alias("to_id"), F.lit("rests_on").alias("activity"), F.lit("r").alias("agent")))
    low = Broker(spark, PUBLIC, high.tables)
    count = lambda b, name: b.get_trace_graph("answer", "click").where("kind = 'fact'").agg(F.count("*").alias("n")).select(F.lit(name).alias("caller"), "n")
    return count(high, "high").unionByName(count(low, "low"))


def retrieval_ablation(spark, sf_dir):
    """Hits among five of each arm; turns of conversations are the chunks, and each conversation's opening words the questions."""
    turns = _turns(spark, sf_dir).withColumn("indexed_text", F.concat(F.lit("speech "), F.coalesce("raw_text", F.lit(""))))
    first = table(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    words = F.split("text", " ")
    asked = first.select(F.col("conv_id").alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("query"), F.when(F.col("conv_id") % 9 != 0, F.array_join(F.slice(words, 1, 5), " ")).alias("expected"))
    return S.ablation(turns, asked)


def entailment_check(spark, sf_dir):
    """The first half of each document as a claim, the rest as the evidence."""
    d = table(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    claim, evidence = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    return d.select("doc_id", N.entailed(claim, evidence).alias("entailed"), F.array_join(N.missing_numbers(claim, evidence), ",").alias("missing"))


def narrative_template(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    figures = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("n_name").alias("title"), F.lit("balance").alias("metric_key"), F.floor("s_acctbal").cast("string").alias("value_text"), F.lit("USD").alias("unit"), F.format_string("F%09d", "s_suppkey").alias("figure_id"), "s_suppkey"
    )
    figures = figures.withColumn("figure_id", F.when(F.col("s_suppkey").isNotNull(), F.col("figure_id")))
    return N.narrative(figures).select("title", "text")


def corpus_dashboard(spark, sf_dir):
    """Customers are documents, nations their trees, orders their runs and late lines the queue."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    reg = c.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("publisher"))
    asts = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("table_count"), F.lit(1).alias("element_count"), F.lit("h").alias("ast_hash"))
    runs = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("tier_counts"), F.col("o_totalprice").alias("duration_s"))
    queue = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("doc_id"))
    return R.corpus_dashboard(reg, asts, runs, queue).select("doc_id", "publisher", "table_count", "tier_counts", "duration_s", "n_review")


def admission(spark, sf_dir):
    planned = table(spark, sf_dir, "part").select(F.col("p_name").alias("model"), (F.col("p_size") / 1000).alias("ram"), (F.col("p_size") / 2000).alias("vram"))
    return R.admission(planned, 8.0, 0.0, 16.0, 0.0).select("admitted", "reason")


QUERIES = {f.__name__: f for f in (graph_neighbours, graph_multi_hop, graph_trust_filter, graph_build, graph_nodes, lineage_full, lineage_back, lineage_forward, revision_impact, bm25_phrase, bm25_classified, bm25_parent, postings_top, hit_at_k, vector_knn, upserted_vectors, rls_classification, rls_scope, export_guard, seal_package, merge_packages, replay_check, agent_answers, agent_pages, trace_visible, retrieval_ablation, entailment_check, narrative_template, corpus_dashboard, admission)}

PATHS_SQL = f"""
WITH RECURSIVE {EDGES_SQL}, p AS (SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node, 0 AS hops, ['region:' || r_regionkey] AS path FROM region
  UNION ALL SELECT p.start, b.dst, p.hops + 1, list_append(p.path, b.dst) FROM p JOIN b ON b.src = p.node WHERE p.hops < %d AND NOT list_contains(p.path, b.dst) AND %s)
"""
GRAPH_SQL = """
reg AS (SELECT 's' || s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'n' || s_nationkey END AS coalfield FROM supplier),
ca AS (SELECT 's' || l_suppkey AS doc_id, 'seam:p' || l_partkey AS seam, CASE WHEN l_returnflag = 'A' THEN 'f' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS fact_id, l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N')),
bo AS (SELECT *, unnest(['b' || (l_orderkey % 50), 'b' || (l_orderkey % 7)]) AS bore FROM ca),
ge AS (SELECT 'document:' || doc_id AS src, 'block:' || doc_id AS dst, 'DESCRIBES' AS rel, 'authoritative' AS trust_layer, NULL AS fact_id, doc_id FROM reg
       UNION ALL SELECT 'block:' || doc_id, 'coalfield:' || coalfield, 'IN_COALFIELD', 'authoritative', NULL, doc_id FROM reg WHERE coalfield IS NOT NULL
       UNION ALL SELECT DISTINCT seam, 'block:' || doc_id, 'IN_BLOCK', 'validated', NULL, doc_id FROM ca
       UNION ALL SELECT DISTINCT 'borehole:' || bore, seam, 'INTERSECTS', 'validated', fact_id, doc_id FROM bo
       UNION ALL SELECT DISTINCT 'document:' || doc_id, 'fact:' || fact_id, 'SUPPORTS', 'authoritative', NULL, doc_id FROM ca WHERE fact_id IS NOT NULL)
"""


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _count(words: str, phrase: str) -> str:
    return f"CASE WHEN len({words}) < len({phrase}) THEN 0 ELSE len(list_filter(range(1, len({words}) - len({phrase}) + 2), lambda i: list_slice({words}, i, i + len({phrase}) - 1) = {phrase})) END"


def _bm25_sql(source: str, phrase: str) -> str:
    return f"""
k AS (SELECT *, {_tokens('indexed_text')} AS w FROM {source}), m AS (SELECT *, len(w) AS n, {_count('w', phrase)} AS f FROM k),
g AS (SELECT count(*) AS big, avg(n) AS av, count(*) FILTER (f > 0) AS df FROM m),
sc AS (SELECT m.*, greatest(ln((big - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)) AS score FROM m, g WHERE f > 0)
"""


def _arm_sql(arm: str, text: str, rerank: bool = False, parents: bool = False) -> str:
    """One arm of the ablation: each question's best chunks, shown as they are or by their parent, and whether one is right."""
    shown = f"coalesce(p.{text}, t.{text})" if parents else f"t.{text}"
    again = "ORDER BY len(list_intersect(phrase, w2)) DESC, len(w2), r" if rerank else "ORDER BY r"
    return f"""(WITH k AS (SELECT *, {_tokens(text)} AS w FROM tu), g AS (SELECT count(*) AS big, avg(len(w)) AS av FROM k),
        m AS (SELECT query_id, phrase, expected, chunk_id, len(w) AS n, {_count('w', 'phrase')} AS f FROM k, q WHERE len(phrase) > 0 AND list_has_all(w, phrase)), d AS (SELECT query_id, count(*) AS df FROM m WHERE f > 0 GROUP BY 1),
        s AS (SELECT m.*, greatest(ln((big - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)) AS score FROM m JOIN d USING (query_id), g WHERE f > 0),
        a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= {20 if rerank else 5}),
        b AS (SELECT a.*, {shown} AS shown, {_tokens(shown)} AS w2 FROM a JOIN tu t USING (chunk_id) LEFT JOIN tu p ON p.chunk_id = t.parent_id),
        c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id {again}) <= 5), h AS (SELECT query_id, count(*) AS c, bool_or(contains(shown, expected)) AS found FROM c GROUP BY 1)
        SELECT '{arm}' AS arm, count(*) FILTER (CASE WHEN expected IS NULL THEN c IS NULL ELSE coalesce(found, false) END) AS hits, count(*) AS questions FROM q LEFT JOIN h USING (query_id))"""


DOCS_SQL = "docs AS (SELECT 'd' || doc_id AS chunk_id, text AS indexed_text, ['restricted', 'internal', 'public'][doc_id % 3 + 1] AS classification FROM documents)"
TURNS_SQL = "turns AS (SELECT DISTINCT ON (conv_id, turn) 'c:' || conv_id || ':' || turn AS chunk_id, CASE WHEN turn > 0 THEN 'c:' || conv_id || ':0' END AS parent_id, text AS indexed_text FROM conversations)"
CURRENT_SQL = f"""{EVENTS_SQL}, cur AS (SELECT led.*, 'fact_' || substr(sha256(fact_identity || '|' || epoch_us(ts) || '|' || printf('%019d', event_id)), 1, 12) AS fact_id,
    'doc:' || (event_id % 7) AS doc_id FROM led JOIN e ON e.ts = led.system_from AND e.entity_id = led.entity_id AND e.metric_key = led.metric_key WHERE system_to IS NULL)"""
SEALED_SQL = "SELECT '%s' AS intent, %s AS kind, count(*) AS n, min(id) AS least_id FROM %s"
ORACLES = {
    "seal_package": f"""WITH {CURRENT_SQL}, {DOCS_SQL}, {_bm25_sql('docs', repr(PHRASE.split()))}, top AS (SELECT chunk_id FROM sc WHERE classification = 'public' ORDER BY score DESC, chunk_id LIMIT 5),
        mem AS (SELECT 'fact' AS kind, fact_id AS id FROM cur WHERE metric_key IN ('click', 'error') UNION ALL SELECT 'passage', chunk_id FROM top UNION ALL SELECT 'coverage', k FROM (VALUES ('click'), ('error')) v(k))
        SELECT 'clicks and errors' AS intent, CAST(sum(count(*)) OVER () AS BIGINT) AS n_members, kind, count(*) AS n, min(id) AS least_id, true AS same FROM mem GROUP BY kind""",
    "merge_packages": f"""WITH {CURRENT_SQL}, m AS (SELECT metric_key AS intent, 'fact' AS kind, fact_id AS id FROM cur WHERE metric_key IN ('click', 'error') UNION ALL SELECT k, 'coverage', k FROM (VALUES ('click'), ('error')) v(k)),
        a AS (SELECT * FROM m UNION ALL SELECT 'both', kind, id FROM m)
        SELECT intent, CAST(sum(count(*)) OVER (PARTITION BY intent) AS BIGINT) AS n_members, kind, count(*) AS n, min(id) AS least_id, CAST(2 AS INT) AS n_sources FROM a GROUP BY intent, kind""",
    "replay_check": f"WITH {CURRENT_SQL} SELECT 'i' AS intent, 'fact' AS kind, count(*) AS n, true AS refused FROM cur WHERE metric_key = 'click' UNION ALL SELECT 'i', 'coverage', 1, true",
    "agent_answers": f"""WITH {CURRENT_SQL}, q AS (SELECT DISTINCT 'user:' || user_id AS entity_id, event_type AS metric_key FROM events UNION ALL SELECT 'user:none', 'click'), n AS (SELECT entity_id, metric_key, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM cur GROUP BY 1, 2)
        SELECT q.entity_id || '/' || q.metric_key AS question_id, CASE WHEN n > 0 THEN 'answered' ELSE 'not_covered' END AS status, CASE WHEN n.n IS NULL THEN 'NOT_DIGITISED' END AS reason, coalesce(n, 0) AS n_facts, total, CASE WHEN n > 0 THEN least(n, 20) END AS n_figures, n.n IS NOT NULL AS recorded
        FROM q LEFT JOIN n USING (entity_id, metric_key)""",
    "agent_pages": f"""WITH {CURRENT_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY metric_key ORDER BY fact_id) - 1) // 20 + 1 AS page FROM cur)
        SELECT metric_key AS question_id, page, count(*) AS n_figures, sha256(string_agg(metric_key || ' is ' || value || ' [' || fact_id || ']', '; ' ORDER BY fact_id)) AS text_sha256 FROM p GROUP BY 1, 2""",
    "trace_visible": f"WITH {CURRENT_SQL} SELECT 'high' AS caller, count(*) AS n FROM cur WHERE metric_key = 'click' UNION ALL SELECT 'low', count(*) FROM cur WHERE metric_key = 'click' AND CAST(doc_id[5:] AS INT) % 3 <> 0",
    "lineage_back": f"""WITH {LINEAGE_SQL}, a AS MATERIALIZED (SELECT fi, min(ti) AS ti FROM le WHERE fk = 'answer' GROUP BY 1),
        p AS MATERIALIZED (SELECT fi, min(ti) AS ti FROM le WHERE fk = 'package' GROUP BY 1), f AS MATERIALIZED (SELECT fi, min(ti) AS ti FROM le WHERE fk = 'fact' GROUP BY 1)
        SELECT a.fi AS start_id, 1 + CAST(p.ti IS NOT NULL AS INT) + CAST(f.ti IS NOT NULL AS INT) AS depth, CASE WHEN p.ti IS NULL THEN 'package' WHEN f.ti IS NULL THEN 'fact' ELSE 'candidate' END AS last_kind
        FROM a LEFT JOIN p ON p.fi = a.ti LEFT JOIN f ON f.fi = p.ti""",
    "graph_neighbours": f"WITH {EDGES_SQL} SELECT rel, trust AS trust_layer, count(*) AS n FROM ed WHERE src = 'nation:3' OR dst = 'nation:3' GROUP BY 1, 2",
    "graph_multi_hop": PATHS_SQL % (3, "true") + "SELECT start, node, hops, array_to_string(path, '>') AS path FROM p WHERE hops > 0",
    "graph_trust_filter": PATHS_SQL % (2, "b.trust IN ('authoritative', 'validated')") + "SELECT start, hops, split_part(node, ':', 1) AS kind, count(*) AS n FROM p WHERE hops > 0 GROUP BY ALL",
    "graph_build": f"WITH {GRAPH_SQL} SELECT rel, trust_layer, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM ge GROUP BY 1, 2",
    "graph_nodes": f"""WITH {GRAPH_SQL} SELECT 'Document' AS label, 'documentary' AS graph, count(*) AS n, count(*) * 2 AS n_props FROM reg
        UNION ALL SELECT 'Coalfield', 'administrative', count(DISTINCT coalfield), count(DISTINCT coalfield) FROM reg UNION ALL SELECT 'Block', 'administrative', count(*), count(*) * 2 FROM reg
        UNION ALL SELECT 'Seam', 'geological', count(DISTINCT seam), count(DISTINCT seam) FROM ca UNION ALL SELECT 'Borehole', 'geological', count(DISTINCT bore), count(DISTINCT bore) FROM bo
        UNION ALL SELECT 'Fact', 'documentary', count(DISTINCT fact_id), count(DISTINCT fact_id) FROM ca""",
    "lineage_full": f"""WITH {LINEAGE_SQL}, a0 AS (SELECT DISTINCT fi AS s FROM le WHERE fk = 'answer'),
        a1 AS (SELECT DISTINCT fi AS s, ti AS id FROM le WHERE fk = 'answer'), a2 AS (SELECT DISTINCT s, ti AS id FROM a1 JOIN le ON fk = 'package' AND fi = id), a3 AS (SELECT DISTINCT s, ti AS id FROM a2 JOIN le ON fk = 'fact' AND fi = id)
        SELECT s AS start_id, 'answer' AS kind, 0 AS depth, 1 AS n FROM a0 UNION ALL SELECT s, 'package', 1, count(*) FROM a1 GROUP BY s UNION ALL SELECT s, 'fact', 2, count(*) FROM a2 GROUP BY s UNION ALL SELECT s, 'candidate', 3, count(*) FROM a3 GROUP BY s""",
    "lineage_forward": f"""WITH {LINEAGE_SQL}, p0 AS (SELECT CAST(p_partkey AS VARCHAR) AS s FROM part), p1 AS (SELECT DISTINCT s, fi AS id FROM p0 JOIN le ON tk = 'candidate' AND ti = s),
        p2 AS (SELECT DISTINCT s, fi AS id FROM p1 JOIN le ON tk = 'fact' AND ti = id), p3 AS (SELECT DISTINCT s, fi AS id FROM p2 JOIN le ON tk = 'package' AND ti = id)
        SELECT s AS start_id, 'candidate' AS kind, 1 AS n FROM p0 UNION ALL SELECT s, 'fact', count(*) FROM p1 GROUP BY s UNION ALL SELECT s, 'package', count(*) FROM p2 GROUP BY s UNION ALL SELECT s, 'answer', count(*) FROM p3 GROUP BY s""",
    "revision_impact": f"""WITH {LINEAGE_SQL}, q AS (SELECT l_partkey, l_suppkey, max(floor(l_quantity)) AS q FROM lineitem GROUP BY 1, 2),
        r AS (SELECT l_partkey || '/' || l_suppkey AS fact_id, [0.0, 0.01, 5.0][l_suppkey % 3 + 1]::DOUBLE AS delta FROM q), p1 AS (SELECT DISTINCT fact_id, fi AS id FROM r JOIN le ON tk = 'fact' AND ti = fact_id), p2 AS (SELECT DISTINCT fact_id, fi AS id FROM p1 JOIN le ON tk = 'package' AND ti = id)
        SELECT fact_id, delta, CASE WHEN delta = 0 THEN 'unchanged' WHEN delta < 0.02 THEN 'immaterial' ELSE 'material' END AS verdict, (SELECT count(*) FROM p1 WHERE p1.fact_id = r.fact_id) + (SELECT count(*) FROM p2 WHERE p2.fact_id = r.fact_id) AS n_affected FROM r""",
    "bm25_phrase": f"WITH {DOCS_SQL}, {_bm25_sql('docs', repr(PHRASE.split()))} SELECT chunk_id, round(score, 6) AS score FROM sc",
    "bm25_classified": f"WITH {DOCS_SQL}, {_bm25_sql('docs', repr(PHRASE.split()))} SELECT chunk_id, round(score, 6) AS score, classification FROM sc WHERE classification <> 'restricted' ORDER BY sc.score DESC, chunk_id LIMIT 20",
    "bm25_parent": f"WITH {TURNS_SQL}, {_bm25_sql('turns', repr(['of', 'the']))}, top AS (SELECT * FROM sc ORDER BY score DESC, chunk_id LIMIT 10) SELECT top.chunk_id, round(top.score, 6) AS score, length(coalesce(p.indexed_text, top.indexed_text)) AS n FROM top LEFT JOIN turns p ON p.chunk_id = top.parent_id",
    "postings_top": f"WITH {TURNS_SQL}, w AS (SELECT chunk_id, unnest(l) AS term, unnest(range(0, len(l))) AS pos FROM (SELECT chunk_id, {_tokens('indexed_text')} AS l FROM turns)) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf, min(pos) AS first FROM w GROUP BY term",
    "hit_at_k": f"""WITH {DOCS_SQL}, q AS (SELECT item_id, {_tokens("text")} AS phrase, CASE WHEN item_id % 5 <> 0 THEN array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') END AS expected FROM benchmark),
        k AS (SELECT *, {_tokens('indexed_text')} AS w FROM docs), g AS (SELECT count(*) AS big, avg(len(w)) AS av FROM k),
        m AS (SELECT item_id, expected, chunk_id, indexed_text, len(w) AS n, {_count('w', 'phrase')} AS f FROM k, q WHERE list_has_all(w, phrase)), d AS (SELECT item_id, count(*) AS df FROM m WHERE f > 0 GROUP BY 1),
        s AS (SELECT m.*, greatest(ln((big - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av)) AS score FROM m JOIN d USING (item_id), g WHERE f > 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS r FROM s), h AS (SELECT item_id, bool_or(contains(indexed_text, expected)) AS found, count(*) AS c FROM t WHERE r <= 5 GROUP BY 1)
        SELECT q.item_id AS query_id, CASE WHEN q.expected IS NULL THEN c IS NULL ELSE coalesce(found, false) END AS hit FROM q LEFT JOIN h USING (item_id)""",
    "retrieval_ablation": f"""WITH {TURNS_SQL}, tu AS (SELECT *, indexed_text AS raw_text, 'speech ' || coalesce(indexed_text, '') AS full_text FROM turns), o AS (SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY 1),
        q AS (SELECT conv_id AS query_id, {_tokens("array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')")} AS phrase, CASE WHEN conv_id % 9 <> 0 THEN array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') END AS expected FROM o)
        {_arm_sql('lexical', 'raw_text')} UNION ALL {_arm_sql('rerank', 'raw_text', rerank=True)} UNION ALL {_arm_sql('prefix', 'full_text')} UNION ALL {_arm_sql('parent', 'full_text', parents=True)}""",
    "vector_knn": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""",
    "upserted_vectors": "SELECT count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END), 6) AS total FROM embeddings",
    "rls_classification": "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 10 = 9 OR doc_id % 3 <> 0 GROUP BY 1",
    "rls_scope": "WITH e AS (SELECT CASE WHEN user_id % 4 <> 0 THEN 'd' || (user_id % 20) END AS doc_id, event_type FROM events) SELECT doc_id, event_type, count(*) AS n FROM e WHERE doc_id IS NULL OR doc_id IN ('d1', 'd3', 'd7') GROUP BY 1, 2",
    "export_guard": "SELECT 'd' || doc_id AS chunk_id FROM documents WHERE doc_id % 3 = 2",
    "entailment_check": r"""WITH c AS (SELECT doc_id, regexp_extract_all(regexp_replace(substr(text, 1, length(text) // 2), '\[[^\]]*\]', '', 'g'), '\d+(?:\.\d+)?') AS nums, coalesce(substr(text, length(text) // 2 + 1), '') AS ev FROM documents)
        SELECT doc_id, len(list_filter(nums, lambda n: NOT contains(ev, n))) = 0 AS entailed, array_to_string(list_filter(nums, lambda n: NOT contains(ev, n)), ',') AS missing FROM c""",
    "narrative_template": """SELECT n_name AS title, n_name || ': ' || coalesce(string_agg('balance is ' || CAST(floor(s_acctbal) AS BIGINT) || ' USD [' || printf('F%09d', s_suppkey) || ']', '; ' ORDER BY s_suppkey) || '.', 'no covered figures for this section.') AS text
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    "corpus_dashboard": """SELECT c_custkey AS doc_id, c_mktsegment AS publisher, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS table_count, r.o_orderstatus AS tier_counts, r.o_totalprice AS duration_s, coalesce(q.n, 0) AS n_review FROM customer
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) r ON r.o_custkey = c_custkey AND r.rn = 1
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) q ON q.o_custkey = c_custkey""",
    "admission": "SELECT sum(p_size / 1000) <= 8 AS admitted, CASE WHEN sum(p_size / 1000) > 8 THEN 'memory over budget' ELSE 'within budget' END AS reason FROM part",
}
