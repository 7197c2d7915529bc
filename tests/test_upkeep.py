"""What is brought up to date equals what is made from scratch: closures, sketches, counted graphs, the assay, neighbours."""

import os
import random
import tempfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from orewright.config import Rule
from orewright.operators import assay as A
from orewright.operators import graph as G
from orewright.operators import lineage as X
from orewright.operators import search as S
from orewright.shared import shared_folder

KINDS = ["answer", "package", "fact", "candidate"]


def edges(spark, pairs):
    rows = [(KINDS[a % 4], str(a), KINDS[b % 4], str(b), "x", "me") for a, b in pairs]
    return spark.createDataFrame(rows, "from_kind string, from_id string, to_kind string, to_id string, activity string, agent string")


def told(df):
    return sorted(map(tuple, df.select("start_kind", "start_id", "kind", "id", "depth").collect()))


@pytest.mark.parametrize("forward", [False, True])
def test_closure_of_batches_is_that_of_all(spark, forward):
    """Random graphs with cycles, repeated edges, edges that shorten ways, and a start that comes later."""
    r = random.Random(5 + forward)
    batches = [[(r.randrange(24), r.randrange(24)) for _ in range(n)] for n in (14, 10, 12)]
    batches[2] += batches[0][:3]
    starts = lambda ids: spark.createDataFrame([(KINDS[i % 4], str(i)) for i in ids], "kind string, id string")
    pairs, old = X.closure(edges(spark, batches[0]), starts([0, 1, 2, 30]), forward), list(batches[0])
    for k, batch in enumerate(batches[1:]):
        pairs = X.extend_closure(pairs, edges(spark, old), edges(spark, batch), starts([5 + k]), forward)
        old += batch
        assert told(pairs) == told(X.closure(edges(spark, old), starts([0, 1, 2, 30, *range(5, 6 + k)]), forward))
    assert told(X.extend_closure(pairs, edges(spark, old), edges(spark, []), None, forward)) == told(pairs)


def test_reach_counts(spark):
    """Exact while few; within three standard errors on a node that thousands can be reached from; cycles end."""
    few = [(0, 1), (1, 2), (2, 0), (1, 2), (4, 5), (5, 6), (6, 3)]
    got = {(x.kind, x.id): round(x.reach) for x in X.reach_counts(edges(spark, few), leaves=()).collect()}
    assert got == {("answer", "0"): 3, ("package", "1"): 3, ("fact", "2"): 3, ("answer", "4"): 3, ("package", "5"): 2, ("fact", "6"): 1}
    many = [(1, 2)] + [(2, 4 * i) for i in range(1, 6000)] + [(4, 4 * i + 1) for i in range(1, 3000)]
    got = {(x.kind, x.id): x.reach for x in X.reach_counts(edges(spark, many)).collect()}
    assert abs(got[("package", "1")] - 9000) < 3 * 0.017 * 9000
    assert X.reach_counts(edges(spark, [])).count() == 0


def layers(spark):
    """100 answers, 1,000 packages and 10,000 facts of 1,000 candidates; 12,100 pairs of answer and node, 21,000 edges."""
    text = lambda c: F.expr(c).cast("string")
    made = lambda n, a, b, to, what: X.edge_rows(spark.range(n), a, text("id" if a != "answer" else "id % 100"), b, text(to), what)
    e = made(1000, "answer", "package", "id", "answered_from").unionByName(X.edge_rows(spark.range(10000), "package", text("id % 1000"), "fact", text("id"), "cites"))
    return e.unionByName(made(10000, "fact", "candidate", "id % 1000", "published"))


def written(spark):
    """Bytes in the folder that driver and executors share."""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_folder(spark).removeprefix("file:")) for f in files)


def test_closure_brought_up_to_date_writes_little(spark):
    """Some bytes for a pair, not a whole row for each round that it is looked at."""
    edges = layers(spark)
    starts = spark.range(100).select(F.lit("answer").alias("kind"), F.col("id").cast("string").alias("id"))
    late = F.crc32(F.concat_ws("|", "from_id", "to_id").cast("binary")) % 3 == 0
    pairs, before = X.closure(edges.where(~late), starts), written(spark)
    pairs = X.extend_closure(pairs, edges.where(~late), edges.where(late))
    assert pairs.count() == 12100 and written(spark) - before < 300_000


def test_reach_writes_little(spark):
    before = written(spark)
    got = X.reach_counts(layers(spark), forward=True, kinds=("fact",))
    assert (got.count(), got.where("round(reach) <> 2").count()) == (10000, 0) and written(spark) - before < 500_000
    everything = X.reach_counts(layers(spark), forward=True)
    assert sorted(map(tuple, everything.where("kind = 'fact'").collect())) == sorted(map(tuple, got.collect()))


def test_revision_impact_writes_little(spark):
    facts = spark.range(10000).select(F.col("id").cast("string").alias("fact_id"), F.lit("1").alias("value"))
    before = written(spark)
    got = X.revision_impact(facts, facts.select("fact_id", F.lit("2").alias("new_value")), layers(spark))
    assert got.where("n_affected = 2 and verdict = 'material'").count() == 10000 and written(spark) - before < 200_000


EDGE = "src string, dst string, rel string, trust_layer string, doc_id string"


def test_counted_graph_equals_a_rebuild(spark):
    r = random.Random(8)
    store = G.CountedGraph(spark, tempfile.mkdtemp(prefix="graph-") + "/g")
    held = {}
    give = lambda df, ddl: spark.createDataFrame(df, ddl)
    for step in range(4):
        docs = [f"d{i}" for i in r.sample(range(9), 4)] + (["gone"] if step % 2 else [])
        rows = [(f"n{r.randrange(6)}", f"n{r.randrange(6)}", "R", "validated", d) for d in docs if d != "gone" for _ in range(r.randrange(6))]
        rows += rows[:2]  # a document that says the same twice counts once
        if step == 0:
            rows.append(("n0", "only", "R", "validated", docs[0]))
        nodes = [(x, "N", row[4]) for row in rows for x in row[:2]]
        store.put(give(nodes, "node_id string, label string, doc_id string"), give(rows, EDGE), give([(d,) for d in docs], "doc_id string"))
        held |= {d: {x for x in rows if x[4] == d} for d in docs}
        want = {}
        for d, own in held.items():
            for e in {x[:4] for x in own}:
                want[e] = want.get(e, 0) + 1
        assert {tuple(x)[:4]: x.n_docs for x in store.edges().collect()} == want
        at = {x for e in want for x in e[:2]}
        assert {x.node_id for x in store.nodes().collect()} == at
    store.put(give([], "node_id string, label string, doc_id string"), give([], EDGE), give([(d,) for d in held], "doc_id string"))
    assert store.nodes().count() == 0 and store.edges().count() == 0


def test_counted_graph_writes_little(spark):
    """Rows are kept by columns, and nothing that a put made on the way stays."""
    rows = spark.range(20000).selectExpr("'n' || id AS src", "'m' || id % 50 AS dst", "'R' AS rel", "'validated' AS trust_layer", "'d' || id % 40 AS doc_id")
    nodes = rows.selectExpr("src AS node_id", "'N' AS label", "doc_id")
    store, docs, before = G.CountedGraph(spark, tempfile.mkdtemp(prefix="graph-") + "/g"), rows.select("doc_id").distinct(), written(spark)
    store.put(nodes, rows, docs)
    store.put(nodes.where("doc_id = 'd1'"), rows.where("doc_id = 'd1'"), docs.where("doc_id < 'd2'"))
    assert store.edges().count() == store.nodes().count() == 14500 and written(spark) - before < 100_000


RULES = [
    Rule("r", "range", "block", "{value} out", applies_to=("a",), min=0, max=8),
    Rule("p", "pair", "block", "{a_value} over {b_value}", metric_a="a", metric_b="b", relation="le", match_on=("entity_id", "qualifiers.k")),
    Rule("q", "pair", "warn", "{a_value} is not {b_value}", metric_a="b", metric_b="a", relation="eq", match_on=("period",)),
]
CANDIDATE = "candidate_id string, entity_id string, metric_key string, value decimal(38,18), value_text string, unit string, unit_source string, qualifiers map<string,string>, period string, status string, extraction_confidence double"


def candidates(spark, r, ids):
    rows = []
    for i in ids:
        v = r.choice([None, *range(10)])
        rows.append((f"c{i}", r.choice([None, "e1", "e2", "e3"]), r.choice(["a", "b", "z"]), None if v is None else Decimal(v), None if v is None else str(v), r.choice(["m", None]), "explicit", {"k": r.choice("xy")}, r.choice(["p1", "p2", None]), "final", 0.9))
    return spark.createDataFrame(rows, CANDIDATE)


def verdicts(df):
    return sorted((x.candidate_id, x.state, x.failed_gate, x.failure_reason, x.confidence, str(x.gate_results)) for x in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_assay_of_changes_equals_a_whole_run(spark, seed):
    r = random.Random(seed)
    first = candidates(spark, r, range(40)).cache()
    found = A.findings(first, RULES)
    before = A.run_gates(first, found, ["a", "b"])
    changed = candidates(spark, r, [3, 7, 11, 50, 51]).cache()
    removed = spark.createDataFrame([("c5",), ("c6",), ("none",)], "candidate_id string")
    after, now = A.assay_after(before, found, changed, RULES, ["a", "b"], removed)
    gone = {"c5", "c6", "c3", "c7", "c11"}
    whole = first.where(~F.col("candidate_id").isin(*gone)).unionByName(changed)
    want = A.findings(whole, RULES)
    assert verdicts(after) == verdicts(A.run_gates(whole, want, ["a", "b"]))
    key = lambda df: sorted(map(tuple, df.select(*A.FINDING).collect()))
    assert key(now) == key(want)
    same, _ = A.assay_after(before, found, changed.limit(0), RULES, ["a", "b"])
    assert verdicts(same) == verdicts(before)


def test_totals_out_of_the_pass_that_writes(spark):
    r = random.Random(3)
    c = candidates(spark, r, range(30)).cache()
    judged = A.run_gates(c, A.findings(c, RULES), ["a"])
    rows, seen = A.observed_run(judged)
    rows.write.parquet(tempfile.mkdtemp(prefix="run-") + "/v")
    got = seen.get
    assert got["candidates"] == 30 and {k[6:]: n for k, n in got.items() if k.startswith("state_") and n} == {x.state: x.n for x in A.state_counts(judged).collect()}
    assert {k[7:]: n for k, n in got.items() if k.startswith("failed_") and n} == {x.failed_gate: x.n for x in A.failure_counts(judged).collect()}


def test_approximate_neighbours(spark, monkeypatch):
    """Recall of 0.9 over clustered vectors; a bucket with a third of all rows is dealt in parts and stays whole."""
    monkeypatch.setattr(S, "HELD", 50)
    g = np.random.default_rng(6)
    centres = g.normal(size=(30, 16))
    x = centres[g.integers(0, 30, 900)] + 0.2 * g.normal(size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[0].tolist()) for i in range(300)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0])]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = held.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(q.query_id, q.vec_id): q.similarity for q in S.knn(held, asked, 5).collect()}
    near = {(q.query_id, q.vec_id): q.similarity for q in S.approximate_knn(held, asked, 5, bucket=40).collect()}
    assert len(set(exact) & set(near)) >= 0.9 * len(exact)
    assert {k: near[k] for k in exact if k[0] == 2010} == {k: v for k, v in exact.items() if k[0] == 2010}
    assert S.approximate_knn(held.limit(0), asked, 5).count() == 0


def test_approximate_neighbours_without_clusters(spark):
    """Vectors of no structure, whose neighbours are hardly nearer than others: planes and probes are fitted to them."""
    x = np.random.default_rng(4).normal(size=(6000, 64))
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = held.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = lambda df: {(q.query_id, q.vec_id) for q in df.select("query_id", "vec_id").collect()}
    exact = pairs(S.knn(held, asked, 5))
    assert len(exact & pairs(S.approximate_knn(held, asked, 5, bucket=16))) >= 0.9 * len(exact)
