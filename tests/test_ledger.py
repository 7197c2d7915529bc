"""The ledger, statements, graph, lineage and the broker."""

import json
from datetime import datetime, timezone
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orewright.operators import graph, ledger, lineage
from orewright.operators.broker import PUBLIC, AccessDenied, Broker, Principal, assert_exportable
from orewright.sources.registry import buckets, plan_manifest, register, run_manifest

OBSERVED = "candidate_id string, entity_id string, metric_key string, qualifiers map<string,string>, period string, value_kind string, value decimal(38,18), value_text string, unit string, source struct<doc_id: string>, observed_at timestamp"


def at(day):
    return datetime(2026, 1, day, tzinfo=timezone.utc)


def rows(spark, *values, doc="d1"):
    return spark.createDataFrame([(f"c{i}", "E", "m", q, "p", "point", Decimal(v), v, u, (doc,), at(d)) for i, (v, u, q, d) in enumerate(values)], OBSERVED)


def test_versions_noop_and_as_of(spark):
    book = ledger.publish(rows(spark, ("1.80", None, {"a": "1", "b": "2"}, 1), ("1.80", None, {"b": "2", "a": "1"}, 2), ("1.90", None, {"a": "1", "b": "2"}, 3))).cache()
    v = book.orderBy("version").collect()
    assert [str(x.value_text) for x in v] == ["1.80", "1.90"]
    assert v[0].system_to == v[1].system_from and v[1].supersedes == v[0].fact_id and v[1].system_to is None
    assert ledger.as_of(book, "2026-01-02 00:00:00").first().value_text == "1.80"
    assert ledger.current_facts(book, entity_id="E").first().value_text == "1.90"
    assert ledger.history(book, v[0].fact_identity).count() == 2


def test_publish_into_equals_publish_of_all(spark):
    """In every column, the last observation of a version that stays included."""
    a, b = rows(spark, ("5", "m", {}, 1), ("5", "m", {}, 3), ("6", "m", {"k": "v"}, 2)), rows(spark, ("7", "m", {}, 4), ("7", "m", {}, 6))
    told = lambda df: df.orderBy("fact_identity", "version").drop("candidate_id", "fact_id", "supersedes").collect()
    step, whole = ledger.publish_into(ledger.publish(a), b), ledger.publish(a.union(b))
    assert told(step.select(*whole.columns)) == told(whole)
    assert [x.last_seen.day for x in told(step) if x.qualifiers == {}] == [3, 6]
    again = ledger.publish_into(step, rows(spark, ("7", "m", {}, 8)))
    assert [x.last_seen.day for x in told(again) if x.qualifiers == {}] == [3, 8]


def test_fact_ids_do_not_depend_on_the_time_zone(spark):
    data = rows(spark, ("5", "m", {}, 1), ("6", "m", {}, 3))
    ids = []
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        ids.append([x.fact_id for x in ledger.publish(data).orderBy("version").collect()])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ids[0] == ids[1]


def test_late_values_are_refused(spark):
    """A repeat makes no version, but the ledger knows when it was seen: a value before it is late."""
    book = ledger.publish(rows(spark, ("5", "m", {}, 1), ("5", "m", {}, 3)))
    assert book.count() == 1
    with pytest.raises(ledger.LateValue):
        ledger.publish_into(book, rows(spark, ("7", "m", {}, 2)))
    assert ledger.publish_into(book, rows(spark, ("7", "m", {}, 4))).count() == 2


def test_contradictions_need_two_documents_and_values(spark):
    one, two = ledger.publish(rows(spark, ("3.42", "m", {}, 1))), ledger.publish(rows(spark, ("9.99", "m", {}, 1), doc="d2"))
    three = ledger.publish(rows(spark, ("3.420", "m", {}, 1), doc="d3"))
    st = ledger.statements
    group = ledger.contradictions(st(one).union(st(two)).union(st(two))).collect()
    assert [(x.n_docs, x.n_values, x.n_members) for x in group] == [(2, 2, 3)]
    assert {(x.doc_id, x.value_text) for x in ledger.contradiction_members(st(one).union(st(two))).collect()} == {("d1", "3.42"), ("d2", "9.99")}
    assert ledger.contradictions(st(one).union(st(three))).count() == 0
    assert ledger.contradictions(st(one).union(st(three)), strict_text=True).count() == 1


def test_paths_respect_trust(spark):
    e = spark.createDataFrame([("b", "s", "INTERSECTS", "validated"), ("s", "k", "IN_BLOCK", "derived"), ("s", "k", "IN_BLOCK", "derived")], "src string, dst string, rel string, trust_layer string")
    start = spark.createDataFrame([("b",)], "node string")
    assert graph.multi_hop(e, start, max_hops=3).where("node = 'k'").count() == 1
    assert graph.multi_hop(e, start, max_hops=3, bag=True).where("node = 'k'").count() == 2
    assert graph.multi_hop(e, start, trust_layers=["validated"], max_hops=3).where("node = 'k'").count() == 0


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([(1, "fact", "f", "candidate", "c"), (2, "package", "p", "fact", "f"), (3, "answer", "a", "package", "p"), (4, "package", "p", "package", "q"), (5, "package", "q", "package", "p")], "id long, from_kind string, from_id string, to_kind string, to_id string")
    start = spark.createDataFrame([("answer", "a")], "kind string, id string")
    assert {(r.kind, r.id) for r in lineage.closure(e, start).collect()} == {("answer", "a"), ("package", "p"), ("package", "q"), ("fact", "f"), ("candidate", "c")}
    assert [r.id for r in lineage.trace_back(e, start).orderBy("depth").collect()] == ["a", "p", "f", "c"]
    fact = spark.createDataFrame([("fact", "f")], "kind string, id string")
    assert ("answer", "a") in {(r.kind, r.id) for r in lineage.closure(e, fact, forward=True).collect()}


def chunks(spark):
    row = lambda i, text, level: (i, None, i, text, text, level, None)
    return spark.createDataFrame([row("a", "bore SKM-12 here", "public"), row("b", "bore SKM-12 there", "restricted"), row("c", "nothing", "public")], "chunk_id string, parent_id string, doc_id string, indexed_text string, raw_text string, classification string, candidate_id string")


def test_broker_filters_logs_and_seals(spark):
    book = ledger.publish(rows(spark, ("1", "m", {}, 1)))
    b = Broker(spark, PUBLIC, {"chunk": chunks(spark), "fact": book})
    assert [r.chunk_id for r in b.search_evidence("SKM 12").collect()] == ["a"]
    with pytest.raises(AccessDenied):
        b.call("drop_everything")
    first = b.seal_evidence_package("i", "skm 12", ["m"])
    assert b.seal_evidence_package("i", "skm 12", ["m"]) == first and b.tables["sealed_package"].count() == 1
    assert {(x.intent, x.kind, x.member_id) for x in b.replay(first).collect()} >= {("i", "passage", "a"), ("i", "coverage", "m")}
    assert b.replay("SEP-none").count() == 0
    assert {(r.tool, r.allowed) for r in b.audit_log().collect()} >= {("drop_everything", False), ("search_evidence", True)}
    high = Broker(spark, Principal("r", ("public", "restricted")), b.tables).seal_evidence_package("j", None, ["m"])
    with pytest.raises(AccessDenied):
        b.replay(high)
    with pytest.raises(AccessDenied):
        assert_exportable(["public", "restricted"])


def test_traces_hide_documents_of_others(spark):
    """Edges at facts, passages and packages that a caller may not see are no steps of a walk; ids are stable."""
    open_, shut = ledger.publish(rows(spark, ("1", "m", {}, 1), doc="open")), ledger.publish(rows(spark, ("2", "m", {"a": "1"}, 1), doc="shut"))
    registry = spark.createDataFrame([("open", "public"), ("shut", "restricted")], "doc_id string, classification string")
    high = Broker(spark, Principal("r", ("public", "restricted")), {"fact": open_.union(shut), "source_registry": registry, "chunk": chunks(spark)})
    package = high.seal_evidence_package("all", "skm 12", ["m", "n"])
    high.record_answer("a1", package)
    assert [x.id for x in high.tables["lineage_edge"].orderBy("id").collect()] == [x.id for x in high.tables["lineage_edge"].orderBy("id").collect()]
    assert {x.kind for x in high.get_trace_graph("answer", "a1").collect()} == {"answer", "package", "fact", "passage"}
    low = Broker(spark, PUBLIC, high.tables)
    assert {(x.kind, x.id) for x in low.get_trace_graph("answer", "a1").collect()} == {("answer", "a1")}
    fact = shut.first().fact_id
    assert low.revision_impact(fact, "9").count() == 0 and high.revision_impact(fact, "9").first().n_affected == 2
    mine = low.seal_evidence_package("mine", "skm 12", ["m", "n"])
    assert {x.member_id for x in low.replay(mine).where("kind in ('fact', 'passage')").collect()} == {open_.first().fact_id, "a"}
    assert low.seal_evidence_package("mine", "skm 12", ["n", "m"]) == mine
    both = low.merge_packages([mine, low.seal_evidence_package("other", None, ["m"])], "both")
    assert low.replay(both).where("kind = 'coverage'").count() == 2 and low.merge_packages([mine, mine], "both") == both
    assert low.additions > high.additions


def test_questions_to_recorded_answers(spark):
    from orewright.operators.agents import answer_questions

    book = ledger.publish(rows(spark, ("1.5", "m", {}, 1), ("4", "m", {"a": "1"}, 1)))
    b = Broker(spark, PUBLIC, {"fact": book})
    asked = spark.createDataFrame([("q1", "Of m", "m", None), ("q2", "Of E", "m", "E"), ("q3", "Of none", "never", None)], "question_id string, title string, metric_key string, entity_id string")
    got = {x.question_id: x for x in answer_questions(b, asked).collect()}
    assert (got["q1"].status, got["q1"].n_facts, got["q1"].total) == ("answered", 2, Decimal("5.5")) and got["q1"].text.startswith("Of m: m is ")
    assert (got["q3"].status, got["q3"].text, got["q3"].reason) == ("not_covered", None, "NOT_DIGITISED")
    assert {x.kind for x in b.get_trace_graph("answer", "q2").collect()} == {"answer", "package", "fact"} and b.get_trace_graph("answer", "q3").count() == 1


def test_pages_fail_alone(spark):
    from orewright.operators import profile

    def read(row):
        if row["page_no"] == 2:
            raise ValueError("torn")
        return f"text {row['page_no']}"

    got = profile.read_pages(spark.createDataFrame([("d", i) for i in (1, 2, 3)], "doc_id string, page_no int"), read)
    assert [(x.element_id, x.reason) for x in profile.failed_pages(got).collect()] == [("page-2-failed", "ValueError: torn")]
    assert sorted(x.text for x in got.where("error is null").collect()) == ["text 1", "text 3"]


def test_graph_store_and_vectors(spark, tmp_path):
    from orewright.operators import search

    store = graph.GraphStore(spark, str(tmp_path / "g"))
    edge = lambda a, b, d: (a, b, "IN", "validated", {}, None, d)
    kind = "src string, dst string, rel string, trust_layer string, props map<string,string>, fact_id string, doc_id string"
    node = spark.createDataFrame([("a", "A", "g", {}, "d1")], "node_id string, label string, graph string, props map<string,string>, doc_id string")
    store.put(node, spark.createDataFrame([edge("a", "b", "d1"), edge("b", "c", "d2")], kind))
    store.put(node, spark.createDataFrame([edge("a", "x", "d1")], kind))
    assert {(x.src, x.dst) for x in store.edges().collect()} == {("a", "x"), ("b", "c")} and store.neighbours("a").count() == 1
    assert store.multi_hop(spark.createDataFrame([("c",)], "node string"), max_hops=2).count() == 1
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    more = search.upsert_vectors(held, spark.createDataFrame([(2, [1.0, 0.1]), (3, [0.0, 2.0])], held.schema))
    asked = spark.createDataFrame([(9, [0.0, 3.0])], "query_id long, q array<float>")
    assert more.count() == 3 and [x.vec_id for x in search.knn(more, asked, 2).orderBy("rank").collect()] == [3, 2]


def test_manifest_isolates_failures_and_registering_is_idempotent(spark):
    m = spark.createDataFrame([("a", None), ("b", "u"), ("c", "u"), ("d", None)], "doc_id string, source_url string")
    plan = plan_manifest(m, spark.createDataFrame([("x",)], "doc_id string"), spark.createDataFrame([("a",)], "doc_id string"))

    def ingest(row):
        if row["doc_id"] == "c":
            raise ValueError("bad page")

    assert {r.bucket: r.doc_ids for r in buckets(run_manifest(plan, ingest)).collect()} == {"skipped": ["a"], "ingested": ["b"], "failed": ["c"], "no_source": ["d"]}
    reg = spark.createDataFrame([("a", "h1", at(1))], "doc_id string, artifact_id string, registered_at timestamp")
    more = spark.createDataFrame([("a", "h2", at(2)), ("b", "h3", at(2))], reg.schema)
    once = register(reg, more)
    assert {(r.doc_id, r.artifact_id) for r in once.collect()} == {("a", "h2"), ("b", "h3")} == {(r.doc_id, r.artifact_id) for r in register(once, more).collect()}


def test_a_package_tells_the_coverage_of_each_metric(spark):
    """One pass for all metrics asked for, repeated ones once; each is a decision of its own in the log."""
    one = rows(spark, ("1", None, {}, 1))
    held = ledger.publish(one.unionByName(one.withColumn("metric_key", F.lit("n"))))
    b = Broker(spark, PUBLIC, {"fact": held, "chunk": chunks(spark)})
    package = b.seal_evidence_package("both", None, ["m", "none", "n", "m"])
    told = [json.loads(x.body) for x in b.replay(package).where("kind = 'coverage'").collect()]
    assert sorted((x["metric_key"], x["covered"], x["fact_count"], x.get("reason")) for x in told) == [("m", True, 1, None), ("n", True, 1, None), ("none", False, 0, "NOT_DIGITISED")]
    assert [r.tool for r in b.audit_log().collect()].count("check_coverage") == 4
    empty = b.seal_evidence_package("nothing", None, [])
    assert b.replay(empty).collect()[0].kind is None
    narrow = Broker(spark, Principal("s", ("public",), scopes=frozenset({"seal_evidence_package"})), b.tables)
    with pytest.raises(AccessDenied):
        narrow.seal_evidence_package("both", None, ["m"])
