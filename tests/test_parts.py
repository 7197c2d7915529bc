"""Small parts: model interfaces with fallbacks and memory, the seeded hierarchy, chunks with their candidates, text blocks."""

import pandas as pd
from pyspark.sql import functions as F

from orewright.operators import broker as B
from orewright.operators import graph as G
from orewright.operators import language as N
from orewright.operators import profile as P
from orewright.operators import search as S


def test_the_first_backend_that_works_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)

    def broken(batch):
        raise ConnectionError("no network")

    got = N.with_fallback(df, [broken, lambda b: b["text"].str.upper()], "out").collect()
    assert {(x.text, x.out, x.out_error) for x in got} == {("a", "A", None), ("b", "B", None)}
    none = N.with_fallback(df, [broken], "out").collect()
    assert {(x.out, x.out_error) for x in none} == {(None, "ConnectionError: no network")}
    assert N.with_fallback(df.limit(0), [broken], "out").count() == 0


def test_answers_are_remembered_by_the_whole_content(spark):
    requests = spark.createDataFrame([("claim", "evidence 1"), ("claim", "evidence 2")], "claim string, evidence string")
    key = F.concat_ws("\x1f", "claim", "evidence")
    cache = requests.where("evidence like '%1'").select(F.sha2(key, 256).alias("key"), F.lit("yes").alias("answer"))
    known, asked = N.memoised(requests, cache, key)
    assert [(x.evidence, x.answer) for x in known.collect()] == [("evidence 1", "yes")] and [x.evidence for x in asked.collect()] == ["evidence 2"]


def test_rankings_as_scores(spark):
    assert N.rank_scores([2, 0, 9, -1], 3) == [(2, 1.0), (0, 0.5)]
    assert N.rank_scores([], 3) == []
    ranked = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "chunk_id string, score double")
    assert [x.chunk_id for x in N.pass_through(ranked, 2).collect()] == ["b", "c"]
    assert isinstance(pd.Series([1]), pd.Series)


def test_seeding_a_hierarchy_twice_adds_nothing(spark):
    registry = spark.createDataFrame([("d1", "P"), ("d2", "Q"), ("d3", "P")], "doc_id string, publisher string")
    chain = [("office", "o"), ("state", "s"), ("country", "c")]
    once = G.seed_hierarchy(registry, "P", chain).drop("props")
    want = {("office:o", "state:s", "PART_OF"), ("state:s", "country:c", "PART_OF"), ("document:d1", "office:o", "PUBLISHED_UNDER"), ("document:d3", "office:o", "PUBLISHED_UNDER")}
    assert {(x.src, x.dst, x.rel) for x in once.collect()} == want
    assert once.unionByName(G.seed_hierarchy(registry, "P", chain).drop("props")).distinct().count() == 4
    assert G.seed_hierarchy(registry, "none", chain[:1]).count() == 0


def test_chunks_take_their_class_and_the_first_candidate_of_their_row(spark):
    registry = spark.createDataFrame([("d", "T", "P", "restricted")], "doc_id string, title string, publisher string, classification string")
    texts = spark.createDataFrame([("d", "e1", 2, "hello")], "doc_id string, element_id string, page_no int, text string")
    tables = spark.createDataFrame([("d", "t", 3)], "doc_id string, element_id string, page_no int")
    cells = spark.createDataFrame([("d", "t", 0, 0, "Head", True), ("d", "t", 1, 0, "x", False), ("d", "t", 1, 1, None, False), ("d", "t", 2, 0, " ", False), ("d", "t", 12, 0, "y", False)], "doc_id string, element_id string, row int, col int, text string, column_header boolean")
    candidates = spark.createDataFrame([("c2", "d", "t", "r1c1"), ("c1", "d", "t", "r1c0"), ("c9", "d", "t", "r12c0")], "candidate_id string, doc_id string, table_ref string, cell_ref string")
    got = {x.chunk_id: x for x in S.build_chunks(registry, texts, tables, cells, candidates).collect()}
    assert set(got) == {"d:text:e1", "d:table:t", "d:row:t:1", "d:row:t:12"} and {x.classification for x in got.values()} == {"restricted"}
    assert (got["d:row:t:1"].candidate_id, got["d:row:t:12"].candidate_id, got["d:table:t"].candidate_id) == ("c1", "c9", None)
    assert got["d:row:t:1"].indexed_text == "Document: T. Publisher: P. Table on page 3, columns: Head. x" and got["d:row:t:1"].parent_id == "d:table:t"


def test_text_blocks_are_numbered_before_blank_ones_go(spark):
    pages = spark.createDataFrame([("d", 1, "one\n\n  \n\nthree "), ("d", 2, None), ("d", 3, "")], "doc_id string, page_no int, text string")
    assert [(x.element_id, x.text) for x in P.text_blocks(pages).orderBy("pos").collect()] == [("p1-text-0", "one"), ("p1-text-1", "three")]
    grade = lambda text, tier, head, ocr=None: spark.range(1).select(P.element_confidence(F.lit(text), F.lit(tier), F.lit(1.0), F.lit(head), ocr).alias("c")).first().c
    assert (grade("x", 1, True), grade("x", 2, True), grade("x", 1, False), grade(" ", 1, True), grade("x", 1, True, F.lit(0.4))) == (0.95, 0.5, 0.3, 0.0, 0.4)


def test_audit_of_a_log_of_calls(spark, tmp_path):
    calls = spark.createDataFrame([("u", "get_fact"), ("u", "replay"), ("v", "get_fact"), ("u", "drop"), ("u", None)], "subject string, tool string").withColumn("ts", F.current_timestamp())
    scopes = spark.createDataFrame([("u", ["get_fact"])], "subject string, scopes array<string>")
    got = {(x.subject, x.tool, x.allowed, x.reason) for x in B.audit_calls(calls, scopes).collect()}
    assert got == {("u", "get_fact", True, None), ("u", "replay", False, "not in scope"), ("v", "get_fact", False, "unknown caller"), ("u", "drop", False, "unknown tool"), ("u", None, False, "unknown tool")}
    b = B.Broker(spark, B.Principal("narrow", ("public",), frozenset({"get_fact"})), {})
    for _ in range(2):
        b.get_fact("m")
        try:
            b.call("replay", package_id="x")
        except B.AccessDenied:
            pass
        b.flush_audit(str(tmp_path / "log"))
        b.flush_audit(str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("tool", "allowed").count().count() == 2 and b.audit == [] and spark.read.parquet(str(tmp_path / "log")).count() == 4
