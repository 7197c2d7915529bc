"""The kept index against BM25 over whole texts, through puts, replacements and deletions."""

import random
import tempfile

import pytest

from orewright.operators import search as S
from orewright.operators.textindex import TextIndex

r = random.Random(3)
WORDS = ["alpha", "Beta", "gamma", "été", "x9", "SKM-12", "of", "the"]
SCHEMA = "chunk_id string, doc_id string, parent_id string, indexed_text string, raw_text string, classification string"
QUESTIONS = ["alpha", "of the", "the of the", "SKM-12", "beta gamma", "été x9 alpha", "none here", "the the the", ""]


def chunks(n, tag, docs):
    rows = [(f"{tag}{i}", f"d{i % docs}", None, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 25))), "raw", ["public", "restricted"][i % 2]) for i in range(n)]
    return rows + [(f"{tag}null", f"d{docs}", None, None, "raw", "public"), (f"{tag}long", f"d{docs}", None, "the of " * 5000, "raw", "public")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def scores(df):
    return sorted((x.query_id, x.chunk_id, round(x.score, 9)) for x in df.collect())


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string").selectExpr("cast(query_id as string) query_id", "query")


@pytest.mark.parametrize("segment_words", [40, 1_000_000])
def test_scores_through_replacement_and_deletion(spark, segment_words):
    index = TextIndex(spark, tempfile.mkdtemp(prefix="index-") + "/i", buckets=7, segment_words=segment_words)
    assert index.search("alpha").count() == 0 and index.numbers() == (0, 0, 0)
    held = chunks(60, "a", 20)
    index.put(frame(spark, held))
    again = [x for x in chunks(30, "b", 40) if x[1] not in ("d3",)]
    index.put(frame(spark, again))
    held = [x for x in held if x[1] not in {y[1] for y in again}] + again
    index.delete(spark.createDataFrame([("d3",), ("d9",), ("unknown",)], "doc_id string"))
    held = [x for x in held if x[1] not in ("d3", "d9")]
    now = frame(spark, held)
    want = scores(S.bm25_many(now, asked(spark)))
    assert scores(index.search_many(asked(spark))) == want and len(want) > 20
    one = sorted((x.chunk_id, round(x.score, 9)) for x in S.bm25(now, "of the").collect())
    assert sorted((x.chunk_id, round(x.score, 9)) for x in index.search("of the", 10**6).collect()) == one
    seen = index.search("of the", 3, ["public"]).collect()
    best = sorted((x for x in S.search_evidence(now, "of the", 3, ["public"]).collect()), key=lambda x: (-x.score, x.chunk_id))
    assert [x.chunk_id for x in seen] == [x.chunk_id for x in best]
    index.put(frame(spark, held[:0]))
    assert scores(index.search_many(asked(spark))) == want


def test_only_the_asked_folders_are_read(spark):
    index = TextIndex(spark, tempfile.mkdtemp(prefix="index-") + "/i", buckets=64)
    index.put(frame(spark, chunks(40, "a", 9)))
    files = index.postings(["alpha"]).inputFiles()
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:80] and "PushedFilters: [" in plan and len(files) > 1
    assert index.postings(["alpha"]).count() >= 1


def test_a_put_that_did_not_finish_is_not_seen(spark):
    path = tempfile.mkdtemp(prefix="index-") + "/i"
    index = TextIndex(spark, path)
    index.put(frame(spark, chunks(10, "a", 3)))
    before = scores(index.search_many(asked(spark)))
    index._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))  # after the postings, before the log
    with pytest.raises(RuntimeError):
        index.put(frame(spark, chunks(10, "b", 3)))
    assert scores(TextIndex(spark, path).search_many(asked(spark))) == before


def test_many_questions_score_as_each_alone(spark, monkeypatch):
    """Single words, runs of two with themselves, longer and empty questions, those alike; the ablation searches each text once."""
    from orewright.operators import search as S

    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "b", "c", "the"]) for _ in range(r.randrange(8))) for _ in range(60)] + [None, "", "a", "the the the the"]
    chunks = spark.createDataFrame([(f"c{i}", None, t, t) for i, t in enumerate(texts)], "chunk_id string, parent_id string, raw_text string, indexed_text string")
    asked = ["a", "The the", "a b", "a, B", "b a c", "the the the", "c a b a", "a z", "", "z"]
    q = spark.createDataFrame([(i, t, None if i == 9 else t) for i, t in enumerate(asked)], "query_id int, query string, expected string")
    key = lambda rows: sorted((x.chunk_id, round(x.score, 9)) for x in rows)
    many = S.bm25_many(chunks, q).collect()
    for i, t in enumerate(asked):
        assert key(x for x in many if x.query_id == i) == (key(S.bm25(chunks, t).collect()) if t else [])
    one, calls = S.bm25_many, []
    monkeypatch.setattr(S, "bm25_many", lambda *a: calls.append(a) or one(*a))
    rows = {x.arm: (x.hits, x.questions) for x in S.ablation(chunks, q).collect()}
    assert len(calls) == 2 and set(rows) == {"lexical", "rerank", "prefix", "parent"} and rows["lexical"] == rows["prefix"]
