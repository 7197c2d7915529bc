"""Document trees as a data source: written and read back, filters that pass documents and pages over, torn pages, streams, and
the sources around them."""

import json

import pytest
from pyspark.sql import functions as F

from orewright.sources import registry as R
from orewright.sources import trees as T

ROWS = [(d, p, "text", f"p{p}-text-0", None, None, f"{d} page {p}", None, None, None, None, None) for d in ("a", "b", "c") for p in (1, 2, 3)]
ROWS += [("a", 2, "cell", "t0", r, c, f"{r}.{c}", r == 0, 0.0, 1.0, 2.0, 3.0) for r in range(3) for c in range(2)]


@pytest.fixture
def trees(spark, tmp_path):
    spark.dataSource.register(T.DocumentTrees)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    T.write_trees(spark.createDataFrame(ROWS, T.SCHEMA).repartition(4), str(tmp_path / "trees"))
    return str(tmp_path / "trees")


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_written_and_read_back(spark, trees):
    df = spark.read.format("document_trees").option("path", trees).option("files_per_partition", 2).load()
    assert told(df) == sorted(ROWS, key=repr) and df.rdd.getNumPartitions() == 2
    T.write_trees(spark.createDataFrame([ROWS[3]], T.SCHEMA), trees)  # a document replaces its file
    again = spark.read.format("document_trees").option("path", trees).load()
    assert told(again.where("doc_id = 'b'")) == [ROWS[3]] and again.where("doc_id <> 'b'").count() == len(ROWS) - 3
    assert spark.read.format("document_trees").option("path", trees + "/none").load().count() == 0


def test_what_is_not_asked_for_is_not_parsed(spark, trees):
    df = spark.read.format("document_trees").option("path", trees).load()
    assert told(df.where("doc_id in ('a', 'c') and page_no between 2 and 3 and kind = 'text'")) == [x for x in sorted(ROWS, key=repr) if x[0] in "ac" and x[1] in (2, 3) and x[2] == "text"]
    reader = T.TreeReader(trees, 64)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan

    left = list(reader.pushFilters([EqualTo(("doc_id",), "a"), GreaterThanOrEqual(("page_no",), 2), LessThan(("page_no",), 3), IsNotNull(("page_no",)), EqualTo(("kind",), "cell")]))
    assert len(left) == 2 and (reader.wanted.low, reader.wanted.high) == (2, 2)
    (part,) = reader.partitions()
    before = T.PARSED["lines"]
    rows = list(reader.read(part))
    assert T.PARSED["lines"] - before == 1 and {r[:2] for r in rows} == {("a", 2)} and len(rows) == 7


def test_a_torn_page_is_its_own_failure(spark, trees):
    with open(f"{trees}/torn.jsonl", "w") as f:
        f.write('1\t{"texts": [{"element_id": "x", "text": "fine"}]}\n2\t{"texts": [\n\nno number\n')
    df = spark.read.format("document_trees").option("path", trees).load().where("doc_id = 'torn'")
    assert sorted((x.page_no, x.kind, x.element_id) for x in df.collect()) == [(1, "text", "x"), (2, "failed", "page-2-failed")]


def test_documents_that_arrive(spark, trees, tmp_path):
    def run():
        q = spark.readStream.format("document_trees").option("path", trees).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return spark.read.schema(T.SCHEMA).parquet(str(tmp_path / "out"))

    assert told(run()) == sorted(ROWS, key=repr)
    more = ("d", 7, "text", "p7-text-0", None, None, "new", None, None, None, None, None)
    T.write_trees(spark.createDataFrame([more], T.SCHEMA), trees)
    assert told(run()) == sorted([*ROWS, more], key=repr)


def test_vault_and_files(spark, tmp_path):
    """Content is kept once, whatever the number of files and of puts, and found by its hash."""
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two"), ("d.bin", "three")):
        (tmp_path / "in" / name).write_text(text)
    files = R.read_files(spark, str(tmp_path / "in"), "*.txt")
    assert files.count() == 3 and files.select("artifact_id").distinct().count() == 2
    vault = str(tmp_path / "vault")
    R.vault_put(files, vault)
    R.vault_put(R.read_files(spark, str(tmp_path / "in")), vault)
    assert spark.read.parquet(vault).count() == 3
    one = files.where("path like '%a.txt'").first()
    assert bytes(R.vault_get(spark, vault, one.artifact_id).first().content) == b"one" and R.vault_get(spark, vault, "ff" * 32).count() == 0
    assert files.where("path like '%a.txt'").select(R.vault_path()).first()[0] == f"{one.artifact_id[:2]}/{one.artifact_id}"
    assert R.exists(spark, vault) and not R.exists(spark, vault + "2")


def test_whole_trees_and_json_log(spark, tmp_path):
    (tmp_path / "t").mkdir()
    tree = {"schema_name": "s", "version": "1", "doc_id": "d", "texts": [{"element_id": "e", "page_no": 1, "text": "x"}], "tables": [{"element_id": "t", "page_no": 1, "num_rows": 1, "num_cols": 1, "tier": 1, "confidence": 0.9, "cells": [{"row": 0, "col": 0, "text": "v"}]}]}
    (tmp_path / "t" / "d.json").write_text(json.dumps(tree))
    read = R.read_trees(spark, str(tmp_path / "t"))
    texts, tables, cells = R.tree_tables(read)
    assert (texts.first().text, tables.first().num_cols, cells.first().text, len(read.first().ast_hash)) == ("x", 1, "v", 64)
    log = spark.createDataFrame([("u", 3)], "who string, n int")
    R.append_json(log, str(tmp_path / "log"))
    R.append_json(log.withColumn("n", F.lit(4)), str(tmp_path / "log"))
    assert sorted(x.n for x in spark.read.json(str(tmp_path / "log")).collect()) == [3, 4]
    R.overwrite_documents(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int"), str(tmp_path / "p"))
    R.overwrite_documents(spark.createDataFrame([("a", 9)], "doc_id string, n int"), str(tmp_path / "p"))
    assert {(x.doc_id, x.n) for x in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 9), ("b", 2)}
