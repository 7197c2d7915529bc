"""Document trees as a data source: `spark.read.format("document_trees")` and, for documents that arrive, `readStream`.

A tree is one JSON object per line (see `registry.TREE` for its shape), in `.jsonl` files named by document: `<doc_id>.jsonl`
holds one line of document facts and then one line per page, so a page that is not asked for is passed over by its leading
number, without being parsed. A partition is some files; filters on doc_id choose files by their names, and filters on page_no
choose lines. Paths go through pyarrow's file systems, so any store that it knows works from every executor.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "doc_id string, page_no int, kind string, element_id string, row int, col int, text string, column_header boolean, l double, t double, r double, b double"
FIELDS = ("element_id", "row", "col", "text", "column_header", "l", "t", "r", "b")
FILES_PER_PARTITION = 64
#: How many lines were parsed, in this process: for tests of what is passed over.
PARSED = {"lines": 0}


@dataclass
class Wanted:
    """What the pushed filters leave: documents (None: all) and a range of pages."""

    docs: frozenset[str] | None = None
    low: float = float("-inf")
    high: float = float("inf")

    def take(self, f: Filter) -> bool:
        """Whether a filter is answered here for good."""
        name = getattr(f, "attribute", None)
        if name == ("doc_id",) and isinstance(f, (EqualTo, In)):
            asked = frozenset(f.value if isinstance(f, In) else [f.value])
            self.docs = asked if self.docs is None else self.docs & asked
            return True
        if name == ("page_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual))
            high = isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
            self.low = max(self.low, f.value + (1 if isinstance(f, GreaterThan) else 0)) if low else self.low
            self.high = min(self.high, f.value - (1 if isinstance(f, LessThan) else 0)) if high else self.high
            return True
        return False


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)
    wanted: Wanted = field(default_factory=Wanted)


def _doc_of(path: str) -> str:
    return posixpath.basename(path).removesuffix(".jsonl")


def _files(root: str) -> list[tuple[str, int]]:
    """Path and time of change (nanoseconds) of every tree under a folder, in order of both."""
    store, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(((x.path, x.mtime_ns or 0) for x in found if x.is_file and x.path.endswith(".jsonl")), key=lambda x: (x[1], x[0]))


def read_file(root: str, path: str, wanted: Wanted) -> Iterator[tuple]:
    """The rows of one document: its texts and the cells of its tables, page by page. A line that is torn tells so as a row."""
    store = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
    doc = _doc_of(path)
    with store.open_input_stream(path) as stream:
        for line in stream.read().splitlines():
            number, _, body = line.partition(b"\t")
            if not number.strip().isdigit() or not wanted.low <= int(number) <= wanted.high:
                continue
            page = int(number)
            PARSED["lines"] += 1
            try:
                tree = json.loads(body)
                rows = [(doc, page, "text", *[x.get(f) for f in FIELDS]) for x in tree.get("texts", [])]
                rows += [(doc, page, "cell", t.get("element_id"), *[c.get(f) for f in FIELDS[1:]]) for t in tree.get("tables", []) for c in t.get("cells", [])]
            except (ValueError, AttributeError) as e:  # one page's own failure
                rows = [(doc, page, "failed", f"page-{page}-failed", None, None, f"{type(e).__name__}: {e}", None, None, None, None, None)]
            yield from rows


class TreeReader(DataSourceReader):
    def __init__(self, root: str, per: int):
        self.root, self.per, self.wanted = root, per, Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in _files(self.root) if self.wanted.docs is None or _doc_of(p) in self.wanted.docs]
        return [Files(paths[i : i + self.per], self.wanted) for i in range(0, len(paths), self.per)] or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from read_file(self.root, path, partition.wanted)


class TreeStream(DataSourceStreamReader):
    """Documents by their time of change: an offset is the last one given out (time and path)."""

    def __init__(self, root: str, per: int):
        self.root, self.per = root, per

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.root)
        return {"at": files[-1][1], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [p for p, at in _files(self.root) if (start["at"], start["path"]) < (at, p) <= (end["at"], end["path"])]
        return [Files(new[i : i + self.per]) for i in range(0, len(new), self.per)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from read_file(self.root, path, partition.wanted)


class DocumentTrees(DataSource):
    """Options: path, and files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "document_trees"

    def schema(self) -> str:
        return SCHEMA

    def _how(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("files_per_partition", FILES_PER_PARTITION))

    def reader(self, schema) -> TreeReader:
        return TreeReader(*self._how())

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(*self._how())


def write_trees(elements: DataFrame, path: str) -> None:
    """Rows of `SCHEMA` as document trees, a file per document, written by the tasks; a document in `elements` replaces its file."""
    row = F.struct(*FIELDS)
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", row)))
    tables = elements.where("kind = 'cell'").groupBy("doc_id", "page_no", "element_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS[1:]))).alias("cells"))
    tables = tables.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("element_id", "cells"))).alias("tables"))
    pages = elements.groupBy("doc_id", "page_no").agg(texts.alias("texts")).join(tables, ["doc_id", "page_no"], "left")
    lines = pages.select("doc_id", "page_no", F.to_json(F.struct("texts", "tables")).alias("body"))

    def put(batches):
        for batch in batches:
            for doc, own in batch.groupby("doc_id"):
                store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                store.create_dir(root, recursive=True)
                with store.open_output_stream(f"{root}/{doc}.jsonl") as out:
                    for page, body in sorted(zip(own["page_no"], own["body"])):
                        out.write(f"{page}\t{body}\n".encode())
                yield own[["doc_id"]].head(1)

    # A document's pages must come in one batch: one row per document first.
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "body"))).alias("p"))

    def each(batches):
        for batch in batches:
            yield from put([batch.explode("p").assign(page_no=lambda d: d["p"].map(lambda x: x["page_no"]), body=lambda d: d["p"].map(lambda x: x["body"]))])

    whole.mapInPandas(each, "doc_id string").write.format("noop").mode("overwrite").save()
