"""The property graph: derived nodes and edges, neighbours, and paths of several hops."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, dropped, fresh_path, stored
from ..sources.registry import exists, overwrite_documents
from .ledger import current_facts

STATES = ("auto_passed", "pending_review", "published")
EDGE = ["src", "dst", "rel", "trust_layer", "props", "fact_id", "doc_id"]


def _props(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def _one(src: Column, dst: Column, rel: str, trust: str, props: Column | None = None, fact: Column | None = None) -> Column:
    """An edge without its document, as a struct."""
    fact = F.lit(None).cast("string") if fact is None else fact
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.lit(trust).alias("trust_layer"), (_props() if props is None else props).alias("props"), fact.alias("fact_id"))


def _edge(df: DataFrame, src: Column, dst: Column, rel: str, trust: str) -> DataFrame:
    return df.select(_one(src, dst, rel, trust).alias("e"), "doc_id").select("e.*", "doc_id")


def _id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def seam_links(candidates: DataFrame) -> DataFrame:
    """doc_id, candidate_id, seam, boreholes: the two kinds of table name the seam in different roles."""
    usable = candidates.where(F.col("state").isin(*STATES) & F.col("entity_id").isNotNull())
    by_borehole = F.col("domain_type") == "seam_thickness_table"
    seam = F.when(by_borehole, F.try_element_at("qualifiers", F.lit("seam"))).otherwise(F.col("entity_id"))
    refs = F.filter(F.split(F.coalesce(F.try_element_at("qualifiers", F.lit("source_boreholes")), F.lit("")), ";"), lambda x: x != "")
    return usable.select("doc_id", "candidate_id", "metric_key", "value_kind", seam.alias("seam"), F.when(by_borehole, F.array("entity_id")).otherwise(refs).alias("boreholes")).where("seam is not null and seam <> ''")


def build_edges(registry: DataFrame, candidates: DataFrame, ledger: DataFrame, bag: bool = False) -> DataFrame:
    """Edges of all documents. As a set unless `bag`, which keeps one per candidate."""
    doc, block = _id("document", F.col("doc_id")), _id("block", F.col("doc_id"))
    links = seam_links(candidates).join(current_facts(ledger).select("candidate_id", "fact_id"), "candidate_id", "left")
    about = _props(metric_key=F.col("metric_key"), value_kind=F.col("value_kind"))
    seam, fact = _id("seam", F.col("seam")), F.col("fact_id")
    # A candidate's edges out of one row, so that candidates meet facts once.
    own = [_one(seam, block, "IN_BLOCK", "validated"), F.when(fact.isNotNull(), _one(doc, _id("fact", fact), "SUPPORTS", "authoritative"))]
    bores = F.transform("boreholes", lambda b: _one(_id("borehole", b), seam, "INTERSECTS", "validated", about, fact))
    spread = links.select("doc_id", F.explode(F.concat(F.filter(F.array(*own), lambda e: e.isNotNull()), bores)).alias("e"))
    edges = reduce(
        DataFrame.unionByName,
        [
            _edge(registry, doc, block, "DESCRIBES", "authoritative"),
            _edge(registry.where("coalfield is not null"), block, _id("coalfield", F.col("coalfield")), "IN_COALFIELD", "authoritative"),
            spread.select("e.*", "doc_id"),
        ],
    )
    if bag:
        return edges
    key = F.to_json(F.array_sort(F.map_entries("props")))
    return edges.withColumn("__k", key).dropDuplicates(["src", "dst", "rel", "trust_layer", "__k", "fact_id", "doc_id"]).drop("__k")


def build_nodes(registry: DataFrame, candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Nodes by id; properties of several sources are merged, the last document by doc_id winning."""
    node = lambda df, i, label, graph, props: df.select(i.alias("node_id"), F.lit(label).alias("label"), F.lit(graph).alias("graph"), props.alias("props"), "doc_id")
    links = seam_links(candidates).join(current_facts(ledger).select("candidate_id", "fact_id"), "candidate_id", "left")
    bore = links.withColumn("bore", F.explode("boreholes"))
    every = reduce(
        DataFrame.unionByName,
        [
            node(registry, _id("document", F.col("doc_id")), "Document", "documentary", _props(title=F.col("title"), publisher=F.col("publisher"))),
            node(registry.where("coalfield is not null"), _id("coalfield", F.col("coalfield")), "Coalfield", "administrative", _props(name=F.col("coalfield"))),
            node(registry, _id("block", F.col("doc_id")), "Block", "administrative", _props(name=F.coalesce("block", "doc_id"), stage=F.col("stage"))),
            node(links, _id("seam", F.col("seam")), "Seam", "geological", _props(name=F.col("seam"))),
            node(bore, _id("borehole", F.col("bore")), "Borehole", "geological", _props(name=F.col("bore"))),
            node(links.where("fact_id is not null"), _id("fact", F.col("fact_id")), "Fact", "documentary", _props(metric_key=F.col("metric_key"))),
        ],
    )
    values = every.select("node_id", "label", "graph", "doc_id", F.explode_outer("props").alias("k", "v"))
    last = values.groupBy("node_id", "k").agg(F.max_by("v", "doc_id").alias("v"), F.first("label").alias("label"), F.first("graph").alias("graph"), F.max("doc_id").alias("doc_id"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return last.groupBy("node_id").agg(F.first("label").alias("label"), F.first("graph").alias("graph"), F.map_from_entries(F.array_sort(pairs)).alias("props"), F.max("doc_id").alias("doc_id"))


def seed_hierarchy(registry: DataFrame, publisher: str, chain: list[tuple[str, str]]) -> DataFrame:
    """Authoritative PART_OF edges of a fixed hierarchy (lowest first; kind and name) and from its documents into it."""
    spark = registry.sparkSession
    ids = [f"{kind}:{name}" for kind, name in chain]
    steps = spark.createDataFrame(list(zip(ids, ids[1:])) or [("", "")], "src string, dst string").where("src <> ''").withColumn("doc_id", F.lit(None).cast("string"))
    docs = registry.where(F.col("publisher") == publisher)
    return _edge(steps, F.col("src"), F.col("dst"), "PART_OF", "authoritative").unionByName(_edge(docs, _id("document", F.col("doc_id")), F.lit(ids[0]), "PUBLISHED_UNDER", "authoritative"))


def neighbours(edges: DataFrame, node: str, rel: str | None = None) -> DataFrame:
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return near if rel is None else near.where(F.col("rel") == rel)


def multi_hop(edges: DataFrame, starts: DataFrame, rels: Iterable[str] | None = None, max_hops: int = 5, trust_layers: Iterable[str] | None = None, bag: bool = False) -> DataFrame:
    """All simple paths of up to `max_hops` edges, walked in either direction, from each node of `starts` (node).
    Edges are filtered before they are walked. start, node, hops, path (of nodes), rels."""
    usable = edges
    if rels is not None:
        usable = usable.where(F.col("rel").isin(*rels))
    if trust_layers is not None:
        usable = usable.where(F.col("trust_layer").isin(*trust_layers))
    step = usable.select("src", "dst", "rel")
    both = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))
    both = both if bag else both.distinct()
    frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"), F.array().cast("array<string>").alias("rels"))
    walked = []
    for hop in range(max_hops):
        grown = frontier.join(both, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = grown.select("start", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels"))
        if hop + 1 < max_hops:
            frontier = cut(frontier)  # the next hop reads it again
        walked.append(frontier)
    return reduce(DataFrame.unionByName, walked)


class GraphStore:
    """A graph kept as two tables under a path, written per document: the documents of what comes in replace their own
    edges and nodes, and others stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, nodes: DataFrame, edges: DataFrame) -> None:
        overwrite_documents(nodes.withColumn("doc_id", F.coalesce("doc_id", F.lit(""))), f"{self.path}/nodes")
        overwrite_documents(edges.withColumn("doc_id", F.coalesce("doc_id", F.lit(""))), f"{self.path}/edges")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")

    def neighbours(self, node: str, rel: str | None = None) -> DataFrame:
        return neighbours(self.edges(), node, rel)

    def multi_hop(self, starts: DataFrame, **how) -> DataFrame:
        return multi_hop(self.edges(), starts, **how)


def derived(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What each document alone gives: the different `keys` of its rows."""
    return rows.select(*keys, "doc_id").distinct()


def revise_counts(counts: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`counts` (keys, n_docs: how many documents a node or edge rests on) after documents were replaced: `old` and `new` are what
    these gave before and give now (see `derived`). What no document gives any more is gone."""
    signed = old.select(*keys, F.lit(-1).alias("n_docs")).unionByName(new.select(*keys, F.lit(1).alias("n_docs")))
    return counts.select(*keys, "n_docs").unionByName(signed).groupBy(*keys).agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


class CountedGraph:
    """Nodes and edges kept with the number of documents they rest on. What each document gave is kept by document, and counts by
    buckets of their keys: replacing documents reads theirs, and rewrites only the buckets of what they gave or give.

    A put writes what its documents give and the buckets' new counts beside the old ones under the next version, then the
    version's row, which makes both visible; a bucket or document is read at its last visible version. What a failed put left is
    written over."""

    NODE, LINK, BUCKETS = ["node_id", "label"], ["src", "dst", "rel", "trust_layer"], 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, ddl: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(ddl).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], ddl)

    def _version(self) -> int:
        return self._read("versions", "version int").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    @staticmethod
    def _ddl(keys: list[str]) -> str:
        return ", ".join(f"{k} string" for k in keys)

    def _visible(self, name: str, keys: list[str], part: str, more: str) -> tuple[DataFrame, DataFrame]:
        """All visible rows, and the last version of each `part` (a bucket or document): every version of it has a marker row
        without keys."""
        ddl = f"{self._ddl(keys)}, {more}version int, {part} {'int' if part == 'bucket' else 'string'}"
        rows, marker = self._read(name, ddl).where(F.col("version") <= self._version()), F.col(keys[0]).isNull()
        return rows.where(~marker), rows.where(marker).groupBy(part).agg(F.max("version").alias("version"))

    def _counts(self, name: str, keys: list[str]) -> DataFrame:
        rows, last = self._visible(f"{name}_counts", keys, "bucket", "n_docs long, ")
        return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi")  # at most BUCKETS rows

    def put(self, nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> None:
        """Replaces what `documents` (doc_id) gave by the rows of `nodes` and `edges` that are theirs; a document with none is taken out."""
        version, paths = self._version() + 1, []

        def kept(df: DataFrame) -> DataFrame:
            paths.append(fresh_path(self.spark))
            return stored(df, paths[-1])

        docs = kept(documents.select("doc_id").distinct())
        for name, keys, rows in (("node", self.NODE, nodes), ("edge", self.LINK, edges)):
            given, last = self._visible(f"{name}_docs", keys, "doc_id", "")
            last = kept(last.join(docs, "doc_id", "left_semi"))
            old = kept(given.join(last, ["doc_id", "version"], "left_semi").select(*keys, "doc_id"))
            marker = lambda df, *part: df.select(*[F.lit(None).cast("string").alias(k) for k in keys], *part)  # noqa: B023,E731
            own = derived(rows.where(F.col(keys[0]).isNotNull()).join(docs, "doc_id", "left_semi"), keys).unionByName(marker(docs, "doc_id"))
            own.write.mode("overwrite").option("compression", "zstd").parquet(path := f"{self.path}/{name}_docs/version={version}")
            new = self.spark.read.schema(f"{self._ddl(keys)}, doc_id string").parquet(path).where(F.col(keys[0]).isNotNull())
            bucket = F.pmod(F.xxhash64(*keys), F.lit(self.BUCKETS)).cast("int")
            touched = cut(old.unionByName(new).select(bucket.alias("bucket")).distinct())  # at most BUCKETS rows
            before = self._counts(name, keys).join(F.broadcast(touched), "bucket", "left_semi")
            after = revise_counts(before, old, new, keys).withColumn("bucket", bucket)
            after.unionByName(marker(touched, F.lit(None).cast("long").alias("n_docs"), "bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}_counts/version={version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        for path in paths:
            dropped(self.spark, path)

    def nodes(self) -> DataFrame:
        return self._counts("node", self.NODE).select(*self.NODE, "n_docs")

    def edges(self) -> DataFrame:
        return self._counts("edge", self.LINK).select(*self.LINK, "n_docs")
