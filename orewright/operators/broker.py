"""The guarded query layer: who may call what and see what, sealed packages, and the log of every decision.

Every tool that returns rows filters them by the caller's documents and by classification, traces and what depends on a
fact included: an edge at a node of a document that the caller may not see is left out before the walk.

A sealed package is rows: one in `sealed_package`, and its members (facts, passages, coverage) in `package_member`, with a
content hash over the members' own hashes. Only the package's id comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema
from ..shared import cut
from . import ledger as L
from .lineage import closure, edge_rows, revision_impact, trace_back
from .search import search_evidence

# Fixed: the tools' names.
TOOLS = (
    "search_evidence", "get_fact", "compute_metric", "get_provenance", "check_coverage", "seal_evidence_package", "record_answer",
    "get_trace_graph", "revision_impact", "list_review_queue", "list_geological_tables", "get_conformance_report", "merge_packages", "replay",
)
VERSION = "1"


class AccessDenied(Exception):
    pass


@dataclass(frozen=True)
class Principal:
    subject: str
    max_classification: tuple[str, ...]
    scopes: frozenset[str] = frozenset(TOOLS)
    entity_scope: frozenset[str] | None = None


PUBLIC = Principal("anyone", ("public",))


def office(doc_ids: Iterable[str]) -> Principal:
    """A caller who sees the documents of one office only."""
    return Principal("office", ("public", "restricted"), entity_scope=frozenset(doc_ids))


def in_scope(principal: Principal, doc_id: Column) -> Column:
    return F.lit(True) if principal.entity_scope is None else doc_id.isNull() | doc_id.isin(*principal.entity_scope)


def visible(df: DataFrame, registry: DataFrame, principal: Principal, doc: str = "doc_id") -> DataFrame:
    """Rows of documents that a caller may see; rows of unregistered documents pass the classification."""
    classes = registry.select(F.col("doc_id").alias("__doc"), F.col("classification").alias("__class"))
    seen = df.where(in_scope(principal, F.col(doc))).join(classes, F.col(doc) == F.col("__doc"), "left")
    return seen.where(F.col("__class").isNull() | F.col("__class").isin(*principal.max_classification)).drop("__doc", "__class")


def assert_exportable(classifications: Iterable[str]) -> None:
    """Only public material leaves."""
    held = sorted({c for c in classifications if c != "public"})
    if held:
        raise AccessDenied(f"not exportable: {', '.join(held)}")


def exportable(df: DataFrame) -> DataFrame:
    return df.where("classification = 'public'")


MEMBER = ["request", "kind", "member_id", "body"]


def sealed(members: DataFrame, requests: DataFrame, principal: Principal) -> DataFrame:
    """package_id, content_hash and n_members of each request (request, intent), from its members (see MEMBER).

    Equal members are one. A member's hash goes into the hash of the members whose hashes begin alike, and these go, in
    order, into one hash: so content gathered in another order is the same package, and no task gets all its members.
    """
    one = members.select(*MEMBER).distinct().withColumn("h", F.sha2(F.to_json(F.struct("kind", "member_id", "body")), 256))
    level = one.groupBy("request", F.substring("h", 1, 5).alias("at")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    for digits in (2, 0):
        pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        level = level.groupBy("request", F.substring("at", 1, digits).alias("up")).agg(F.sha2(pairs, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "at")
    may = F.array_sort(F.array(*map(F.lit, principal.max_classification)))
    about = F.to_json(F.struct("intent", may.alias("max_classification"), F.lit(principal.subject).alias("principal_subject")))
    whole = requests.join(level, "request", "left").withColumn("content_hash", F.sha2(F.concat(about, F.coalesce("h", F.lit(""))), 256))
    return whole.select(
        "request", F.concat(F.lit("SEP-"), F.substring("content_hash", 1, 12)).alias("package_id"), "content_hash", F.lit(principal.subject).alias("principal_subject"),
        may.alias("max_classification"), "intent", F.coalesce("n", F.lit(0)).alias("n_members"), F.current_timestamp().alias("sealed_at"),
    )


def insert_absent(store: DataFrame, fresh: DataFrame, key: str = "package_id") -> DataFrame:
    return store.unionByName(fresh.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def fact_members(facts: DataFrame) -> DataFrame:
    """Facts (with their request) as members of packages."""
    body = F.to_json(F.struct("fact_id", "entity_id", "metric_key", "value_text", "unit", "period"))
    return facts.select("request", F.lit("fact").alias("kind"), F.col("fact_id").alias("member_id"), body.alias("body"))


def coverage_members(coverage: DataFrame) -> DataFrame:
    """Coverage rows (with their request) as members of packages, one for each metric and entity."""
    body = F.to_json(F.struct("metric_key", "entity_id", "covered", "fact_count", "reason"))
    return coverage.select("request", F.lit("coverage").alias("kind"), F.concat_ws("|", "metric_key", "entity_id").alias("member_id"), body.alias("body"))


def audit_calls(calls: DataFrame, principals: DataFrame) -> DataFrame:
    """The decisions on a log of calls (ts, subject, tool), as audit_log rows: what `Broker` decides call by call. principals:
    subject and scopes (the tools it may call), a row per subject; a caller without one may call nothing."""
    known = calls.join(principals.select("subject", "scopes"), "subject", "left")
    is_tool = F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))
    allowed = is_tool & F.coalesce(F.array_contains("scopes", F.col("tool")), F.lit(False))
    reason = F.when(allowed, F.lit(None).cast("string")).when(~is_tool, "unknown tool").when(F.col("scopes").isNull(), "unknown caller").otherwise("not in scope")
    return known.select("ts", "subject", "tool", allowed.alias("allowed"), reason.alias("reason"))


EDGE = "from_kind string, from_id string, to_kind string, to_id string, activity string, agent string"


@dataclass
class Broker:
    """Tables by name (see schemas) and one caller. Tools return DataFrames; rows they add are kept in `tables`."""

    spark: SparkSession
    principal: Principal
    tables: dict[str, DataFrame]
    audit: list[tuple] = field(default_factory=list)
    additions: int = 0  # of lineage edges; a broker over stored tables goes on from the greatest id

    def __post_init__(self) -> None:
        if "lineage_edge" in self.tables:
            self.additions = (self.tables["lineage_edge"].agg(F.max("id")).first()[0] or 0) >> 40

    def _t(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], schema(name))
        return self.tables[name]

    def _authorize(self, tool: str) -> None:
        allowed = tool in TOOLS and tool in self.principal.scopes
        reason = None if allowed else "unknown tool" if tool not in TOOLS else "not in scope"
        self.audit.append((datetime.now(timezone.utc), self.principal.subject, tool, allowed, reason))
        if not allowed:
            raise AccessDenied(f"{self.principal.subject}: {tool}: {reason}")

    def call(self, tool: str, **arguments):
        """A tool by name; unknown names are denied and logged like any other."""
        if tool not in TOOLS:
            self._authorize(tool)
        return getattr(self, tool)(**arguments)

    def audit_log(self) -> DataFrame:
        return self.spark.createDataFrame(self.audit, schema("audit_log"))

    def flush_audit(self, path: str) -> None:
        """Appends the decisions made since the last flush to the log under a path; they leave the driver."""
        if self.audit:
            self.audit_log().coalesce(1).write.mode("append").parquet(path)
            self.audit.clear()

    def visible_tools(self) -> list[str]:
        return sorted(t for t in TOOLS if t in self.principal.scopes)

    def meta(self) -> dict:
        return {"version": VERSION, "subject": self.principal.subject, "tools": self.visible_tools()}

    def _facts(self) -> DataFrame:
        facts = L.current_facts(self._t("fact")).withColumn("doc_id", F.col("source.doc_id"))
        return visible(facts, self._t("source_registry"), self.principal)

    def visible_candidates(self) -> DataFrame:
        return visible(self._t("candidate_fact"), self._t("source_registry"), self.principal)

    def search_evidence(self, query: str, k: int = 5) -> DataFrame:
        self._authorize("search_evidence")
        chunks = self._t("chunk").where(in_scope(self.principal, F.col("doc_id")))
        hits = cut(search_evidence(chunks, query, k, list(self.principal.max_classification)))  # k rows, read again below
        linked = edge_rows(hits.where("candidate_id is not null"), "passage", F.col("chunk_id"), "candidate", F.col("candidate_id"), "retrieved", self.principal.subject)
        self._add_edges(linked)
        return hits

    def _add_edges(self, edges: DataFrame) -> None:
        """Keeps edges with a time and an id: the number of the addition, then a hash of the content, so an id never
        changes, later additions have greater ones, and equal edges of one addition are one. The rows are written."""
        self.additions += 1
        content = F.shiftrightunsigned(F.xxhash64("from_kind", "from_id", "to_kind", "to_id", "activity", "agent"), 24)
        known = edges.distinct().withColumns({"at": F.lit(datetime.now(timezone.utc)), "id": F.lit(self.additions << 40) + content})
        have = set(known.columns)
        row = known.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("lineage_edge").fields])
        self.tables["lineage_edge"] = self._t("lineage_edge").unionByName(cut(row))

    def _edges(self) -> DataFrame:
        """Lineage edges between nodes that the caller may see."""
        facts = self._t("fact").select("fact_id", F.col("source.doc_id").alias("doc_id"))
        held = [("fact", facts, "fact_id"), ("candidate", self._t("candidate_fact"), "candidate_id")]
        hidden = []
        for kind, df, key in held:
            seen = visible(df.select(key, "doc_id"), self._t("source_registry"), self.principal)
            hidden.append(df.select(key).join(seen.select(key), key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).alias("id")))
        may = F.col("classification").isin(*self.principal.max_classification) & in_scope(self.principal, F.col("doc_id"))
        hidden.append(self._t("chunk").where(~F.coalesce(may, F.lit(False))).select(F.lit("passage").alias("kind"), F.col("chunk_id").alias("id")))
        above = F.size(F.array_except("max_classification", F.array(*map(F.lit, self.principal.max_classification)))) > 0
        hidden.append(self._t("sealed_package").where(above).select(F.lit("package").alias("kind"), F.col("package_id").alias("id")))
        gone = reduce(DataFrame.unionByName, hidden).distinct()
        edges = self._t("lineage_edge")
        for side in ("from", "to"):
            ends = gone.select(F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"))
            edges = edges.join(ends, [f"{side}_kind", f"{side}_id"], "left_anti")
        return edges

    def get_fact(self, metric_key: str, entity_id: str | None = None) -> DataFrame:
        self._authorize("get_fact")
        found = self._facts().where(F.col("metric_key") == metric_key)
        found = found if entity_id is None else found.where(F.col("entity_id") == entity_id)
        return found.select("fact_id", "entity_id", "metric_key", "value_text", "unit", "period")

    def compute_metric(self, metric_key: str, entity_id: str | None = None, **qualifiers) -> DataFrame:
        self._authorize("compute_metric")
        return L.compute_metric(self._facts(), metric_key, entity_id, **qualifiers)

    def check_coverage(self, metric_key: str, entity_id: str | None = None) -> DataFrame:
        self._authorize("check_coverage")
        return self._coverage([(metric_key, entity_id)])

    def _coverage(self, asked: list[tuple[str, str | None]]) -> DataFrame:
        """Coverage of several metrics and entities in one pass, over the candidates and facts of those metrics alone."""
        wanted = self.spark.createDataFrame(asked, "metric_key string, entity_id string")
        theirs = F.col("metric_key").isin(*{metric for metric, _ in asked})
        return L.coverage(wanted, self.visible_candidates().where(theirs), self._facts().where(theirs))

    def _start(self, kind: str, node_id: str) -> DataFrame:
        return self.spark.createDataFrame([(kind, node_id)], "kind string, id string")

    def get_provenance(self, kind: str, node_id: str) -> DataFrame:
        self._authorize("get_provenance")
        return trace_back(self._edges(), self._start(kind, node_id))

    def get_trace_graph(self, kind: str, node_id: str) -> DataFrame:
        self._authorize("get_trace_graph")
        return closure(self._edges(), self._start(kind, node_id))

    def revision_impact(self, fact_id: str, new_value: str, tolerance: str = "0.01") -> DataFrame:
        self._authorize("revision_impact")
        revision = self.spark.createDataFrame([(fact_id, new_value)], "fact_id string, new_value string")
        return revision_impact(self._facts(), revision, self._edges(), tolerance)

    def seal_evidence_package(self, intent: str, query: str | None = None, metric_keys: Iterable[str] = (), k: int = 5) -> str:
        """Gathers facts, passages and coverage as members, stores the package unless it is there, and links it to what it
        cites. Returns its id."""
        self._authorize("seal_evidence_package")
        keys = list(metric_keys)
        facts = fact_members(self._facts().where(F.col("metric_key").isin(*keys) if keys else F.lit(False)).withColumn("request", F.lit("0")))
        parts = [facts]
        if query:
            parts.append(self.search_evidence(query, k).select(F.lit("0").alias("request"), F.lit("passage").alias("kind"), F.col("chunk_id").alias("member_id"), "text").select("request", "kind", "member_id", F.to_json(F.struct(F.col("member_id").alias("chunk_id"), "text")).alias("body")))
        for _ in keys:
            self._authorize("check_coverage")
        if keys:
            parts.append(coverage_members(self._coverage([(m, None) for m in keys]).withColumn("request", F.lit("0"))))
        request = self.spark.createDataFrame([("0", intent)], "request string, intent string")
        return self.seal_members(reduce(DataFrame.unionByName, parts), request).first().package_id

    def seal_members(self, members: DataFrame, requests: DataFrame) -> DataFrame:
        """Packages of many requests at once: request and package_id. What is there already is not stored again."""
        held = cut(members.select(*MEMBER).distinct())
        made = cut(sealed(held, requests, self.principal))
        fresh = made.dropDuplicates(["package_id"]).join(self._t("sealed_package").select("package_id"), "package_id", "left_anti")
        rows = held.join(fresh.select("request", "package_id"), "request").select("package_id", "kind", "member_id", "body")
        rows, stored = cut(rows), cut(fresh.drop("request"))
        self.tables["sealed_package"] = self._t("sealed_package").unionByName(stored)
        self.tables["package_member"] = self._t("package_member").unionByName(rows)
        cites = rows.where("kind <> 'coverage'").select(F.lit("package").alias("from_kind"), F.col("package_id").alias("from_id"), F.col("kind").alias("to_kind"), F.col("member_id").alias("to_id"), F.lit("cites").alias("activity"), F.lit(self.principal.subject).alias("agent"))
        self._add_edges(cites)
        return made.select("request", "package_id")

    def record_answer(self, answer_id: str, package_id: str) -> None:
        self._authorize("record_answer")
        self._add_edges(self.spark.createDataFrame([("answer", answer_id, "package", package_id, "answered_from", self.principal.subject)], EDGE))

    def _readable(self, package_ids: Iterable[str]) -> DataFrame:
        found = self._t("sealed_package").where(F.col("package_id").isin(*package_ids))
        mine = F.array(*map(F.lit, self.principal.max_classification))
        if not found.where(F.size(F.array_except("max_classification", mine)) > 0).isEmpty():
            raise AccessDenied(f"{self.principal.subject}: package above the caller's classification")
        return found

    def replay(self, package_id: str) -> DataFrame:
        """The members of a package, with its intent; a package without members gives one row of nulls, an unknown one none."""
        self._authorize("replay")
        return self._readable([package_id]).select("package_id", "intent").join(self._t("package_member"), "package_id", "left").select("package_id", "intent", "kind", "member_id", "body")

    def merge_packages(self, package_ids: list[str], intent: str) -> str:
        """A package of all members of others, in the order given; of coverage entries of one metric the last wins."""
        self._authorize("merge_packages")
        order = self.spark.createDataFrame(list(enumerate(package_ids)), "ord int, package_id string")
        parts = self._readable(package_ids).select("package_id").join(F.broadcast(order), "package_id").join(self._t("package_member"), "package_id")
        plain = parts.where("kind <> 'coverage'").select("kind", "member_id", "body").distinct()
        last = parts.where("kind = 'coverage'").groupBy("kind", "member_id").agg(F.max_by("body", "ord").alias("body"))
        members = plain.unionByName(last).select(F.lit("0").alias("request"), "kind", "member_id", "body")
        merged = self.seal_members(members, self.spark.createDataFrame([("0", intent)], "request string, intent string")).first().package_id
        edges = [("package", merged, "package", p, "merged_from", self.principal.subject) for p in package_ids]
        self._add_edges(self.spark.createDataFrame(edges, EDGE))
        return merged

    def list_review_queue(self, doc_id: str | None = None) -> DataFrame:
        self._authorize("list_review_queue")
        queue = visible(self._t("review_queue"), self._t("source_registry"), self.principal)
        return queue if doc_id is None else queue.where(F.col("doc_id") == doc_id)

    def list_geological_tables(self, doc_id: str) -> DataFrame:
        self._authorize("list_geological_tables")
        rows = F.regexp_extract("source.cell_ref", r"^r(\d+)c", 1)
        seen = visible(self._t("candidate_fact"), self._t("source_registry"), self.principal).where(F.col("doc_id") == doc_id)
        return seen.groupBy("doc_id", F.col("source.table_ref").alias("element_id"), "domain_type").agg(F.countDistinct(rows).alias("n_rows"))

    def get_conformance_report(self, doc_id: str) -> DataFrame:
        self._authorize("get_conformance_report")
        runs = visible(self._t("assay_run"), self._t("source_registry"), self.principal)
        return runs.where(F.col("doc_id") == doc_id).orderBy(F.desc("started_at"), "run_id").limit(1)
