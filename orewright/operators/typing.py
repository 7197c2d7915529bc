"""From table cells to candidate facts, under a domain pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Pack
from ..functions.text import canonical_map, resolve_entity, short_hash, stat_of, strip_footnote, to_decimal, unit_of
from ..shared import cut
from .headers import TABLE, header_chains, header_counts


def captions(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """The text block that ends nearest above each table on its page; at ties the earliest block."""
    blocks = texts.select("doc_id", "page_no", F.col("text").alias("caption"), F.col("bbox.b").alias("bottom"), "pos")
    above = tables.select(*TABLE, "page_no", F.col("bbox.t").alias("top")).join(blocks, ["doc_id", "page_no"]).where("bottom <= top")
    return above.groupBy(*TABLE).agg(F.max_by("caption", F.struct("bottom", -F.col("pos"))).alias("caption"))


def header_words(cells: DataFrame, counts: DataFrame) -> DataFrame:
    heads = cells.join(counts, TABLE).where("row < header_rows")
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z%]+"), F.lit(0))
    return heads.groupBy(*TABLE).agg(F.array_distinct(F.flatten(F.collect_list(found))).alias("words"))


def table_type(caption: Column, words: Column, pack: Pack) -> tuple[Column, Column]:
    """The first type whose caption pattern is found, else the one whose signature overlaps most, and the confidence."""
    by_caption = F.coalesce(*[F.when(caption.rlike("(?i)" + p), t.name) for t in pack.table_types for p in t.captions], F.lit(None).cast("string"))
    scored = []
    for order, t in enumerate(pack.table_types):
        overlap = F.size(F.array_intersect(words, F.array(*map(F.lit, t.signature))))
        scored.append(F.when(overlap >= t.min_overlap, F.struct(overlap.alias("overlap"), F.lit(-order).alias("ord"), F.lit(t.name).alias("name"))))
    best = F.array_max(F.filter(F.array(*scored), lambda s: s.isNotNull()))
    name = F.coalesce(by_caption, best["name"])
    return name, F.when(by_caption.isNotNull(), 0.95).when(name.isNotNull(), 0.85).otherwise(0.0)


def classify_tables(tables: DataFrame, texts: DataFrame, cells: DataFrame, counts: DataFrame, pack: Pack) -> DataFrame:
    joined = tables.join(captions(tables, texts), TABLE, "left").join(header_words(cells, counts), TABLE, "left")
    name, confidence = table_type(F.coalesce("caption", F.lit("")), F.coalesce("words", F.array().cast("array<string>")), pack)
    return joined.select(*tables.columns, "caption", name.alias("table_type"), confidence.alias("type_confidence"))


RULE = "struct<ord: int, role: string, metric_key: string, entity_type: string, qualifier_key: string, expect_unit: string, unit_from_header: boolean, stat_from_header: boolean, value_type: string>"


def column_rule(kind: Column, chain: Column, pack: Pack) -> Column:
    """The first rule of a table type, in pack order, of which a pattern is part of the joined headers."""
    text = F.lower(F.concat_ws(" ", chain))
    cases = []
    for t in pack.table_types:
        for order, c in enumerate(t.columns):
            hit = reduce(lambda a, b: a | b, [text.contains(m) for m in c.match])
            values = F.struct(F.lit(order), F.lit(c.role), F.lit(c.metric_key), F.lit(c.entity_type), F.lit(c.qualifier_key), F.lit(c.expect_unit), F.lit(c.unit_from_header), F.lit(c.stat_from_header), F.lit(c.value_type))
            cases.append(F.when((kind == t.name) & hit, values.cast(RULE)))
    return F.coalesce(*cases)


def match_columns(chains: DataFrame, kinds: DataFrame, pack: Pack) -> DataFrame:
    typed = chains.join(kinds.where("table_type is not null").select(*TABLE, "table_type"), TABLE)
    return typed.select(*TABLE, "col", "chain", "table_type", column_rule(F.col("table_type"), F.col("chain"), pack).alias("rule")).where("rule is not null")


def _resolved(kind: Column, raw: Column, pack: Pack) -> Column:
    return F.coalesce(*[F.when(kind == k, resolve_entity(raw, p)) for k, p in pack.entity_patterns.items()], F.lit(None).cast("string"))


def emit_candidates(tables: DataFrame, texts: DataFrame, cells: DataFrame, pack: Pack, period: str = "unknown", status: str = "final") -> DataFrame:
    """One candidate fact per filled metric cell of a typed table, with its row's entity and qualifiers.

    A row whose identity columns are all blank belongs to the row above that has one; borehole names in such rows
    become the owner's qualifier `source_boreholes`.
    """
    plain = cells.withColumn("text", strip_footnote(F.coalesce("text", F.lit(""))))
    counts = header_counts(plain)
    # Headers keep their ends: "(m)" is a unit there, though it looks like a mark.
    kinds = classify_tables(tables, texts, cells, counts, pack)
    rules = match_columns(header_chains(cells, counts), kinds, pack)
    data = cut(plain.join(counts, TABLE).where("row >= header_rows").join(rules, [*TABLE, "col"]))
    identity = F.col("rule.role").isin("entity", "qualifier")
    filled = F.col("text") != ""

    rows = data.groupBy(*TABLE, "row").agg(F.bool_or(identity & filled).alias("own"), F.bool_or(identity).alias("has_identity"))
    owner = F.last(F.when(F.col("own") | ~F.col("has_identity"), F.col("row")), ignorenulls=True).over(Window.partitionBy(*TABLE).orderBy("row"))
    owners = cut(rows.select(*TABLE, "row", F.coalesce(owner, "row").alias("owner")))

    borehole = _resolved(F.lit("borehole"), F.col("text"), pack)
    folded = data.join(owners, [*TABLE, "row"]).where("row <> owner").withColumn("ref", borehole).where("ref is not null")
    refs = folded.groupBy(*TABLE, F.col("owner").alias("row")).agg(F.array_join(F.array_sort(F.collect_set("ref")), ";").alias("refs"))

    entity = F.max_by(F.struct(F.col("text").alias("raw"), _resolved(F.col("rule.entity_type"), F.col("text"), pack).alias("id")), F.when((F.col("rule.role") == "entity") & filled, F.col("col")))
    pairs = F.collect_list(F.when((F.col("rule.role") == "qualifier") & filled, F.struct(F.col("col"), F.col("rule.qualifier_key").alias("k"), F.coalesce(_resolved(F.col("rule.qualifier_key"), F.col("text"), pack), F.col("text")).alias("v"))))
    facts = data.groupBy(*TABLE, "row").agg(entity.alias("entity"), F.array_sort(pairs).alias("pairs")).join(refs, [*TABLE, "row"], "left")
    held = F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["k"], p["v"])))
    qualifiers = F.when(F.col("refs").isNull(), held).otherwise(F.map_concat(held, F.create_map(F.lit("source_boreholes"), F.col("refs"))))
    facts = facts.select(*TABLE, "row", "entity", qualifiers.alias("qualifiers"))

    metric = data.join(owners, [*TABLE, "row"]).where(filled & (F.col("rule.role") == "metric") & (F.col("row") == F.col("owner"))).join(facts, [*TABLE, "row"])
    pages = kinds.select(*TABLE, "page_no", F.col("confidence").alias("table_confidence"))
    unit, unit_source = unit_of(F.col("chain"), F.col("rule.expect_unit"), F.col("rule.unit_from_header"))
    decimal = F.col("rule.value_type") == "decimal"
    cell = F.format_string("r%dc%d", "row", "col")
    page = F.coalesce(F.col("bbox.page_no"), F.col("page_no"))
    return metric.join(pages, TABLE).select(
        short_hash(F.concat_ws("-", "doc_id", "element_id", F.col("row").cast("string"), F.col("col").cast("string")), 10, "cand_").alias("candidate_id"),
        "doc_id", F.col("entity.raw").alias("entity_raw"), F.col("entity.id").alias("entity_id"), F.concat_ws(" ", "chain").alias("metric_raw"),
        F.col("rule.metric_key").alias("metric_key"), F.col("text").alias("value_raw"), F.col("text").alias("value_text"),
        F.when(decimal, to_decimal(F.col("text"))).alias("value"), F.when(decimal, unit).alias("unit"), F.when(decimal, unit_source).alias("unit_source"),
        "qualifiers", stat_of(F.col("chain"), F.col("rule.stat_from_header")).alias("value_kind"), F.lit(period).alias("period"), F.lit(status).alias("status"),
        page.alias("page_no"), F.col("element_id").alias("table_ref"), cell.alias("cell_ref"), F.col("bbox"),
        F.coalesce("confidence", "table_confidence").alias("extraction_confidence"), F.col("table_type").alias("domain_type"), F.lit(pack.version).alias("domain_pack_version"),
    )


__all__ = ["canonical_map", "captions", "classify_tables", "column_rule", "emit_candidates", "header_words", "match_columns", "table_type"]
