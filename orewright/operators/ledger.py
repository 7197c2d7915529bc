"""The bitemporal ledger: versions of facts, current and as of any time; statements and contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_map, short_hash
from .bitemporal import sweep


def fact_identity() -> Column:
    """What makes two values the same fact, whatever the order of the qualifiers' keys."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return short_hash(F.concat_ws("|", text("entity_id"), text("metric_key"), canonical_map(F.col("qualifiers")), text("period"), text("value_kind")), 16)


def publish(observed: DataFrame) -> DataFrame:
    """All versions of the facts in a table of approved values (with observed_at): a value that repeats the one before
    makes no version; a new one closes it. Equal times are ordered by candidate_id. `last_seen` is when a version was last observed."""
    identified = observed.where("entity_id is not null and value is not null").withColumn("fact_identity", fact_identity())
    w = Window.partitionBy("fact_identity").orderBy("observed_at", "candidate_id")
    unit = F.coalesce("unit", F.lit(""))
    same = F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag(unit).over(w).eqNullSafe(unit)
    seen = identified.withColumns({"__same": same, "__before": F.lag("observed_at").over(w), "__end": F.max("observed_at").over(Window.partitionBy("fact_identity"))})
    changed = seen.where("not __same").drop("__same")
    made = changed.withColumn("fact_id", short_hash(F.concat_ws("|", "fact_identity", F.unix_micros(F.col("observed_at").cast("timestamp")).cast("string"), "candidate_id"), 12, "fact_"))
    return made.select(
        "*", F.col("observed_at").alias("valid_from"), F.lead("observed_at").over(w).alias("valid_to"),
        F.col("observed_at").alias("system_from"), F.lead("observed_at").over(w).alias("system_to"),
        F.lag("fact_id").over(w).alias("supersedes"), F.row_number().over(w).alias("version"),
        F.coalesce(F.lead("__before").over(w), "__end").alias("last_seen"),
    ).drop("observed_at", "__before", "__end")


class LateValue(ValueError):
    """A value older than the last observation of its fact: the ledger keeps versions, not the repeats between them."""


def publish_into(ledger: DataFrame, observed: DataFrame) -> DataFrame:
    """The ledger after more values: only identities that got values are worked over; the others pass through. Values
    older than the last observation of their fact are refused (LateValue): publish all observations anew for these."""
    fresh = publish(observed)
    first = fresh.groupBy("fact_identity").agg(F.min("system_from").alias("first"))
    old = ledger.join(first.select("fact_identity"), "fact_identity", "left_semi")
    late = old.groupBy("fact_identity").agg(F.max("last_seen").alias("last")).join(first, "fact_identity").where("first < last")
    if not late.isEmpty():
        raise LateValue(f"values before the last observation, such as of {late.first().fact_identity}")
    rest = [c for c in ledger.columns if c not in ("fact_id", "fact_identity", "valid_from", "valid_to", "system_from", "system_to", "supersedes", "version", "last_seen")]
    # An old version stands for two observations, its first and its last, so that its `last_seen` stays.
    ends = F.explode(F.array_distinct(F.array("system_from", "last_seen"))).alias("observed_at")
    again = old.select(*rest, ends).unionByName(observed.select(*rest, "observed_at"))
    return ledger.join(first, "fact_identity", "left_anti").select(*ledger.columns).unionByName(publish(again).select(*ledger.columns))


def _where(df: DataFrame, filters: dict) -> DataFrame:
    for name, value in filters.items():
        df = df.where(F.col(name) == value)
    return df


def current_facts(ledger: DataFrame, **filters) -> DataFrame:
    return _where(ledger.where("system_to is null"), filters)


def as_of(ledger: DataFrame, at, **filters) -> DataFrame:
    t = F.lit(at).cast("timestamp")
    return _where(ledger.where((F.col("system_from") <= t) & (F.col("system_to").isNull() | (F.col("system_to") > t))), filters)


def as_of_each(ledger: DataFrame, times: DataFrame) -> DataFrame:
    """The ledger as of each time in `times` (at): a version finds the times that it covers by its two ends, among all of
    them in order. Only what is asked becomes a row, however long versions last."""
    return sweep(ledger, times)


def history(ledger: DataFrame, identity: str) -> DataFrame:
    return ledger.where(F.col("fact_identity") == identity).orderBy("system_from")


def compute_metric(ledger: DataFrame, metric_key: str, entity_id: str | None = None, **qualifiers) -> DataFrame:
    found = current_facts(ledger, metric_key=metric_key, **({"entity_id": entity_id} if entity_id else {}))
    for k, v in qualifiers.items():
        found = found.where(F.try_element_at("qualifiers", F.lit(k)) == v)
    return found


def coverage(wanted: DataFrame, candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per (metric_key, entity_id or null) of `wanted`: covered, the number of current facts, and why there are none.

    The most frequent (gate, reason) of candidates not published is given; at ties the first in order of the text.
    """
    keys = wanted.select("metric_key", "entity_id").distinct()
    # Counts per (metric, entity) and per metric: a wanted null entity stands for all.
    def per(df: DataFrame, *aggs) -> DataFrame:
        grouped = df.cube("metric_key", "entity_id").agg(*aggs, F.grouping_id().alias("g"))
        return grouped.where("g = 0 and entity_id is not null or g = 1").drop("g")

    facts = per(current_facts(ledger), F.count("*").alias("fact_count"))
    unresolved = F.col("state") != "published"
    held = per(candidates, F.count("*").alias("held"), F.count_if(unresolved).alias("open"))
    metric = candidates.groupBy("metric_key").agg(F.lit(True).alias("known"))
    reasons = candidates.where(unresolved).select("metric_key", "entity_id", F.concat_ws(" — ", F.coalesce("failed_gate", F.lit("no_gate_recorded")), F.coalesce("failure_reason", "state")).alias("why"))
    each = reasons.groupBy("metric_key", "entity_id", "why").count()
    each = each.unionByName(each.groupBy("metric_key", F.lit(None).cast("string").alias("entity_id"), "why").agg(F.sum("count").alias("count")).select(*each.columns))
    top = each.groupBy("metric_key", "entity_id").agg(F.min_by("why", F.struct(-F.col("count"), "why")).alias("why"))
    out = keys
    for other in (facts, held, top):
        other = other.withColumnRenamed("metric_key", "__m").withColumnRenamed("entity_id", "__e")
        out = out.join(other, (F.col("metric_key") == F.col("__m")) & F.col("entity_id").eqNullSafe(F.col("__e")), "left").drop("__m", "__e")
    out = out.join(metric, "metric_key", "left")
    count = F.coalesce("fact_count", F.lit(0))
    reason = (
        F.when(count > 0, F.lit(None).cast("string")).when(F.col("known").isNull(), "NOT_DIGITISED").when(F.coalesce("held", F.lit(0)) == 0, "NO_SOURCE")
        .when(F.coalesce("open", F.lit(0)) == 0, "NOT_VALIDATED").otherwise(F.concat(F.lit("NOT_VALIDATED: "), "why"))
    )
    return out.select("metric_key", "entity_id", (count > 0).alias("covered"), count.alias("fact_count"), reason.alias("reason"))


def statements(ledger: DataFrame) -> DataFrame:
    facts = current_facts(ledger)
    return facts.select(
        short_hash(F.concat(F.lit("stmt|"), "fact_id"), 12, "stmt_").alias("statement_id"), "fact_id", F.col("source.doc_id").alias("doc_id"), "metric_key", "entity_id", "period", "qualifiers", "value_kind", "value", "value_text", "unit",
    )


def _torn(published: DataFrame, strict_text: bool) -> tuple[DataFrame, DataFrame, list[str], str]:
    """Statements with the key of their group, and the groups of more than one document and value: by least and greatest,
    which meet in part before the shuffle. A null entity or period is no fact in common."""
    value = "value_text" if strict_text else "value"
    keys = ["metric_key", "entity_id", "period", "qualifier_key", *([] if strict_text else ["value_kind", "unit"])]
    rows = published.where("entity_id is not null").withColumn("qualifier_key", canonical_map(F.col("qualifiers")))
    ends = rows.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in ("doc_id", value) for n, f in (("lo", F.min), ("hi", F.max))])
    torn = ends.where(F.col("__lo_doc_id") != F.col("__hi_doc_id")).where(F.col(f"__lo_{value}") != F.col(f"__hi_{value}"))
    return rows, torn.select(*[F.col(k).alias(f"__{k}") for k in keys]), keys, value


def contradiction_members(published: DataFrame, strict_text: bool = False) -> DataFrame:
    """The statements of contradictory groups, one row each, with their group's keys."""
    rows, torn, keys, _ = _torn(published, strict_text)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(torn, same, "left_semi")


def contradictions(published: DataFrame, strict_text: bool = False) -> DataFrame:
    """Groups of statements on one fact by more than one document with more than one value, and how many documents, values and
    statements they have. Values are compared as decimals with their units and kinds; `strict_text` compares their text alone."""
    _, _, keys, value = _torn(published, strict_text)
    members = contradiction_members(published, strict_text)
    # Distinct documents and values by one row each, so that no group is gathered anywhere.
    each = members.select(*keys, F.explode(F.array(F.struct(F.lit("doc").alias("what"), F.col("doc_id").alias("x")), F.struct(F.lit("value").alias("what"), F.col(value).cast("string").alias("x")))).alias("e")).select(*keys, "e.*")
    once = each.groupBy(*keys, "what", "x").agg(F.count("*").alias("n"))
    told = lambda what: F.count_if((F.col("what") == what) & F.col("x").isNotNull())
    return once.groupBy(*keys).agg(told("doc").alias("n_docs"), told("value").alias("n_values"), F.sum(F.when(F.col("what") == "doc", F.col("n"))).alias("n_members"))
