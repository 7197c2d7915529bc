"""Rules, gates and the states of candidate facts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import Pack, Rule
from ..functions.text import fill, resolve_entity
from ..shared import cut

PASS_FLOOR = 0.85
#: Fixed: the relations a pair rule can name, and the bounds of the last. Each tells how many second-side values break it
#: with a value `a`, from counts over the second side of its key: all, those below and equal to `a`, and those over a bound.
HIGH_ASH, HIGH_GCV = 40, 5500
BROKEN = {
    "le": lambda a, n: n("less"),
    "lt": lambda a, n: n("less") + n("equal"),
    "ge": lambda a, n: n("all") - n("less") - n("equal"),
    "gt": lambda a, n: n("all") - n("less"),
    "eq": lambda a, n: n("all") - n("equal"),
    "high_ash_high_gcv_implausible": lambda a, n: F.when(a > HIGH_ASH, n("high")).otherwise(0),
}
FINDING = ["candidate_id", "ord", "rule_id", "severity", "message", "n"]


def key_of(name: str, alias: str = "") -> Column:
    """A column, or `qualifiers.<key>`."""
    at = f"{alias}." if alias else ""
    head, dot, key = name.partition(".")
    return F.try_element_at(F.col(f"{at}qualifiers"), F.lit(key)) if dot and head == "qualifiers" else F.col(at + name)


def range_findings(candidates: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of values outside their rule's bounds. One pass: a candidate's rules are an array that is exploded."""
    made = []
    for order, r in enumerate(rules):
        if r.type != "range":
            continue
        low, high = (F.lit(x).cast("decimal(38,18)") for x in (r.min, r.max))
        bad = F.coalesce(F.col("value") < low, F.lit(False)) | F.coalesce(F.col("value") > high, F.lit(False))
        text = fill(r.message, {"metric_key": F.col("metric_key"), "min": F.lit(r.min), "max": F.lit(r.max), "unit": F.lit(r.unit), "value": F.coalesce("value_text", F.col("value").cast("string"))})
        hit = F.col("metric_key").isin(*r.applies_to) & bad
        made.append(F.when(hit, F.struct(F.lit(order).alias("ord"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), text.alias("message"), F.lit(1).cast("long").alias("n"))))
    if not made:
        return candidates.select("candidate_id", F.lit(0).alias("ord"), *[F.lit("").alias(c) for c in FINDING[2:-1]], F.lit(1).cast("long").alias("n")).limit(0)
    return candidates.select("candidate_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("candidate_id", "f.*")


def pair_findings(candidates: DataFrame, rules: list[Rule], within: tuple[str, ...] = ()) -> DataFrame:
    """One finding for each first-side candidate and rule that some second-side candidate of its key breaks: how many do
    (n), and the message for the one that breaks it furthest. Keys match null-safely; `within` adds keys such as doc_id.

    No pair of rows is made: each side is reduced to the distinct values of a key, which are ranked, and the ranks count
    the partners. So a key that many rows share, such as a null one, costs its distinct values only.
    """
    parts = []
    for order, r in enumerate(rules):
        if r.type != "pair":
            continue
        names = [*r.match_on, *within]
        keys = [f"__k{i}" for i in range(len(names))]
        value = F.col("value").cast("double").alias("__v")
        text = F.coalesce("value_text", F.col("value").cast("string"))
        side = lambda m: candidates.where((F.col("metric_key") == m) & F.col("value").isNotNull()).select("*", *[key_of(k).alias(n) for k, n in zip(names, keys)], value, text.alias("__text"))  # noqa: B023,E731
        a, b = side(r.metric_a), side(r.metric_b)
        held = b.groupBy(*keys, "__v").agg(F.count("*").alias("nb"), F.min("__text").alias("b_text"))
        asks = a.select(*keys, "__v", F.lit(0).cast("long").alias("nb"), F.lit(None).cast("string").alias("b_text")).distinct()
        every = held.unionByName(asks).groupBy(*keys, "__v").agg(F.sum("nb").alias("nb"), F.max("b_text").alias("b_text"), F.bool_or(F.col("nb") == 0).alias("asked"))
        whole = Window.partitionBy(*keys)
        below = whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        one = F.when(F.col("nb") > 0, F.struct("__v", "b_text"))
        ranked = every.select(
            *keys, "__v", "asked", F.col("nb").alias("equal"), F.coalesce(F.sum("nb").over(below), F.lit(0)).alias("less"), F.sum("nb").over(whole).alias("all"),
            F.sum(F.when(F.col("__v") > HIGH_GCV, F.col("nb")).otherwise(0)).over(whole).alias("high"), F.min(one).over(whole).alias("low_b"), F.max(one).over(whole).alias("high_b"),
        )
        n = BROKEN[r.relation](F.col("__v"), F.col)
        least = F.lit(r.relation in ("le", "lt")) | (F.lit(r.relation == "eq") & (F.col("low_b.__v") != F.col("__v")))
        broken = ranked.where("asked").select(*keys, "__v", n.alias("n"), F.when(least, F.col("low_b.b_text")).otherwise(F.col("high_b.b_text")).alias("b_text")).where("n > 0")
        on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__v"]])
        hit = a.alias("a").join(broken.alias("r"), on)
        values = {"a_value": F.col("a.__text"), "b_value": F.col("r.b_text"), "entity_id": F.col("a.entity_id"), "metric_key": F.col("a.metric_key")}
        parts.append(hit.select(F.col("a.candidate_id").alias("candidate_id"), F.lit(1000 + order).alias("ord"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), fill(r.message, values).alias("message"), "r.n"))
    if not parts:
        return range_findings(candidates, [])
    return reduce(DataFrame.unionByName, parts)


def findings(candidates: DataFrame, rules: list[Rule], within: tuple[str, ...] = ()) -> DataFrame:
    return range_findings(candidates, rules).unionByName(pair_findings(candidates, rules, within))


def unit_confidence(unit: Column, source: Column) -> Column:
    return F.when(unit.isNull(), 0.3).when(source == "explicit", 1.0).when(source.startswith("column_header"), 0.9).when(source == "rulebook_default", 0.6).otherwise(0.5)


def confidence() -> Column:
    """The weakest link of extraction, unit and entity."""
    return F.round(F.least("extraction_confidence", unit_confidence(F.col("unit"), F.col("unit_source")), F.when(F.col("entity_id").isNotNull(), 1.0).otherwise(0.5)), 3)


def run_gates(candidates: DataFrame, found: DataFrame, metrics: list[str], floor: float = PASS_FLOOR) -> DataFrame:
    """Seven gates, each reached only if those before passed: gate_results, failed_gate, failure_reason, confidence, state."""
    per = found.groupBy("candidate_id").agg(
        F.min_by("message", F.when(F.col("severity") == "block", F.struct("ord", "message"))).alias("block"),
        F.count_if(F.col("severity") == "block").alias("blocks"),
        F.count_if(F.col("severity") == "warn").alias("warns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "warn", F.struct("ord", "message")))), lambda w: w["message"]), "; ").alias("warned"),
    )
    c = candidates.join(per, "candidate_id", "left").withColumn("confidence", confidence())
    blocks, warns = F.coalesce("blocks", F.lit(0)), F.coalesce("warns", F.lit(0))
    has_value = F.col("value").isNotNull() | (F.coalesce("value_text", F.lit("")) != "")
    needed = {"entity_id": F.col("entity_id"), "metric_key": F.col("metric_key"), "value": F.when(has_value, "x"), "period": F.col("period"), "status": F.col("status")}
    missing = [F.when(v.isNull(), k) for k, v in needed.items()] + [F.when(F.col("value").isNotNull() & F.col("unit").isNull(), "unit")]
    lacking = F.array_compact(F.array(*missing))
    gates = [
        ("G1", (F.coalesce("metric_key", F.lit("")) != "") & has_value, F.lit("no metric or value")),
        ("G2", F.size(lacking) == 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
        ("G3", F.col("metric_key").isin(*metrics), F.concat(F.lit("unknown metric "), F.coalesce("metric_key", F.lit("")))),
        ("G4", F.lit(True), F.lit("")),
        ("G5", blocks == 0, F.coalesce("block", F.lit(""))),
        ("G6", F.lit(True), F.lit("")),
        ("G7", (F.col("confidence") >= floor) & (warns == 0), F.when(warns > 0, F.col("warned")).otherwise(F.concat(F.lit("confidence "), F.col("confidence").cast("string")))),
    ]
    ok = [F.coalesce(p, F.lit(False)) for _, p, _ in gates]
    failed = F.coalesce(*[F.when(~p, g) for p, (g, *_) in zip(ok, gates)])
    ran = F.coalesce(*[F.when(~p, i + 1) for i, p in enumerate(ok)], F.lit(len(gates)))
    results = F.array(*[F.struct(F.lit(g).alias("gate"), p.alias("passed"), F.when(~p, why).when(F.lit(g == "G5") & (warns > 0), F.col("warned")).alias("reason")) for p, (g, _, why) in zip(ok, gates)])
    state = F.when(failed.isNull(), "auto_passed").when(failed == "G7", "pending_review").otherwise("soft_rejected")
    reason = F.coalesce(*[F.when(~p, why) for p, (_, _, why) in zip(ok, gates)])
    return c.select(*candidates.columns, "confidence", F.slice(results, F.lit(1), ran).alias("gate_results"), failed.alias("failed_gate"), reason.alias("failure_reason"), state.alias("state"))


def merge_run(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("published", "rejected")) -> DataFrame:
    """A re-run over a stored table: candidates that vanished go, but what a person decided stays as it was."""
    decided = old.where(F.col("state").isin(*keep))
    return decided.unionByName(new.join(decided.select("candidate_id"), "candidate_id", "left_anti").select(*new.columns), allowMissingColumns=True)


def _keyed(candidates: DataFrame, r: Rule, within: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """A pair rule's two sides with their keys."""
    names = [*r.match_on, *within]
    keys = [f"__k{i}" for i in range(len(names))]
    return candidates.where(F.col("metric_key").isin(r.metric_a, r.metric_b)).select("*", *[key_of(k).alias(n) for k, n in zip(names, keys)]), keys


def assay_after(judged: DataFrame, found: DataFrame, changed: DataFrame, rules: list[Rule], metrics: list[str], removed: DataFrame | None = None, within: tuple[str, ...] = (), floor: float = PASS_FLOOR) -> tuple[DataFrame, DataFrame]:
    """The verdicts and findings after some candidates changed, came or went: equal to a whole run, but a pair rule looks only at
    keys that one of these had or has, a range rule at them alone, and only candidates whose findings may differ are judged anew.

    judged and found: the last run's `run_gates` and `findings`; changed: new versions of candidates (without verdicts), new ones
    included; removed: candidate_ids to take out. What people decided is merged afterwards, as after any run (`merge_run`)."""
    base = judged.select(*changed.columns)
    gone = changed.select("candidate_id")
    gone = cut((gone if removed is None else gone.unionByName(removed.select("candidate_id"))).distinct())
    before = cut(base.join(gone, "candidate_id", "left_semi"))
    after = base.join(gone, "candidate_id", "left_anti").unionByName(changed)
    moved = before.unionByName(changed)

    fresh, dropped, anew = [range_findings(changed, rules)], [], [changed.select("candidate_id")]
    for order, r in enumerate(rules):
        if r.type != "pair":
            continue
        touched, keys = _keyed(moved, r, within)
        touched = cut(touched.select(*[F.col(k).alias(f"t{k}") for k in keys]).distinct())
        rows, _ = _keyed(after, r, within)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"t{k}")) for k in keys], F.lit(True))
        scope = cut(rows.join(touched, same, "left_semi").drop(*keys))
        # The rule keeps its place among all rules, by which findings are ordered.
        fresh.append(pair_findings(scope, [r], within).withColumn("ord", F.lit(1000 + order)))
        dropped.append(scope.select("candidate_id", F.lit(1000 + order).alias("ord")))
        anew.append(scope.select("candidate_id"))
    kept = found.join(gone, "candidate_id", "left_anti")
    if dropped:
        kept = kept.join(reduce(DataFrame.unionByName, dropped).distinct(), ["candidate_id", "ord"], "left_anti")
    now = cut(kept.select(*FINDING).unionByName(reduce(DataFrame.unionByName, [f.select(*FINDING) for f in fresh])))
    again = cut(reduce(DataFrame.unionByName, anew).distinct())
    rejudged = run_gates(after.join(again, "candidate_id", "left_semi"), now.join(again, "candidate_id", "left_semi"), metrics, floor)
    rest = judged.join(again, "candidate_id", "left_anti").join(gone, "candidate_id", "left_anti")
    return rest.unionByName(rejudged.select(*judged.columns)), now


def state_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("state").agg(F.count("*").alias("n"))


def failure_counts(candidates: DataFrame) -> DataFrame:
    return candidates.where("failed_gate is not null").groupBy("failed_gate").agg(F.count("*").alias("n"))


def reeval(candidates: DataFrame, rules: list[Rule], metrics: list[str], pack: Pack, within: tuple[str, ...] = ()) -> DataFrame:
    """Soft-rejected candidates judged anew under the pack's patterns; rules look at all rows, other rows stay."""
    entity = F.coalesce("entity_id", *[resolve_entity(F.col("entity_raw"), p) for p in pack.entity_patterns.values()])
    tried = candidates.withColumn("__again", F.col("state") == "soft_rejected").withColumn("entity_id", F.when(F.col("__again"), entity).otherwise(F.col("entity_id")))
    base = tried.drop("confidence", "gate_results", "failed_gate", "failure_reason", "state")
    fresh = run_gates(base, findings(base, rules, within), metrics).where("__again").withColumn("reeval_count", F.col("reeval_count") + 1)
    return candidates.where(F.col("state").isNull() | (F.col("state") != "soft_rejected")).unionByName(fresh.select(*candidates.columns))


def run_summary(judged: DataFrame, run_id: str, pack_version: int, started_at) -> DataFrame:
    """One row per document of a run: how many candidates it has, their states, and the gates that they failed at."""
    counts = judged.groupBy("doc_id", "state", "failed_gate").count()
    tally = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "n")))))
    per = lambda c, name: counts.where(F.col(c).isNotNull()).groupBy("doc_id", c).agg(F.sum("count").alias("n")).groupBy("doc_id").agg(tally(c).alias(name))
    total = counts.groupBy("doc_id").agg(F.sum("count").alias("candidate_count"))
    none = F.create_map().cast("map<string,bigint>")
    joined = total.join(per("state", "state_counts"), "doc_id", "left").join(per("failed_gate", "failure_counts"), "doc_id", "left")
    return joined.select(
        F.concat_ws("-", F.lit(run_id), "doc_id").alias("run_id"), "doc_id", F.lit(pack_version).alias("pack_version"), F.lit(started_at).cast("timestamp").alias("started_at"), "candidate_count",
        F.coalesce("state_counts", none).alias("state_counts"), F.coalesce("failure_counts", none).alias("failure_counts"),
    )


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """People's decisions (candidate_id, state, approver, at); the latest wins."""
    latest = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("state", "approver"), "at").alias("d"))
    rest = [c for c in candidates.columns if c not in ("state", "approver")]
    return candidates.join(latest, "candidate_id", "left").select(*rest, F.coalesce("d.state", "state").alias("state"), F.coalesce(F.col("d.approver"), F.col("approver") if "approver" in candidates.columns else F.lit(None)).alias("approver"))


def explain(candidates: DataFrame, candidate_id: str) -> DataFrame:
    return candidates.where(F.col("candidate_id") == candidate_id).select("candidate_id", F.posexplode("gate_results").alias("step", "g")).select("candidate_id", "step", "g.*")


def review_queue(candidates: DataFrame, state: str = "pending_review") -> DataFrame:
    return candidates.where(F.col("state") == state).orderBy("confidence", "candidate_id")


def latest_per(df: DataFrame, key: str, by: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def observed_run(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """`judged` with totals that come out of the very pass that writes it: once an action has run over it, `get` of the
    observation tells candidates, each state and each failed gate."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    states = [F.count_if(F.col("state") == s).alias(f"state_{s}") for s in ("auto_passed", "pending_review", "soft_rejected", "published", "rejected")]
    gates = [F.count_if(F.col("failed_gate") == f"G{i}").alias(f"failed_G{i}") for i in range(1, 8)]
    return judged.observe(seen, F.count(F.lit(1)).alias("candidates"), *states, *gates), seen
