"""Lineage edges, traces back and forward, and the impact of a revision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, dropped, fresh_path, stored


def edge_rows(df: DataFrame, from_kind: str, from_id: Column, to_kind: str, to_id: Column, activity: str, agent: Column | str = "system") -> DataFrame:
    agent = F.lit(agent) if isinstance(agent, str) else agent
    return df.select(F.lit(from_kind).alias("from_kind"), from_id.alias("from_id"), F.lit(to_kind).alias("to_kind"), to_id.alias("to_id"), F.lit(activity).alias("activity"), agent.alias("agent"))


def trace_back(edges: DataFrame, starts: DataFrame, max_depth: int = 20) -> DataFrame:
    """From each (kind, id), the first outgoing edge again and again; stops at candidates, at nodes already seen and at
    `max_depth`. start_kind, start_id, depth, kind, id."""
    w = Window.partitionBy("from_kind", "from_id").orderBy("id")
    first = edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("from_kind", "from_id", "to_kind", "to_id")
    at = starts.select(F.col("kind").alias("start_kind"), F.col("id").alias("start_id"), F.lit(0).alias("depth"), "kind", "id", F.array(F.concat_ws(":", "kind", "id")).alias("seen"))
    out = at
    for _ in range(max_depth):
        step = at.where("kind <> 'candidate'").join(first, (F.col("kind") == F.col("from_kind")) & (F.col("id") == F.col("from_id")))
        key = F.concat_ws(":", "to_kind", "to_id")
        at = cut(step.where(~F.array_contains("seen", key)).select("start_kind", "start_id", (F.col("depth") + 1).alias("depth"), F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), F.array_append("seen", key).alias("seen")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.drop("seen")


def _step_rows(edges: DataFrame, forward: bool) -> DataFrame:
    a, b = ("to", "from") if forward else ("from", "to")
    return edges.select(F.col(f"{a}_kind").alias("at_kind"), F.col(f"{a}_id").alias("at_id"), F.col(f"{b}_kind").alias("next_kind"), F.col(f"{b}_id").alias("next_id"))


PAIR = ["start_kind", "start_id", "kind", "id"]
STEP = ["at_kind", "at_id", "next_kind", "next_id"]

#: While there are so many kinds at most, a round looks only at rows of the kinds that it can meet.
KINDS = 1000


def _kinds(df: DataFrame, *columns: str) -> set[tuple] | None:
    """The different values of some columns of kinds; None if there are too many to be told apart."""
    rows = df.select(*columns).distinct().limit(KINDS + 1).collect()
    return {tuple(x) for x in rows} if len(rows) <= KINDS else None


def _after(ways: set[tuple] | None, kinds: set | None, ends: tuple[str, ...] = ()) -> set | None:
    """The kinds one step on, by the kinds that edges go from and to."""
    return None if ways is None or kinds is None else {b for a, b in ways if a in kinds and a not in ends}


def _within(ways: set[tuple] | None, kinds: set | None, ends: tuple[str, ...] = ()) -> set | None:
    """The kinds that can be come by, those given among them."""
    more = kinds
    while more:
        more = _after(ways, more, ends)
        kinds, more = (None, None) if more is None else (kinds | more, more - kinds)
    return kinds


def _of(df: DataFrame, column: str, kinds: set | None, out: bool = False) -> DataFrame:
    """The rows of some kinds, or with `out` the others."""
    told = sorted(k for k in kinds or () if k is not None)
    own = F.coalesce(F.col(column).isin(*told), F.lit(False)) if told else F.lit(False)
    return df.where(~own if out else own) if kinds is not None else df.where("false") if out else df


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _walk(pairs: DataFrame, step: DataFrame, leaves: tuple[str, ...]) -> DataFrame:
    """One step on from each pair, with the least number of steps."""
    grown = pairs.where(~F.col("kind").isin(*leaves)) if leaves else pairs
    found = grown.join(step, (F.col("kind") == F.col("at_kind")) & (F.col("id") == F.col("at_id")))
    return found.groupBy("start_kind", "start_id", F.col("next_kind").alias("kind"), F.col("next_id").alias("id")).agg((F.min("depth") + 1).alias("depth"))


def _at_start(starts: DataFrame) -> DataFrame:
    return starts.select(F.col("kind").alias("start_kind"), F.col("id").alias("start_id"), "kind", "id", F.lit(0).alias("depth")).distinct()


def closure(edges: DataFrame, starts: DataFrame, forward: bool = False, leaves: tuple[str, ...] = ("candidate",), max_depth: int = 100) -> DataFrame:
    """Everything reachable from each (kind, id), with the least number of steps; backward along edges, or forward
    against them. Kinds in `leaves` end a backward walk. Each round joins only what the last one found, with the edges of its
    kinds, and looks among what is known of the kinds that these lead to."""
    spark, ends = edges.sparkSession, () if forward else leaves
    ways = _kinds(_step_rows(edges, forward), "at_kind", "next_kind")
    frontier = stored(_at_start(starts))
    one = lambda kinds: None if kinds is None else {k for k, in kinds}
    kinds = one(_kinds(frontier, "kind"))
    step = stored(_of(_step_rows(edges, forward), "at_kind", _within(ways, kinds, ends)).distinct(), path := fresh_path(spark))
    seen = [(frontier, kinds)]
    for _ in range(max_depth):
        ahead = _after(ways, kinds, ends)
        if ahead is not None and not ahead:
            break
        found = _walk(frontier, _of(step, "at_kind", kinds), ends)
        known = [_of(df, "kind", ahead).select(*PAIR) for df, own in seen if own is None or ahead is None or own & ahead]
        frontier = stored(found.join(_all(known), PAIR, "left_anti") if known else found)
        kinds = one(_kinds(frontier, "kind"))
        if kinds is not None and not kinds:
            break
        seen.append((frontier, kinds))
    dropped(spark, path)
    return _all([df for df, _ in seen])


def extend_closure(pairs: DataFrame, edges: DataFrame, fresh: DataFrame, starts: DataFrame | None = None, forward: bool = False, leaves: tuple[str, ...] = ("candidate",), max_depth: int = 100) -> DataFrame:
    """The closure `pairs` of `edges` after more edges (and more starts). What is known meets the new edges once; from then on only
    pairs that are new or nearer go on, over all edges. Starts that no new edge can be reached from are not looked at again."""
    spark, ends = edges.sparkSession, () if forward else leaves
    paths = [fresh_path(spark) for _ in range(2)]
    both = _step_rows(edges, forward).withColumn("new", F.lit(False)).unionByName(_step_rows(fresh, forward).withColumn("new", F.lit(True)))
    step = stored(both.groupBy(*STEP).agg(F.min("new").alias("new")), paths[0])
    ways = _kinds(step, "at_kind", "next_kind")
    found = _walk(pairs, step.where("new"), ends)
    if starts is not None:
        found = found.unionByName(_at_start(starts)).groupBy(*PAIR).agg(F.min("depth").alias("depth"))
    found = stored(found, paths[1])
    touched = found.select("start_kind", "start_id", F.lit(True).alias("mine")).distinct()
    marked = stored(pairs.join(touched, ["start_kind", "start_id"], "left").withColumn("mine", F.coalesce("mine", F.lit(False))))
    mine, merged, ahead = [marked.where("mine").drop("mine")], None, None
    for _ in range(max_depth):
        known = _of(_all(mine), "kind", ahead).select(*PAIR, F.col("depth").alias("known"))
        better = found.join(known, PAIR, "left").where("known is null or depth < known")
        frontier = stored(better.select(*PAIR, "depth", F.col("known").isNotNull().alias("nearer")))
        kinds = _kinds(frontier, "kind", "nearer")
        if kinds is not None and not kinds:
            break
        more = frontier.drop("nearer")
        if kinds is None or any(nearer for _, nearer in kinds):
            # A pair that is nearer now stands in an earlier table too.
            rest = stored(_all(mine).join(frontier.where("nearer").select(*PAIR), PAIR, "left_anti"), path := fresh_path(spark))
            if merged:
                dropped(spark, merged)
            mine, merged = [rest, more], path
        else:
            mine.append(more)
        kinds = None if kinds is None else {k for k, _ in kinds}
        ahead = _after(ways, kinds, ends)
        if ahead is not None and not ahead:
            break
        found = _walk(more, _of(step, "at_kind", kinds), ends)
    for path in paths:
        dropped(spark, path)
    return _all([marked.where("not mine").drop("mine"), *mine])


def reach_counts(edges: DataFrame, forward: bool = False, leaves: tuple[str, ...] = ("candidate",), lg_k: int = 12, max_depth: int = 100, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """kind, id and reach of every node that an edge leaves (of some kinds only, if these are given): how many different nodes
    can be reached from it, by sketches of distinct counts (a standard error of 1.04 / sqrt(2 ** lg_k), 1.6 % with the default;
    exact while there are few). A node's sketch is the union of its successors and their sketches, so no pairs of start and node
    are made; a round hands on only sketches that grew in the last, and writes those of the kinds that these can be reached from."""
    spark, ends = edges.sparkSession, () if forward else leaves
    ways = _kinds(_step_rows(edges, forward), "at_kind", "next_kind")
    asked = None if kinds is None else _within(ways, set(kinds), ends)
    step = _of(_step_rows(edges, forward), "at_kind", asked)
    step = stored((step.where(~F.col("at_kind").isin(*ends)) if ends else step).distinct(), path := fresh_path(spark))
    name = F.concat_ws(":", "next_kind", "next_id")
    grew = stored(step.groupBy(F.col("at_kind").alias("kind"), F.col("at_id").alias("id")).agg(F.hll_sketch_agg(name, F.lit(lg_k)).alias("sketch")))
    held = [grew]
    for _ in range(max_depth):
        larger = _kinds(grew, "kind")
        if larger is not None and not larger:
            break
        larger = None if larger is None else {k for k, in larger}
        behind = None if ways is None or larger is None else {a for a, b in ways if b in larger and a not in ends and (asked is None or a in asked)}
        if behind is not None and not behind:
            break
        next_to = grew.select(F.col("kind").alias("next_kind"), F.col("id").alias("next_id"), "sketch")
        more = _of(step, "next_kind", larger).join(next_to, ["next_kind", "next_id"]).groupBy(F.col("at_kind").alias("kind"), F.col("at_id").alias("id")).agg(F.hll_union_agg("sketch").alias("more"))
        joined = _of(_all(held), "kind", behind).join(more, ["kind", "id"], "left").withColumn("both", F.when(F.col("more").isNotNull(), F.hll_union("sketch", "more")))
        grown = F.hll_sketch_estimate("both") > F.hll_sketch_estimate("sketch")
        now = stored(joined.select("kind", "id", F.coalesce("both", "sketch").alias("sketch"), F.coalesce(grown, F.lit(False)).alias("grew")))
        held = [*([] if behind is None else [_of(df, "kind", behind, out=True) for df in held]), now.drop("grew")]
        grew = now.where("grew").drop("grew")
    dropped(spark, path)
    out = _all(held).select("kind", "id", F.hll_sketch_estimate("sketch").alias("reach"))
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))


def with_cells(trace: DataFrame, candidates: DataFrame) -> DataFrame:
    """A trace with one more step, from each candidate to its table cell."""
    cells = candidates.select(F.col("candidate_id").alias("id"), F.concat_ws("/", "doc_id", "table_ref", "cell_ref").alias("cell"))
    last = trace.where("kind = 'candidate'").join(cells, "id").withColumn("depth", F.col("depth") + 1).withColumn("kind", F.lit("cell")).withColumn("id", F.col("cell"))
    return trace.unionByName(last.select(*trace.columns))


def affected_by(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, kind, id, depth: everything that rests on each fact (fact_id), one row each."""
    after = closure(edges, facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id")), forward=True)
    return after.where("depth > 0").select(F.col("start_id").alias("fact_id"), "kind", "id", "depth")


def revision_impact(ledger: DataFrame, revisions: DataFrame, edges: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Per revision (fact_id, new_value): the change, whether it is material, and how much depends on the fact (see
    `affected_by` for what)."""
    change = F.abs(F.col("new_value").cast("decimal(38,18)") - F.col("value").cast("decimal(38,18)"))
    judged = stored(revisions.join(ledger.select("fact_id", "value"), "fact_id").select("fact_id", change.alias("delta")))
    verdict = F.when(F.col("delta") == 0, "unchanged").when(F.col("delta") <= F.lit(tolerance).cast("decimal(38,18)"), "immaterial").otherwise("material")
    counts = affected_by(edges, judged).groupBy("fact_id").agg(F.count("*").alias("n_affected"))
    return judged.withColumn("verdict", verdict).join(counts, "fact_id", "left").withColumn("n_affected", F.coalesce("n_affected", F.lit(0)))
