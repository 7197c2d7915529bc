"""From questions to recorded answers, without a language model: every step over all questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from . import ledger as L
from .broker import Broker, coverage_members, fact_members
from .language import entailed

#: Figures of one page of an answer.
SHOWN = 20


def evidence_of(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts that each question is about, with its question_id and title. Questions on an entity meet the facts of their metric
    and entity, and only those on any entity all facts of their metric."""
    own = ["fact_id", "value", "value_text", "unit", "period"]
    told = asked.select("question_id", "title", "metric_key", F.col("entity_id").alias("__e"))
    about = facts.select("metric_key", "entity_id", *own)
    named = told.where("__e is not null").withColumnRenamed("__e", "entity_id").join(about, ["metric_key", "entity_id"])
    met = [df.select("question_id", "title", "metric_key", "entity_id", *own) for df in (named, told.where("__e is null").join(about, "metric_key"))]
    return met[0].unionByName(met[1])


def answer_questions(broker: Broker, questions: DataFrame, shown: int = SHOWN) -> DataFrame:
    """questions: question_id, title, metric_key, entity_id (null: any). Evidence is sealed, coverage looked up, the metric
    computed, its figures narrated in pages of `shown`, by fact_id, and the answer recorded in the lineage. Every figure, on whatever
    page, must follow from its own fact. All pages are rows of the broker's table `answer_page` (question_id, page, n_figures,
    text), of which the answer shows the first. question_id, status (answered, not_covered, not_entailed), reason, n_facts,
    total, text and package_id; an answer that does not follow from its evidence has no text and is not recorded.
    """
    for tool in ("seal_evidence_package", "check_coverage", "compute_metric", "get_provenance", "record_answer"):
        broker._authorize(tool)
    asked = cut(questions.select("question_id", "title", "metric_key", "entity_id"))
    facts = broker._facts()
    evidence = cut(evidence_of(asked, facts))

    candidates = broker.visible_candidates()
    wanted = L.coverage(asked, candidates, facts)
    same = (F.col("a.metric_key") == F.col("w.metric_key")) & F.col("a.entity_id").eqNullSafe(F.col("w.entity_id"))
    covered = cut(asked.alias("a").join(wanted.alias("w"), same).select("a.question_id", "a.title", "w.*"))
    members = fact_members(evidence.withColumn("request", F.col("question_id"))).unionByName(coverage_members(covered.withColumn("request", F.col("question_id"))))
    packages = broker.seal_members(members, asked.select(F.col("question_id").alias("request"), F.col("title").alias("intent")))

    totals = evidence.groupBy("question_id").agg(F.count("*").alias("n_facts"), F.sum("value").alias("total"))
    figure = F.concat(F.col("metric_key"), F.lit(" is "), F.concat_ws(" ", "value_text", "unit"), F.lit(" ["), F.col("fact_id"), F.lit("]"))
    told = evidence.select("question_id", "fact_id", figure.alias("figure"), entailed(figure, F.concat_ws(" ", "metric_key", "value_text", "unit")).alias("ok"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("fact_id")) - 1
    paged = told.withColumn("page", F.floor(place / shown) + 1).groupBy("question_id", "page")
    pages = cut(paged.agg(F.count("*").alias("n_figures"), F.bool_and("ok").alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "figure"))), lambda x: x["figure"]), "; ").alias("text")))
    drafts = pages.groupBy("question_id").agg(F.bool_and("ok").alias("ok"), F.max(F.when(F.col("page") == 1, F.col("text"))).alias("figures"))
    joined = reduce(lambda a, b: a.join(b, "question_id", "left"), [totals, drafts, packages.withColumnRenamed("request", "question_id")], covered)
    status = F.when(~F.col("covered"), "not_covered").when(F.coalesce("ok", F.lit(False)), "answered").otherwise("not_entailed")
    text = F.when(F.col("status") == "answered", F.concat(F.col("title"), F.lit(": "), F.col("figures"), F.lit(".")))
    answers = cut(joined.withColumn("status", status).select("question_id", "status", "reason", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "total", text.alias("text"), "package_id"))
    recorded = answers.where("status = 'answered'")
    broker.tables["answer_page"] = pages.join(recorded.select("question_id"), "question_id", "left_semi").select("question_id", "page", "n_figures", "text")
    broker._add_edges(recorded.select(F.lit("answer").alias("from_kind"), F.col("question_id").alias("from_id"), F.lit("package").alias("to_kind"), F.col("package_id").alias("to_id"), F.lit("answered_from").alias("activity"), F.lit(broker.principal.subject).alias("agent")))
    return answers
