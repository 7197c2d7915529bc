"""Checks and drafts without a language model, the interface for models, and fallbacks between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reranker(Protocol):
    def rerank(self, query: str, candidates: pd.DataFrame, k: int) -> pd.DataFrame: ...


class EntailmentChecker(Protocol):
    def check(self, claims: pd.Series, evidence: pd.Series) -> pd.Series: ...


class NarrativeGenerator(Protocol):
    def draft(self, titles: pd.Series, figures: pd.Series) -> pd.Series: ...


def missing_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of a claim (citations in brackets aside) that the evidence does not hold."""
    numbers = F.regexp_extract_all(F.regexp_replace(claim, r"\[[^\]]*\]", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(numbers, lambda n: ~F.contains(F.coalesce(evidence, F.lit("")), n))


def entailed(claim: Column, evidence: Column) -> Column:
    return F.size(missing_numbers(claim, evidence)) == 0


def narrative(figures: DataFrame, title: str = "title") -> DataFrame:
    """One sentence per title from (title, metric_key, value_text, unit, figure_id), figures in order of their id."""
    part = F.trim(F.concat(F.col("metric_key"), F.lit(" is "), F.col("value_text"), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" ["), F.col("figure_id"), F.lit("]")))
    grouped = figures.groupBy(title).agg(F.array_sort(F.collect_list(F.when(F.col("figure_id").isNotNull(), F.struct("figure_id", part.alias("part"))))).alias("f"))
    text = F.when(F.size("f") == 0, F.concat(F.col(title), F.lit(": no covered figures for this section."))).otherwise(F.concat(F.col(title), F.lit(": "), F.array_join(F.transform("f", lambda x: x["part"]), "; "), F.lit(".")))
    return grouped.select(title, text.alias("text"), F.transform("f", lambda x: x["figure_id"]).alias("cited"))


def pass_through(ranked: DataFrame, k: int) -> DataFrame:
    """The reranker that changes nothing: the first k."""
    return ranked.orderBy(F.desc("score"), "chunk_id").limit(k)


def rank_scores(order: list[int], n: int) -> list[tuple[int, float]]:
    """A model's ranking as scores 1 / (rank + 1); places out of range are left out."""
    return [(i, 1 / (rank + 1)) for rank, i in enumerate(order) if 0 <= i < n]


def with_fallback(df: DataFrame, chain: list[Callable[[pd.DataFrame], pd.Series]], out: str, kind: str = "string") -> DataFrame:
    """A column from the first backend of a chain that works on a batch; null and the last error if none does."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            error = None
            for backend in chain:
                try:
                    yield batch.assign(**{out: backend(batch), f"{out}_error": None})
                    break
                except Exception as e:  # a backend may fail in any way; the next one is tried
                    error = f"{type(e).__name__}: {e}"
            else:
                yield batch.assign(**{out: None, f"{out}_error": error})

    return df.mapInPandas(run, f"{columns}, `{out}` {kind}, `{out}_error` string")


def memoised(requests: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Requests split by a hash of their whole content: those with a cached answer, and those still to be asked."""
    keyed = requests.withColumn("key", F.sha2(key, 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")
