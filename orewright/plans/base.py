"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)
