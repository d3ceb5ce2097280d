"""Queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import sound_unions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; where it comes in fewer splits than there are cores, dealt by id, as patterns are costly to match."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def inline(spark: SparkSession, columns: str, values: str) -> DataFrame:
    """Rows given as SQL values; the text is also valid for the oracle."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def inline_sql(name: str, columns: str, values: str) -> str:
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {values}) AS t({columns}))"
