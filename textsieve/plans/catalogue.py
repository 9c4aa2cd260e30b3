"""Named queries over the tables of a folder, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import record_queries, text_queries, upkeep_queries

ALL = text_queries.QUERIES | record_queries.QUERIES | upkeep_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ALL["rule_hits_by_rule"][0](spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
