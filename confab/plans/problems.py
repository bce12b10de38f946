"""The core's training-data query: nested records to flat child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confab.operators import nested
from confab.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_links(table(spark, sf_dir, "segments"), table(spark, sf_dir, "sessions"))


def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_table(table(spark, sf_dir, "segments"), "candidate")


def p3_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_table(table(spark, sf_dir, "sessions"), "channel")


QUERIES = {f.__name__: f for f in (p3_found, p3_candidates, p3_channels)}
ORACLE_SQL: dict[str, str] = {}
