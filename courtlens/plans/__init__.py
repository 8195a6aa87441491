"""Queries that bind the operators to the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtlens.plans import documents, rosters, schools, tables, values
from courtlens.plans.binding import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (values, rosters, schools, tables, documents):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["team_pivot"](spark, sf_dir)
