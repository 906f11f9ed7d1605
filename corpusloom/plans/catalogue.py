"""All core queries and their SQL counterparts, collected by section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import answers, evidence, inventory, rollups, scalars, scans, search, storing, streams

Query = Callable[[SparkSession, str], DataFrame]
SECTIONS = [search, scalars, storing, evidence, answers, scans, inventory, rollups, streams]


def queries() -> dict[str, Query]:
    return {name: f for section in SECTIONS for name, f in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for section in SECTIONS for name, sql in section.SQL.items()}
