"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 10_000


def by_group(rows: DataFrame, groups: DataFrame, key: str = "h", size: str = "n", how: str = "inner") -> DataFrame:
    """rows joined by key with groups (key, size, ...), one row per key, size being the number of rows with that key.

    Groups with more than a ten-thousandth of all grouped rows, which are fewer than HOT_GROUPS, are broadcast, so that no hot group is
    gathered in one task; the others are joined by shuffle. groups is read three times: pass a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(size) * HOT_GROUPS > total))
    rest = groups.where(F.col(size) * HOT_GROUPS <= total)
    return rows.join(hot, key, how).unionByName(rows.join(rest, key, how))
