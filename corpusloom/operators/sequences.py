"""What stood before each row of a sequence, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(rows: DataFrame, group: str, order: list[str], value: Column, slot: Column, name: str = "before") -> DataFrame:
    """Adds `name`: the value of the row before, within the group and in the given order; null for the first row.

    slot must not fall where the order rises (an hour of a time, a range of a number). A group is cut at its slots: only
    the rows of one slot are sorted together, and each slot hands its last value on to the next one. Null groups form one
    group; null order columns come first; a null value is handed on as null.
    """
    # The row goes along as a whole, so none of its columns can clash with the helpers.
    tagged = rows.select(F.struct(*rows.columns).alias("row"), F.col(group).alias("g"), F.struct(*order).alias("at"), slot.alias("slot"), F.struct(value.alias("v")).alias("value"))
    inside = F.lag("value").over(Window.partitionBy("g", "slot").orderBy("at"))
    last = tagged.groupBy(F.col("g").alias("group"), F.col("slot").alias("part")).agg(F.max_by("value", "at").alias("last"))
    carried = last.select("group", "part", F.lag("last").over(Window.partitionBy("group").orderBy("part")).alias("carried"))
    same = F.col("g").eqNullSafe(F.col("group")) & F.col("slot").eqNullSafe(F.col("part"))
    joined = tagged.withColumn("inside", inside).join(carried, same, "left")
    return joined.select("row.*", F.coalesce("inside", "carried")["v"].alias(name))
