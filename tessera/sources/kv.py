"""An ordered table of binary keys and values; binaries sort by unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(table: DataFrame, new: DataFrame) -> DataFrame:
    """New keys replace old ones; a null value is an empty one. Of a key that ``new`` repeats the last by ``seq`` stays, if it has one, else the greatest value."""
    value = F.coalesce("value", F.expr("cast('' as binary)"))
    last = F.struct(F.col("seq"), value) if "seq" in new.columns else F.struct(value)
    new = new.groupBy("key").agg(F.max_by(value, last).alias("value"))
    return table.join(new, "key", "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, "key", "left_anti")


def get(table: DataFrame, key: Column) -> DataFrame:
    return table.where(F.col("key") == key).limit(1)


def exists(table: DataFrame, key: Column) -> bool:
    return not get(table, key).isEmpty()


def scan(table: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Keys in [start, end), an end of None open, in order."""
    if start is not None:
        table = table.where(F.col("key") >= start)
    if end is not None:
        table = table.where(F.col("key") < end)
    return table.orderBy("key")
