"""Keyed tables and state between runs: differences, upserts, sticky status, flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(fetched: DataFrame, seen: DataFrame, key: str, order: list[Column], date: str) -> DataFrame:
    """fetched - seen, once each (first wins), with the high-water mark of all that was fetched."""
    first = Window.partitionBy(key).orderBy(*order)
    new = fetched.join(seen.select(key), key, "left_anti").withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    mark = fetched.agg(F.max(date).alias("high_water"))
    return new.crossJoin(F.broadcast(mark))  # one row


def advance(seen: DataFrame, new: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The cursor takes up what was handled; failed events are offered again."""
    return seen.select(key).unionByName(new.select(key).join(failed.select(key), key, "left_anti")).distinct()


def union_last_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Both by key; the new side wins, within a side the first in order."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("__src").desc(), *order)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__src")


def upsert_keep_old(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A full outer join; a null in the new row keeps the old value."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def replace_children(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete, then insert, for the keys of new."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def sticky(items: DataFrame, prior: DataFrame, now: DataFrame, key: list[str], status: str, start: str = "green") -> DataFrame:
    """New status where there is a signal, else the one before, else `start`."""
    p, n = prior.select(*key, F.col(status).alias("prior")), now.select(*key, F.col(status).alias("now"))
    out = items.select(*key).join(p, key, "left").join(n, key, "left")
    return out.select(*key, F.coalesce("prior", F.lit(start)).alias("prior"), F.coalesce("now", "prior", F.lit(start)).alias(status))


def flips(statuses: DataFrame, status: str) -> DataFrame:
    return statuses.where(F.col("prior") != F.col(status))
