"""Joins whose small side has a checked size and another way beyond it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values (8 bytes each) of a summary that is sent to all tasks, at most.
SENT_VALUES = 1 << 20
#: Slices of each key of a summary that is shuffled: so many tasks meet a key that a third of the rows have.
SLICES = 32


def meet(rows: DataFrame, summary: DataFrame, key: str, spread: Column, values: Column | None = None, how: str = "left", often: Callable[[], DataFrame] | None = None) -> DataFrame:
    """rows with the columns of the written summary (one row a key), by a column that both have.

    A summary of up to SENT_VALUES values in all is broadcast; of a larger one each row
    is repeated once for each slice that spread deals the rows into. values: how many
    values a row of the summary holds (its columns by default). often: makes the written
    few keys that many rows have; then only their rows are sliced and repeated.
    """
    size = summary.agg(F.sum(values if values is not None else F.lit(len(summary.columns)))).first()[0] or 0
    if size <= SENT_VALUES:
        return rows.join(F.broadcast(summary), key, how)
    many = F.lit(True)
    if often is not None:
        hot = F.broadcast(often().select(key, F.lit(True).alias("__often")))
        rows, summary = rows.join(hot, key, "left"), summary.join(hot, key, "left")
        many = F.coalesce("__often", F.col(key).isNull())  # nulls meet nothing, but would be in one task
    left = rows.withColumn("__slice", F.when(many, F.pmod(spread, F.lit(SLICES)).cast("int")).otherwise(0)).drop("__often")
    right = summary.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.when(many, SLICES - 1).otherwise(0)))).drop("__often")
    return left.join(right, [key, "__slice"], how).drop("__slice")
