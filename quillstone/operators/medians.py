"""Exact medians of a few large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .joins import meet

#: Ranges that a group's values are counted in, in each round.
RANGES = 4096
#: Values of a group that one task may sort at the end.
SORTED = 1 << 16


def medians(df: DataFrame, by: list[str], value: str, ranges: int = RANGES, at_end: int = SORTED) -> DataFrame:
    """by and median (the mean of the two middle values of an even number; null where a group has no value).

    Each round counts the values that are left in equal ranges between their least and
    greatest one, and keeps the range that the middle is in: which range a value is
    in never falls as the value rises, whatever rounding does, so the middle is never
    lost. When at_end values or one distinct value are left, the middle is read off.
    Counts are pre-aggregated; a group's counts, ranges rows at most, are all that
    is gathered. NaN and infinite values are left out, as nulls are. Groups are few.
    """
    keys = [F.col(c) for c in by]
    key = F.struct(F.lit(0).alias("__one"), *keys).alias("__g")
    rows = df.select(*by, key, F.col(value).cast("double").alias("v"))
    groups = written(rows.select(*by, "__g").distinct(), "groups")
    rows = written(rows.select("__g", "v").where(F.abs("v") < F.lit(float("inf"))), "values")
    total = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # the middle's two places, counted from 0 among the values between lo and hi
    ends = total.select("__g", "lo", "hi", "n", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("place")).groupBy("__g", "place", "lo", "hi", "n").agg(F.count(F.lit(1)).alias("copies"))
    ends = written(ends, "ends")
    while not ends.where((F.col("n") > at_end) & (F.col("lo") < F.col("hi"))).isEmpty():
        open_ = ends.where((F.col("n") > at_end) & (F.col("lo") < F.col("hi")))
        spans = written(open_.groupBy("__g").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")  # two at most
        inside = meet(rows, spans, "__g", F.xxhash64("v"), F.lit(8), "inner").select("__g", "v", F.explode("spans").alias("s")).where(F.col("v").between(F.col("s.lo"), F.col("s.hi")))
        half = F.col("v") / 2 - F.col("s.lo") / 2  # halves, so that no difference of doubles overflows
        which = F.least(F.floor(half / (F.col("s.hi") / 2 - F.col("s.lo") / 2) * ranges), F.lit(ranges - 1))
        counted = inside.groupBy("__g", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), which.alias("range")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        counted = written(counted, "counted")
        before = F.coalesce(F.sum("m").over(Window.partitionBy("__g", "lo", "hi").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        next_ = open_.join(counted.withColumn("before", before), ["__g", "lo", "hi"]).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m")))
        moved = next_.select("__g", (F.col("place") - F.col("before")).alias("place"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("m").alias("n"), "copies")
        ends = written(ends.where((F.col("n") <= at_end) | (F.col("lo") >= F.col("hi"))).unionByName(moved), "ends")
    sure = ends.where(F.col("lo") >= F.col("hi")).select("__g", F.col("lo").alias("v"), "copies")
    left = written(ends.where(F.col("lo") < F.col("hi")), "left")
    spans = left.groupBy("__g").agg(F.collect_list(F.struct("lo", "hi", "place", "copies")).alias("spans"))
    last = meet(rows, written(spans, "spans"), "__g", F.xxhash64("v"), F.lit(16), "inner").select("__g", "v", F.explode("spans").alias("s")).where(F.col("v").between(F.col("s.lo"), F.col("s.hi")))
    rank = F.row_number().over(Window.partitionBy("__g", "s").orderBy("v")) - 1
    read = last.withColumn("rank", rank).where(F.col("rank") == F.col("s.place")).select("__g", "v", F.col("s.copies").alias("copies"))
    both = sure.unionByName(read).groupBy("__g").agg((F.sum(F.col("v") * F.col("copies")) / F.sum("copies")).alias("median"))
    return groups.join(both, "__g", "left").select(*by, "median")
