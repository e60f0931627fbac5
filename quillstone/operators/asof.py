"""As-of joins without an inequality join: one shuffle on the key, one sort, a window; by pieces of time where a key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _union(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("__hit"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(right_time, *values).alias("__hit"))
    return a.unionByName(b)


#: Pieces that the rows of one key are dealt into by time, so that no key is sorted in one task.
PIECES = 16


def _beside(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """df with the other columns of small, whose keys are distinct; a null key meets a null key."""
    s = small.withColumnsRenamed({c: f"__of_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
    return df.join(s, on).drop(*(f"__of_{c}" for c in by))


def _carried(both: DataFrame, by: list[str], ascending: bool, pieces: int) -> DataFrame:
    """__hit: of each row the last right row up to it in time order (or the next one from it on).

    Each key's span of time is cut into equal pieces, which are sorted on their
    own; the last right row of each piece (one small row) is carried into the next.
    """
    span = both.groupBy(*by).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.greatest(F.ceil((at("__hi") - at("__lo") + 1) / pieces), F.lit(1))
    cut = _beside(both, span, by).withColumn("__piece", F.floor((at("__t") - at("__lo")) / width).cast("int")).drop("__lo", "__hi")
    order = F.col("__t") if ascending else F.col("__t").desc()
    w = Window.partitionBy(*by, "__piece").orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("__own", F.last("__hit", ignorenulls=True).over(w))
    pick = F.max_by if ascending else F.min_by
    ends = cut.groupBy(*by, "__piece").agg(pick("__hit", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    step = F.col("__piece") if ascending else F.col("__piece").desc()
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    return _beside(own, carry, [*by, "__piece"]).withColumn("__hit", F.coalesce("__own", "__carry"))


def backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], prefix: str = "", pieces: int = 1) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (nulls where there is none).

    pieces: more than one cuts each key by time, for keys that hold a large part of all rows.
    """
    return _joined(left, right, by, left_time, right_time, values, prefix, True, pieces)


def forward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], prefix: str = "", pieces: int = 1) -> DataFrame:
    """Each left row with the first right row of its key at or after its time."""
    return _joined(left, right, by, left_time, right_time, values, prefix, False, pieces)


def _joined(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], prefix: str, ascending: bool, pieces: int) -> DataFrame:
    both = _union(left, right, by, left_time, right_time, values)
    if pieces > 1:
        return _out(_carried(both, by, ascending, pieces), right_time, values, prefix)
    w = Window.partitionBy(*by).orderBy(F.col("__t") if ascending else F.col("__t").desc(), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _out(both.withColumn("__hit", F.last("__hit", ignorenulls=True).over(w)), right_time, values, prefix)


def _out(df: DataFrame, right_time: str, values: list[str], prefix: str) -> DataFrame:
    hits = [F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in (right_time, *values)]
    return df.where("__side = 1").select("__row.*", *hits)


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the right row closest in time; the earlier one wins a tie."""
    before = backward(left, right, by, left_time, right_time, values, "b_")
    both = forward(before, right, by, left_time, right_time, values, "f_")
    gap = lambda p: F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(f"{p}{right_time}").cast("timestamp")))
    use_f = F.col(f"b_{right_time}").isNull() | (F.col(f"f_{right_time}").isNotNull() & (gap("f_") < gap("b_")))
    return both.select(*left.columns, *(F.when(use_f, F.col(f"f_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in (right_time, *values)))
