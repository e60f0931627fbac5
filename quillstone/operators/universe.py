"""Screens, code ranges, top-k and search over a universe of instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import first_of, safe_div


def screen(df: DataFrame, kind: str, cap: str, price: str, volume: str, pinned: str | None = None, cap_range: tuple[float, float] = (50e6, 2e9), least_price: float = 1.0, least_volume: float = 1e6) -> DataFrame:
    """Equities (or unknown) within the bounds; pinned names come in whatever theirs are."""
    ok = (F.col(kind).isNull() | (F.col(kind) == "EQUITY")) & F.col(cap).between(*cap_range) & (F.col(price) >= least_price) & (F.col(volume) >= least_volume)
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok | F.coalesce(F.col(pinned), F.lit(False)) if pinned else ok)


def top(df: DataFrame, value: str, n: int, *ties: str, positive: bool = False) -> DataFrame:
    """The n rows of largest value (nulls as 0); Spark keeps only n in each task."""
    df = df.where(F.col(value) > 0) if positive else df
    return df.orderBy(F.coalesce(F.col(value), F.lit(0)).desc(), *ties).limit(n)


def range_table(spark: SparkSession, rows: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, lo int, hi int, label string")


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """'7372,3674-3679' as pairs; parts that are no numbers are dropped."""
    out = []
    for part in text.split(","):
        ends = [p.strip() for p in part.split("-")]
        if all(e.isdigit() for e in ends) and len(ends) in (1, 2):
            out.append((int(ends[0]), int(ends[-1])))
    return out


def classify(df: DataFrame, ranges: DataFrame, code: str) -> DataFrame:
    """The first labelled range that holds the code. The range table is a fixed dimension, so the join is broadcast; rows fan out by overlapping ranges only."""
    hit = df.select(F.col(code).alias("__c")).distinct().join(F.broadcast(ranges), F.col("__c").between(F.col("lo"), F.col("hi")))
    first = hit.groupBy("__c").agg(F.min_by("label", "ord").alias("label"))
    return df.join(first, F.col(code) == F.col("__c"), "left").drop("__c")


def plain_symbol(symbol: str) -> Column:
    return F.col(symbol).rlike("^[A-Z]{1,5}$")


def suggest(df: DataFrame, ticker: str, name: str, focus: Column, query: str, n: int = 8) -> DataFrame:
    """Tickers that contain the query (any case, trimmed; an empty one: all): prefixes first, then by rows, then by ticker."""
    q = query.strip().upper()
    t = F.upper(F.col(ticker))
    hit = df.where(t.contains(q)) if q else df
    g = hit.groupBy(F.col(ticker).alias("ticker")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(focus).alias("focus"), F.min(name).alias("name"))
    return g.orderBy(F.upper("ticker").startswith(q).desc(), F.col("n").desc(), "ticker").limit(n)


def floor_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at floor(n / 2) of the sorted values (the upper of two middle ones)."""
    w = Window.partitionBy(*by)
    m = df.where(F.col(value).isNotNull()).withColumns({"rn": F.row_number().over(w.orderBy(value)), "n": F.count(F.lit(1)).over(w)})
    return m.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select(*by, F.col(value).alias("median"))


def historical_multiple(df: DataFrame, by: list[str], price: str, base: str, most: float, least: int = 5) -> DataFrame:
    """Median of price / base over the rows where it lies in (0, most); null of fewer than five."""
    m = df.withColumn("m", safe_div(price, base))
    ok = (F.col("m") > 0) & (F.col("m") < most)
    return m.groupBy(*by).agg(F.when(F.count_if(ok) >= least, F.median(F.when(ok, F.col("m")))).alias("median"), F.count_if(ok).alias("n"))


def valuation_gap(implied: Column, actual: Column, points: float = 10.0) -> tuple[Column, Column]:
    """Whether the two rates are more than ten points apart, and which way."""
    gap = F.abs(implied - actual) * 100
    flag = gap > points
    return flag, F.when(flag, F.when(implied < actual, "below").otherwise("above"))


def versus_median(x: Column, median: Column) -> Column:
    return first_of((x.isNull() | median.isNull(), None), (x > median * 1.1, "above"), (x < median * 0.9, "below"), otherwise="near")
