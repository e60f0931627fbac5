"""Implied growth: the rate at which ten years of cash flow and a terminal value are worth today's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import safe_div

# Bounds of growth, steps, tolerance, and the grid.
LOW, HIGH, STEPS, TOLERANCE, YEARS = -0.10, 0.50, 60, 1e-3, 10
DISCOUNTS, MULTIPLES = (0.08, 0.10, 0.12), (15.0, 20.0, 25.0)


def present_value(fcf: Column, growth: Column, discount: Column, multiple: Column, years: int = YEARS) -> Column:
    """Cash flows of the years, each grown and discounted, and the last one's multiple at the end; one expression, so it stays in generated code."""
    out = F.lit(0.0)
    for t in range(1, years + 1):
        out = out + fcf * F.pow(1 + growth, F.lit(float(t))) / F.pow(1 + discount, F.lit(float(t)))
    return out + fcf * F.pow(1 + growth, F.lit(float(years))) * multiple / F.pow(1 + discount, F.lit(float(years)))


def implied_growth(fcf: Column, price: Column, discount: Column, multiple: Column) -> Column:
    """Bisection: the first midpoint within 0.1 % of the price (or the last after 60); null if fcf or price is not positive or the answer lies outside the bounds."""
    start = F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), F.lit(None).cast("double").alias("g"))

    def step(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        value = present_value(fcf, mid, discount, multiple)
        near = F.abs(value - price) / price < TOLERANCE
        return F.when(acc["g"].isNotNull(), acc).otherwise(F.struct(F.when(value < price, mid).otherwise(acc["lo"]).alias("lo"), F.when(value < price, acc["hi"]).otherwise(mid).alias("hi"), F.when(near, mid).alias("g")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: F.coalesce(acc["g"], (acc["lo"] + acc["hi"]) / 2))
    inside = (present_value(fcf, F.lit(LOW), discount, multiple) <= price) & (present_value(fcf, F.lit(HIGH), discount, multiple) >= price)
    return F.when((fcf > 0) & (price > 0) & inside, found)


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, m) for d in DISCOUNTS for m in MULTIPLES], "discount double, multiple double")


def reverse_dcf(df: DataFrame, fcf: str, price: str) -> DataFrame:
    """Each row in each cell of the grid (nine fixed cells)."""
    cells = df.crossJoin(F.broadcast(grid(df.sparkSession)))
    return cells.withColumn("implied_growth", implied_growth(F.col(fcf), F.col(price), F.col("discount"), F.col("multiple")))


def growth_between(first: str, last: str, years: int) -> Column:
    """Yearly growth between two positive values."""
    return F.when((F.col(first) > 0) & (F.col(last) > 0), F.pow(safe_div(last, first), F.lit(1.0 / years)) - 1)


def stretched(implied: Column, cagr5: Column, cagr3: Column) -> Column:
    """More than five points over the growth of five (else three) years; over 12 % where neither is known. An implied growth of 0 or none is not."""
    actual = F.coalesce(cagr5, cagr3)
    known = F.coalesce(implied, F.lit(0.0)) != 0
    return known & F.when(actual.isNotNull(), implied > actual + 0.05).otherwise(implied > 0.12)
