"""Transitions and accelerations over positions in a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import first_of, safe_div, trailing_run


def _positions(df: DataFrame, by: list[str], order: list[Column], value: str, back: tuple[int, ...]) -> DataFrame:
    """The latest row of each key beside the values so many positions back; order: oldest first."""
    w = Window.partitionBy(*by).orderBy(*order)
    latest = F.row_number().over(Window.partitionBy(*by).orderBy(*(_reversed(order))))
    return df.withColumns({f"back_{k}": F.lag(value, k).over(w) for k in back} | {"__latest": latest}).where("__latest = 1").drop("__latest")


def _reversed(order: list[Column]) -> list[Column]:
    """order holds plain ascending columns."""
    return [c.desc() for c in order]


def share_changes(df: DataFrame, by: list[str], order: list[Column], shares: str) -> DataFrame:
    """qoq against the position before, yoy against four back (null where there is none or it is not positive)."""
    out = _positions(df, by, order, shares, (1, 4))
    up = lambda k: F.when(F.col(f"back_{k}") > 0, safe_div(shares, f"back_{k}") - 1)
    return out.withColumns({"qoq": up(1), "yoy": up(4)})


def dilution(df: DataFrame, by: list[str], order: list[Column], shares: str) -> DataFrame:
    """Growing share counts; a jump of more than 20-fold is a change of unit, not dilution."""
    q, y = F.col("qoq"), F.col("yoy")
    out = share_changes(df, by, order, shares).where(~F.coalesce(q > 20, F.lit(False)))
    return out.withColumn("severity", first_of((q >= 0.25, "critical"), (q >= 0.10, "high"), (y >= 0.5, "high"), (y >= 0.25, "medium"))).where(F.col("severity").isNotNull())


def buyback(df: DataFrame, by: list[str], order: list[Column], shares: str) -> DataFrame:
    """Shrinking share counts; a fall of 30 % in a quarter or 40 % in a year is a reverse split."""
    q, y = F.col("qoq"), F.col("yoy")
    out = share_changes(df, by, order, shares).where(~F.coalesce((q <= -0.30) | (y <= -0.40), F.lit(False)))
    steps = (((q <= -0.05) | (y <= -0.10), "critical"), ((q <= -0.02) | (y <= -0.05), "high"), (y <= -0.02, "medium"))
    steps = tuple((F.coalesce(c, F.lit(False)), v) for c, v in steps)
    return out.withColumn("severity", first_of(*steps)).where(F.col("severity").isNotNull())


def turn(df: DataFrame, by: list[str], order_desc: list[Column], value: str, base: str, least_base: float = 1e6, least_run: int = 2, window: int = 9) -> DataFrame:
    """The latest value is the first above 0 after a run of values that are not, within the last `window` points.

    The latest point's base must reach least_base. Run of 4 or more: critical, else high.
    """
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order_desc))
    last = df.where(F.col(value).isNotNull()).withColumn("rn", rn).where(F.col("rn") <= window)
    flag = F.when(F.col("rn") == 1, F.col(value) > 0).otherwise(F.col(value) <= 0)
    w, ok = trailing_run(flag, by, order_desc)
    g = last.withColumn("ok", ok).groupBy(*by).agg((F.sum("ok") - 1).cast("int").alias("run"), *(F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"latest_{c}") for c in dict.fromkeys((value, base))))
    out = g.where((F.col(f"latest_{value}") > 0) & (F.col("run") >= least_run) & (F.col(f"latest_{base}") >= least_base))
    return out.withColumn("severity", F.when(F.col("run") >= 4, "critical").otherwise("high"))


def acceleration(df: DataFrame, by: list[str], order: list[Column], value: str, least_base: float = 1e6) -> DataFrame:
    """Growth over four positions, now (t0 / t4 - 1) and one earlier (t1 / t5 - 1); six positions are needed."""
    out = _positions(df, by, order, value, (1, 4, 5)).where(F.col("back_5").isNotNull())
    out = out.where((F.col("back_4") > 0) & (F.col("back_5") > 0) & (F.col("back_4") >= least_base))
    out = out.withColumns({"g0": safe_div(value, "back_4") - 1, "g1": safe_div("back_1", "back_5") - 1})
    gain = F.col("g0") - F.col("g1")
    steps = ((F.col("g0") >= 0.5) & (gain >= 0.2), "critical"), ((F.col("g0") >= 0.25) & (gain >= 0.1), "high")
    return out.withColumn("severity", first_of(*steps)).where(F.col("severity").isNotNull())


def runway(df: DataFrame, by: list[str], order: list[Column], cash: str, fcf: str, least: int = 3) -> DataFrame:
    """Quarters that the latest cash lasts at the mean burn of the last four; only where they burn in total."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-3, 0)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*_reversed(order)))
    total, n = F.sum(F.col(fcf).cast("decimal(18,2)")).over(w).cast("double"), F.count(fcf).over(w)
    out = df.withColumns({"total": total, "n": n, "rn": rn}).where("rn = 1").where((F.col("n") >= least) & (F.col("total") < 0) & (F.col(cash) > 0))
    out = out.withColumn("quarters", safe_div(F.col(cash), -F.col("total") / F.col("n")))
    q = F.col("quarters")
    return out.withColumn("severity", first_of((q < 2, "critical"), (q < 4, "high"), (q < 6, "medium"))).where(F.col("severity").isNotNull()).drop("rn")


def zone_news(df: DataFrame, by: list[str], order: list[Column], zone: str, tier: str) -> DataFrame:
    """Distress is news for a small company only when the year before was safe or grey."""
    prior = F.lag(zone).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("prior_zone", prior).withColumn("is_news", (F.col(zone) == "distress") & F.col("prior_zone").isin("safe", "grey") & F.col(tier).isin("nano", "micro", "small"))


def share_trend(df: DataFrame, by: list[str], order: list[Column], shares: str) -> DataFrame:
    """Yearly growth over the last (at most) four rows: over 2 % growing, under -1 % shrinking, else flat."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-3, 0)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*_reversed(order)))
    out = df.withColumns({"first": F.first(shares).over(w), "years": (F.count(F.lit(1)).over(w) - 1).cast("int"), "rn": rn}).where("rn = 1").drop("rn")
    cagr = F.when((F.col("years") >= 1) & (F.col("first") > 0) & (F.col(shares) > 0), F.pow(safe_div(shares, "first"), 1 / F.col("years")) - 1)
    c = F.col("cagr")
    return out.withColumn("cagr", cagr).withColumn("label", first_of((c > 0.02, "growing"), (c < -0.01, "shrinking"), (c.isNotNull(), "flat")))
