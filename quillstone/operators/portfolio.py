"""Positions against as-of prices, and their roll-up against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import money_sum, safe_div
from .asof import backward, forward


#: The calendar of a benchmark goes on to this day with its last close.
LAST_DAY = "2100-01-01"


def calendar(benchmark: DataFrame) -> DataFrame:
    """date, close: for every day from the benchmark's first bar to LAST_DAY the last close at or before it.

    A benchmark has a bar a day at most (the largest close of equal dates), so all
    of it is an array of some thousand entries in one row; the calendar has a row
    a day and may be broadcast, whatever the number of positions.
    """
    one = benchmark.where(F.col("date").isNotNull()).groupBy("date").agg(F.max("close").alias("close"))
    bars = one.agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("b")).where(F.size("b") > 0)
    each = bars.select("b", F.explode(F.sequence(F.lit(1), F.size("b"))).alias("i"))
    bar, end = F.element_at("b", F.col("i")), F.try_element_at("b", F.col("i") + 1)["date"]
    spans = each.select(bar["close"].alias("close"), bar["date"].alias("since"), F.coalesce(F.date_sub(end, 1), F.lit(LAST_DAY).cast("date")).alias("until"))
    return spans.select(F.explode(F.sequence("since", F.greatest("since", "until"))).alias("date"), "close")


def value_positions(positions: DataFrame, bars: DataFrame, benchmark: DataFrame, ticker: str, opened: str, mark_date: str | Column, amount: float = 1000.0) -> DataFrame:
    """Fill, mark, return, benchmark return over the same window, alpha, pnl and holding days.

    The fill is the first bar at or after the verdict; without one the position
    is pending (all nulls). The mark is the last bar at or before mark_date, never
    before the fill. Prices are adjusted closes (column close, by date).
    """
    mark = F.lit(mark_date).cast("date") if isinstance(mark_date, str) else mark_date
    p = forward(positions, bars, [ticker], opened, "date", ["close"], "fill_").withColumn("__mark", mark)
    p = backward(p, bars, [ticker], "__mark", "date", ["close"], "mark_")
    days = calendar(benchmark)
    for at, name in (("fill_date", "bench_fill_close"), ("mark_date", "bench_mark_close")):
        p = p.join(F.broadcast(days.select(F.col("date").alias("__day"), F.col("close").alias(name))), F.least(F.col(at), F.lit(LAST_DAY).cast("date")) == F.col("__day"), "left").drop("__day")
    live = F.col("fill_close").isNotNull() & (F.col("fill_close") > 0) & (F.col("mark_date") >= F.col("fill_date"))
    ret = F.when(live, safe_div("mark_close", "fill_close") - 1)
    bench = F.when(live & (F.col("bench_fill_close") > 0), safe_div("bench_mark_close", "bench_fill_close") - 1)
    p = p.withColumns({"ret": ret, "bench_ret": bench})
    p = p.withColumns({"alpha": F.col("ret") - F.col("bench_ret"), "pnl": F.col("ret") * amount, "cost": F.when(live, F.lit(amount)), "days": F.when(live, F.greatest(F.datediff("mark_date", "fill_date"), F.lit(0)))})
    return p.drop("__mark")


def summary(valued: DataFrame, by: list[str]) -> DataFrame:
    """Counts, cost, value, pnl, benchmark-covered alpha, win and beat rates, median, best, worst (only of two or more), mean days; an empty book has zeros and nulls."""
    open_, covered = F.col("ret").isNotNull(), F.col("bench_ret").isNotNull() & F.col("ret").isNotNull()
    money = lambda x: F.coalesce(money_sum(F.round(x, 2)), F.lit(0.0))
    g = valued.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(open_).alias("n_open"),
        F.count_if(covered).alias("n_covered"),
        money(F.col("cost")).alias("cost"),
        money(F.col("pnl")).alias("pnl"),
        money(F.when(covered, F.col("pnl"))).alias("covered_pnl"),
        money(F.when(covered, F.col("bench_ret") * F.col("cost"))).alias("bench_pnl"),
        money(F.when(covered, F.col("cost"))).alias("covered_cost"),
        F.count_if(F.col("ret") > 0).alias("n_win"),
        F.count_if(F.col("alpha") > 0).alias("n_beat"),
        F.median("ret").alias("median_ret"),
        F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
        F.avg("days").alias("mean_days"),
    )
    return g.withColumns(
        {
            "value": F.col("cost") + F.col("pnl"),
            "ret": safe_div("pnl", "cost"),
            "bench_ret": safe_div("bench_pnl", "covered_cost"),
            "alpha": safe_div(F.col("covered_pnl") - F.col("bench_pnl"), "covered_cost"),
            "win_rate": safe_div("n_win", "n_open"),
            "beat_rate": safe_div("n_beat", "n_covered"),
            "worst": F.when(F.col("n_open") > 1, F.col("worst")),
        }
    )


def by_return(valued: DataFrame, *ties: str) -> DataFrame:
    """Best return first, pending positions last."""
    return valued.orderBy(F.col("ret").desc_nulls_last(), *ties)
