"""Small read-side operators: comparisons, gates, caps, grids, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SEVERITY_BY_RANK, SEVERITY_RANK
from ..functions.expr import columns_of, first_of, rank_of, safe_div


def price_delta(now: Column, base: Column) -> Column:
    """Change since a base price; null unless the base is positive."""
    return F.when(base > 0, safe_div(now - base, base))


def adverse(direction: Column, tripwire: Column) -> Column:
    """A signal in the direction that trips an item's wire: 'weakens' or 'strengthens'; a wire for 'either' takes any that is not neutral."""
    return first_of((tripwire == "either", direction != "neutral"), otherwise=direction == tripwire)


def agreement(view: Column, verdict: Column) -> Column:
    """Of a person's view and a verdict: agree, disagree, or unscorable where either is silent."""
    good = verdict.isin("Strong", "Watchlist")
    return first_of((view.isNull() | verdict.isNull() | ~view.isin("positive", "negative") | (verdict == "Insufficient"), "unscorable"), (good == (view == "positive"), "agree"), otherwise="disagree")


def agreement_rate(df: DataFrame, by: list[str], column: str) -> DataFrame:
    scorable = F.col(column).isin("agree", "disagree")
    return df.groupBy(*by).agg(F.count_if(scorable).alias("n_scorable"), F.avg(F.when(scorable, (F.col(column) == "agree").cast("double"))).alias("rate"))


def provisional(df: DataFrame, by: list[str], direction: str, tripwire: str, magnitude: str) -> DataFrame:
    """A thesis's status from its signals alone: red with an adverse one of 0.5 or more, amber with one of 0.2 or more, else green (supportive ones raise nothing)."""
    against = adverse(F.col(direction), F.col(tripwire)) & (F.col(direction) != "neutral")
    level = first_of((against & (F.col(magnitude) >= 0.5), 2), (against & (F.col(magnitude) >= 0.2), 1), otherwise=0)
    return df.groupBy(*by).agg(F.element_at(F.array(F.lit("green"), F.lit("amber"), F.lit("red")), (F.max(level) + 1).cast("int")).alias("status"))


def max_severity(df: DataFrame, by: list[str], severity: str) -> DataFrame:
    top = F.max(rank_of(severity, SEVERITY_RANK, 0))
    return df.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, SEVERITY_BY_RANK)), (top + 1).cast("int")).alias("severity"))


def compare_runs(a: DataFrame, b: DataFrame, by: list[str], dimension: str, score: str) -> DataFrame:
    """Two runs by key: dimensions that both scored, the largest and mean distance, and dimensions that one run lacks."""
    x, y = a.select(*by, dimension, F.col(score).alias("__a")), b.select(*by, dimension, F.col(score).alias("__b"))
    j = x.join(y, [*by, dimension], "full")
    gap = F.abs(F.col("__a") - F.col("__b"))
    return j.groupBy(*by).agg(F.count(gap).alias("n_both"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count_if(F.col("__a").isNull() != F.col("__b").isNull()).alias("n_one_sided"))


def first_keys(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Rows of the first n distinct keys by their first row; only first rows meet in one task, n from each."""
    one = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1")
    return df.join(F.broadcast(one.orderBy(*order).limit(n).select(key)), key, "left_semi")


def grid_pivot(cells: DataFrame, by: list[str], row: str, column: str, value: str, columns: list) -> DataFrame:
    return columns_of(cells, [*by, row], column, value, {str(c): c for c in columns})


def bar_position(df: DataFrame, by: list[str], score: str, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Where a key's smallest and largest score lie on a bar from low to high, in per cent."""
    at = lambda x: (x - low) / (high - low) * 100
    return df.groupBy(*by).agg(at(F.min(score)).alias("from_pct"), at(F.max(score)).alias("to_pct"))


def calibration(samples: DataFrame, actual: str, estimated: str) -> DataFrame:
    """Actual over estimated: the worst under-count and the mean."""
    ratio = F.col(actual) / F.greatest(F.col(estimated), F.lit(1))
    return samples.agg(F.max(ratio).alias("worst"), F.avg(ratio).alias("mean"), F.count(F.lit(1)).alias("n"))


def variance_merge(history: DataFrame, fresh: DataFrame, by: list[str], dimension: str, prompt: str, columns: list[str]) -> DataFrame:
    """New samples replace a dimension's old ones; a key whose prompt changed loses all its old ones."""
    prompts = fresh.select(*by, F.col(prompt).alias("__p")).distinct()
    kept = history.join(prompts, by, "left").where(F.col("__p").isNull() | (F.col("__p") == F.col(prompt))).drop("__p")
    kept = kept.join(fresh.select(*by, dimension), [*by, dimension], "left_anti")
    return kept.select(*by, dimension, prompt, *columns).unionByName(fresh.select(*by, dimension, prompt, *columns))


def lookback_since(seen: Column, today: Column, since: Column, wide: int = 365, keep_narrow: Column | bool = False) -> Column:
    """Where to look back to: a year for a cursor that has seen nothing (unless kept narrow), else the caller's own date."""
    narrow = keep_narrow if isinstance(keep_narrow, Column) else F.lit(keep_narrow)
    return F.when((F.coalesce(seen, F.lit(0)) == 0) & ~narrow, F.date_sub(today, wide)).otherwise(since)


def by_health(df: DataFrame, health: str, key: str) -> DataFrame:
    """Unknown, red, amber, green, in a band by key; rank says the place in that order."""
    return df.withColumn("band", rank_of(health, {"red": 0, "amber": 1, "green": 2}, -1)).orderBy("band", key)


def view(signals: DataFrame, direction: str | None = None, focus_only: bool = False) -> DataFrame:
    """What a reader asked to see; it never bears on what is written."""
    signals = signals.where(F.col("direction") == direction) if direction else signals
    return signals.where("focus") if focus_only else signals


def signal_order(signals: DataFrame, severity: str, ticker: str) -> DataFrame:
    """Focus first, then severity (critical first), then ticker."""
    return signals.orderBy(F.col("focus").desc(), rank_of(severity, SEVERITY_RANK, -1).desc(), ticker)


def stale(df: DataFrame, by: list[str], fetched: str, now: str, hours: int = 4) -> DataFrame:
    """Keys whose latest mark is older than four hours."""
    g = df.groupBy(*by).agg(F.max(fetched).alias("last"))
    return g.where(F.col("last").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))


def snapshot(df: DataFrame) -> DataFrame:
    """EV, EV/EBIT, EV/Sales, FCF yield, P/E and net cash of price, shares, cash, debt, ebit, revenue, fcf, net_income; null where a base is not positive."""
    cap = F.col("price") * F.col("shares")
    ev = cap + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    over = lambda x, c: F.when(F.col(c) > 0, safe_div(x, F.col(c)))
    return df.withColumns({"market_cap": cap, "ev": ev, "ev_ebit": over(ev, "ebit"), "ev_sales": over(ev, "revenue"), "fcf_yield": F.when(cap > 0, safe_div(F.col("fcf"), cap)), "pe": over(cap, "net_income"), "net_cash": F.coalesce("cash", F.lit(0.0)) - F.coalesce("debt", F.lit(0.0))})


def growth_label(implied: Column, actual: Column, margin: float = 0.02) -> Column:
    return first_of((implied.isNull() | actual.isNull(), None), (implied > actual + margin, "demanding"), (implied < actual - margin, "forgiving"), otherwise="in-line")


def section_usable(confidence: Column, text: Column) -> Column:
    """A section that has text and did not fail (an unknown confidence counts as high)."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False)) & F.coalesce(confidence, F.lit("high")).isin("high", "low")


def run_counts(df: DataFrame, escalate: str, hold: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(escalate).alias("escalated"), F.count_if(hold).alias("held"))


def severity_counts(df: DataFrame, by: list[str], severity: str) -> DataFrame:
    """Counts in the fixed order of severities; those without a row are left out."""
    return df.groupBy(*by, severity).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, rank_of(severity, SEVERITY_RANK, -1).desc())
