"""Events: keyed surfacing, clusters, confluence, classification, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import BEARISH_ITEMS, CAP_RELATIVE_ITEMS, FORM_SIGNALS, MICRO_MAX, NANO_MAX, SEVERITY_BY_RANK, SEVERITY_RANK, SMALL_MAX
from ..functions.expr import first_of, rank_of, safe_div


def cap_tier(cap: Column) -> Column:
    return first_of((cap.isNull() | F.isnan(cap) | (cap <= 0), "unknown"), (cap < NANO_MAX, "nano"), (cap < MICRO_MAX, "micro"), (cap < SMALL_MAX, "small"), otherwise="mid-plus")


def item_severity(df: DataFrame, item: str, severity: str, tier: str) -> DataFrame:
    """Items that weigh by size go up one notch (critical at most) for small companies; every item gets a direction."""
    relative = F.col(item).isin(*CAP_RELATIVE_ITEMS) & F.col(tier).isin("nano", "micro", "small")
    rank = rank_of(severity, SEVERITY_RANK, 0)
    up = F.element_at(F.array(*map(F.lit, SEVERITY_BY_RANK)), (F.least(rank + 1, F.lit(3)) + 1).cast("int"))
    own = first_of(*((F.col(item) == k, v) for k, v in CAP_RELATIVE_ITEMS.items()))
    base = first_of((F.col(item).isin(*BEARISH_ITEMS), "bearish"), (own.isNotNull(), own), otherwise="bearish")
    return df.withColumns({"resolved": F.when(relative, up).otherwise(F.col(severity)), "direction": F.when(relative, own).otherwise(base), "promoted": relative})


def form_table(spark: SparkSession, rows: tuple = FORM_SIGNALS) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, key string, kind string, severity string, direction string, exact_only boolean")


def form_signals(filings: DataFrame, forms: DataFrame, form: str) -> DataFrame:
    """Filings whose form is a key, or an amendment of one that takes them.

    A form with '/' is looked up whole and by what stands before it in one map of the
    forms (a few dozen, on every task); of several the least ord counts. Filings are
    not shuffled, and equal ones stay as many as they are.
    """
    names = [c for c in forms.columns if c != "ord"]
    one = forms.groupBy(F.upper("key").alias("k")).agg(F.min(F.struct("ord", *names)).alias("v"))
    table = one.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__forms"))  # one row
    upper = F.upper(F.col(form))
    whole = F.try_element_at("__forms", upper)
    # a key from before a '/' is an amendment's
    parts = [F.try_element_at("__forms", F.substring_index(upper, "/", n)) for n in (1, 2)]
    found = F.array(whole, *(F.when(~p["exact_only"], p) for p in parts))
    hit = filings.join(F.broadcast(table)).withColumn("__hit", F.array_min(F.filter(found, lambda x: x.isNotNull())))
    return hit.where(F.col("__hit").isNotNull()).select(*filings.columns, *(F.col("__hit")[c].alias(c) for c in names))


def is_periodic(form: str) -> Column:
    """10-K or 10-Q, or an amendment of either."""
    return F.substring_index(F.upper(F.col(form)), "/", 1).isin("10-K", "10-Q")


# Titles of chief and financial executives.
EXECUTIVES = r"(?i)chief\s+executive|\bceo\b|president\s+and\s+chief|chief\s+financial|\bcfo\b|principal\s+financial"


def insider_clusters(buys: DataFrame, issuer: str, owner: Column, date: str, shares: str, price: str, as_of: str, days: int = 14, exec_title: str | None = None, cap: str | None = None) -> DataFrame:
    """Purchases of the last `days` days, the first of them included, by issuer: distinct buyers, priced value, shares, first and last day, and severity.

    Critical: three buyers, 250,000 by the chief or financial executives or half a
    per cent of the company; high: two, 100,000 in all or a fifth of a per cent;
    medium: 25,000 in all. exec_title: a column of titles of officers.
    """
    recent = buys.where((F.col(date) <= F.lit(as_of).cast("date")) & (F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days)))
    value = F.when(F.col(price) > 0, F.round(F.col(shares) * F.col(price), 2)).cast("decimal(18,2)")
    is_exec = F.coalesce(F.col(exec_title).rlike(EXECUTIVES), F.lit(False)) if exec_title else F.lit(False)
    g = recent.groupBy(issuer).agg(
        F.count_distinct(owner).alias("n_buyers"),
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("value"),
        F.sum(F.col(shares).cast("decimal(18,4)")).cast("double").alias("shares"),
        F.coalesce(F.sum(F.when(is_exec, value)), F.lit(0)).cast("double").alias("exec_value"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        (F.max(cap) if cap else F.lit(None).cast("double")).alias("cap"),
        F.count(F.lit(1)).alias("n_buys"),
    )
    share = safe_div("value", "cap")
    level = first_of(
        ((F.col("n_buyers") >= 3) | (F.col("exec_value") >= 250_000) | F.coalesce(share >= 0.005, F.lit(False)), "critical"),
        ((F.col("n_buyers") >= 2) | (F.col("value") >= 100_000) | F.coalesce(share >= 0.002, F.lit(False)), "high"),
        (F.col("value") >= 25_000, "medium"),
    )
    return g.withColumn("severity", level)


def confluence(signals: DataFrame, by: str, kind: str, date: str, as_of: str, days: int = 30, kinds: int = 2, done: DataFrame | None = None) -> DataFrame:
    """Keys with two or more distinct kinds from `days` days before as_of to it, both included: the sorted kinds, and the latest row's kind and date; keys in `done` are left out."""
    window = signals.where((F.col(date) <= F.lit(as_of).cast("date")) & (F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days)))
    if done is not None:
        window = window.join(done.select(by).distinct(), by, "left_anti")
    g = window.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.count_distinct(kind).alias("n_kinds"), F.count(F.lit(1)).alias("n"), F.max(F.struct(date, kind)).alias("__last"))
    return g.where(F.col("n_kinds") >= kinds).select(by, "kinds", "n_kinds", "n", F.col(f"__last.{date}").alias("last_date"), F.col(f"__last.{kind}").alias("last_kind"))


def surface_new(batch: DataFrame, seen: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key was not seen before, once each (the first in order): what an insert-if-absent inserts."""
    first = Window.partitionBy(*key).orderBy(*order)
    fresh = batch.join(seen.select(*key), key, "left_anti")
    return fresh.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def queue(signals: DataFrame, jobs: DataFrame, key: str, severity: str = "severity", least: int = 2) -> DataFrame:
    """Signals of rank `least` or more that have no job yet."""
    return signals.where(rank_of(severity, SEVERITY_RANK, -1) >= least).join(jobs.select(key), key, "left_anti")


def claim_oldest(jobs: DataFrame, status: str, enqueued: str, started: str, now: str | Column, key: str, stale_minutes: int = 30) -> DataFrame:
    """The oldest job that is pending, or running for longer than the lease."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    stale = (F.col(status) == "running") & (F.col(started).cast("timestamp") < at - F.expr(f"interval {stale_minutes} minutes"))
    return jobs.where((F.col(status) == "pending") | stale).orderBy(enqueued, key).limit(1)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def watch_map(events: DataFrame, items: DataFrame, source: str, ticker: str, tag: str) -> DataFrame:
    """Events for watch items: the item has the event's source, and its ticker or the event's tag.

    items: id, sources (array), tickers (array). Two equi-joins and a distinct
    union instead of a nested loop.
    """
    by_source = items.select("id", F.explode("sources").alias(source), "tickers")
    one = events.join(by_source.select("id", source, F.explode("tickers").alias(ticker)), [source, ticker])
    two = events.join(by_source.select("id", source, F.col("id").alias(tag)), [source, tag])
    return one.select(*events.columns, "id").unionByName(two.select(*events.columns, "id")).distinct()
