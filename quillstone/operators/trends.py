"""Multi-period trends: runs of year-over-year deterioration, with their size and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import DETECTORS, SEVERITY_RANK
from ..functions.expr import first_of, rank_of, safe_div, trailing_run


def detector_table(spark: SparkSession, rows: tuple = DETECTORS) -> DataFrame:
    return spark.createDataFrame(list(rows), "id string, metric string, category string, worse_when string, unit string, min_run int, min_change double")


def change_in(unit: Column, latest: Column, base: Column) -> Column:
    """Days and ratios: the difference; bps: times 10000; percent: of the size of the base (0 for a base of 0)."""
    diff = latest - base
    return first_of((unit == "bps", diff * 10000), (unit == "percent", F.when(base == 0, 0.0).otherwise(safe_div(diff, F.abs(base)))), otherwise=diff)


def severity_for(run: Column, change: Column, least: Column) -> Column:
    size = safe_div(F.abs(change), F.abs(least))
    high = (run >= 5) | ((run >= 4) & (size >= 2))
    return first_of((high, "high"), ((run >= 4) | (size >= 2), "medium"), otherwise="low")


def detect(pairs: DataFrame, detectors: DataFrame, by: list[str], order: list[Column], periods: int = 5) -> DataFrame:
    """Findings of all detectors at once: one row for each key and detector that fires.

    pairs: long, with metric, value and prior_value; order: latest first. The run
    counts the latest pairs in a row that are worse than a year before; it must
    reach the detector's least run, its change the least change, and the key must
    have `periods` periods (column n_periods), else there is no finding.
    """
    joined = pairs.join(F.broadcast(detectors), "metric")  # a dozen rows, fixed
    worse = F.when(F.col("worse_when") == "higher", F.col("value") > F.col("prior_value")).otherwise(F.col("value") < F.col("prior_value"))
    key = [*by, "id"]
    w, ok = trailing_run(worse, key, order)
    latest = Window.partitionBy(*key).orderBy(*order)
    marked = joined.withColumns({"ok": ok, "rn": F.row_number().over(latest)})
    first = marked.groupBy(*key).agg(
        F.sum("ok").cast("int").alias("run"),
        *(F.max(F.when(F.col("rn") == 1, F.col(c))).alias(c) for c in ("metric", "category", "unit", "min_run", "min_change", "value", "prior_value", "n_periods")),
        F.count(F.lit(1)).cast("int").alias("n_pairs"),
    )
    change = change_in(F.col("unit"), F.col("value"), F.col("prior_value"))
    out = first.where((F.col("n_periods") >= periods) & (F.col("n_pairs") >= F.col("min_run"))).withColumn("change", change)
    out = out.where((F.col("run") >= F.col("min_run")) & (F.abs("change") >= F.col("min_change")))
    return out.withColumn("severity", severity_for(F.col("run"), F.col("change"), F.col("min_change")))


def ordered(findings: DataFrame, *ties: str) -> DataFrame:
    """Severity, then run, largest first."""
    return findings.orderBy(rank_of("severity", SEVERITY_RANK, -1).desc(), F.col("run").desc(), *ties)


def restated(points: DataFrame, by: list[str], least: int = 3, period: str = "period") -> DataFrame:
    """Concepts whose published values were restated: high if in three periods or more."""
    g = points.where(F.col("restated_from").isNotNull()).groupBy(*by).agg(F.count_distinct(period).cast("int").alias("n_restated"))
    return g.withColumn("severity", F.when(F.col("n_restated") >= least, "high").otherwise("medium"))


def with_series(findings: DataFrame, pairs: DataFrame, by: list[str], period: list[str], least: int = 6) -> DataFrame:
    """findings with series: the value of each of the last pairs, oldest first, as many as the run is long (six at least)."""
    key = [*by, "metric"]
    latest = Window.partitionBy(*key).orderBy(*(F.col(p).desc() for p in period))
    last = pairs.select(*key, *period, "value", F.row_number().over(latest).alias("__rn"))
    shown = findings.select(*key, "id", F.greatest("run", F.lit(least)).alias("__n")).join(last, key).where(F.col("__rn") <= F.col("__n"))
    g = shown.groupBy(*key, "id").agg(F.array_sort(F.collect_list(F.struct(*period, "value"))).alias("series"))
    return findings.join(g, [*key, "id"], "left")
