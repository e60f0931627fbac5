"""Extractions of a filing's chunks, merged into one brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SEVERITY_BY_RANK, SEVERITY_RANK
from ..functions.expr import alnum_key, rank_of, safe_div


def flag_key(category: str, claim: str) -> Column:
    """Category, the claim's numbers, and its first eight words of more than three characters."""
    numbers = F.array_join(F.regexp_extract_all(F.col(claim), F.lit(r"[0-9][0-9,.]*"), F.lit(0)), ",")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(claim)), "[^a-z0-9 ]", ""), " +"), lambda w: F.length(w) > 3)
    return F.concat_ws("|", F.col(category), numbers, F.array_join(F.slice(words, 1, 8), " "))


def merge_flags(flags: DataFrame, by: list[str], category: str, claim: str, severity: str, chunk: str, order: str) -> DataFrame:
    """Flags of one key: occurrences, distinct chunks, highest severity, the first claim's words."""
    rank = rank_of(severity, SEVERITY_RANK, 0)
    g = flags.withColumn("key", flag_key(category, claim)).groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(chunk).alias("n_chunks"),
        F.max(rank).alias("rank"),
        F.min_by(claim, order).alias("claim"),
        F.min(category).alias("category"),
    )
    names = F.array(*map(F.lit, SEVERITY_BY_RANK))
    return g.withColumn("severity", F.element_at(names, (F.col("rank") + 1).cast("int"))).drop("rank")


def order_flags(flags: DataFrame, *ties: str) -> DataFrame:
    return flags.orderBy(rank_of("severity", SEVERITY_RANK, -1).desc(), F.col("occurrences").desc(), "category", *ties)


def first_metrics(metrics: DataFrame, by: list[str], label: str, period: str, value: str, prior: str, order: str) -> DataFrame:
    """Metrics without repeats of (label, period, value); the first stays. position: those with a prior value come first, each kind in its order."""
    key = F.concat_ws("|", alnum_key(label), F.col(period), F.coalesce(F.col(value).cast("string"), F.lit("null")))
    w = Window.partitionBy(*by, "key").orderBy(order)
    one = metrics.withColumn("key", key).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return one.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(prior).isNull(), order)))


def first_texts(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """Texts without repeats (case and white space folded); the first stays."""
    key = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    w = Window.partitionBy(*by, "key").orderBy(order)
    return df.withColumn("key", key).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def claims(df: DataFrame, by: list[str], quote: str, checkable: str, order: str) -> DataFrame:
    """Claims without repeats of their quote. position: those that can be checked come first, each kind in its order."""
    one = first_texts(df, by, quote, order)
    return one.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(checkable).desc(), order)))


def drop_rate(df: DataFrame, by: list[str], kept: Column) -> DataFrame:
    """Findings kept and dropped for quotes that were not found; more than a quarter dropped is suspect."""
    g = df.groupBy(*by).agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"))
    return g.withColumn("suspect", F.coalesce(safe_div("n_dropped", F.col("n_kept") + F.col("n_dropped")) > 0.25, F.lit(False)))


def top_of(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def trim_to(df: DataFrame, by: list[str], list_: str, position: str, tokens: str, floors: dict[str, int], target: int) -> DataFrame:
    """Rows of a key's lists cut to a token budget: last entries go first, list after list in the order of floors, each down to its floor, until the rest fits.

    An entry goes if all that would go before it leaves more than the target, which
    is a running sum over the entries in that order; a brief has some hundred.
    """
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.partitionBy(*by, list_).orderBy(position))
    rank = rank_of(list_, {k: i for i, k in enumerate(floors)})
    floor = rank_of(list_, dict(floors))
    m = df.withColumns({"__place": place, "__rank": rank, "__total": F.sum(tokens).over(w)}).withColumn("__loose", F.coalesce(F.col("__place") > floor, F.lit(False)))
    gone = F.sum(F.when(F.col("__loose"), F.col(tokens)).otherwise(0)).over(w.orderBy(F.col("__loose").desc(), "__rank", F.col("__place").desc()).rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("__total") - F.coalesce(gone, F.lit(0))
    return m.withColumn("__left", left).where(~(F.col("__loose") & (F.col("__left") > target))).drop("__place", "__rank", "__total", "__loose", "__left")
