"""Boilerplate rules over blocks: first match names the rule, tables never match, protected phrases always stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import PROTECTED_PHRASES, STRIP_RULES
from ..functions.expr import all_of, any_of, first_of, safe_div


def rule_of(text: str, rules: tuple = STRIP_RULES, disabled: tuple[str, ...] = ()) -> Column:
    """The first rule that a text meets, or null."""
    return first_of(*((any_of([all_of([F.col(text).rlike(p) for p in every]) for every in options]), name) for name, options in rules if name not in disabled))


def protected(text: str, phrases: tuple[str, ...] = PROTECTED_PHRASES) -> Column:
    return F.lower(text).rlike("|".join(p.replace("-", r"\-") for p in phrases))


def mark(blocks: DataFrame, text: str = "text", kind: str | None = "kind", rules: tuple = STRIP_RULES, disabled: tuple[str, ...] = ()) -> DataFrame:
    """blocks with rule (that matched), is_protected and stripped."""
    rule = rule_of(text, rules, disabled)
    if kind:
        rule = F.when(F.col(kind) != "table", rule)
    out = blocks.withColumn("rule", rule).withColumn("is_protected", F.col("rule").isNotNull() & protected(text))
    return out.withColumn("stripped", F.col("rule").isNotNull() & ~F.col("is_protected"))


def strip(blocks: DataFrame, **options) -> DataFrame:
    return mark(blocks, **options).where(~F.col("stripped")).drop("rule", "is_protected", "stripped")


def report(marked: DataFrame, by: list[str], size: Column) -> DataFrame:
    """By key and rule: blocks and characters removed."""
    return marked.where("stripped").groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("blocks_removed"), F.sum(size).cast("bigint").alias("chars_removed"))


def totals(marked: DataFrame, by: list[str], size: Column, warn_over: float = 0.5) -> DataFrame:
    """By key: characters before and after, share stripped, blocks kept for a protected phrase, and whether too much went."""
    g = marked.groupBy(*by).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("chars_before"), F.coalesce(F.sum(F.when(~F.col("stripped"), size)), F.lit(0)).cast("bigint").alias("chars_after"), F.count_if("is_protected").alias("n_protected"))
    share = F.coalesce(safe_div(F.col("chars_before") - F.col("chars_after"), "chars_before"), F.lit(0.0))
    return g.withColumn("share", share).withColumn("suspect", F.col("share") > warn_over)
