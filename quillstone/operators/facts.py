"""Bitemporal facts: many reports of a period become one labelled point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import CONCEPTS
from ..functions.expr import columns_of, first_of, js_round, safe_div

#: A later value differs from the one before if by more than this share of the larger.
MATERIAL = 0.005


def concept_table(spark: SparkSession, concepts: tuple = CONCEPTS) -> DataFrame:
    """A row for each tag: concept, kind, unit, tag and its priority from 0."""
    rows = [(c, kind, unit, tag, i) for c, kind, unit, tags in concepts for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, kind string, unit string, tag string, priority int")


def claim(facts: DataFrame, by: list[str], priority: str = "priority") -> DataFrame:
    """Of each period, all values of the best tag that reports it; other tags fill what is left."""
    best = F.min(priority).over(Window.partitionBy(*by))
    return facts.withColumn("__best", best).where(F.col(priority) == F.col("__best")).drop("__best")


def pick(facts: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key."""
    return facts.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def repair_scale(facts: DataFrame, by: list[str], value: str, least: int = 4) -> DataFrame:
    """Values three or more powers of ten off their series' median power are brought to it (four non-zero values needed)."""
    exponent = F.when(F.col(value) != 0, js_round(F.log10(F.abs(F.col(value)))).cast("int"))
    w = Window.partitionBy(*by)
    marked = facts.withColumn("__e", exponent)
    middle = js_round(F.percentile(F.col("__e"), F.lit(0.5)).over(w)).cast("int")
    marked = marked.withColumns({"__m": middle, "__n": F.count("__e").over(w)})
    off = F.col("__m") - F.col("__e")
    wrong = (F.col("__n") >= least) & F.col("__e").isNotNull() & (F.abs(off) >= 3)
    scaled = F.col(value) * F.pow(F.lit(10.0), off)
    return marked.withColumn("repaired", F.coalesce(wrong, F.lit(False))).withColumn(value, F.when(F.col("repaired"), scaled).otherwise(F.col(value))).drop("__e", "__m", "__n")


def span_kind(start: str, end: str, fp: str) -> Column:
    """quarter: 80 to 100 days; annual: 350 to 380 and a full-year label; else null (cumulative)."""
    days = F.datediff(end, start)
    return first_of((days.between(80, 100), "quarter"), (days.between(350, 380) & (F.col(fp) == "FY"), "annual"))


def material(a: Column, b: Column) -> Column:
    return F.abs(a - b) > MATERIAL * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def fold(reports: Column, value: Column, restated_from: Column) -> Column:
    """(value, restated_from) after an array of reports (field v), in their order, from what held before them.

    A materially different value replaces the current one; the value that the first
    such report replaced stays as restated_from, whatever follows.
    """
    start = F.struct(value.cast("double").alias("value"), restated_from.cast("double").alias("restated_from"))
    return F.aggregate(reports, start, lambda now, x: F.when(material(now["value"], x["v"]), F.struct(x["v"].alias("value"), F.coalesce(now["restated_from"], now["value"]).alias("restated_from"))).otherwise(now))


def collapse(reports: DataFrame, by: list[str], filed: str, value: str, ties: list[str], labels: list[str] = ()) -> DataFrame:
    """One point for each period from all its reports.

    In order of filing a later value replaces the current one if it differs by
    more than half a per cent of the larger (1 at least); smaller drifts add up to
    nothing. restated_from is the value first disclosed, if any report replaced it.
    labels come from the earliest report. A period's reports are few, so they are
    folded as an array; no order across partitions is needed.
    """
    row = F.struct(F.col(filed).alias("f"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)), F.col(value).cast("double").alias("v"), *labels)
    g = reports.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("r"))
    out = g.withColumn("__p", fold(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.col("r")[0]["v"], F.lit(None)))
    return out.select(*by, "__p.value", "__p.restated_from", F.size("r").cast("int").alias("n_reports"), *(F.col("r")[0][c].alias(c) for c in labels))


def residual_quarter(points: DataFrame, by: list[str], fy: str, fp: str, value: str) -> DataFrame:
    """Fourth quarters that were not reported: the year less its three reported quarters (column derived)."""
    names = ["p_Q1", "p_Q2", "p_Q3", "p_Q4", "p_FY"]  # a bare FY would clash with a column fy
    p = columns_of(points, [*by, fy], fp, value, {n: n.removeprefix("p_") for n in names})
    q1, q2, q3, q4, year = map(F.col, names)
    whole = q1.isNotNull() & q2.isNotNull() & q3.isNotNull() & year.isNotNull() & q4.isNull()
    made = p.where(whole).select(*by, fy, F.lit("Q4").alias(fp), (year - (q1 + q2 + q3)).alias(value), F.lit(True).alias("derived"))
    return points.where(F.col(fp) != "FY").select(*by, fy, fp, value, F.lit(False).alias("derived")).unionByName(made)


def instant_points(points: DataFrame, fp: str) -> DataFrame:
    """A year-end balance counts as the year's and as its fourth quarter's."""
    return points.unionByName(points.where(F.col(fp) == "FY").withColumn(fp, F.lit("Q4")))


def missing(facts: DataFrame, concepts: DataFrame, by: list[str], concept: str = "concept") -> DataFrame:
    """Concepts that an entity never reported."""
    every = facts.select(*by).distinct().crossJoin(F.broadcast(concepts.select(concept).distinct()))  # a few dozen fixed names
    return every.join(facts.select(*by, concept).distinct(), [*by, concept], "left_anti")


def form_rank(form: str) -> Column:
    return first_of((F.col(form) == "10-K", 3), (F.col(form).isin("10-K/A", "20-F"), 2), otherwise=1)


def annual(facts: DataFrame, by: list[str], fy: str, end: str, rank: Column, order: list[Column]) -> DataFrame:
    """One value a year: the best form for each period end (first of equals), then the latest end."""
    best = pick(facts, [*by, fy, end], [rank.desc(), *order])
    return pick(best, [*by, fy], [F.col(end).desc()])


def annual_rows(facts: DataFrame, by: list[str], fy: str, concept: str, value: str, last: int = 10) -> DataFrame:
    """Revenue, ebit, net income, fcf = cfo - |capex|, debt and debt / equity by year; missing flows are 0; the last ten years that have revenue or ebit."""
    names = ["revenue", "ebit", "netIncome", "cfo", "capex", "debt", "equity"]
    p = columns_of(facts, [*by, fy], concept, value, {n: n for n in names}).where(F.col("revenue").isNotNull() | F.col("ebit").isNotNull())
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in names if c != "equity"}
    p = p.withColumns(zero).withColumns({"fcf": F.col("cfo") - F.abs("capex"), "debt_to_equity": F.when(F.col("equity") > 0, safe_div("debt", "equity"))})
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(fy).desc()))
    return p.withColumn("__rn", rn).where(F.col("__rn") <= last).drop("__rn")


def discontinuities(df: DataFrame, by: list[str], fy: str, value: str, most: float = 3.0) -> DataFrame:
    """Consecutive years whose ratio (the larger over the smaller) is beyond `most`."""
    prior = F.lag(value).over(Window.partitionBy(*by).orderBy(fy))
    out = df.withColumn("prior", prior).where((F.col("prior") > 0) & (F.col(value) > 0))
    return out.withColumn("ratio", safe_div(F.greatest(F.col(value), F.col("prior")), F.least(F.col(value), F.col("prior")))).where(F.col("ratio") > most)
