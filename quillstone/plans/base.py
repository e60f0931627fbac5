"""Base views over the tables, in Spark and as SQL, and the decorator that registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import money_sum

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF, EVENTS_AS_OF = "2001-03-31", "2024-01-20"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dec(c: str, precision: int = 12) -> str:
    return f"CAST({c} AS DECIMAL({precision},2))"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly revenue, active customers and orders by nation; whole quarters only."""
    orders = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz"))
    j = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fq"))
    return g.agg(money_sum("o_totalprice").alias("revenue"), F.count_distinct("o_custkey").alias("shares"), F.count(F.lit(1)).alias("n"))


SERIES = """series AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(quarter(o_orderdate) AS INTEGER) AS fq,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o_custkey) AS shares, count(*) AS n
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1, 2, 3)"""


def costs(spark: SparkSession, d: str) -> DataFrame:
    """Net line amounts, list amounts and quantities by nation and quarter of the order."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    orders = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_orderdate")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fq"))
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    return g.agg(F.sum(net).cast("double").alias("cost"), money_sum("l_extendedprice").alias("listed"), money_sum("l_quantity").alias("quantity"))


COSTS = """costs AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(quarter(o_orderdate) AS INTEGER) AS fq,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS cost,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS listed, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1, 2, 3)"""


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """Wide annual rows by nation, whole years only, from orders and lines (the stand-ins are stated in the SQL)."""
    s, c = series(spark, d).where("fy < 2001"), costs(spark, d).where("fy < 2001")
    a = s.groupBy("entity", "fy").agg(money_sum("revenue").alias("revenue"), F.sum("n").cast("double").alias("n"), F.sum("shares").cast("double").alias("shares"))
    b = c.groupBy("entity", "fy").agg(money_sum("listed").alias("listed"), F.sum(F.col("cost").cast("decimal(20,4)")).cast("double").alias("cost"), money_sum("quantity").alias("quantity"))
    return a.join(b, ["entity", "fy"])


YEARLY = f"""{SERIES}, {COSTS}, yearly AS (SELECT a.entity, a.fy, a.revenue, a.n, a.shares, b.listed, b.cost, b.quantity FROM
 (SELECT entity, fy, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(shares) AS DOUBLE) AS shares FROM series WHERE fy < 2001 GROUP BY 1, 2) a
 JOIN (SELECT entity, fy, CAST(sum(CAST(listed AS DECIMAL(18,2))) AS DOUBLE) AS listed, CAST(sum(CAST(cost AS DECIMAL(20,4))) AS DOUBLE) AS cost, CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM costs WHERE fy < 2001 GROUP BY 1, 2) b
 ON a.entity = b.entity AND a.fy = b.fy)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each user and day: a price bar."""
    return events(spark, d).groupBy(F.col("user_id").alias("ticker"), F.col("day").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


BARS = "bars AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2)"


def benchmark_bars(spark: SparkSession, d: str) -> DataFrame:
    """The last view of each day: the benchmark's bar."""
    return events(spark, d).where("event_type = 'view'").groupBy(F.col("day").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


BENCH = "bench AS (SELECT CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_type = 'view' GROUP BY 1)"
