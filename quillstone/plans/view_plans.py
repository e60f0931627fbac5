"""Queries of a viewer: joins, top-k, group-bys, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import universe
from .base import query, table


@query("""SELECT c.c_custkey, n.n_name, r.r_name, o.n_orders, CAST(o.total AS DOUBLE) AS total FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def q_left_joins(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "n_name", "r_name", "n_orders", "total")


@query("""SELECT c_custkey, c_name, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000), -1) AS largest_order FROM customer""")
def q_detail(spark, d):
    first = table(spark, d, "orders").where("o_totalprice > 450000").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    return table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("k", F.lit(-1).cast("bigint")).alias("largest_order"))


@query("""SELECT o_orderkey, o_orderdate, c_name, coalesce(c_mktsegment, 'none') AS status FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def q_feed(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", "o_orderdate", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("status")).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(200)


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")
def q_not_exists(spark, d):
    o = table(spark, d, "orders")
    big, pending = (o.where(c).select(F.col("o_custkey").alias("c_custkey")).distinct() for c in ("o_totalprice > 480000", "o_orderstatus = 'P'"))
    left = table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")
    return left.join(pending.withColumn("pending", F.lit(True)), "c_custkey", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


@query("""WITH g AS (SELECT p_brand AS ticker, count(*) AS n, bool_or(p_size > 45) AS focus, min(p_name) AS name FROM part WHERE contains(upper(p_brand), 'BRAND#1') GROUP BY 1) SELECT * FROM g ORDER BY starts_with(upper(ticker), 'BRAND#1') DESC, n DESC, ticker LIMIT 8""")
def q_suggest(spark, d):
    return universe.suggest(table(spark, d, "part"), "p_brand", "p_name", F.col("p_size") > 45, " brand#1 ")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low, min(o_orderkey) AS first_key FROM orders GROUP BY 1""")
def q_group_by_date(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(p == "1-URGENT").alias("critical"), F.count_if(p == "2-HIGH").alias("high"), F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("low"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def q_latest_per_key(spark, d):
    return E.latest(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""WITH m AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_retailprice AS median FROM m WHERE rn = floor(n / 2) + 1""")
def q_floor_median(spark, d):
    return universe.floor_median(table(spark, d, "part"), ["p_brand"], "p_retailprice")


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, max(o_orderdate) AS last FROM orders""")
def q_index_stats(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct(F.col("o_orderdate").cast("date")).alias("n_days"), F.max("o_orderdate").alias("last"))


@query("""SELECT p_partkey, p_brand, p_retailprice, CASE WHEN p_retailprice > m * 1.1 THEN 'above' WHEN p_retailprice < m * 0.9 THEN 'below' ELSE 'near' END AS label FROM part JOIN (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand)""")
def q_versus_median(spark, d):
    p = table(spark, d, "part")
    m = p.groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))
    return p.join(m, "p_brand").select("p_partkey", "p_brand", "p_retailprice", universe.versus_median(F.col("p_retailprice"), F.col("m")).alias("label"))
