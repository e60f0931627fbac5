"""Queries on the read-side operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..operators import views
from ..text import render
from .base import YEARLY, query, table, yearly
from .event_plans import _STICKY, _sticky


@query(f"""WITH {YEARLY}, x AS (SELECT entity, fy, revenue / nullif(n, 0) AS price, shares, listed * 0.1 AS cash, CASE WHEN entity % 3 = 0 THEN NULL ELSE listed * 0.2 END AS debt, revenue * 0.1 - cost * 0.01 AS ebit, revenue, revenue * 0.05 AS fcf, revenue * 0.07 AS net_income FROM yearly),
c AS (SELECT *, price * shares AS cap, price * shares + coalesce(debt, 0) - coalesce(cash, 0) AS ev FROM x)
SELECT entity, fy, round(ev, 6) AS ev, CASE WHEN ebit > 0 THEN round(ev / ebit, 6) END AS ev_ebit, CASE WHEN revenue > 0 THEN round(ev / revenue, 6) END AS ev_sales, CASE WHEN cap > 0 THEN round(fcf / cap, 6) END AS fcf_yield, round(coalesce(cash, 0) - coalesce(debt, 0), 6) AS net_cash FROM c""")
def q_snapshot_ratios(spark, d):
    c = F.col
    x = yearly(spark, d).select("entity", "fy", safe_div("revenue", "n").alias("price"), "shares", (c("listed") * 0.1).alias("cash"), F.when(c("entity") % 3 != 0, c("listed") * 0.2).alias("debt"), (c("revenue") * 0.1 - c("cost") * 0.01).alias("ebit"), "revenue", (c("revenue") * 0.05).alias("fcf"), (c("revenue") * 0.07).alias("net_income"))
    s = views.snapshot(x)
    return s.select("entity", "fy", F.round("ev", 6).alias("ev"), *(F.round(k, 6).alias(k) for k in ("ev_ebit", "ev_sales", "fcf_yield")), F.round("net_cash", 6).alias("net_cash"))


@query("""WITH a AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), b AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.s AS x, b.s AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type) SELECT user_id, count(abs(x - y)) AS n_both, max(abs(x - y)) AS max_gap, round(avg(abs(x - y)), 6) AS mean_gap, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS n_one_sided FROM j GROUP BY 1""")
def q_compare_runs(spark, d):
    e = table(spark, d, "events")
    run = lambda w: e.where(w).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("s"))
    a, b = run(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), run(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    return views.compare_runs(a, b, ["user_id"], "event_type", "s").withColumn("mean_gap", F.round("mean_gap", 6))


@query("""WITH f AS (SELECT user_id, min(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY m LIMIT 5) SELECT user_id, event_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM f)""")
def q_first_keys(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    return views.first_keys(e, "user_id", [F.col("event_id")], 5).select("user_id", "event_id")


@query("""WITH v AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' END AS view, CASE event_id % 4 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Watchlist' WHEN 2 THEN 'Pass' ELSE 'Insufficient' END AS verdict FROM events),
a AS (SELECT user_id, CASE WHEN view IS NULL OR verdict = 'Insufficient' THEN 'unscorable' WHEN (verdict IN ('Strong', 'Watchlist')) = (view = 'positive') THEN 'agree' ELSE 'disagree' END AS a FROM v) SELECT user_id, count(*) FILTER (a <> 'unscorable') AS n_scorable, round(avg(CASE WHEN a <> 'unscorable' THEN CAST(a = 'agree' AS INTEGER) END), 6) AS rate FROM a GROUP BY 1""")
def q_agreement(spark, d):
    t, i = F.col("event_type"), F.col("event_id") % 4
    v = table(spark, d, "events").select("user_id", F.when(t == "purchase", "positive").when(t == "error", "negative").alias("view"), F.when(i == 0, "Strong").when(i == 1, "Watchlist").when(i == 2, "Pass").otherwise("Insufficient").alias("verdict"))
    a = v.withColumn("a", views.agreement(F.col("view"), F.col("verdict")))
    return views.agreement_rate(a, ["user_id"], "a").withColumn("rate", F.round("rate", 6))


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM orders GROUP BY 1""")
def q_severity_counts(spark, d):
    p = F.col("o_orderpriority")
    o = table(spark, d, "orders").select(F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low").alias("severity"))
    return views.severity_counts(o, [], "severity")


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT o_custkey, last FROM l WHERE last < TIMESTAMP '2001-03-31 00:00:00' - INTERVAL 4 HOUR""")
def q_stale(spark, d):
    return views.stale(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "2001-03-31 00:00:00")


@query(f"""{_STICKY} SELECT CAST(user_id % 10 AS BIGINT) AS thesis, '## ' || CAST(user_id % 10 AS VARCHAR) || chr(10) || string_agg('- ' || user_id || ': ' || prior || ' -> ' || status, chr(10) ORDER BY user_id) AS text FROM r WHERE prior <> status GROUP BY user_id % 10""")
def q_digest(spark, d):
    f = _sticky(spark, d).where("prior <> status").withColumn("thesis", F.col("user_id") % 10)
    return render.digest(f, "thesis", "user_id")


@query("""SELECT c_custkey, CASE WHEN abs(c_acctbal * 123457.3) >= 1e9 THEN printf('$%.1fB', c_acctbal * 123457.3 / 1e9) WHEN abs(c_acctbal * 123457.3) >= 1e6 THEN printf('$%.1fM', c_acctbal * 123457.3 / 1e6) WHEN abs(c_acctbal * 123457.3) >= 1e3 THEN printf('$%.0fK', c_acctbal * 123457.3 / 1e3) ELSE printf('$%.0f', c_acctbal * 123457.3) END AS cap FROM customer""")
def q_money_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", render.money(F.col("c_acctbal") * 123457.3).alias("cap"))
