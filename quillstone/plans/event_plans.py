"""Queries on events, positions, queues, state and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dims import CATEGORY_WEIGHT, TECH_RANGES
from ..functions.expr import safe_div
from ..operators import asof, portfolio, scores, state, universe
from ..operators import events as E
from .base import BARS, BENCH, EVENTS_AS_OF, bars, benchmark_bars, events, query, table

_PROBE = "probe AS (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS opened FROM events WHERE event_type = 'signup')"


def _probe(spark, d):
    return events(spark, d).where("event_type = 'signup'").select("event_id", F.col("user_id").alias("ticker"), F.col("day").alias("opened"))


@query(f"WITH {BARS}, {_PROBE}, p AS (SELECT event_id, ticker, opened - 1 AS at FROM probe) SELECT p.event_id, p.ticker, p.at, b.date AS bar_date, b.close FROM p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.at >= b.date")
def q_asof_backward(spark, d):
    p = _probe(spark, d).select("event_id", "ticker", F.date_sub("opened", 1).alias("at"))
    return asof.backward(p, bars(spark, d), ["ticker"], "at", "date", ["close"]).withColumnRenamed("date", "bar_date")


@query(f"WITH {BARS}, {_PROBE}, p AS (SELECT event_id, ticker, opened + 1 AS at FROM probe) SELECT p.event_id, p.ticker, p.at, b.date AS bar_date, b.close FROM p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.at <= b.date")
def q_asof_forward(spark, d):
    p = _probe(spark, d).select("event_id", "ticker", F.date_add("opened", 1).alias("at"))
    return asof.forward(p, bars(spark, d), ["ticker"], "at", "date", ["close"]).withColumnRenamed("date", "bar_date")


@query("""WITH n AS (SELECT DISTINCT event_type, CAST(ts AS DATE) + INTERVAL 12 HOUR AS noon FROM events),
j AS (SELECT n.event_type, n.noon, e.event_id, row_number() OVER (PARTITION BY n.event_type, n.noon ORDER BY abs(epoch_us(e.ts) - epoch_us(n.noon)), e.ts, e.event_id) AS rn FROM n JOIN events e ON e.event_type = n.event_type AND e.ts BETWEEN n.noon - INTERVAL 3 DAY AND n.noon + INTERVAL 3 DAY)
SELECT event_type, CAST(noon AS DATE) AS day, event_id FROM j WHERE rn = 1""")
def q_nearest(spark, d):
    e = events(spark, d)
    noon = e.select("event_type", (F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("noon")).distinct()
    one = e.groupBy("event_type", "ts").agg(F.min("event_id").alias("event_id"))
    return asof.nearest(noon, one, ["event_type"], "noon", "ts", ["event_id"]).select("event_type", F.col("noon").cast("date").alias("day"), "event_id")


_VALUED = f"""{BARS}, {BENCH}, {_PROBE},
f AS (SELECT p.*, b.date AS fill_date, b.close AS fill_close FROM probe p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.opened <= b.date),
k AS (SELECT f.*, b.date AS mark_date, b.close AS mark_close FROM (SELECT *, DATE '{EVENTS_AS_OF}' AS m FROM f) f ASOF LEFT JOIN bars b ON f.ticker = b.ticker AND f.m >= b.date),
b1 AS (SELECT k.*, b.close AS bf FROM k ASOF LEFT JOIN bench b ON k.fill_date >= b.date),
b2 AS (SELECT b1.*, b.close AS bm FROM b1 ASOF LEFT JOIN bench b ON b1.mark_date >= b.date),
v AS (SELECT *, fill_close IS NOT NULL AND fill_close > 0 AND mark_date >= fill_date AS live FROM b2),
w AS (SELECT *, CASE WHEN live THEN mark_close / nullif(fill_close, 0) - 1 END AS ret, CASE WHEN live AND bf > 0 THEN bm / bf - 1 END AS bench_ret FROM v),
valued AS (SELECT event_id, ticker, event_id % 2 AS leg, ret, bench_ret, ret - bench_ret AS alpha, ret * 1000 AS pnl, CASE WHEN live THEN 1000.0::DOUBLE END AS cost, CAST(CASE WHEN live THEN greatest(mark_date - fill_date, 0) END AS INTEGER) AS days FROM w)"""


def _valued(spark, d):
    p = _probe(spark, d).withColumn("leg", F.col("event_id") % 2)
    return portfolio.value_positions(p, bars(spark, d), benchmark_bars(spark, d), "ticker", "opened", EVENTS_AS_OF)


@query(f"WITH {_VALUED} SELECT event_id, ticker, round(ret, 6) AS ret, round(bench_ret, 6) AS bench_ret, round(alpha, 6) AS alpha, round(pnl, 4) AS pnl, days FROM valued")
def q_position_value(spark, d):
    return _valued(spark, d).select("event_id", "ticker", *(F.round(c, 6).alias(c) for c in ("ret", "bench_ret", "alpha")), F.round("pnl", 4).alias("pnl"), "days")


@query(f"""WITH {_VALUED}, g AS (SELECT leg, count(*) AS n, count(ret) AS n_open, count(bench_ret) AS n_covered, CAST(coalesce(sum(CAST(round(cost, 2) AS DECIMAL(18,2))), 0) AS DOUBLE) AS cost, CAST(coalesce(sum(CAST(round(pnl, 2) AS DECIMAL(18,2))), 0) AS DOUBLE) AS pnl,
 CAST(coalesce(sum(CASE WHEN bench_ret IS NOT NULL THEN CAST(round(pnl, 2) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS cp, CAST(coalesce(sum(CASE WHEN bench_ret IS NOT NULL THEN CAST(round(bench_ret * cost, 2) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS bp,
 CAST(coalesce(sum(CASE WHEN bench_ret IS NOT NULL THEN CAST(round(cost, 2) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS cc, count(*) FILTER (ret > 0) AS n_win, count(*) FILTER (alpha > 0) AS n_beat, median(ret) AS med, max(ret) AS best, min(ret) AS worst, avg(days) AS days FROM valued GROUP BY 1)
SELECT leg, n, n_open, n_covered, cost, round(cost + pnl, 2) AS value, round(pnl / nullif(cost, 0), 6) AS ret, round((cp - bp) / nullif(cc, 0), 6) AS alpha, round(n_win / nullif(n_open, 0), 6) AS win_rate, round(n_beat / nullif(n_covered, 0), 6) AS beat_rate,
 round(med, 6) AS median_ret, round(best, 6) AS best, CASE WHEN n_open > 1 THEN round(worst, 6) END AS worst, round(days, 6) AS mean_days FROM g""")
def q_portfolio(spark, d):
    s = portfolio.summary(_valued(spark, d), ["leg"])
    return s.select("leg", "n", "n_open", "n_covered", "cost", F.round("value", 2).alias("value"), *(F.round(c, 6).alias(c) for c in ("ret", "alpha", "win_rate", "beat_rate", "median_ret", "best", "worst", "mean_days")))


@query("""WITH b AS (SELECT l_partkey % 100 AS issuer, l_suppkey AS owner, CAST(l_shipdate AS DATE) AS day, l_quantity AS shares, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price FROM lineitem),
r AS (SELECT *, CAST(CASE WHEN price > 0 THEN round(shares * price, 2) END AS DECIMAL(18,2)) AS value FROM b WHERE day <= DATE '2001-03-31' AND day >= DATE '2001-03-17'),
g AS (SELECT issuer, count(DISTINCT owner) AS n_buyers, CAST(coalesce(sum(value), 0) AS DOUBLE) AS value, CAST(sum(CAST(shares AS DECIMAL(18,4))) AS DOUBLE) AS shares, min(day) AS first_date, max(day) AS last_date, count(*) AS n_buys FROM r GROUP BY 1)
SELECT *, CASE WHEN n_buyers >= 3 THEN 'critical' WHEN n_buyers >= 2 OR value >= 100000 THEN 'high' WHEN value >= 25000 THEN 'medium' END AS severity FROM g""")
def q_insider_cluster(spark, d):
    line = table(spark, d, "lineitem")
    price = F.when(F.col("l_discount") != 0, safe_div("l_extendedprice", "l_quantity"))
    b = line.select((F.col("l_partkey") % 100).alias("issuer"), F.col("l_suppkey").alias("owner"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("shares"), price.alias("price"))
    out = E.insider_clusters(b, "issuer", F.col("owner"), "day", "shares", "price", "2001-03-31")
    return out.select("issuer", "n_buyers", "value", "shares", "first_date", "last_date", "n_buys", "severity")


@query(f"""WITH w AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '{EVENTS_AS_OF}' AND CAST(ts AS DATE) >= DATE '{EVENTS_AS_OF}' - 7),
g AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n_kinds, count(*) AS n, max(day) AS last_date, arg_max(event_type, (day, event_type)) AS last_kind FROM w GROUP BY 1) SELECT * FROM g WHERE n_kinds >= 2""")
def q_confluence(spark, d):
    return E.confluence(events(spark, d), "user_id", "event_type", "day", EVENTS_AS_OF, days=7)


@query("SELECT c_custkey, CASE WHEN c_acctbal * 1e5 <= 0 THEN 'unknown' WHEN c_acctbal * 1e5 < 50e6 THEN 'nano' WHEN c_acctbal * 1e5 < 300e6 THEN 'micro' WHEN c_acctbal * 1e5 < 2e9 THEN 'small' ELSE 'mid-plus' END AS tier FROM customer")
def q_cap_tier(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.cap_tier(F.col("c_acctbal") * 1e5).alias("tier"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN '1.01' WHEN 'click' THEN '2.03' WHEN 'error' THEN '4.02' WHEN 'signup' THEN '8.01' ELSE '5.03' END AS item, CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN user_id % 3 = 0 THEN 'micro' ELSE 'mid-plus' END AS tier FROM events),
p AS (SELECT *, item IN ('1.01', '2.01', '2.02', '2.03', '5.01', '5.03') AND tier IN ('nano', 'micro', 'small') AS promoted FROM e)
SELECT event_id, item, CASE WHEN promoted THEN CASE severity WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END ELSE severity END AS resolved,
 CASE WHEN item = '1.01' THEN 'ambiguous' ELSE 'bearish' END AS direction, promoted FROM p""")
def q_item_severity(spark, d):
    t = F.col("event_type")
    e = events(spark, d).select(
        "event_id",
        F.when(t == "view", "1.01").when(t == "click", "2.03").when(t == "error", "4.02").when(t == "signup", "8.01").otherwise("5.03").alias("item"),
        F.when(t == "error", "critical").when(t == "click", "high").otherwise("medium").alias("severity"),
        F.when(F.col("user_id") % 3 == 0, "micro").otherwise("mid-plus").alias("tier"),
    )
    return E.item_severity(e, "item", "severity", "tier").select("event_id", "item", "resolved", "direction", "promoted")


_FORM = "CASE o_orderkey % 6 WHEN 0 THEN 'S-1' WHEN 1 THEN 'S-1/A' WHEN 2 THEN 'SC 13G' WHEN 3 THEN 'SC 13G/A' WHEN 4 THEN '10-K' ELSE 'NT 10-K/A' END"


@query(f"""WITH f AS (SELECT o_orderkey, {_FORM} AS form FROM orders), k(ord, key, kind, severity, exact_only) AS (VALUES (0, 'S-1', 'offering', 'high', false), (7, 'NT 10-K', 'late-filing', 'critical', false), (13, 'SC 13G', 'ownership', 'medium', true))
SELECT o_orderkey, form, kind, severity FROM f JOIN k ON form = key OR (NOT exact_only AND starts_with(form, key || '/'))""")
def q_form_signal(spark, d):
    f = table(spark, d, "orders").select("o_orderkey", F.expr(_FORM).alias("form"))
    return E.form_signals(f, E.form_table(spark), "form").select("o_orderkey", "form", "kind", "severity")


@query("""WITH v AS (SELECT p_partkey, p_retailprice, CASE p_type WHEN 'ECONOMY' THEN 'EQUITY' WHEN 'PROMO' THEN NULL ELSE 'FUND' END AS kind, p_retailprice * 1e5 AS cap, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS volume, p_size = 7 AS pinned FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT * FROM v WHERE pinned OR coalesce((kind IS NULL OR kind = 'EQUITY') AND cap BETWEEN 95e6 AND 2e9 AND p_retailprice >= 950 AND volume >= 500000, false)) SELECT p_partkey, volume FROM s ORDER BY volume DESC, p_partkey LIMIT 200""")
def q_universe_screen(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    volume = line.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("volume"))
    v = part.join(volume, F.col("l_partkey") == F.col("p_partkey"), "left").withColumns({"volume": F.coalesce("volume", F.lit(0.0)), "kind": F.when(F.col("p_type") == "ECONOMY", "EQUITY").when(F.col("p_type") != "PROMO", "FUND"), "cap": F.col("p_retailprice") * 1e5, "pinned": F.col("p_size") == 7})
    s = universe.screen(v, "kind", "cap", "p_retailprice", "volume", "pinned", (95e6, 2e9), 950.0, 500000.0)
    return universe.top(s, "volume", 200, "p_partkey").select("p_partkey", "volume")


_RANGES = ", ".join(f"({i}, {a}, {b}, '{label}')" for i, (a, b, label) in enumerate(TECH_RANGES))


@query(f"""WITH r(ord, lo, hi, label) AS (VALUES {_RANGES}), c AS (SELECT p_partkey, 3550 + p_size * 6 AS code FROM part) SELECT p_partkey, CAST(code AS INTEGER) AS code, (SELECT label FROM r WHERE code BETWEEN lo AND hi ORDER BY ord LIMIT 1) AS label FROM c""")
def q_range_class(spark, d):
    c = table(spark, d, "part").select("p_partkey", (F.lit(3550) + F.col("p_size") * 6).alias("code"))
    return universe.classify(c, universe.range_table(spark, list(TECH_RANGES)), "code").select("p_partkey", "code", "label")


@query("""WITH s AS (SELECT DISTINCT o_custkey || ':' || CAST(o_orderdate AS DATE) AS key FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), b AS (SELECT o_custkey || ':' || CAST(o_orderdate AS DATE) AS key, o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) AS rn FROM b WHERE key NOT IN (SELECT key FROM s)) SELECT key, o_orderkey, o_totalprice FROM n WHERE rn = 1""")
def q_surface_once(spark, d):
    o = table(spark, d, "orders").withColumn("key", F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("date").cast("string")))
    seen = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("key")
    batch = o.where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("key", "o_orderkey", "o_totalprice")
    return E.surface_new(batch, seen.distinct(), ["key"], [F.col("o_orderkey")])


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS note FROM customer), n AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' END AS note FROM supplier)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.note, o.note) AS note FROM o FULL JOIN n ON o.id = n.id""")
def q_upsert_coalesce(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "supplier").alias("note"))
    return state.upsert_keep_old(old, new, "id", ["name", "note"])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'purchase')""")
def q_queue_select(spark, d):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    signals = table(spark, d, "orders").select("o_orderkey", "o_custkey", severity.alias("severity"))
    jobs = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("o_orderkey"))
    return E.queue(signals, jobs, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-01-02 00:00:00' - INTERVAL 30 MINUTE) ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_claim_oldest(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    jobs = table(spark, d, "orders").withColumns({"status": status, "started": F.col("o_orderdate")})
    return E.claim_oldest(jobs, "status", "o_orderdate", "started", "1995-01-02 00:00:00", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""WITH f AS (SELECT event_type || ':' || user_id AS key, event_id, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-15'), s AS (SELECT DISTINCT event_type || ':' || user_id AS key FROM events WHERE ts < TIMESTAMP '2024-01-05'),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS rn FROM f WHERE key NOT IN (SELECT key FROM s)) SELECT key, event_id, day, (SELECT max(day) FROM f) AS high_water FROM n WHERE rn = 1""")
def q_diff_cursor(spark, d):
    e = events(spark, d).withColumn("key", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    fetched = e.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("key", "event_id", "day")
    seen = e.where(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")).select("key")
    return state.fresh(fetched, seen.distinct(), "key", [F.col("event_id")], "day")


@query("""WITH o AS (SELECT user_id, event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT user_id, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'error'),
u AS (SELECT *, 0 AS src FROM o UNION ALL SELECT *, 1 FROM n) SELECT user_id, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY src DESC, event_id DESC) = 1""")
def q_union_last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", "ts", "event_type")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = e.where(F.col("ts") < cut), e.where((F.col("ts") >= cut) & (F.col("event_type") != "error"))
    return state.union_last_wins(old, new, ["user_id"], [F.col("event_id").desc()]).select("user_id", "event_id", "value")


@query("""WITH m AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 9000), a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE coalesce(o_orderstatus, '') = 'P' AND o_totalprice > 480000) SELECT id, (id IN (SELECT id FROM a)) AS ordered FROM (SELECT id FROM m UNION SELECT id FROM a)""")
def q_focus_union(spark, d):
    manual = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    auto = table(spark, d, "orders").where((F.coalesce("o_orderstatus", F.lit("")) == "P") & (F.col("o_totalprice") > 480000)).select(F.col("o_custkey").alias("id")).distinct()
    return manual.union(auto).distinct().join(auto.withColumn("ordered", F.lit(True)), "id", "left").withColumn("ordered", F.coalesce("ordered", F.lit(False)))


@query("""WITH i AS (SELECT n_nationkey AS id, [CASE WHEN n_regionkey = 0 THEN 'view' ELSE 'click' END, 'error'] AS sources, [CAST(n_nationkey AS BIGINT), n_nationkey + 30] AS tickers FROM nation)
SELECT DISTINCT e.event_id, i.id FROM events e JOIN i ON list_contains(i.sources, e.event_type) AND (list_contains(i.tickers, e.user_id) OR e.event_id % 40 = i.id)""")
def q_watch_map(spark, d):
    n = F.col("n_nationkey").cast("bigint")
    items = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.when(F.col("n_regionkey") == 0, "view").otherwise("click"), F.lit("error")).alias("sources"), F.array(n, n + 30).alias("tickers"))
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 40).cast("int").alias("tag"))
    return E.watch_map(e, items, "event_type", "user_id", "tag").select("event_id", "id")


_HEALTH = "CASE WHEN max(CASE WHEN event_type = 'view' OR value / 500 < 0.02 THEN 0 WHEN event_type = 'error' AND value / 500 >= 0.3 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) = 2 THEN 'red' WHEN max(CASE WHEN event_type = 'view' OR value / 500 < 0.02 THEN 0 WHEN event_type = 'error' AND value / 500 >= 0.3 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'amber' ELSE 'green' END"


def _health_of(df):
    v = df.select("user_id", F.when(F.col("event_type") == "view", "neutral").otherwise("signal").alias("direction"), (F.col("event_type") == "error").alias("adverse"), (F.col("value") / 500).alias("raw"))
    # magnitudes are stretched so that the thresholds of 0.2 and 0.5 fall on 0.02 and 0.3 of the raw share
    size = F.when(F.col("raw") < 0.02, 0.0).when(F.col("raw") >= 0.3, 1.0).otherwise(0.3)
    return scores.item_health(v.withColumn("magnitude", size), ["user_id"], "direction", "adverse", "magnitude")


_STICKY = f"""WITH items AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, {_HEALTH} AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT user_id, {_HEALTH} AS s FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1),
r AS (SELECT i.user_id, coalesce(p.s, 'green') AS prior, coalesce(n.s, p.s, 'green') AS status FROM items i LEFT JOIN p USING (user_id) LEFT JOIN n USING (user_id))"""


def _sticky(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "ts")
    prior = _health_of(e.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))).withColumnRenamed("health", "status")
    now = _health_of(e.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))).withColumnRenamed("health", "status")
    return state.sticky(e.select("user_id").distinct(), prior, now, ["user_id"], "status")


@query(f"{_STICKY} SELECT * FROM r")
def q_sticky_status(spark, d):
    return _sticky(spark, d)


@query(f"{_STICKY} SELECT * FROM r WHERE prior <> status")
def q_flips(spark, d):
    return state.flips(_sticky(spark, d), "status")


_VOTES = "votes AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'weakens' WHEN 'purchase' THEN 'strengthens' ELSE 'neutral' END AS vote, value, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS confidence FROM events)"


@query(f"""WITH {_VOTES}, n AS (SELECT user_id, vote, count(*) AS n FROM votes GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE vote WHEN 'neutral' THEN 0 WHEN 'weakens' THEN 1 ELSE 2 END) AS rn FROM n),
a AS (SELECT v.*, w.n, w.total FROM votes v JOIN w ON v.user_id = w.user_id AND v.vote = w.vote AND w.rn = 1), m AS (SELECT user_id, median(value) AS magnitude FROM a GROUP BY 1),
c AS (SELECT user_id, confidence, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS rn FROM a GROUP BY 1, 2)
SELECT a.user_id, any_value(a.vote) AS vote, any_value(a.n) AS n_agree, round(any_value(m.magnitude), 6) AS magnitude, CASE WHEN any_value(a.n) * 2 > any_value(a.total) THEN any_value(c.confidence) ELSE 'low' END AS confidence, arg_min(a.event_id, (abs(a.value - m.magnitude), a.event_id)) AS representative
FROM a JOIN m USING (user_id) JOIN c ON c.user_id = a.user_id AND c.rn = 1 GROUP BY 1""")
def q_majority_vote(spark, d):
    t = F.col("event_type")
    v = table(spark, d, "events").select("user_id", "event_id", F.when(t == "error", "weakens").when(t == "purchase", "strengthens").otherwise("neutral").alias("vote"), "value", F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high").alias("confidence"))
    return scores.majority(v, ["user_id"], "vote", "value", "confidence", "event_id").withColumn("magnitude", F.round("magnitude", 6))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM events), g AS (SELECT user_id, median(score) AS med, max(score) - min(score) AS spread, count(score) AS n_scored, count(*) AS n_samples FROM s GROUP BY 1)
SELECT g.user_id, round(any_value(med), 6) AS median, round(any_value(spread), 6) AS spread, any_value(n_scored) AS n_scored, any_value(n_samples) AS n_samples, arg_min(s.event_id, (abs(s.score - g.med), s.event_id)) FILTER (s.score IS NOT NULL) AS representative FROM g JOIN s USING (user_id) GROUP BY 1""")
def q_sample_median(spark, d):
    s = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    g = scores.sample_spread(s, ["user_id"], "score", "event_id")
    return g.select("user_id", F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"), "n_scored", "n_samples", "representative")


_DIMS = """x AS (SELECT user_id, event_type, count(*) % 11 AS score, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS weight, max(value) - min(value) AS spread FROM events GROUP BY 1, 2),
dims AS (SELECT user_id, CASE WHEN score = 0 THEN NULL ELSE score END AS score, weight, CASE WHEN spread IS NULL THEN 'moderate' WHEN spread / 100 <= 0.5 THEN 'tight' WHEN spread / 100 <= 1.5 THEN 'moderate' ELSE 'high' END AS unc FROM x)"""


@query(f"""WITH {_DIMS}, g AS (SELECT user_id, sum(CASE WHEN score IS NOT NULL THEN score * CASE WHEN unc = 'high' THEN weight * 0.7 ELSE weight END END) AS num, sum(CASE WHEN score IS NOT NULL THEN CASE WHEN unc = 'high' THEN weight * 0.7 ELSE weight END END) AS den, count(score) AS n_scored, coalesce(bool_or(score < 4 AND unc <> 'high'), false) AS weak, bool_or(unc = 'high') AS unsure FROM dims GROUP BY 1),
s AS (SELECT *, round(CAST(coalesce(num / nullif(den, 0), 5.5) AS DOUBLE), 9) AS score FROM g) SELECT user_id, round(CAST(score AS DOUBLE), 6) AS score, n_scored, CASE WHEN n_scored = 0 THEN 'Insufficient' WHEN weak OR score < 6 THEN 'Pass' WHEN score >= 8 AND NOT unsure THEN 'Strong' ELSE 'Watchlist' END AS verdict FROM s""")
def q_weighted_score(spark, d):
    t = F.col("event_type")
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) % 11).alias("score"), (F.max("value") - F.min("value")).alias("spread"))
    dims = x.select("user_id", F.when(F.col("score") != 0, F.col("score").cast("double")).alias("score"), F.when(t == "view", 3.0).when(t == "click", 2.0).otherwise(1.0).alias("weight"), scores.uncertainty(F.col("spread") / 100).alias("unc"))
    return scores.weighted(dims, ["user_id"], "score", "weight", "unc").select("user_id", F.round("score", 6).alias("score"), "n_scored", "verdict")


@query("""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'error') AS c, CASE WHEN count(*) FILTER (event_type = 'signup') > 12 THEN count(*) FILTER (event_type = 'signup') END AS e, count(*) FILTER (event_type = 'purchase') AS f FROM events GROUP BY 1),
h AS (SELECT user_id, a * 0.5::DOUBLE AS a, b * 0.5::DOUBLE AS b, c * 0.5::DOUBLE AS c, e * 0.5::DOUBLE AS e, f * 0.5::DOUBLE AS f FROM p),
t AS (SELECT user_id, floor((a * 0.3::DOUBLE + b * 0.25::DOUBLE + c * 0.2::DOUBLE + coalesce(e * 0.15::DOUBLE, 0) + f * 0.1::DOUBLE) * 10::DOUBLE + 0.5::DOUBLE) / 10 AS total FROM h) SELECT user_id, CAST(total AS DOUBLE) AS total, CASE WHEN total >= 8 THEN 'Strong' WHEN total >= 6 THEN 'Watchlist' ELSE 'Pass' END AS verdict FROM t""")
def q_fixed_weight(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    p = table(spark, d, "events").groupBy("user_id").agg(n("view").alias("a"), n("click").alias("b"), n("error").alias("c"), F.when(n("signup") > 12, n("signup")).alias("e"), n("purchase").alias("f"))
    half = p.select("user_id", *((F.col(c) * 0.5).alias(c) for c in "abcef"))
    return scores.fixed_weight(half, ["a", "b", "c", "e", "f"]).select("user_id", "total", "verdict")


_WEIGHT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_WEIGHT.items()) + " ELSE 1 END"


@query(f"""WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'item' WHEN 'click' THEN 'trend' WHEN 'signup' THEN 'recurrence' WHEN 'view' THEN 'flag' ELSE 'chunks' END AS source, CASE event_id % 4 WHEN 0 THEN 'going-concern' WHEN 1 THEN 'receivables' WHEN 2 THEN 'margin' ELSE 'litigation' END AS category,
 CASE WHEN value < 60 THEN 'low' WHEN value < 120 THEN 'medium' WHEN value < 400 OR event_type <> 'error' THEN 'high' ELSE 'critical' END AS severity, CASE event_type WHEN 'view' THEN 1 + event_id % 3 WHEN 'purchase' THEN (event_id % 10) / 20.0 ELSE 0 END AS n FROM events),
p AS (SELECT *, {_WEIGHT} * CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 0 END AS base FROM f),
q AS (SELECT *, CASE WHEN source = 'item' AND severity = 'critical' THEN 100.0 WHEN source = 'item' AND severity = 'high' THEN 8.0 WHEN source = 'flag' THEN base * (1 + log2(greatest(n, 1)) / 2) WHEN source = 'trend' THEN base * 2.0 WHEN source = 'recurrence' THEN base * 1.5 ELSE 0.0 END AS pts FROM p),
g AS (SELECT user_id, CAST(sum(CAST(round(pts, 6) AS DECIMAL(18,6))) AS DOUBLE) AS points, count(DISTINCT CASE WHEN source IN ('flag', 'trend') AND severity <> 'low' THEN category END) AS n_categories, coalesce(bool_or(source = 'item' AND severity = 'critical'), false) AS unconditional, coalesce(bool_or(source = 'trend' AND severity = 'high'), false) AS strong, coalesce(max(CASE WHEN source = 'chunks' THEN n END), 0) AS failed FROM q GROUP BY 1),
b AS (SELECT *, points + CASE WHEN n_categories >= 3 THEN n_categories * 2 ELSE 0 END AS total, NOT strong AND failed > 0.3 AS hold FROM g)
SELECT user_id, n_categories, hold, floor(total * 10 + 0.5) / 10 AS score, unconditional OR (total >= 12 AND NOT hold) AS escalate FROM b""")
def q_triage(spark, d):
    t, v, i = F.col("event_type"), F.col("value"), F.col("event_id")
    f = events(spark, d).select(
        "user_id",
        F.when(t == "error", "item").when(t == "click", "trend").when(t == "signup", "recurrence").when(t == "view", "flag").otherwise("chunks").alias("source"),
        F.when(i % 4 == 0, "going-concern").when(i % 4 == 1, "receivables").when(i % 4 == 2, "margin").otherwise("litigation").alias("category"),
        F.when(v < 60, "low").when(v < 120, "medium").when((v < 400) | (t != "error"), "high").otherwise("critical").alias("severity"),
        F.when(t == "view", (1 + i % 3).cast("double")).when(t == "purchase", (i % 10) / 20.0).otherwise(0.0).alias("n"),
    )
    return scores.triage(f, ["user_id"]).select("user_id", "n_categories", "hold", "score", "escalate")


@query("""WITH v AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events WHERE event_type = 'view')
SELECT user_id, event_id, day, value, round(value - prior, 6) AS delta, CASE WHEN prior IS NOT NULL THEN CASE WHEN value - prior >= 0 THEN 'up' ELSE 'down' END END AS direction FROM v WHERE rn = 1""")
def q_latest_revision(spark, d):
    e = events(spark, d).where("event_type = 'view'")
    prior = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = E.latest(e.withColumn("prior", prior), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    delta = F.col("value") - F.col("prior")
    return x.select("user_id", "event_id", "day", "value", F.round(delta, 6).alias("delta"), F.when(F.col("prior").isNotNull(), F.when(delta >= 0, "up").otherwise("down")).alias("direction"))


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total_k, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS max_k FROM events GROUP BY 1""")
def q_json_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"), F.max(k).alias("max_k"))


@query("""WITH c AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN starts_with(event_type, 'sign') THEN 'sign' ELSE 'other' END AS stage, event_type, value FROM events), p(event_type, rate) AS (VALUES ('view', 3.0), ('click', 15.0), ('signup', 0.25))
SELECT stage, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS tokens, round(CAST(sum(CAST(value AS DECIMAL(18,2)) * coalesce(rate, 1.0)) AS DOUBLE), 4) AS cost FROM c LEFT JOIN p USING (event_type) GROUP BY 1""")
def q_cost_rollup(spark, d):
    t = F.col("event_type")
    stage = F.when(t.isin("view", "click"), "read").when(t.startswith("sign"), "sign").otherwise("other")
    rates = spark.createDataFrame([("view", 3.0), ("click", 15.0), ("signup", 0.25)], "event_type string, rate double")
    e = table(spark, d, "events").join(F.broadcast(rates), "event_type", "left")
    value = F.col("value").cast("decimal(18,2)")
    return e.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).cast("double").alias("tokens"), F.round(F.sum(value * F.coalesce("rate", F.lit(1.0)).cast("decimal(6,2)")).cast("double"), 4).alias("cost"))
