"""Queries on writes, state, streams, views, renderers and hooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions.dims import CONCEPTS, SEVERITY_RANK
from ..functions.expr import rank_of
from ..operators import events as E
from ..operators import facts, portfolio, retrieval, scores, solver, state, trends, universe
from ..operators import views as V
from ..session import scratch
from ..sources import sinks
from ..streaming import events as ST
from ..text import chunks, contexts, render, snippets
from .base import YEARLY, events, query, table, yearly
from .event_plans import _STICKY, _VALUED, _sticky, _valued
from .text_plans import _ESTIMATE, _stream

# --- writes

_HALF = "2024-01-16"
_KEYED = "k AS (SELECT user_id || ':' || event_type AS key, event_id, value, ts < TIMESTAMP '2024-01-16' AS old FROM events)"


def _keyed(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "value", "ts")
    cut = F.lit(_HALF).cast("timestamp_ntz")
    return e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")


@query(f"""WITH {_KEYED}, o AS (SELECT key, min(event_id) AS event_id FROM k WHERE old GROUP BY 1), n AS (SELECT key, min(event_id) AS event_id FROM k WHERE NOT old AND key NOT IN (SELECT key FROM o) GROUP BY 1)
SELECT key, event_id, false AS returned FROM o UNION ALL SELECT key, event_id, true FROM n""")
def q_insert_absent(spark, d):
    old, new = (x.select("key", "event_id") for x in _keyed(spark, d))
    t = sinks.Table(spark, scratch(spark, "inserts"), "key string, event_id bigint", ["key"], buckets=4)
    t.insert_absent(old, [F.col("event_id")])
    fresh = t.insert_absent(new, [F.col("event_id")])  # a sweep that overlaps surfaces only what is new
    return t.read().join(fresh.select("key", F.lit(True).alias("r")), "key", "left").select("key", "event_id", F.coalesce("r", F.lit(False)).alias("returned"))


@query(f"""WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY old, event_id DESC) AS rn FROM k) SELECT key, event_id, value FROM r WHERE rn = 1""")
def q_upsert_table(spark, d):
    t = sinks.Table(spark, scratch(spark, "upserts"), "key string, event_id bigint, value double", ["key"], buckets=4)
    for part in _keyed(spark, d):
        t.upsert(part, [F.col("event_id").desc()])
    return t.read()


@query("""WITH p AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer), c AS (SELECT o_custkey AS key, o_orderkey AS child, year(o_orderdate) AS y FROM orders), late AS (SELECT DISTINCT key FROM c WHERE y >= 2001)
SELECT 'parent' AS kind, key, CAST(NULL AS BIGINT) AS child, CASE WHEN key IN (SELECT key FROM late) THEN value + 1 ELSE value END AS value FROM p UNION ALL SELECT 'child', key, child, NULL FROM c WHERE y >= 2001 OR key NOT IN (SELECT key FROM late)""")
def q_push_tables(spark, d):
    """Parents are upserted and their children replaced in one transaction."""
    store = sinks.Store(spark, scratch(spark, "push"), {"parents": ("key bigint, value double", ["key"]), "children": ("key bigint, child bigint", ["key"])}, buckets=4)
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("child"), F.year("o_orderdate").alias("y"))
    late = c.where("y >= 2001").select("key", "child")
    for parents, children in ((p, c.where("y < 2001").select("key", "child")), (p.join(late.select("key").distinct(), "key", "left_semi").withColumn("value", F.col("value") + 1), late)):
        t = store.transaction()
        t.upsert("parents", parents, [F.col("value")])
        t.replace("children", children)
        t.commit()
    null = F.lit(None)
    return store.read("parents").select(F.lit("parent").alias("kind"), "key", null.cast("bigint").alias("child"), "value").unionByName(store.read("children").select(F.lit("child").alias("kind"), "key", "child", null.cast("double").alias("value")))


@query("""SELECT ticker, date, close FROM (SELECT 'u' || user_id AS ticker, CAST(ts AS DATE) AS date, round(max(value) * CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1 END, 6) AS close FROM events GROUP BY user_id, 2)""")
def q_refetch_window(spark, d):
    """A symbol whose prices were adjusted is fetched whole, so that no series mixes two bases."""
    bars = events(spark, d).groupBy("user_id", F.col("day").alias("date")).agg(F.max("value").alias("close"))
    ticker = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ticker")
    t = sinks.Table(spark, scratch(spark, "bars"), "ticker string, date date, close double", ["ticker"], buckets=4)
    t.replace(bars.select(ticker, "date", F.round("close", 6).alias("close")))
    t.replace(bars.where("user_id % 2 = 0").select(ticker, "date", F.round(F.col("close") * 0.5, 6).alias("close")))
    return t.read()


@query("""WITH c AS (SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n FROM documents) SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN n + 1 ELSE n END AS n FROM c""")
def q_reindex(spark, d):
    c = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n"))
    return retrieval.reindex(c, c.where(F.col("source").isin("src1", "src2")).withColumn("n", F.col("n") + 1), "source")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_append_monthly(spark, d):
    path = scratch(spark, "monthly")
    for part in (events(spark, d).where("user_id < 75"), events(spark, d).where("user_id >= 75")):
        sinks.append_monthly(part.select("event_type", "day"), path, "day")
    return spark.read.schema("event_type string, day date, month string").json(path).groupBy("month", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, 'cache/' || CASE WHEN length(left(text, 200)) > 180 THEN sha1(left(text, 200)) ELSE regexp_replace(left(text, 200), '[^A-Za-z0-9._-]', '_', 'g') END || '.json' AS path FROM documents""")
def q_cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", sinks.cache_key(F.lit("cache"), F.substring("text", 1, 200)).alias("path"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'running' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders""")
def q_job_transition(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return sinks.transition(o.select("o_orderkey", status.alias("status")), o.where("o_totalprice > 300000").select("o_orderkey"), "o_orderkey", "status", "pending", "running")


@query("SELECT owner, CAST(row_number() OVER (ORDER BY owner) AS INTEGER) AS step, (row_number() OVER (ORDER BY owner) - 1) % 3 = 0 AS got FROM (SELECT DISTINCT o_orderpriority AS owner FROM orders)")
def q_run_lock(spark, d):
    """The priorities of orders are runs that ask for one lock every twenty seconds; a lease is sixty seconds long."""
    path, got = scratch(spark, "lock"), []
    owners = table(spark, d, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()  # a handful of priorities
    for step, (owner,) in enumerate(owners):
        lock = sinks.RunLock(spark, path, 60, lambda step=step: 20.0 * step)
        got.append((owner, step + 1, lock.acquire(owner)))
    return spark.createDataFrame(got, "owner string, step int, got boolean")


@query("""WITH n AS (SELECT DISTINCT user_id || ':' || event_type AS key FROM events), f AS (SELECT DISTINCT user_id || ':' || event_type AS key FROM events WHERE value > 200), s AS (SELECT DISTINCT user_id || ':' || event_type AS key FROM events WHERE ts < TIMESTAMP '2024-01-02') SELECT key FROM s UNION SELECT key FROM n WHERE key NOT IN (SELECT key FROM f)""")
def q_advance_cursor(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")
    e = table(spark, d, "events")
    seen, new, failed = e.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).select(key).distinct(), e.select(key).distinct(), e.where("value > 200").select(key).distinct()
    return state.advance(seen, new, failed, "key")


# --- filters, labels, views


@query("SELECT o_orderkey, split_part(upper(f), '/', 1) IN ('10-K', '10-Q') AS periodic FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-k/A' WHEN 2 THEN '10-Q' WHEN 3 THEN '10-KT' ELSE '8-K' END AS f FROM orders)")
def q_periodic(spark, d):
    form = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-k/A' WHEN 2 THEN '10-Q' WHEN 3 THEN '10-KT' ELSE '8-K' END")
    return table(spark, d, "orders").withColumn("form", form).select("o_orderkey", E.is_periodic("form").alias("periodic"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7 OR p_size BETWEEN 20 AND 29")
def q_in_ranges(spark, d):
    ranges = universe.range_table(spark, [(a, b, "in") for a, b in universe.parse_ranges("7, 20-29, x-3, ")])
    return universe.classify(table(spark, d, "part").select("p_partkey", "p_size"), ranges, "p_size").where("label = 'in'").select("p_partkey", "p_size")


@query("SELECT doc_id, regexp_matches(upper(regexp_extract(text, '^[A-Za-z.]+')), '^[A-Z]{1,5}$') AS plain FROM documents")
def q_plain_symbol(spark, d):
    return table(spark, d, "documents").withColumn("s", F.upper(F.regexp_extract("text", "^[A-Za-z.]+", 0))).select("doc_id", universe.plain_symbol("s").alias("plain"))


@query("SELECT o_orderkey FROM orders WHERE upper('t' || o_custkey % 50) = 'T7' AND o_orderstatus IN ('O', 'P') AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderkey <> 21")
def q_search_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"), F.col("o_orderkey").cast("string").alias("accession"), F.col("o_orderstatus").alias("form"), F.col("o_orderdate").cast("date").alias("filing_date"))
    return retrieval.search_filter(o, ticker="t7", exclude="21", forms=["O", "P"], since="1998-01-01").select("o_orderkey")


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 40""")
def q_view(spark, d):
    s = table(spark, d, "events").withColumns({"direction": F.when(F.col("event_type") == "error", "bearish").otherwise("bullish"), "focus": F.col("value") > 40})
    return V.view(s, "bearish", focus_only=True).select("event_id", "user_id")


@query("""SELECT event_id, row_number() OVER (ORDER BY value > 40 DESC, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END DESC, user_id || '-' || event_id) AS k FROM events ORDER BY k LIMIT 100""")
def q_signal_order(spark, d):
    severity = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high")
    s = table(spark, d, "events").select("event_id", severity.alias("severity"), (F.col("value") > 40).alias("focus"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("ticker"))
    top = V.signal_order(s, "severity", "ticker").limit(100)  # a report of the first hundred
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.col("focus").desc(), rank_of("severity", SEVERITY_RANK, -1).desc(), "ticker")).cast("bigint")).select("event_id", "k")


@query("""SELECT o_orderkey, CASE WHEN base > 0 THEN round((o_totalprice - base) / base, 9) END AS change FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 150000.0::DOUBLE END AS base FROM orders)""")
def q_price_delta(spark, d):
    base = F.when(F.col("o_orderstatus") == "P", 0.0).when(F.col("o_orderstatus") == "O", 150000.0)
    return table(spark, d, "orders").select("o_orderkey", F.round(V.price_delta(F.col("o_totalprice"), base), 9).alias("change"))


@query("""SELECT event_id, CAST(CASE WHEN event_type = 'error' OR event_type = 'signup' OR user_id % 3 = 0 THEN 3 WHEN value / 100 <= 0.5 THEN 1 ELSE 3 END AS INTEGER) AS samples FROM events""")
def q_sample_count(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", hooks.samples_needed(F.when(t != "signup", t), F.col("user_id") % 3 == 0, F.col("value") / 100, t == "error").alias("samples"))


_SIGNAL = "s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'weakens' WHEN 'purchase' THEN 'strengthens' ELSE 'neutral' END AS direction, ['weakens', 'strengthens', 'either'][1 + user_id % 3] AS wire, value / 200 AS size FROM events), a AS (SELECT *, CASE wire WHEN 'either' THEN direction <> 'neutral' ELSE direction = wire END AS adverse FROM s)"


def _signals(spark, d):
    t = F.col("event_type")
    wire = F.element_at(F.array(F.lit("weakens"), F.lit("strengthens"), F.lit("either")), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("user_id", "event_id", F.when(t == "error", "weakens").when(t == "purchase", "strengthens").otherwise("neutral").alias("direction"), wire.alias("wire"), (F.col("value") / 200).alias("size"))


@query(f"WITH {_SIGNAL} SELECT event_id, adverse FROM a")
def q_adverse(spark, d):
    return _signals(spark, d).select("event_id", V.adverse(F.col("direction"), F.col("wire")).alias("adverse"))


@query(f"WITH {_SIGNAL} SELECT user_id, CASE WHEN bool_or(adverse AND direction <> 'neutral' AND size >= 0.5) THEN 'red' WHEN bool_or(adverse AND direction <> 'neutral' AND size >= 0.2) THEN 'amber' ELSE 'green' END AS status FROM a GROUP BY 1")
def q_provisional(spark, d):
    return V.provisional(_signals(spark, d), ["user_id"], "direction", "wire", "size")


@query(f"WITH {_SIGNAL}, p AS (SELECT user_id, CASE WHEN bool_or(adverse AND direction <> 'neutral' AND size >= 0.5) THEN 'red' WHEN bool_or(adverse AND direction <> 'neutral' AND size >= 0.2) THEN 'amber' ELSE 'green' END AS status FROM a GROUP BY 1) SELECT user_id, status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END, user_id) AS INTEGER) AS place FROM p ORDER BY place LIMIT 60")
def q_health_order(spark, d):
    first = V.by_health(V.provisional(_signals(spark, d), ["user_id"], "direction", "wire", "size"), "status", "user_id").limit(60)  # a page of the list
    return first.select("user_id", "status", F.row_number().over(Window.orderBy("band", "user_id")).alias("place"))


@query("""WITH e AS (SELECT entity, fy, revenue, cost FROM yearly) SELECT entity, fy, 'revenue' AS metric, round(revenue, 2) AS value FROM e UNION ALL SELECT entity, fy, 'cost', round(cost, 2) FROM e""".replace("WITH e", f"WITH {YEARLY}, e", 1))
def q_metric_history(spark, d):
    w = yearly(spark, d).select("entity", "fy", "revenue", "cost", "shares")
    return retrieval.metric_history(w, ["entity", "fy"], ["revenue", "cost"], ("revenue", "cost", "shares")).withColumn("value", F.round("value", 2))


@query("""SELECT o.o_orderkey, c.c_name, coalesce(c.c_name, 'unknown') AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON o.o_custkey = c.c_custkey""")
def q_named(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name", F.coalesce("c_name", F.lit("unknown")).alias("name"))


@query("""WITH p AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE count(*) END AS seen FROM events GROUP BY 1) SELECT user_id, CASE WHEN seen = 0 AND user_id % 8 <> 0 THEN DATE '2024-01-30' - 365 ELSE DATE '2024-01-20' END AS since FROM p""")
def q_lookback(spark, d):
    u = F.col("user_id")
    p = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.when(u % 4 == 0, 0).otherwise(F.col("n")))
    day = lambda x: F.lit(x).cast("date")
    return p.select("user_id", V.lookback_since(F.col("seen"), day("2024-01-30"), day("2024-01-20"), keep_narrow=u % 8 == 0).alias("since"))


@query("SELECT user_id, max(CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END) AS high_water FROM events GROUP BY 1")
def q_high_water(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("day"))).alias("high_water"))


@query("SELECT count(*) AS total, count(*) FILTER (value > 50) AS escalated, count(*) FILTER (event_type = 'error') AS held FROM events")
def q_run_counts(spark, d):
    return V.run_counts(table(spark, d, "events").withColumns({"e": F.col("value") > 50, "h": F.col("event_type") == "error"}), "e", "h")


@query("SELECT user_id, round((min(1 + value % 9) - 1) / 9 * 100, 6) AS from_pct, round((max(1 + value % 9) - 1) / 9 * 100, 6) AS to_pct FROM events GROUP BY 1")
def q_bar_position(spark, d):
    b = V.bar_position(table(spark, d, "events").withColumn("s", 1 + F.col("value") % 9), ["user_id"], "s")
    return b.select("user_id", F.round("from_pct", 6).alias("from_pct"), F.round("to_pct", 6).alias("to_pct"))


@query("SELECT round(max(length(text) / greatest(n_chars // 3, 1)), 9) AS worst, count(*) AS n FROM documents")
def q_calibration(spark, d):
    x = table(spark, d, "documents").select(F.length("text").alias("a"), F.floor(F.col("n_chars") / 3).alias("e"))
    return V.calibration(x, "a", "e").select(F.round("worst", 9).alias("worst"), "n")


_RUNS = "x AS (SELECT user_id, event_type AS dim, max(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, max(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1, 2)"


@query(f"WITH {_RUNS}, changed AS (SELECT DISTINCT user_id FROM x WHERE b IS NOT NULL AND user_id % 5 = 0) SELECT user_id, dim, CASE WHEN b IS NOT NULL AND user_id % 5 = 0 THEN 'p2' ELSE 'p1' END AS prompt, coalesce(b, a) AS value FROM x WHERE b IS NOT NULL OR (a IS NOT NULL AND user_id NOT IN (SELECT user_id FROM changed))")
def q_variance_merge(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("dim"), "value", (F.col("ts") < F.lit(_HALF).cast("timestamp_ntz")).alias("old"))
    old = e.where("old").groupBy("user_id", "dim").agg(F.max("value").alias("value")).withColumn("prompt", F.lit("p1"))
    new = e.where("not old").groupBy("user_id", "dim").agg(F.max("value").alias("value")).withColumn("prompt", F.when(F.col("user_id") % 5 == 0, "p2").otherwise("p1"))
    return V.variance_merge(old, new, ["user_id"], "dim", "prompt", ["value"])


_DCF_GRID = ", ".join(f"({x!r}::DOUBLE)" for x in solver.DISCOUNTS), ", ".join(f"({x!r}::DOUBLE)" for x in solver.MULTIPLES)


@query(f"""WITH {YEARLY}, g AS (SELECT entity, fy, a.r AS discount, CAST(m.x AS INTEGER) AS m, revenue * a.r * m.x AS v FROM yearly, (VALUES {_DCF_GRID[0]}) a(r), (VALUES {_DCF_GRID[1]}) m(x))
SELECT entity, fy, discount, round(max(v) FILTER (m = 15), 4) AS x15, round(max(v) FILTER (m = 20), 4) AS x20, round(max(v) FILTER (m = 25), 4) AS x25 FROM g GROUP BY 1, 2, 3""")
def q_grid_pivot(spark, d):
    cells = yearly(spark, d).select("entity", "fy", "revenue").crossJoin(F.broadcast(solver.grid(spark))).withColumns({"m": F.col("multiple").cast("int"), "v": F.col("revenue") * F.col("discount") * F.col("multiple")})
    p = V.grid_pivot(cells, ["entity", "fy"], "discount", "m", "v", [15, 20, 25])
    return p.select("entity", "fy", "discount", *(F.round(F.col(f"`{m}`"), 4).alias(f"x{m}") for m in (15, 20, 25)))


@query(f"""WITH {YEARLY}, x AS (SELECT entity, fy, revenue / 1e10 AS implied, CASE WHEN entity % 3 = 0 THEN NULL ELSE n / 10000 END AS c5, CASE WHEN entity % 2 = 0 THEN shares / 10000 END AS c3 FROM yearly)
SELECT entity, fy, implied <> 0 AND CASE WHEN coalesce(c5, c3) IS NOT NULL THEN implied > coalesce(c5, c3) + 0.05 ELSE implied > 0.12 END AS stretched FROM x""")
def q_stretched(spark, d):
    e = F.col("entity")
    x = yearly(spark, d).select("entity", "fy", (F.col("revenue") / 1e10).alias("i"), F.when(e % 3 != 0, F.col("n") / 10000).alias("c5"), F.when(e % 2 == 0, F.col("shares") / 10000).alias("c3"))
    return x.select("entity", "fy", solver.stretched(F.col("i"), F.col("c5"), F.col("c3")).alias("stretched"))


@query(f"WITH {_VALUED} SELECT event_id, CAST(row_number() OVER (ORDER BY ret DESC NULLS LAST, event_id) AS INTEGER) AS place FROM valued ORDER BY place LIMIT 100")
def q_portfolio_order(spark, d):
    first = portfolio.by_return(_valued(spark, d), "event_id").limit(100)  # a page of the book
    return first.select("event_id", F.row_number().over(Window.orderBy(F.col("ret").desc_nulls_last(), "event_id")).alias("place"))


# --- facts and trends

_REPORTS = "f AS (SELECT o_custkey AS entity, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS priority, year(o_orderdate) AS fy, 'Q' || quarter(o_orderdate) AS fp, o_orderkey, o_totalprice FROM orders)"


@query(f"WITH {_REPORTS} SELECT entity, CAST(fy AS INTEGER) AS fy, fp, o_orderkey, o_totalprice FROM f QUALIFY row_number() OVER (PARTITION BY entity, fy, fp ORDER BY priority, o_orderkey) = 1")
def q_pick_concept(spark, d):
    p = F.col("o_orderpriority")
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).otherwise(2).alias("priority"), F.year("o_orderdate").alias("fy"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fp"), "o_orderkey", "o_totalprice")
    return facts.pick(f, ["entity", "fy", "fp"], [F.col("priority"), F.col("o_orderkey")]).drop("priority")


@query("""WITH x AS (SELECT event_id, DATE '2020-01-01' AS s, DATE '2020-01-01' + CAST(event_id * 37 % 400 AS INTEGER) AS e, CASE WHEN user_id % 2 = 0 THEN 'FY' ELSE 'Q1' END AS fp FROM events) SELECT event_id, CASE WHEN e - s BETWEEN 80 AND 100 THEN 'quarter' WHEN e - s BETWEEN 350 AND 380 AND fp = 'FY' THEN 'annual' END AS kind FROM x""")
def q_span_kind(spark, d):
    s = F.lit("2020-01-01").cast("date")
    x = table(spark, d, "events").select("event_id", s.alias("s"), F.date_add(s, (F.col("event_id") * 37 % 400).cast("int")).alias("e"), F.when(F.col("user_id") % 2 == 0, "FY").otherwise("Q1").alias("fp"))
    return x.select("event_id", facts.span_kind("s", "e", "fp").alias("kind"))


@query("WITH x AS (SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END AS fp FROM orders) SELECT * FROM x UNION ALL SELECT o_orderkey, 'Q4' FROM x WHERE fp = 'FY'")
def q_instant_points(spark, d):
    fp = F.when(F.month("o_orderdate") == 12, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    return facts.instant_points(table(spark, d, "orders").select("o_orderkey", fp.alias("fp")), "fp")


_TAGS = [t for *_, ts in CONCEPTS for t in ts]


@query(f"""WITH v(concept, kind, unit, tag) AS (VALUES {', '.join(f'({c!r}, {k!r}, {u!r}, {t!r})' for c, k, u, ts in CONCEPTS for t in ts)}), f AS (SELECT {_TAGS!r}[1 + o_orderkey % {len(_TAGS)}] AS tag, o_totalprice AS val FROM orders),
n AS (SELECT concept, kind, unit, count(*) AS n_tags FROM v GROUP BY 1, 2, 3)
SELECT concept, kind, unit, n_tags, count(*) AS n_facts, CAST(sum(CAST(val AS DECIMAL(18,2))) AS DOUBLE) AS total FROM f JOIN v USING (tag) JOIN n USING (concept, kind, unit) GROUP BY 1, 2, 3, 4""")
def q_concept_table(spark, d):
    """Facts (orders that carry a tag) by the concept that their tag reports."""
    concepts = facts.concept_table(spark)
    tag = F.element_at(F.lit(_TAGS), (F.col("o_orderkey") % len(_TAGS) + 1).cast("int"))
    j = table(spark, d, "orders").select(tag.alias("tag"), "o_totalprice").join(F.broadcast(concepts), "tag")  # a few dozen fixed tags
    n = concepts.groupBy("concept", "kind", "unit").agg(F.count(F.lit(1)).alias("n_tags"))
    g = j.groupBy("concept", "kind", "unit").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return g.join(F.broadcast(n), ["concept", "kind", "unit"]).select("concept", "kind", "unit", "n_tags", "n_facts", "total")


@query("""WITH x AS (SELECT user_id, event_type AS concept, CAST(ts AS DATE) AS period, CASE WHEN value > 40 THEN value END AS restated_from FROM events) SELECT user_id, concept, CAST(count(DISTINCT period) AS INTEGER) AS n_restated, CASE WHEN count(DISTINCT period) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE restated_from IS NOT NULL GROUP BY 1, 2""")
def q_restated(spark, d):
    x = events(spark, d).select("user_id", F.col("event_type").alias("concept"), F.col("day").alias("period"), F.when(F.col("value") > 40, F.col("value")).alias("restated_from"))
    return trends.restated(x, ["user_id", "concept"])


@query("""WITH x AS (SELECT user_id, event_type, CASE WHEN max(value) < 60 THEN 'low' WHEN max(value) < 150 THEN 'medium' ELSE 'high' END AS severity, count(*) AS run FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END DESC, run DESC, user_id, event_type) AS k FROM x ORDER BY k LIMIT 100""")
def q_findings_order(spark, d):
    m = F.max("value")
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.when(m < 60, "low").when(m < 150, "medium").otherwise("high").alias("severity"), F.count(F.lit(1)).alias("run"))
    first = trends.ordered(x, "user_id", "event_type").limit(100)  # a report of the first hundred
    w = Window.orderBy(rank_of("severity", SEVERITY_RANK, -1).desc(), F.col("run").desc(), "user_id", "event_type")
    return first.select("user_id", "event_type", F.row_number().over(w).cast("bigint").alias("k"))


_TITLES = "['Chief  Executive', 'VP Sales (ceo)', 'Principal Financial Officer', 'oceoanic', 'Director']"


@query(f"""WITH b AS (SELECT l_partkey % 100 AS issuer, l_suppkey AS owner, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS value, {_TITLES}[1 + l_linenumber % 5] AS title FROM lineitem),
g AS (SELECT issuer, count(DISTINCT owner) AS n_buyers, CAST(sum(value) AS DOUBLE) AS value, CAST(coalesce(sum(value) FILTER (title IN ('Chief  Executive', 'VP Sales (ceo)', 'Principal Financial Officer')), 0) AS DOUBLE) AS exec_value FROM b WHERE day <= DATE '2001-03-31' AND day >= DATE '2001-03-17' GROUP BY 1)
SELECT *, CASE WHEN n_buyers >= 3 OR exec_value >= 250000 THEN 'critical' WHEN n_buyers >= 2 OR value >= 100000 THEN 'high' WHEN value >= 25000 THEN 'medium' END AS severity FROM g""")
def q_executive_buys(spark, d):
    title = F.element_at(F.array(*map(F.lit, ("Chief  Executive", "VP Sales (ceo)", "Principal Financial Officer", "oceoanic", "Director"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    b = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("issuer"), F.col("l_suppkey").alias("owner"), F.col("l_shipdate").cast("date").alias("day"), F.lit(1.0).alias("shares"), F.col("l_extendedprice").alias("price"), title.alias("title"))
    return E.insider_clusters(b, "issuer", F.col("owner"), "day", "shares", "price", "2001-03-31", exec_title="title").select("issuer", "n_buyers", "value", "exec_value", "severity")


@query("""WITH w AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' AND CAST(ts AS DATE) >= DATE '2024-01-13'), done AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND value > 100) > 0)
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM w WHERE user_id NOT IN (SELECT user_id FROM done) GROUP BY 1 HAVING count(DISTINCT event_type) >= 2""")
def q_confluence_once(spark, d):
    done = table(spark, d, "events").where("event_type = 'purchase' and value > 100").select("user_id")
    return E.confluence(events(spark, d), "user_id", "event_type", "day", "2024-01-20", days=7, done=done).select("user_id", "kinds")


# --- streams


@query("""WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'signup')), w AS (SELECT DISTINCT user_id, CAST(day + CAST(i AS INTEGER) AS DATE) AS last FROM e, range(0, 15) t(i))
SELECT w.user_id, w.last - 14 AS first_day, count(*) AS n, count(DISTINCT event_type) AS kinds, max(day) AS last_date, w.user_id || ':' || max(day) || ':' || count(DISTINCT event_type) AS key FROM w JOIN e ON e.user_id = w.user_id AND e.day BETWEEN w.last - 14 AND w.last GROUP BY w.user_id, w.last""")
def q_stream_windows(spark, d):
    s = _stream(spark, d).where("event_type in ('purchase', 'signup')")
    c = ST.sliding_clusters(s, ["user_id"], "at", "15 days", "1 day", "3 days", n=F.count(F.lit(1)), kinds=F.size(F.collect_set("event_type")).cast("bigint"), last_date=F.max(F.to_date("at")))
    out = ST.run_to_latest(c, scratch(spark, "windows"), ["user_id", "window_start"])
    day = F.to_date("window_start")
    return out.select("user_id", day.alias("first_day"), "n", "kinds", "last_date", ST.cluster_key("user_id", "last_date", "kinds").alias("key"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value < 40 THEN 'green' WHEN value < 90 THEN 'amber' ELSE 'red' END AS level FROM events), c AS (SELECT *, lag(level, 1, 'green') OVER (PARTITION BY user_id ORDER BY ts, level) AS before FROM e)
SELECT user_id, count(*) AS n_changes, arg_max(level, (ts, level)) AS last FROM c WHERE level <> before GROUP BY 1""")
def q_stream_sticky(spark, d):
    s = _stream(spark, d).withColumn("level", F.when(F.col("value") < 40, "green").when(F.col("value") < 90, "amber").otherwise("red"))
    at = scratch(spark, "sticky")
    out = ST.run_to_table(ST.sticky_status(s, "user_id", "level", "at"), f"{at}/out", f"{at}/state")
    return out.groupBy(F.col("key").alias("user_id")).agg(F.count(F.lit(1)).alias("n_changes"), F.max_by("to_status", F.struct("at", "to_status")).alias("last"))


@query("SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events GROUP BY 1")
def q_stream_surface(spark, d):
    """Keys surface once for good: what was surfaced is a table, so a key that comes back after any watermark is not new."""
    keyed = _stream(spark, d).select(F.col("user_id").cast("string").alias("key"), F.to_date("at").alias("day"))
    t = sinks.Table(spark, scratch(spark, "surfaced"), "key string, day date", ["key"], buckets=2)
    ST.surface_for_good(keyed, t, [F.col("day")], scratch(spark, "surfaced-state"))
    return t.read().select(F.col("key").cast("bigint").alias("user_id"), F.col("day").alias("first"))


# --- text for readers


@query(f"""{_STICKY}, f AS (SELECT * FROM r WHERE prior <> status), l AS (SELECT user_id, CASE status WHEN 'red' THEN '🔴 Exit' WHEN 'amber' THEN '🟡 Watch' ELSE '🟢 Hold' END AS now, CASE prior WHEN 'red' THEN '🔴 Exit' WHEN 'amber' THEN '🟡 Watch' ELSE '🟢 Hold' END AS was FROM f)
SELECT user_id, '1 thesis state change' AS subject, '<ul><li><b>a &lt;' || user_id || '&gt;</b>: ' || was || ' → ' || now || '</li></ul><a href="https://x.test/theses/' || user_id || '">open</a>' AS html FROM l""")
def q_digest_html(spark, d):
    f = state.flips(_sticky(spark, d), "status").withColumn("label", F.concat(F.lit("a <"), F.col("user_id").cast("string"), F.lit(">")))
    return render.digest_html(f, "user_id", "label", "https://x.test")


_BRIEF = """f AS (SELECT conv_id, role AS category, CASE WHEN length(text) > 400 THEN 'high' WHEN length(text) > 200 THEN 'medium' ELSE 'low' END AS severity, 'turn ' || turn AS claim, 1 + turn % 3 AS occurrences, left(text, 20) AS quote, turn FROM conversations),
fl AS (SELECT conv_id, string_agg('- **[' || severity || '] ' || category || '** — ' || claim || CASE WHEN occurrences > 1 THEN ' _(raised in ' || occurrences || ' chunks)_' ELSE '' END || chr(10) || '  - quote: "' || quote || '"', chr(10) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, occurrences DESC, category, claim) AS t FROM f WHERE turn < 4 GROUP BY 1),
ml AS (SELECT conv_id, string_agg('- chars: ' || CASE WHEN turn = 4 THEN 'n/a' ELSE CAST(length(text) AS VARCHAR) END || ' n — T' || turn || CASE WHEN turn = 5 THEN ' (prior: 9)' ELSE '' END || chr(10) || '  - quote: "q"', chr(10) ORDER BY turn) AS t FROM conversations WHERE turn >= 4 GROUP BY 1),
cl AS (SELECT conv_id, string_agg('- ' || role || CASE WHEN turn = 0 THEN ' _(checkable)_' ELSE '' END || chr(10) || '  - quote: "q' || turn || '"', chr(10) ORDER BY turn) AS t FROM conversations WHERE turn < 2 GROUP BY 1), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"""


@query(f"""WITH {_BRIEF} SELECT n.conv_id, '# T' || n.conv_id || ' — 10-K filed 2024-01-01' || coalesce(chr(10) || chr(10) || '## Flags' || chr(10) || fl.t, chr(10) || chr(10) || '## Flags' || chr(10) || '_none raised_') || coalesce(chr(10) || chr(10) || '## Metrics' || chr(10) || ml.t, '') || coalesce(chr(10) || chr(10) || '## Management claims' || chr(10) || cl.t, '')
 || chr(10) || chr(10) || '_' || n.n || ' chunks processed, 0 failed, 1 findings dropped for unverifiable quotes._' AS text FROM n LEFT JOIN fl USING (conv_id) LEFT JOIN ml USING (conv_id) LEFT JOIN cl USING (conv_id)""")
def q_brief_markdown(spark, d):
    c, turn = table(spark, d, "conversations"), F.col("turn")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    f = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks")).select("conv_id", text("T", F.col("conv_id").cast("string")).alias("ticker"), F.lit("10-K").alias("form"), F.lit("2024-01-01").alias("filing_date"), "chunks", F.lit(0).alias("failed"), F.lit(1).alias("dropped"))
    severity = F.when(F.length("text") > 400, "high").when(F.length("text") > 200, "medium").otherwise("low")
    flags = c.where("turn < 4").select("conv_id", F.col("role").alias("category"), severity.alias("severity"), text("turn ", turn.cast("string")).alias("claim"), (1 + turn % 3).alias("occurrences"), F.substring("text", 1, 20).alias("quote"))
    metrics = c.where("turn >= 4").select("conv_id", F.lit("chars").alias("label"), F.when(turn != 4, F.length("text").cast("string")).alias("value"), F.lit("n").alias("unit"), text("T", turn.cast("string")).alias("period"), F.when(turn == 5, "9").alias("prior"), F.lit("q").alias("quote"), turn.alias("position"))
    claims = c.where("turn < 2").select("conv_id", F.col("role").alias("claim"), (turn == 0).alias("checkable"), text("q", turn.cast("string")).alias("quote"), turn.alias("position"))
    return render.brief_markdown(f, "conv_id", flags, metrics, claims)


@query("""WITH x AS (SELECT user_id, event_type, round(max(value) / 100, 1) AS score, CASE WHEN count(*) > 1 THEN round((max(value) - min(value)) / 100, 1) END AS spread, count(*) / 10.0::DOUBLE AS w FROM events GROUP BY 1, 2), u AS (SELECT *, CASE WHEN spread IS NULL THEN 'moderate' WHEN spread <= 0.5 THEN 'tight' WHEN spread <= 1.5 THEN 'moderate' ELSE 'high' END AS unc FROM x),
l AS (SELECT user_id, string_agg('| ' || event_type || ' | **' || printf('%.1f', score) || '** | ' || coalesce(printf('%.1f', spread), '—') || ' | ' || CASE unc WHEN 'high' THEN '⚠️ **high**' ELSE unc END || ' | ' || printf('%.2f', w) || ' |', chr(10) ORDER BY event_type) AS t, max(score) AS s FROM u GROUP BY 1)
SELECT user_id, CASE WHEN contains(t, 'high') THEN 'unsure' ELSE 'sure' END AS kind, md5(t) AS rows_md5 FROM l""")
def q_card_markdown(spark, d):
    spread = F.when(F.count(F.lit(1)) > 1, F.round((F.max("value") - F.min("value")) / 100, 1))
    x = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.round(F.max("value") / 100, 1).alias("score"), spread.alias("spread"), (F.count(F.lit(1)) / 10.0).alias("weight"))
    dims = x.withColumns({"uncertainty": scores.uncertainty(F.col("spread")), "position": F.col("label")})
    cards = dims.groupBy("user_id").agg(F.max("score").alias("score")).withColumns({"verdict": F.lit("Pass"), "summary": F.lit("s")})
    text = render.card_markdown(cards, dims, "user_id")
    rows = F.expr("substring(text, instr(text, '|---|---|---|---|---|') + 22)")
    return text.select("user_id", F.when(rows.contains("high"), "unsure").otherwise("sure").alias("kind"), F.md5(rows).alias("rows_md5"))


@query("""SELECT user_id, '[' || string_agg('{"event_type":"' || event_type || '","n":' || n || '}', ',' ORDER BY event_type) || ']' AS json FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def q_findings_json(spark, d):
    return render.trends_json(table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), "user_id", ["event_type", "n"])


_ROUTED = """s AS (SELECT doc_id, ['business', 'risk-factors', 'mda'][i] AS section, CASE WHEN i < 3 THEN l[i] ELSE array_to_string(l[3:], chr(10)) END AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), (VALUES (1), (2), (3)) t(i)), k AS (SELECT * FROM s WHERE length(text) > 0),
r(dimension, pos, section) AS (VALUES ('moatDurability', 0, 'business'), ('moatDurability', 1, 'mda'), ('moatDurability', 2, 'risk-factors'), ('ownerEarningsQuality', 2, 'mda'), ('capitalAllocation', 0, 'mda'), ('debtSustainability', 2, 'mda'), ('cyclicalityAwareness', 0, 'risk-factors'), ('cyclicalityAwareness', 1, 'mda'))"""


@query(f"""WITH {_ROUTED} SELECT doc_id, dimension, string_agg(section, ', ' ORDER BY pos) AS sources, string_agg('### ' || section || ' (' || format('{{:,}}', length(text)) || ' chars)' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM k JOIN r USING (section) GROUP BY 1, 2""")
def q_contexts(spark, d):
    """Each whole text as three sections, its first line, its second and all the others, under a ceiling that none reaches."""
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    parts = (("business", F.try_element_at(lines, F.lit(1))), ("risk-factors", F.try_element_at(lines, F.lit(2))), ("mda", rest))
    s = table(spark, d, "documents").select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("section"), t.alias("text")) for n, t in parts))))
    s = s.withColumn("bundled", F.when(F.col("section") == "business", F.array(F.lit("mda"))))  # the business section stands for the discussion too
    return contexts.contexts(s, "doc_id", {}, ceiling=1 << 40)


_PARTS = "regexp_replace(substr(text, {0}, 30), '[^a-z]', ' ', 'g')"


@query(f"""WITH p AS (SELECT doc_id, {_PARTS.format(1)} AS a, {_PARTS.format(31)} AS b, CAST(doc_id AS VARCHAR) AS n FROM documents)
SELECT doc_id, b || chr(10) || 'the zqrevenue' || n || ' grew' || chr(10) || a AS text, false AS above FROM p""")
def q_snippet(spark, d):
    part = lambda i: F.regexp_replace(F.substring("text", i, 30), "[^a-z]", " ")
    n = F.col("doc_id").cast("string")
    cut = F.udf(lambda t, k: snippets.snippet(t, f"zqrevenue{k}", 200), "struct<text: string, above: boolean>")
    x = table(spark, d, "documents").select("doc_id", cut(F.concat(part(31), F.lit("\nthe zqrevenue"), n, F.lit(" grew\n"), part(1)), "doc_id").alias("s"))
    return x.select("doc_id", "s.text", "s.above")


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^[\x09-\x0D ]+', '') ELSE text END AS body FROM documents")
def q_body_only(spark, d):
    t = table(spark, d, "documents")
    marked = F.concat(F.lit(f"{chunks.OVERLAP}\nwhat came before\n{chunks.OVERLAP_END}\n\n"), F.col("text"))
    return t.withColumn("chunk", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text"))).select("doc_id", chunks.body_only("chunk").alias("body"))


# --- hooks


@query(f"""WITH x AS (SELECT doc_id, text, {_ESTIMATE} > 8000 AS long FROM documents)
SELECT doc_id, CASE WHEN NOT long THEN '{{"digest": "' || left(sha1(text), 12) || '", "length": ' || length(text) || '}}' END AS response, CASE WHEN long THEN 'prompt does not fit the context' END AS error FROM x""")
def q_model_call(spark, d):
    """Every whole text as a prompt; those that do not fit a model's context are refused."""
    return hooks.call(table(spark, d, "documents"), "text", hooks.stub, ["doc_id"])


@query("SELECT doc_id, CAST(3 AS BIGINT) AS dims, CAST(length(text) AS DOUBLE) AS first FROM documents")
def q_embed(spark, d):
    e = retrieval.embed(table(spark, d, "documents"), "text", lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts])
    return e.select("doc_id", F.size("embedding").cast("bigint").alias("dims"), F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings")
def q_pack_floats(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", retrieval.pack_floats("embedding").alias("b")).select("vec_id", retrieval.unpack_floats("b").alias("v"))
    return e.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))
