"""Queries on sources: fixtures are written from the tables in the source's own format, and read through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import filings, market, tables
from ..text import transcripts
from .base import SERIES, events, query, table
from .base import series as quarterly


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1")
def q_day_folders(spark, d):
    path = scratch(spark, "days")
    events(spark, d).select(F.concat_ws("|", "user_id", "event_type").alias("value"), F.col("day").alias("date")).write.partitionBy("date").text(path)
    lines = tables.day_folders(spark, path, "2024-01-10", "2024-01-12")
    return lines.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.split("value", r"\|")[0]).alias("n_users"))


@query(f"""WITH {SERIES} SELECT CAST(entity AS BIGINT) AS cik, 'Revenues' AS tag, 'USD' AS unit, make_date(fy, 3 * fq - 2, 1) AS start, last_day(make_date(fy, 3 * fq, 1)) AS "end", round(revenue, 2) AS val, fy, 'Q' || fq AS fp, 'acc-' || fy || fq AS accn FROM series""")
def q_company_facts(spark, d):
    fy, fq = F.col("fy"), F.col("fq")
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    value = F.struct(
        date(F.make_date(fy, 3 * fq - 2, F.lit(1))).alias("start"), date(F.last_day(F.make_date(fy, 3 * fq, F.lit(1)))).alias("end"), F.round("revenue", 2).alias("val"),
        F.concat(F.lit("acc-"), fy.cast("string"), fq.cast("string")).alias("accn"), fy.alias("fy"), F.concat(F.lit("Q"), fq.cast("string")).alias("fp"), F.lit("10-Q").alias("form"), F.lit("2002-01-01").alias("filed"),
    )
    g = quarterly(spark, d).groupBy("entity").agg(F.collect_list(value).alias("v"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("v")).alias("units"))))
    path = scratch(spark, "facts")
    one = g.select(F.col("entity").cast("bigint").alias("cik"), F.lit("x").alias("entityName"), facts.alias("facts"))
    one.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)  # a few nations
    return filings.company_facts(spark, path).select("cik", "tag", "unit", "start", "end", "val", "fy", "fp", "accn")


@query("SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, n_name AS title FROM nation")
def q_ticker_map(spark, d):
    row = F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_nationkey").cast("bigint").alias("cik_str"), F.lower("n_name").alias("ticker"), F.col("n_name").alias("title")))
    path = scratch(spark, "tickers")
    table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(row))).alias("value")).write.text(path)
    return tables.ticker_map(spark, path)


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(3000 + n_nationkey AS INTEGER) END AS sic, 'industry ' || n_regionkey AS industry, len(list_filter(['NYSE', CASE WHEN n_regionkey = 1 THEN 'Nasdaq' END], lambda x: x IS NOT NULL)) AS n_exchanges FROM nation")
def q_company_profiles(spark, d):
    n = table(spark, d, "nation")
    sic = F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise((F.col("n_nationkey") + 3000).cast("string"))
    one = n.select(F.col("n_nationkey").cast("string").alias("cik"), F.col("n_name").alias("name"), sic.alias("sic"), F.concat(F.lit("industry "), F.col("n_regionkey").cast("string")).alias("sicDescription"), F.array(F.col("n_name")).alias("tickers"), F.when(F.col("n_regionkey") == 1, F.array(F.lit("NYSE"), F.lit("Nasdaq"))).otherwise(F.array(F.lit("NYSE"))).alias("exchanges"))
    path = scratch(spark, "profiles")
    one.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return tables.company_profiles(spark, path).select("cik", "name", "sic", "industry", F.size("exchanges").cast("bigint").alias("n_exchanges"))


@query("SELECT n_regionkey || '-' || n_nationkey AS key, CAST(n_nationkey AS BIGINT) AS n, 'folder=' || n_name AS ticker FROM nation")
def q_fixtures(spark, d):
    path = scratch(spark, "fixtures")
    n = table(spark, d, "nation").select(F.concat_ws("-", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("folder"))
    n.repartition(1).write.partitionBy("folder").json(path)  # a document for each folder
    return tables.fixtures(spark, path, "key string, n bigint").select("key", "n", "ticker")


_F = "CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '8-K' WHEN 3 THEN '4' ELSE '10-Q' END"
_LISTED = f"f AS (SELECT o_custkey, {_F} AS form, strftime(o_orderdate, '%Y-%m-%d') AS date, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession FROM orders)"


def _lists(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.expr(_F).alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accession"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("accession", "form", "date"))).alias("x"))
    return g.select("o_custkey", *(F.col(f"x.{c}").alias(c) for c in ("form", "date", "accession")))


def _listed(name: str, forms: str, since: str, limit: int) -> str:
    return f"WITH {_LISTED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY date DESC, form, accession) AS INTEGER) AS rn FROM f WHERE split_part(form, '/', 1) IN ({forms}) AND date >= '{since}') SELECT * FROM r WHERE rn <= {limit}"


@query(_listed("q_list_filings", "'10-K', '10-Q'", "1996-01-01", 5))
def q_list_filings(spark, d):
    return filings.list_filings(_lists(spark, d), ["o_custkey"], ["form", "date", "accession"], ["10-K", "10-Q"], "form", "date", "1996-01-01", 5)


@query(_listed("q_latest_filing", "'10-K'", "1000-01-01", 1))
def q_latest_filing(spark, d):
    return filings.list_filings(_lists(spark, d), ["o_custkey"], ["form", "date", "accession"], ["10-K"], "form", "date", limit=1)


@query(_listed("q_tracked_filings", "'8-K', '4', '10-Q'", "2000-06-01", 100))
def q_tracked_filings(spark, d):
    return filings.list_filings(_lists(spark, d), ["o_custkey"], ["form", "date", "accession"], ["8-K", "4", "10-Q"], "form", "date", "2000-06-01")


_FILE = "CASE l_linenumber % 4 WHEN 0 THEN 'ex99-' WHEN 1 THEN 'Exhibit-99_' WHEN 2 THEN 'ex-10.' ELSE 'form8k-' END || l_linenumber || '-' || l_partkey"
_EXHIBITS = f"x AS (SELECT l_orderkey, {_FILE} AS name FROM lineitem), e AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY name) AS INTEGER) AS rn FROM x WHERE regexp_matches(name, '(?i)ex-?(hibit)?-?99')), e3 AS (SELECT * FROM e WHERE rn <= 3)"


def _exhibits(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.expr(_FILE).alias("name"))
    return filings.exhibits(x, ["l_orderkey"], "name")


@query(f"WITH {_EXHIBITS} SELECT * FROM e3")
def q_exhibits(spark, d):
    return _exhibits(spark, d)


_ITEMS = "CASE o_orderkey % 4 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '5.02' WHEN 2 THEN '1.01, 9.01' ELSE '12.02' END"


@query(f"""WITH {_EXHIBITS}, t AS (SELECT l_orderkey, string_agg(name, chr(10) || chr(10) ORDER BY rn) AS texts FROM e3 GROUP BY 1)
SELECT o_orderkey, 'body ' || o_orderkey || CASE WHEN texts IS NOT NULL AND o_orderkey % 4 IN (0, 2) THEN chr(10) || chr(10) || texts ELSE '' END AS body FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def q_current_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_ITEMS).alias("items"), F.concat(F.lit("body "), F.col("o_orderkey").cast("string")).alias("body"))
    e = _exhibits(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), "name", "rn")
    return filings.current_report(o, e, "o_orderkey", "items", "body", "name").select("o_orderkey", "body")


@query("""WITH t AS (SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'N') AND l_quantity > 0)
SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS cik, 'T' || l_orderkey % 100 AS ticker, 'acc' || l_orderkey AS accession, day AS transaction_date, CAST(l_orderkey % 1000 AS VARCHAR) AS owner_cik, l_quantity AS shares, CASE WHEN l_discount > 0 THEN l_extendedprice END AS price, CASE WHEN l_discount > 0 THEN round(l_quantity * l_extendedprice, 2) END AS value, l_orderkey % 2 = 0 AS is_officer, l_linenumber AS line FROM t""")
def q_form4(spark, d):
    line = table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    value = lambda tag, x: F.concat(F.lit(f"<{tag}><value>"), x, F.lit(f"</value></{tag}>"))
    code = F.concat(F.lit("<transactionCoding><transactionCode>"), F.when(F.col("l_linestatus") == "F", "P").otherwise("S"), F.lit("</transactionCode></transactionCoding>"))
    how = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "").otherwise("D")
    price = F.when(F.col("l_discount") > 0, text("l_extendedprice")).otherwise("0")
    amounts = F.concat(F.lit("<transactionAmounts>"), value("transactionShares", text("l_quantity")), value("transactionPricePerShare", price), value("transactionAcquiredDisposedCode", how), F.lit("</transactionAmounts>"))
    deal = F.concat(F.lit("<nonDerivativeTransaction>"), value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), code, amounts, F.lit("</nonDerivativeTransaction>"))
    owner = F.concat(F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), (F.col("l_orderkey") % 1000).cast("string"), F.lit("</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>"), F.when(F.col("l_orderkey") % 2 == 0, "true").otherwise("0"), F.lit("</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>"))
    xml = F.concat(F.lit("<ownershipDocument><issuer><issuerTradingSymbol>t"), (F.col("l_orderkey") % 100).cast("string"), F.lit("</issuerTradingSymbol></issuer>"), owner, F.lit("<nonDerivativeTable>"), deal, F.lit("</nonDerivativeTable></ownershipDocument>"))
    forms = line.select(F.col("l_orderkey").cast("string").alias("cik"), F.concat(F.lit("acc"), F.col("l_orderkey").cast("string")).alias("accession"), F.struct(F.lit("2002-01-01").alias("day"), F.col("l_linenumber").alias("line")).alias("filing_date"), xml.alias("xml"))
    forms = forms.withColumn("line", F.col("filing_date.line")).withColumn("filing_date", F.concat_ws("/", F.col("filing_date.day"), F.col("line").cast("string")))
    out = filings.form4_purchases(forms)
    return out.select("cik", "ticker", "accession", "transaction_date", "owner_cik", "shares", "price", F.round("value", 2).alias("value"), "is_officer", F.split("filing_date", "/")[1].cast("int").alias("line"))


@query("SELECT c_name AS symbol, length(c_name) + CAST(right(c_name, 3) AS INTEGER) / 4.0 AS price, CAST(NULL AS VARCHAR) AS error FROM customer")
def q_quotes(spark, d):
    return tables.quotes(table(spark, d, "customer"), "c_name", lambda names: {n: len(n) + int(n[-3:]) / 4 for n in names})


@query("""SELECT upper(p_brand) || '-' || p_partkey AS ticker, CASE WHEN p_size <> 3 THEN p_retailprice END AS price, p_retailprice * 1e6 AS market_cap, p_retailprice * 2 AS high_52w, p_retailprice / 2 AS low_52w, CASE WHEN p_size <> 3 THEN p_retailprice * coalesce(CASE WHEN p_size % 2 = 0 THEN p_size * 100.0 END, p_size * 10.0) END AS avg_dollar_volume FROM part""")
def q_market_snapshot(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    q = p.select(F.concat_ws("-", F.lower("p_brand"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(size != 3, F.col("p_retailprice")).alias("price"), (F.col("p_retailprice") * 1e6).alias("cap"), (F.col("p_retailprice") * 2).alias("hi"), (F.col("p_retailprice") / 2).alias("lo"), F.when(size % 2 == 0, size * 100.0).alias("v3"), (size * 10.0).alias("v10"))
    return market.market_snapshot(q, "symbol", "price", "cap", "hi", "lo", "v3", "v10")


@query("""WITH e AS (SELECT 'N' || n_nationkey AS symbol, make_date(2000 + CAST(i AS INTEGER), 12, 31) AS date, CAST(n_nationkey * 10 + i AS DOUBLE) AS "revenueAvg", CASE WHEN i % 2 = 0 THEN i / 4.0::DOUBLE END AS "epsAvg", CAST(i AS INTEGER) AS "numAnalystsEps" FROM nation, range(1, 11) t(i))
SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) AS INTEGER) AS position FROM e QUALIFY position <= 8""")
def q_estimates(spark, d):
    i = F.col("i").cast("int")
    each = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    e = F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("symbol"), F.concat((i + 2000).cast("string"), F.lit("-12-31")).alias("date"), (F.col("n_nationkey") * 10.0 + i).alias("revenueAvg"), F.when(i % 2 == 0, i / 4.0).alias("epsAvg"), i.alias("numAnalystsEps"))
    replies = each.groupBy("n_nationkey").agg(F.to_json(F.collect_list(e)).alias("json"))
    return market.consensus_estimates(replies, "json").select("symbol", "date", "position", "revenueAvg", "epsAvg", "numAnalystsEps")


@query("""SELECT event_id, user_id, value AS raw_close, CASE WHEN event_id % 3 = 0 THEN value * 0.5 ELSE value END AS close FROM events WHERE event_type <> 'error'""")
def q_bars(spark, d):
    i, v = F.col("event_id"), F.col("value")
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", v).alias("c"), F.when(i % 3 == 0, v * 0.5).when(i % 3 == 1, 0.0).alias("a"))
    return market.bars(e, "event_id", "user_id", "c", "a")


@query("""WITH b AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1, 2) SELECT o_custkey, CAST(year(date) AS INTEGER) AS year, arg_max(close, date) AS close, max(date) AS date FROM b GROUP BY 1, 2""")
def q_year_end_closes(spark, d):
    b = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("close"))
    return market.year_end_closes(b, "o_custkey", "date", "close")


_RATED = """r AS (SELECT user_id, CAST(ts AS DATE) AS month, count(*) FILTER (event_type = 'purchase') AS sb, count(*) FILTER (event_type = 'signup') AS b, count(*) FILTER (event_type = 'view') AS h, nullif(count(*) FILTER (event_type = 'click'), 0) AS s, count(*) FILTER (event_type = 'error') AS ss FROM events GROUP BY 1, 2),
i AS (SELECT user_id, month, 2 * sb + b - (coalesce(s, 0) + 2 * ss) AS bull_index, sb + b + h + coalesce(s, 0) + ss AS total FROM r)"""


@query(f"""WITH {_RATED}, m AS (SELECT *, lag(bull_index) OVER (PARTITION BY user_id ORDER BY month) AS prior FROM i)
SELECT *, bull_index - prior AS delta, round((bull_index - prior) / nullif(abs(prior), 0), 6) AS share, CASE WHEN prior IS NOT NULL THEN CASE WHEN bull_index >= prior THEN 'up' ELSE 'down' END END AS direction FROM m""")
def q_bull_index(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    r = events(spark, d).groupBy("user_id", F.col("day").alias("month")).agg(n("purchase").alias("strong_buy"), n("signup").alias("buy"), n("view").alias("hold"), F.nullif(n("click"), F.lit(0)).alias("sell"), n("error").alias("strong_sell"))
    x = transcripts.bull_index(r).select("user_id", "month", "bull_index", "total")
    return transcripts.month_change(x, ["user_id"], "month", "bull_index").withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT 'customer-' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, 'order-' || o_orderkey AS key, o_totalprice AS amount, CAST(NULL AS DOUBLE) AS value FROM orders), e AS (SELECT 'user-' || user_id AS symbol, CAST(ts AS DATE) AS date, 'event-' || event_id AS key, CAST(NULL AS DOUBLE) AS amount, value FROM events WHERE event_type = 'signup'),
u AS (SELECT * FROM s UNION ALL SELECT * FROM e) SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY date, key) AS prior_value FROM u""")
def q_union_feeds(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_totalprice").alias("amount"))
    e = events(spark, d).where("event_type = 'signup'").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("symbol"), F.col("day").alias("date"), F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("key"), "value")
    u = market.union_feeds([o, e], "date", "key").withColumn("at", F.struct("date", "key"))
    return market.with_prior_month(u, "symbol", "at", "value").drop("at")


@query(r"SELECT page_id, nullif(CAST(regexp_extract(html, '(?is)track\(.{0,200}?([0-9][0-9,]*(?:\.[0-9]+)?)', 1) AS DOUBLE), 0) AS value FROM pages")
def q_scraped_index(spark, d):
    return table(spark, d, "pages").select("page_id", market.scraped_index(F.col("html"), r"track\(").alias("value"))


@query("""WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE strftime(ts, '%Y%m%d%H%M%S') END AS stamp FROM events) SELECT user_id, count(*) FILTER (stamp <> 'bad' AND user_id % 7 <> 0) AS n, min(stamp) FILTER (stamp <> 'bad' AND user_id % 7 <> 0) AS first, max(stamp) FILTER (stamp <> 'bad' AND user_id % 7 <> 0) AS last FROM t GROUP BY 1""")
def q_capture_times(spark, d):
    at = F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    wide, here = F.col("user_id") % 2 == 0, F.col("user_id") % 7 != 0
    row = F.when(wide, F.array(at, F.lit("x"))).otherwise(F.array(F.lit("u"), F.lit("v"), at))
    head = F.when(wide, F.array(F.when(here, "timestamp").otherwise("other"), F.lit("url"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.when(here, "timestamp").otherwise("other")))
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(row).alias("rows"))
    times = market.capture_times(F.to_json(F.concat(F.array(head), F.col("rows"))))
    t = g.select("user_id", F.coalesce(times, F.array().cast("array<string>")).alias("t"))
    return t.select("user_id", F.size("t").cast("bigint").alias("n"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


_CUES = """c AS (SELECT conv_id, turn, CAST(floor(turn * 3.7 + 0.5) AS DOUBLE) AS start, CAST(floor(turn * 3.7 + 2.2 + 0.5) AS DOUBLE) AS "end", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)"""


@query(f"""WITH {_CUES} SELECT conv_id, start, "end", text FROM c WHERE text <> ''""")
def q_caption_cues(spark, d):
    return _cues(spark, d)


def _cues(spark, d):
    t = F.col("turn")
    e = F.struct(F.round(t * 3700.0, 3).alias("tStartMs"), F.lit(2200.0).alias("dDurationMs"), F.array(F.struct(F.substring("text", 1, 5).alias("utf8")), F.struct(F.expr("substring(text, 6)").alias("utf8"))).alias("segs"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(e).alias("events"))).alias("json"))
    return g.select("conv_id", F.explode(market.caption_cues(F.col("json"))).alias("c")).select("conv_id", "c.start", "c.end", "c.text")


@query(f"""WITH RECURSIVE {_CUES}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start, "end", text) AS k FROM c WHERE text <> ''),
w AS (SELECT conv_id, k, start AS first, 1 AS part FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, CASE WHEN o."end" - w.first < 10 THEN w.first ELSE o.start END, CASE WHEN o."end" - w.first < 10 THEN w.part ELSE w.part + 1 END FROM w JOIN o ON o.conv_id = w.conv_id AND o.k = w.k + 1)
SELECT o.conv_id, min(o.start) AS start, max(o."end") AS "end", string_agg(o.text, ' ' ORDER BY o.k) AS text FROM o JOIN w USING (conv_id, k) GROUP BY o.conv_id, part""")
def q_merge_cues(spark, d):
    return transcripts.merge_cues(_cues(spark, d), ["conv_id"], "start", "end", "text")


@query("""SELECT conv_id, CAST(turn * 2 AS DOUBLE) AS start, CAST(turn * 2 + floor(1.5 + 0.5) AS DOUBLE) AS "end", 'turn ' || turn || ' & <' || role || '>' AS text FROM conversations""")
def q_timed_text(spark, d):
    t = F.col("turn")
    line = F.concat(F.lit('<text start="'), (t * 2).cast("string"), F.lit('" dur="1.5" x="y">turn '), t.cast("string"), F.lit(" &amp; \n&lt;"), F.col("role"), F.lit("&gt;</text>"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(line), "").alias("xml"))
    return g.select("conv_id", F.explode(market.timed_text(F.col("xml"))).alias("c")).select("conv_id", "c.*")


_CHAPTER = "CASE WHEN turn % 4 = 3 THEN 'no time here' WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN '1:0' || turn % 10 || ':30 - Part ' || turn ELSE turn % 60 || ':15 Part ' || turn END"


@query("""WITH c AS (SELECT conv_id, turn, 'Part ' || turn AS title, CAST(CASE WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN 3600 + 60 * (turn % 10) + 30 ELSE 60 * (turn % 60) + 15 END AS INTEGER) AS seconds FROM conversations WHERE turn % 4 <> 3),
o AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(seconds) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c), k AS (SELECT *, bool_and(before IS NULL OR before <= seconds) OVER (PARTITION BY conv_id) AS ordered FROM o) SELECT conv_id, seconds, title FROM k WHERE n >= 3 AND ordered""")
def q_chapters(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_CHAPTER).alias("line"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\r\n").alias("text"))
    return g.select("conv_id", F.explode(market.chapters(F.col("text"))).alias("c")).select("conv_id", "c.seconds", "c.title")


@query("SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL ELSE left(md5(url), 11) END AS video FROM pages")
def q_video_id(spark, d):
    p = table(spark, d, "pages")
    key, kind = F.substring(F.md5("url"), 1, 11), F.col("page_id") % 5
    url = F.when(kind == 0, F.concat(F.lit("https://youtu.be/"), key)).when(kind == 1, F.concat(F.lit("https://www.youtube.com/watch?x=1&v="), key, F.lit("&t=3"))).when(kind == 2, F.concat(F.lit("https://youtube.com/shorts/"), key, F.lit("?a"))).when(kind == 3, F.concat(F.lit("https://m.youtube.com/live/"), key)).otherwise(F.concat(F.lit("https://youtu.be/"), F.substring(key, 1, 9)))
    return p.select("page_id", market.video_id(url).alias("video"))


@query("""WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY)) AS DATE) AS date)
SELECT date FROM d WHERE isodow(date) < 6 AND date NOT IN (DATE '1998-01-01', DATE '1998-01-19', DATE '1998-02-16') AND date NOT IN (SELECT date FROM f)""")
def q_missed_days(spark, d):
    index = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("filing_date"))
    return filings.missed_days(index, filings.business_days(spark, "1998-01-01", "1998-03-31")).select("date")


@query("""SELECT event_id, left(sha1('{"p0":"' || event_type || '","p1":' || user_id || '}'), 12) AS key FROM events""")
def q_identity(spark, d):
    return table(spark, d, "events").select("event_id", market.identity(F.col("event_type"), F.col("user_id")).alias("key"))


@query("SELECT turn, CASE WHEN turn * 977 >= 3600 THEN turn * 977 // 3600 || ':' || lpad(CAST(turn * 977 % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(turn * 977 // 60 AS VARCHAR) END || ':' || lpad(CAST(turn * 977 % 60 AS VARCHAR), 2, '0') AS clock, count(*) AS n FROM conversations GROUP BY 1")
def q_clock(spark, d):
    return table(spark, d, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("n")).withColumn("clock", transcripts.clock(F.col("turn") * 977))


