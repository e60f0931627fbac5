"""Events, state, as-of joins, portfolios, sources and sinks on small frames."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import asof, portfolio, scores, state, universe
from quillstone.operators import events as E
from quillstone.sources import filings, market, sinks


def d(s):
    return dt.date.fromisoformat(s)


def test_asof(spark):
    bars = spark.createDataFrame([("x", d("2020-01-02"), 10.0), ("x", d("2020-01-05"), 12.0)], "t string, date date, close double")
    left = spark.createDataFrame([(i, "x", d(s)) for i, s in enumerate(["2020-01-01", "2020-01-02", "2020-01-04", "2020-01-06"])] + [(9, "y", d("2020-01-04"))], "i int, t string, at date")
    back = {r.i: r.close for r in asof.backward(left, bars, ["t"], "at", "date", ["close"]).collect()}
    assert back == {0: None, 1: 10.0, 2: 10.0, 3: 12.0, 9: None}
    forth = {r.i: r.close for r in asof.forward(left, bars, ["t"], "at", "date", ["close"]).collect()}
    assert forth == {0: 10.0, 1: 10.0, 2: 12.0, 3: None, 9: None}
    near = {r.i: r.close for r in asof.nearest(left, bars, ["t"], "at", "date", ["close"]).collect()}
    assert near == {0: 10.0, 1: 10.0, 2: 12.0, 3: 12.0, 9: None}


def test_positions(spark):
    bars = spark.createDataFrame([("x", d("2020-01-02"), 10.0), ("x", d("2020-01-09"), 15.0)], "ticker string, date date, close double")
    bench = spark.createDataFrame([(d("2020-01-02"), 100.0), (d("2020-01-09"), 110.0)], "date date, close double")
    pos = spark.createDataFrame([(1, "x", d("2020-01-01"), "a"), (2, "x", d("2020-02-01"), "a"), (3, "x", d("2020-01-09"), "b")], "id int, ticker string, opened date, leg string")
    v = {r.id: r for r in portfolio.value_positions(pos, bars, bench, "ticker", "opened", "2020-01-10").collect()}
    assert round(v[1].ret, 9) == 0.5 and round(v[1].alpha, 9) == 0.4 and v[1].days == 7
    assert v[2].ret is None and v[2].pnl is None  # pending
    assert v[3].ret == 0.0 and v[3].days == 0  # flat
    s = {r.leg: r for r in portfolio.summary(portfolio.value_positions(pos, bars, bench, "ticker", "opened", "2020-01-10"), ["leg"]).collect()}
    assert (s["a"].n, s["a"].n_open, s["a"].cost, s["a"].value, s["a"].worst) == (2, 1, 1000.0, 1500.0, None)
    assert portfolio.summary(portfolio.value_positions(pos, bars, bench, "ticker", "opened", "2020-01-10").where("id = 2"), []).first().cost == 0.0


def test_clusters(spark):
    rows = [(1, "a", d("2020-01-10"), 10.0, 100.0), (1, "a", d("2020-01-11"), 10.0, 100.0), (1, "b", d("2019-01-01"), 1.0, 1.0), (2, "a", d("2020-01-10"), 1.0, 1.0), (2, "b", d("2020-01-10"), 1.0, None), (2, "c", d("2020-01-10"), 1.0, 1.0), (3, "a", d("2020-01-10"), 300.0, 100.0)]
    got = {r.issuer: r for r in E.insider_clusters(spark.createDataFrame(rows, "issuer int, owner string, date date, shares double, price double"), "issuer", F.col("owner"), "date", "shares", "price", "2020-01-12").collect()}
    assert got[1].n_buyers == 1 and got[1].severity is None  # one buyer twice is one buyer
    assert got[2].severity == "critical" and got[2].value == 2.0 and got[2].shares == 3.0
    assert got[3].severity == "medium"


def test_forms_and_items(spark):
    f = spark.createDataFrame([(i, x) for i, x in enumerate(["S-1", "s-1/a", "SC 13G", "SC 13G/A", "S-11", "SC 13D/A"])], "i int, form string")
    assert sorted((r.i, r.key) for r in E.form_signals(f, E.form_table(spark), "form").collect()) == [(0, "S-1"), (1, "S-1"), (2, "SC 13G"), (5, "SC 13D")]
    assert {r.form for r in f.where(E.is_periodic("form")).collect()} == set()
    i = spark.createDataFrame([("1.01", "medium", "micro"), ("1.01", "medium", "mid-plus"), ("4.02", "critical", "nano"), ("2.03", "critical", "nano")], "item string, severity string, tier string")
    assert [(r.resolved, r.direction) for r in E.item_severity(i, "item", "severity", "tier").collect()] == [("high", "ambiguous"), ("medium", "ambiguous"), ("critical", "bearish"), ("critical", "bearish")]


def test_surface_twice(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"), "key string, n int", ["key"], buckets=4)
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    assert sorted(map(tuple, t.insert_absent(batch, [F.col("n")]).collect())) == [("a", 1), ("b", 3)]
    assert t.insert_absent(batch, [F.col("n")]).count() == 0
    t.upsert(spark.createDataFrame([("b", 9), ("c", 4)], "key string, n int"), [F.col("n")])
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 9), ("c", 4)]
    t.upsert_keep_old(spark.createDataFrame([("a", None), ("d", 5)], "key string, n int"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 9), ("c", 4), ("d", 5)]
    t.replace(spark.createDataFrame([("a", 7), ("a", 8)], "key string, n int"))
    assert sorted(map(tuple, t.read().where("key = 'a'").collect())) == [("a", 7), ("a", 8)]


def test_store_of_tables(spark, tmp_path):
    tables = {"parents": ("k string, v int", ["k"]), "children": ("k string, c string", ["k"])}
    store = sinks.Store(spark, str(tmp_path / "s"), tables, buckets=3)
    make = lambda t, *rows: spark.createDataFrame(list(rows), tables[t][0])
    t = store.transaction()
    t.upsert("parents", make("parents", ("a", 1), ("b", 2)), [F.col("v")])
    t.replace("children", make("children", ("a", "x"), ("a", "y"), ("b", "z")))
    assert store.read("parents").count() == store.read("children").count() == 0  # nothing before commit
    t.commit()
    one, two = store.transaction(), store.transaction()
    one.replace("children", make("children", ("a", "w")))
    two.upsert("parents", make("parents", ("c", 3)), [F.col("v")])
    one.commit()
    with pytest.raises(sinks.Conflict):
        two.commit()
    assert sorted(map(tuple, store.read("children").collect())) == [("a", "w"), ("b", "z")]
    assert sorted(map(tuple, store.read("parents").collect())) == [("a", 1), ("b", 2)]
    for i in range(3):
        t = store.transaction()
        t.upsert("parents", make("parents", ("a", i)), [F.col("v")])
        t.commit()
    n = len(store.files.names("data-"))
    store.vacuum(1)
    assert len(store.files.names("data-")) < n and sorted(map(tuple, store.read("parents").collect())) == [("a", 2), ("b", 2)]
    with pytest.raises(ValueError):
        store.transaction().replace("children", make("children", ("a", "w")), ["c"])


def test_run_lock(spark, tmp_path):
    now = [0.0]
    a, b = (sinks.RunLock(spark, str(tmp_path / "lock"), 60, lambda: now[0]) for _ in "ab")
    assert a.acquire("a") and not b.acquire("b")
    a.release()
    assert b.acquire("b") and not a.acquire("a")
    now[0] = 61
    assert a.acquire("a")  # b's lease has run out


def test_state(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    prior = spark.createDataFrame([(1, "red"), (2, "amber")], "k int, status string")
    now = spark.createDataFrame([(2, "green")], "k int, status string")
    s = state.sticky(items, prior, now, ["k"], "status")
    assert sorted(map(tuple, s.collect())) == [(1, "red", "red"), (2, "amber", "green"), (3, "green", "green")]
    assert [r.k for r in state.flips(s, "status").collect()] == [2]
    seen, new, failed = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in ("ab", "bcd", "d"))
    assert {r.key for r in state.advance(seen, new, failed, "key").collect()} == set("abc")


def test_votes(spark):
    v = spark.createDataFrame([(1, 1, "weakens", 0.25, "high"), (1, 2, "weakens", 0.75, "high"), (1, 3, "neutral", 0.1, "low"), (2, 1, "weakens", 0.5, "high"), (2, 2, "neutral", 0.2, "high"), (2, 3, "strengthens", 0.9, "high")], "k int, i int, vote string, size double, conf string")
    got = {r.k: r for r in scores.majority(v, ["k"], "vote", "size", "conf", "i").collect()}
    assert (got[1].vote, got[1].n_agree, round(got[1].magnitude, 9), got[1].confidence, got[1].representative) == ("weakens", 2, 0.5, "high", 1)
    assert (got[2].vote, got[2].confidence) == ("neutral", "low")  # a tie


def test_triage(spark):
    f = spark.createDataFrame([(1, "item", "x", "critical", 0.0), (2, "flag", "going-concern", "high", 1.0), (3, "flag", "margin", "low", 2.0), (4, "flag", "going-concern", "high", 1.0), (4, "chunks", "x", "low", 0.5), (5, "trend", "margin", "high", 0.0), (5, "flag", "auditor", "high", 1.0), (5, "flag", "reserves", "high", 1.0), (5, "chunks", "x", "low", 0.5)], "k int, source string, category string, severity string, n double")
    got = {r.k: r for r in scores.triage(f, ["k"]).collect()}
    assert got[1].escalate and got[1].score == 100.0
    assert got[2].escalate and got[2].score == 20.0
    assert not got[3].escalate and got[3].score == 1.5
    assert got[4].hold and not got[4].escalate
    assert got[5].escalate and got[5].score == 8 + 20 + 16 + 6  # three categories


def test_universe(spark):
    assert universe.parse_ranges("7372, 3674-3679,x") == [(7372, 7372), (3674, 3679)]
    df = spark.createDataFrame([("A", "EQUITY", 1e8, 5.0, 2e6, False), ("B", "ETF", 1e8, 5.0, 2e6, False), ("C", None, 1e8, 5.0, 2e6, None), ("D", "ETF", 1.0, 0.1, None, True), ("E", "EQUITY", None, 5.0, 2e6, False)], "t string, kind string, cap double, price double, vol double, pin boolean")
    assert [r.t for r in universe.screen(df, "kind", "cap", "price", "vol", "pin").collect()] == ["A", "C", "D"]
    names = spark.createDataFrame([("ABC", "x"), ("XAB", "y"), ("AB", None), ("AB", "z")], "t string, n string")
    assert [r.ticker for r in universe.suggest(names, "t", "n", F.lit(False), " ab ").collect()] == ["AB", "ABC", "XAB"]


def test_index_and_calendar(spark):
    lines = ["CIK|Company|Form|Date|File", "123|ACME|10-K|20240105|edgar/data/123/0000123456-24-000001.txt", "45|B|4|2024-01-08|edgar/data/45/0000123456-24-000002.txt", "9|bad|4|soon|x", "77|C|8-K|20240101|edgar/data/77/0000123456-24-000003.txt"]
    i = filings.master_index(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.cik, r.form, str(r.filing_date)) for r in i.orderBy("accession").collect()] == [("0000000123", "10-K", "2024-01-05"), ("0000000045", "4", "2024-01-08"), ("0000000077", "8-K", "2024-01-01")]
    days = filings.business_days(spark, "2024-01-01", "2024-01-15")
    assert days.count() == 9  # the first and the fifteenth are holidays
    ciks = spark.createDataFrame([("0000000123",), ("0000000077",)], "cik string")
    assert [r.cik for r in filings.sweep(i, days, ciks, ["10-K", "8-K"]).collect()] == ["0000000123"]
    y = {r.name: str(r.date) for r in filings.holidays(spark, 2021, 2021).collect()}
    assert y["Juneteenth"] == "2021-06-18" and y["Independence"] == "2021-07-05" and y["Christmas"] == "2021-12-24" and y["Memorial"] == "2021-05-31" and y["Thanksgiving"] == "2021-11-25"


def test_facts_json(spark, tmp_path):
    one = {"start": "2020-01-01", "end": "2020-03-31", "val": 5.0, "accn": "a", "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}
    (tmp_path / "c.json").write_text(json.dumps({"cik": 7, "entityName": "n", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [one]}}}}}))
    r = filings.company_facts(spark, str(tmp_path / "c.json")).first()
    assert (r.cik, r.tag, r.unit, r.val, r.end) == (7, "Revenues", "USD", 5.0, d("2020-03-31"))


FORM4 = """<ownershipDocument><issuer><issuerTradingSymbol>acme</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>99</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer><isDirector>0</isDirector><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"""
TRADE = "<nonDerivativeTransaction><transactionDate><value>2020-01-0{n}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{ad}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"


def test_form4(spark):
    trades = [("P", 100, 5, "A"), ("S", 100, 5, "D"), ("P", 50, 0, "A"), ("P", 0, 5, "A"), ("P", 10, 5, "D")]
    xml = FORM4.format("".join(TRADE.format(n=i + 1, code=c, shares=s, price=p, ad=a) for i, (c, s, p, a) in enumerate(trades)))
    df = spark.createDataFrame([("12", "acc", d("2020-01-09"), xml)], "cik string, accession string, filing_date date, xml string")
    got = sorted((r.key, r.ticker, r.value, r.is_officer, r.cik) for r in filings.form4_purchases(df).collect())
    assert got == [("acc:99:2020-01-01:100", "ACME", 500.0, True, "0000000012"), ("acc:99:2020-01-03:50", "ACME", None, True, "0000000012")]


def test_form4_without_a_purchase_is_not_parsed(spark):
    """Only codes that surely are not P pass unparsed; P in odd writing is found still."""
    code = lambda x: FORM4.format(TRADE.format(n=1, code="__", shares=7, price=5, ad="A").replace("<transactionCode>__</transactionCode>", x))
    bought = ["P", "p", " P ", "\nP\r\n", "&#80;", "&#x50;", "<![CDATA[P]]>", "<![CDATA[]]>P<![CDATA[]]>", "P<!-- S -->", "<!-- S -->P", "P<?a S?>", "P&#32;"]
    bought = [code(f"<transactionCode>{x}</transactionCode>") for x in bought] + [code(x) for x in ("<TRANSACTIONCODE>P</TRANSACTIONCODE>", "<transactionCode a='b' >P</transactionCode >", "<transactionCode>S</transactionCode><transactionCode>P</transactionCode>")]
    sold = [code(f"<transactionCode>{x}</transactionCode>") for x in ("S", "a", "9", "PS", "<!-- P -->S")] + [code("<transactionCode/>"), code("")]
    df = spark.createDataFrame([(str(i), "acc", d("2020-01-09"), x) for i, x in enumerate(bought + sold)], "cik string, accession string, filing_date date, xml string")
    assert sorted(int(r.cik) for r in filings.form4_purchases(df).collect()) == list(range(len(bought)))
    parsed = df.where(filings.may_purchase(F.col("xml"))).collect()
    assert sorted(int(r.cik) for r in parsed) == list(range(len(bought)))


def test_lists_and_feeds(spark):
    df = spark.createDataFrame([("x", ["10-K", "8-K", "10-K/A"], ["2020-01-01", "2020-02-01", "2020-03-01"])], "t string, form array<string>, date array<string>")
    assert [r.date for r in filings.list_filings(df, ["t"], ["form", "date"], ["10-K"], "form", "date").orderBy("rn").collect()] == ["2020-03-01", "2020-01-01"]
    one = spark.range(1).select(
        market.scraped_index(F.lit("<b>DXI</b> <i>41,234.5</i>"), "DXI").alias("i"),
        market.capture_times(F.lit('[["urlkey","timestamp"],["x","20240101120000"],["x","bad"]]')).alias("c"),
        market.video_id(F.lit("https://www.youtube.com/watch?v=abcdefghijk&t=1")).alias("v"),
        market.caption_cues(F.lit('{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"hi "},{"utf8":"you"}]},{"tStartMs":2000}]}')).alias("q"),
        market.chapters(F.lit("intro\n0:00 Start\n0:59 middle\n1:02:03 - End")).alias("ch"),
        market.chapters(F.lit("0:00 Start\n1:02:03 - End")).alias("few"),
        market.chapters(F.lit("0:00 Start\n1:02:03 - Later\n0:10 End")).alias("unordered"),
        market.timed_text(F.lit('<x><text start="0.4" dur="1.2" a="b">a &amp;amp; b\n c</text><text start="3" dur="1"> </text></x>')).alias("tt"),
    ).first()
    assert one.i == 41234.5 and one.c == ["20240101120000"] and one.v == "abcdefghijk"
    assert [tuple(x) for x in one.q] == [(1.0, 2.0, "hi you")] and [tuple(x) for x in one.ch] == [(0, "Start"), (59, "middle"), (3723, "End")]
    assert one.few == [] and one.unordered == [] and [tuple(x) for x in one.tt] == [(0.0, 2.0, "a &amp; b c")]
