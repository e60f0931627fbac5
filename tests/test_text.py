"""Documents on small inputs: layout, sections, boilerplate, chunks, quotes, search, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillstone.functions.expr import token_estimate
from quillstone.functions.hooks import call, stub
from quillstone.operators import retrieval as R
from quillstone.streaming import events as ST
from quillstone.text import boilerplate, chunks, layout, quotes, recurrence, sections, snippets, tokens, transcripts


def test_tokens(spark):
    texts = ["", "hello world", "a1b2\n", "été — 12,5 %", "x" * 100, "\t\t  "]
    df = spark.createDataFrame(enumerate(texts), "i int, t string")
    assert [r.n for r in df.orderBy("i").select(token_estimate("t").alias("n")).collect()] == [tokens.estimate(t) for t in texts]
    long = "word " * 500
    assert tokens.estimate(tokens.head(long, 50)) <= 50 and tokens.estimate(tokens.tail(long, 50)) <= 50
    assert tokens.head("short", 50) == "short"


HTML = """<html><head><title>no</title></head><body><h2>Item 1. Business</h2><p>We make <b>things</b>.</p><script>no()</script>
<table><tr><td colspan=3>(in millions)</td></tr><tr><td></td><td>2020</td><td>2019</td></tr><tr><td>Revenue</td><td>$</td><td>10</td><td>$</td><td>9</td></tr><tr><td>Loss</td><td>(</td><td>1</td><td>)</td><td>2</td></tr></table>
<p><span style="font-weight:700">Bold line</span></p></body></html>"""


def test_layout():
    b = layout.layout(HTML)
    assert [(x["kind"], x["text"][:12]) for x in b] == [("heading", "Item 1. Busi"), ("para", "We make thin"), ("table", "2020 2019 Re"), ("heading", "Bold line")]
    md = b[2]["markdown"].split("\n")
    assert md[0] == "(in millions)" and md[1] == "|  | 2020 | 2019 |" and md[3] == "| Revenue | $10 | $9 |" and md[4] == "| Loss | (1) | 2 |"
    assert layout.layout(None) == [] and layout.layout("plain") == [{"kind": "para", "text": "plain", "rows": None, "markdown": "plain"}]


def test_sections(spark):
    body = "".join(f"<h2>{t}</h2><p>{w * 80}</p>" for t, w in (("Item 1. Business", "we sell "), ("Item 1A. Risk Factors", "risk "), ("Item 7. MD&A", "went up ")))
    toc = "<table><tr><td><a>Item 1. Business 3</a></td></tr></table>"
    df = spark.createDataFrame([(1, f"<html><body>{toc}{body}</body></html>"), (2, "<p>nothing</p>"), (3, None)], "k int, html string")
    got = {r.section: r.text for r in sections.sections(df, "k", "html").collect()}
    assert set(got) == {"business", "risk-factors", "mda"} and "we sell" in got["business"] and "risk" not in got["business"].lower().replace("risk factors", "")
    blocks = spark.createDataFrame([(1, 0, "para", "Item 4.02 Non-Reliance", "Item 4.02 Non-Reliance"), (1, 1, "para", "text", "text"), (1, 2, "para", "Item 6.66 Odd", "x")], "k int, ordinal int, kind string, text string, markdown string")
    assert sorted((r.number, r.severity, r.body) for r in sections.eightk_items(blocks, "k").collect()) == [("4.02", "critical", "text"), ("6.66", "low", "")]
    assert sections.locate("alpha beta " * 20, ["x", "alpha beta " * 10, "alpha beta " * 10, "y"]) == (1, 2) and sections.locate("short", ["short"]) is None


def test_sections_are_cut_where_they_are_read(spark):
    long = "long words " * 30
    body = "".join(f"<h2>{t}</h2><p>{w}</p>" for t, w in (("Item 1. Business", long), ("Item 1A. Risk Factors", "see elsewhere"), ("Item 2. Properties", "none"), ("Item 3. Legal", long), ("Item 7. MD&amp;A", "incorporated")))
    rows = [(1, body), (1, body), (None, "<h2>Item 3. Claims</h2>" + "<p>\U0001f600 one</p>" * 90), (4, "<a>Item 7. Linked 12</a>"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "k int, html string")
    out = sections.sections(df.withColumn("section", F.lit("clash")), "k", "html")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    got = out.collect()
    first = [r for r in got if r.k == 1]
    assert len(first) == 10  # each row is a filing of its own
    assert {(r.section, r.bundled_from) for r in first} == {("business", None), ("risk-factors", "legal-proceedings"), ("properties", "legal-proceedings"), ("legal-proceedings", None), ("mda", "legal-proceedings")}
    assert all(r.text.startswith("Item 3. Legal") for r in first if r.section == "mda")
    (other,) = [r for r in got if r.k is None]
    assert other.section == "legal-proceedings" and other.text.count("\U0001f600") == 90
    assert not [r for r in got if r.k in (4, 5, 6)]  # a link with a page number is a table of contents


def test_boilerplate(spark):
    rows = ["Table of Contents", "See accompanying notes", "Page 3", "These forward-looking statements: actual results may differ materially", "forward-looking statements; actual results could differ materially given a covenant", "Real news", "/s/ Jane"]
    df = spark.createDataFrame([(i, t, "para") for i, t in enumerate(rows)] + [(9, "Page 3", "table")], "i int, text string, kind string")
    m = {r.i: (r.rule, r.stripped) for r in boilerplate.mark(df).collect()}
    assert m[0] == ("page-furniture", True) and m[1] == ("notes-legend", True) and m[3] == ("safe-harbor", True)
    assert m[4] == ("safe-harbor", False) and m[5] == (None, False) and m[6] == ("signature-block", True) and m[9] == (None, False)


def test_chunks(spark):
    parts = [("heading", "## A"), *[("para", "word " * 60)] * 6, ("heading", "## B"), ("para", "end")]
    out = chunks.pack(parts, most=150, least=60, repeated=10)
    assert all(c["tokens"] <= 150 + 40 for c in out) and out[1]["text"].startswith(chunks.OVERLAP) and sum(c["n_blocks"] for c in out) == len(parts)
    table = "cap\n| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | {i} |" for i in range(60))
    pieces = chunks.split_table(table, 100)
    assert len(pieces) > 1 and all("| a | b |" in p for p in pieces) and sum(p.count("| row") for p in pieces) == 60
    assert chunks.water_fill([10, 100, 100], 110) == [10, 50, 50] and chunks.water_fill([], 5) == [] and chunks.water_fill([3, 4], 100) == [3, 4]
    assert chunks.fit([(5, 60), (1, 50), (2, 40)], 100) == [2, 5]
    assert len(chunks.trim({"s": ["x" * 36] * 10, "m": ["y" * 36] * 10}, {"s": 2, "m": 8}, 100)["s"]) == 2
    df = spark.createDataFrame([(1, out[1]["text"]), (2, "plain")], "i int, text string")
    assert [r.b[:4] for r in df.select(chunks.body_only("text").alias("b"), "i").orderBy("i").collect()] == ["word", "plai"]


def test_quotes(spark):
    text = "Sales  rose “sharply” — by 10 % | in the $ quarter."
    cases = {"rose “sharply”": "exact", "Sales rose": "whitespace-normalized", "sales  ROSE": "case-insensitive", 'sales rose "sharply" - by': "punctuation-normalized", "10%inthequarter": "table-normalized", "fell": "no-match"}
    df = spark.createDataFrame([(text, q, t) for q, t in cases.items()], "text string, q string, want string")
    assert all(r.got == r.want for r in df.select("want", quotes.tier(F.col("text"), F.col("q")).alias("got")).collect())
    assert [r.ok for r in df.select(quotes.verified(F.col("text"), F.col("q")).alias("ok")).collect()] == [True, False, False, True, False, False]


def test_recurrence(spark):
    say = "weather delays hurt shipments across northern regions"
    p = spark.createDataFrame([("x", i, i, t) for i, t in enumerate([say, say + " again", "nothing alike", say])], "source string, filing int, ord int, text string")
    got = {r.claim_id: r.n_prior for r in recurrence.repeated(p.withColumn("claim_id", F.col("filing")), p, "source").collect()}
    assert got == {3: 2}
    f = spark.createDataFrame([("x", i, i, "A Restructuring Charge") for i in range(5)], "source string, filing int, ord int, text string")
    assert sorted((r.filing, r.severity) for r in recurrence.one_time(f, "source").collect()) == [(2, "medium"), (3, "medium"), (4, "high")]


def test_snippets():
    lines = [f"line {i} filler" for i in range(30)] + ["Revenue rose 12.5% on volume"] + ["tail"] * 5
    s, above = snippets.snippet("\n".join(lines), "revenue 12.5%", 60)
    assert "12.5%" in s and not above and tokens.estimate(s) <= 60
    t = "Sales\n| q | v |\n| --- | --- |\n" + "\n".join(f"| r{i} | {i} |" for i in range(100))
    s, above = snippets.snippet(t, "r77", 60)
    assert above and "| q | v |" in s and "r77" in s
    assert snippets.summary("Acme Corp. makes things. It sells them. More.") == "Acme Corp. makes things. It sells them."
    assert snippets.summary(" ") is None and snippets.summary("x" * 400).endswith("…") and len(snippets.summary("x" * 400)) == 300


def test_search(spark):
    docs = spark.createDataFrame([(1, "net debt rose"), (2, "net sales fell"), (3, "unrelated words here"), (4, "debt debt debt")], "d int, t string")
    q = spark.createDataFrame([(1, "debt AND near")], "q int, w string").select("q", R.query_terms(F.col("w")).alias("terms"))
    assert q.first().terms == ["debt"]
    hits = R.bm25(docs, q, "d", "t", "q", "terms").orderBy("rank").collect()
    assert [r.d for r in hits] == [4, 1]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "d int, e array<float>")
    near = R.knn(vec, spark.createDataFrame([(1, [1.0, 0.0])], "q int, v array<float>"), "d", "e", "q", "v")
    assert [(r.d, r.score) for r in near.orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    both = R.fuse({"a": hits_of(spark, [1, 2]), "b": hits_of(spark, [2, 3])}, "q", "d").orderBy("rank").collect()
    assert both[0].d == 2 and both[0].matched_by == "a,b"
    assert R.find_quote(docs, "d", "t", "net debt rose").count() == 1 and R.find_quote(docs, "d", "t", "net debt").count() == 0


def hits_of(spark, order):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(order)], "q int, d int, rank int")


def test_transcripts(spark):
    cues = spark.createDataFrame([("v", 0.0, 4.0, "a"), ("v", 4.0, 8.0, "b"), ("v", 8.0, 12.0, "c")], "v string, s double, e double, t string")
    assert [(r.s, r.e, r.t) for r in transcripts.merge_cues(cues, ["v"], "s", "e", "t").orderBy("s").collect()] == [(0.0, 8.0, "a b"), (8.0, 12.0, "c")]
    assert [r.c for r in spark.createDataFrame([(65.0,), (3661.0,)], "x double").select(transcripts.clock(F.col("x")).alias("c")).collect()] == ["1:05", "1:01:01"]


def test_hook(spark):
    def model(text):
        if "bad" in text:
            raise ValueError("no")
        return stub(text)

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "x " * 20000)], "i int, p string")
    got = {r.i: (r.response is not None, r.error) for r in call(df, "p", model, ["i"], 4000).collect()}
    assert got[1] == (True, None) and got[2] == (False, "ValueError: no") and got[3][1] is not None


def test_stream_state(spark, tmp_path):
    rows = [(k, s, dt.datetime(2024, 1, 1, 0, i)) for i, (k, s) in enumerate([(1, "red"), (1, "red"), (2, "green"), (1, "green"), (2, "amber")])]
    spark.createDataFrame(rows, "k int, s string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ST.sticky_status(ST.read(spark, str(tmp_path / "in"), "k int, s string, at timestamp"), "k", "s", "at")
    got = ST.run_to_memory(out, "sticky", str(tmp_path / "cp"))
    assert sorted((r.key, r.from_status, r.to_status) for r in got.collect()) == [(1, "green", "red"), (1, "red", "green"), (2, "green", "amber")]


def test_tiers_of_every_pair(spark):
    """The same tiers as pair by pair, with each text's weakest reading made once."""
    texts = ["Sales  rose “sharply” — by 10 % | in the $ quarter.", "sales ROSE", "", None, "s a l e s", "ΟΔΟΣ sales", " Sales rose x|y", "a$b c"]
    quotes_ = ["Sales", "sales", "SALES", "Sales rose", "rose “sharply”", 'ROSE "sharply" -', "", "ab", "xy", "ΟΔΟΣ", "οδος", " rose ", "inthe", "sales\n"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    q = spark.createDataFrame(list(enumerate(quotes_)), "k int, q string")
    got = quotes.tiers(t, q, "text", "q")
    want = t.crossJoin(q).select("i", "k", quotes.tier(F.col("text"), F.col("q")).alias("tier"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(texts) * len(quotes_)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__weak" in plan[plan.index("Join") :] and "collect_list" in plan  # one row of all quotes meets a text
