"""Queries on filings' texts: sections, items, boilerplate, quotes, briefs, budgets, contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dims import SEVERITY_RANK
from ..functions.expr import rank_of
from ..operators import views as V
from ..text import boilerplate, briefs, chunks, layout, quotes, sections, snippets, tokens, transcripts
from .base import query, table

_LINES = "lines AS (SELECT doc_id, source, CAST(ord - 1 AS INTEGER) AS ord, line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS ord))"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


# --- layout and sections

_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '[<>&]', '', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g'))"


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, ord, {_PLAIN.format('line')} AS t FROM lines), k AS (SELECT *, ord % 4 AS how FROM p WHERE t <> '')
SELECT doc_id, how, CASE WHEN length(t) <= 200 AND (how IN (0, 1) OR (length(t) >= 4 AND t = upper(t) AND regexp_matches(t, '[A-Z]'))) THEN 'heading' ELSE 'para' END AS kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM k GROUP BY ALL""")
def q_heading_test(spark, d):
    text = F.regexp_replace(F.regexp_replace(F.col("line"), "[<>&]", ""), r"\s+", " ")
    how = F.col("ord") % 4
    tag = F.when(how == 0, F.concat(F.lit("<h2>"), text, F.lit("</h2>"))).when(how == 1, F.concat(F.lit("<p><b>"), text, F.lit("</b></p>"))).when(how == 2, F.concat(F.lit("<div><b>x</b></div><p>"), text, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    x = _lines(spark, d).select(F.struct("doc_id", how.alias("how")).alias("k"), tag.alias("html")).select(F.concat_ws(":", F.col("k.doc_id").cast("string"), F.col("k.how").cast("string")).alias("k"), "html")
    b = layout.blocks(x, ["k"], "html").where("text <> 'x' or kind <> 'heading'")
    k = F.split("k", ":")
    return b.groupBy(k[0].cast("bigint").alias("doc_id"), k[1].cast("int").alias("how"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH g AS (SELECT c_custkey, count(*) AS n, list({y: CAST(o_orderdate AS DATE), k: o_orderkey, p: o_totalprice} ORDER BY o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, '|  | Order | Day Price |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| o' || x.k || ' | $' || CAST(CAST(round(x.p) AS BIGINT) AS VARCHAR) || ' | ' || strftime(x.y, '%Y%m%d') || '% |'), chr(10)) AS markdown FROM g""")
def q_table_markdown(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.round("o_totalprice").cast("bigint").cast("string"))
    row = F.concat(F.lit("<tr><td>o"), F.col("o_orderkey").cast("string"), F.lit("</td><td>$</td><td>"), F.col("price"), F.lit("</td><td></td><td>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("</td><td>%</td></tr>"))
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("r"))
    html = F.concat(F.lit("<table><tr><th>Order</th><th>Day</th><th></th></tr><tr><td></td><td>Price</td></tr>"), F.array_join(F.transform("r", lambda x: x["row"]), ""), F.lit("</table>"))
    return layout.blocks(g.select("c_custkey", html.alias("html")), ["c_custkey"], "html").select("c_custkey", "markdown")


_ITEMED = """parts AS (SELECT doc_id, list_transform([coalesce(l[1], ''), coalesce(l[2], ''), coalesce(array_to_string(l[3:], chr(10)), '')], lambda x: regexp_replace(x, '[<>&]', '', 'g')) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b AS (SELECT doc_id, 'Item 1. Business' AS t1, p[1] AS b1, 'Item 1A. Risk Factors' AS t2, p[2] AS b2, 'Item 7. Discussion' AS t3, p[3] AS b3 FROM parts),
s AS (SELECT doc_id, 'business' AS section, 1 AS at, trim(t1 || b1, ' ') AS text FROM b UNION ALL SELECT doc_id, 'risk-factors', 2, trim(t2 || b2, ' ') FROM b UNION ALL SELECT doc_id, 'mda', 3, trim(t3 || b3, ' ') FROM b)"""


@query(f"""WITH {_ITEMED}, f AS (SELECT *, length(text) >= 200 AS whole FROM s),
o AS (SELECT a.doc_id, a.section, a.text, a.whole, (SELECT {{t: b.text, s: b.section}} FROM f b WHERE b.doc_id = a.doc_id AND b.whole AND b.at <> a.at ORDER BY b.at < a.at, CASE WHEN b.at > a.at THEN b.at ELSE -b.at END LIMIT 1) AS other FROM f a)
SELECT doc_id, section, CASE WHEN NOT whole AND other IS NOT NULL THEN other.t ELSE text END AS text, CASE WHEN NOT whole THEN other.s END AS bundled_from FROM o""")
def q_sections(spark, d):
    """Each whole text under three items: its first line, its second, and all the others."""
    lines = F.split("text", "\n")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[<>&]", "")
    line = lambda i: plain(F.try_element_at(lines, F.lit(i)))
    rest = plain(F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    title = lambda t: F.lit(f"<h2><b>{t}</b></h2>")
    contents = F.lit("<table><tr><td><a href='#a'>Item 1. Business 3</a></td></tr><tr><td><a href='#b'>Item 1A. Risk Factors 9</a></td></tr></table>")
    html = F.concat(F.lit("<html><body>"), contents, title("Item 1. Business"), F.lit("<p>"), line(1), F.lit("</p>"), title("Item 1A. Risk Factors"), F.lit("<p>"), line(2), F.lit("</p>"), title("Item 7. Discussion"), F.lit("<p>"), rest, F.lit("</p></body></html>"))
    f = table(spark, d, "documents").select("doc_id", html.alias("html"))
    return sections.sections(f, "doc_id", "html").select("doc_id", "section", "text", "bundled_from")


_EIGHT = "['4.02', '8.01', '5.02', '9.99']"


@query(f"""WITH {_LINES}, x AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 1 THEN 'ITEM ' || {_EIGHT}[1 + ord % 4] || ' Title' ELSE line END AS line, ord % 3 = 1 AS starts FROM lines), g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM x)
SELECT doc_id, CAST(part AS BIGINT) AS part, max(CASE WHEN starts THEN {_EIGHT}[1 + ord % 4] END) AS number, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY ord) FILTER (NOT starts), '') AS body, CASE max(CASE WHEN starts THEN {_EIGHT}[1 + ord % 4] END) WHEN '4.02' THEN 'critical' WHEN '5.02' THEN 'high' ELSE 'low' END AS severity, max(CASE WHEN starts THEN {_EIGHT}[1 + ord % 4] END) <> '9.99' AS known FROM g WHERE part > 0 GROUP BY 1, 2""")
def q_eightk_items(spark, d):
    return _items(spark, d).select("doc_id", "part", "number", "body", "severity", "known")


def _items(spark, d):
    starts = F.col("ord") % 3 == 1
    number = F.element_at(F.array(*map(F.lit, ("4.02", "8.01", "5.02", "9.99"))), (F.col("ord") % 4 + 1).cast("int"))
    # a line that could pass for an item's title is a table here: such a block opens none
    text = F.when(starts, F.concat(F.lit("ITEM "), number, F.lit(" Title"))).otherwise(F.col("line"))
    b = _lines(spark, d).select("doc_id", F.col("ord").alias("ordinal"), F.when(starts, "para").otherwise("table").alias("kind"), text.alias("text"), text.alias("markdown"))
    return sections.eightk_items(b, "doc_id")


@query(f"""WITH {_LINES}, x AS (SELECT doc_id, CASE {_EIGHT}[1 + ord % 4] WHEN '4.02' THEN 3 WHEN '5.02' THEN 2 ELSE 0 END AS rank FROM lines WHERE ord % 3 = 1) SELECT doc_id, ['low', 'medium', 'high', 'critical'][1 + max(rank)] AS severity FROM x GROUP BY 1""")
def q_max_severity(spark, d):
    return V.max_severity(_items(spark, d), ["doc_id"], "severity")


@query("""WITH s AS (SELECT doc_id, length(text) AS n, CASE lang WHEN 'en' THEN 2000 ELSE 900 END AS floor FROM documents) SELECT doc_id, CASE WHEN n < floor * 0.3 THEN 'failed' WHEN n < floor THEN 'low' ELSE 'high' END AS confidence FROM s""")
def q_length_confidence(spark, d):
    floor = F.when(F.col("lang") == "en", 2000).otherwise(900)
    return table(spark, d, "documents").select("doc_id", sections.length_confidence(F.length("text"), floor).alias("confidence"))


_SQUASH = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH {_LINES}, q AS (SELECT doc_id, list({_SQUASH.format('line')} ORDER BY ord) AS b FROM lines GROUP BY 1), x AS (SELECT doc_id, b, array_to_string(b[2:len(b) - 1], '') AS text, array_to_string(b, '') AS joined, list_transform(range(1, len(b) + 1), lambda i: length(array_to_string(b[1:i], ''))) AS ends FROM q),
y AS (SELECT *, strpos(joined, left(text, 200)) - 1 AS start FROM x WHERE length(text) >= 40), z AS (SELECT *, strpos(substr(joined, start + 1), right(text, 200)) AS tail FROM y)
SELECT doc_id, CAST(len(list_filter(ends, lambda e: e <= start)) AS INTEGER) AS first, CAST(len(list_filter(ends, lambda e: e < CASE WHEN tail = 0 THEN length(joined) ELSE start + tail - 1 + least(200, length(text)) END)) AS INTEGER) AS last FROM z""")
def q_locate_section(spark, d):
    g = _lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x")).select("doc_id", F.col("x.line").alias("blocks"))
    text = F.array_join(F.slice("blocks", 2, F.greatest(F.size("blocks") - 2, F.lit(0))), "  \n ")  # all but the first line and the last
    return sections.located(g.withColumn("text", text), ["doc_id"], "text", "blocks").select("doc_id", "first", "last")


# --- boilerplate: all rules, on sentences made to meet each of them

_MADE = (
    ("safe-harbor", "These forward-looking statements: actual results may differ materially. "),
    ("notes-legend", "See accompanying notes "),
    ("audit-scope", "We conducted our audits in accordance with the standards of the PCAOB "),
    ("icfr-recital", "Internal control over financial reporting is a process designed to provide reasonable assurance "),
    ("page-furniture", "Table of Contents"),
    ("signature-block", "/s/ "),
    ("exhibit-index", "Exhibit Index "),
    ("xbrl-artifact", "us-gaap:"),
)
_MADE_SQL = "CASE ord % 10 " + " ".join(f"WHEN {i} THEN '{p}'" + ("" if n == "page-furniture" else " || line") for i, (n, p) in enumerate(_MADE)) + " ELSE 'Net: ' || line END"
_GUARD = "CASE WHEN ord % 20 >= 10 AND ord % 10 <> 4 THEN ' and a material weakness' ELSE '' END"


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, ord, ({_MADE_SQL}) || {_GUARD} AS text, ord % 7 = 6 AS is_table, CASE WHEN ord % 10 < 8 THEN [{', '.join(f"'{n}'" for n, _ in _MADE)}][1 + ord % 10] END AS rule, ord % 20 >= 10 AND ord % 10 <> 4 AS guarded FROM lines WHERE NOT regexp_matches(line, '(?i)(default|impairment|covenant|dismissed|resigned|restat)'))
SELECT doc_id, rule, count(*) AS blocks_removed, CAST(sum(length(text)) AS BIGINT) AS chars_removed FROM m WHERE rule IS NOT NULL AND NOT guarded AND NOT is_table GROUP BY 1, 2""")
def q_strip_all_rules(spark, d):
    x = _lines(spark, d).where(~F.col("line").rlike("(?i)(default|impairment|covenant|dismissed|resigned|restat)"))
    text = F.concat(F.expr(_MADE_SQL), F.expr(_GUARD))
    b = x.select("doc_id", text.alias("text"), F.when(F.col("ord") % 7 == 6, "table").otherwise("para").alias("kind"))
    return boilerplate.report(boilerplate.mark(b), ["doc_id"], F.length("text"))


# --- tokens, chunks, budgets

_WORDY = "regexp_replace(regexp_replace(text, '[^a-z ]', '', 'g'), ' +', ' ', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {_WORDY} AS t FROM documents), n AS (SELECT doc_id, t, (SELECT max(k) FROM range(0, least(length(t), 800) + 1) r(k) WHERE ceil(length(replace(left(t, k), ' ', '')) / 3.6) <= 100) AS k, ceil(length(replace(t, ' ', '')) / 3.6) <= 100 AS fits FROM t),
c AS (SELECT *, length(left(t, k)) - strpos(reverse(left(t, k)), ' ') AS sp, strpos(left(t, k), ' ') > 0 AS has FROM n) SELECT doc_id, CASE WHEN fits THEN t ELSE rtrim(left(t, CASE WHEN has AND sp > k * 0.8 THEN sp ELSE k END), ' ') END AS head FROM c""")
def q_truncate(spark, d):
    head = F.udf(lambda t: tokens.head(t, 100), "string")
    text = F.regexp_replace(F.regexp_replace("text", "[^a-z ]", ""), " +", " ")
    return table(spark, d, "documents").select("doc_id", head(text).alias("head"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n') AS l FROM documents)),
x AS (SELECT doc_id, ord, unnest(CASE WHEN length(p) > 1500 THEN list_transform(range(0, length(p), 1000), lambda i: substr(p, i + 1, 1000)) ELSE [p] END) AS x, unnest(range(0, CASE WHEN length(p) > 1500 THEN length(p) ELSE 1 END, 1000)) AS i FROM p),
t AS (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) AS k, doc_id, length(x) AS n, trim(regexp_replace(x, '\\s', '', 'g')) <> '' AS said FROM x),
w AS (SELECT doc_id, k, n AS size, 1 AS part, said FROM t WHERE k = 1 UNION ALL SELECT t.doc_id, t.k, CASE WHEN w.size = 0 OR w.size + t.n + 2 > 1000 THEN t.n ELSE w.size + t.n + 2 END, CASE WHEN w.size > 0 AND w.size + t.n + 2 > 1000 THEN w.part + 1 ELSE w.part END, t.said FROM w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k + 1),
g AS (SELECT doc_id, part, max(size) AS n, bool_or(said) AS said, part = max(part) OVER (PARTITION BY doc_id) AS is_last FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(part - 1 AS INTEGER) AS part, n FROM g WHERE said OR NOT is_last""")
def q_paragraphs(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    out = chunks.paragraph_chunks(docs, ["doc_id"], "text", 1000)
    return out.select("doc_id", "part", F.length("text").cast("bigint").alias("n"))


_FIT = "x AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY length(text) % 97, doc_id) AS rank FROM documents)"


@query(f"""WITH RECURSIVE {_FIT}, w AS (SELECT source, rank, CASE WHEN size <= 20000 THEN 20000 - size ELSE 20000 END AS remaining, size <= 20000 AS took FROM x WHERE rank = 1
UNION ALL SELECT x.source, x.rank, CASE WHEN x.size <= w.remaining THEN w.remaining - x.size ELSE w.remaining END, x.size <= w.remaining FROM w JOIN x ON x.source = w.source AND x.rank = w.rank + 1) SELECT x.source, x.doc_id FROM x JOIN w USING (source, rank) WHERE took""")
def q_fit_budget(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"), (F.length("text") % 97).alias("r"))
    return chunks.fit_budget(x, ["source"], ["r", "doc_id"], "doc_id", "size", 20_000).select("source", "doc_id")


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END DESC, event_id) AS rn, event_id FROM events) SELECT user_id, event_id FROM f WHERE rn <= 20""")
def q_top_flags(spark, d):
    e = table(spark, d, "events")
    severity = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high")
    return briefs.top_of(e.withColumn("severity", severity), ["user_id"], [rank_of("severity", SEVERITY_RANK, -1).desc(), F.col("event_id")], 20).select("user_id", "event_id")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'flags' ELSE 'metrics' END AS list, length(text) AS n FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, list ORDER BY turn) AS place, sum(n) OVER (PARTITION BY conv_id) AS total FROM x),
l AS (SELECT *, place > CASE list WHEN 'metrics' THEN 1 ELSE 2 END AS loose FROM p), d AS (SELECT a.conv_id, a.turn, a.loose, a.total, coalesce(sum(b.n), 0) AS before FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id AND b.loose AND a.loose AND (b.list = 'metrics' AND a.list = 'flags' OR b.list = a.list AND b.place > a.place) GROUP BY ALL)
SELECT conv_id, turn FROM d WHERE NOT (loose AND total - before > 900)""")
def q_trim_brief(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "flags").otherwise("metrics").alias("list"), F.length("text").alias("n"))
    return briefs.trim_to(x, ["conv_id"], "list", "turn", "n", {"metrics": 1, "flags": 2}, 900).select("conv_id", "turn")


# --- quotes

_Q25 = "array_to_string(regexp_split_to_array(trim(text, ' '), '\\s+')[1:25], ' ')"


@query(f"""WITH b AS (SELECT item_id, text AS quote, len(regexp_split_to_array(trim(text, ' '), '\\s+')) AS n, {_Q25} AS head FROM benchmark), x AS (SELECT item_id, quote, n, head, CASE WHEN item_id % 3 = 0 THEN quote || ' and so on' ELSE head || ' other words' END AS text FROM b)
SELECT item_id, CASE WHEN contains(text, quote) THEN 'exact' WHEN n > 25 AND contains(text, head) THEN 'exact' WHEN n > 25 AND contains(regexp_replace(text, '\\s+', ' ', 'g'), head) THEN 'whitespace-normalized' WHEN contains(regexp_replace(text, '\\s+', ' ', 'g'), regexp_replace(quote, '\\s+', ' ', 'g')) THEN 'whitespace-normalized' ELSE 'no-match' END AS tier, NOT contains(regexp_replace(text, '\\s+', ' ', 'g'), regexp_replace(quote, '\\s+', ' ', 'g')) AND n > 25 AS cut FROM x""")
def q_quote_window(spark, d):
    head = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 25), " ")
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" and so on"))).otherwise(F.concat(head, F.lit(" other words"))).alias("text"))
    tier, cut = quotes.with_window(F.col("text"), F.col("quote"))
    return b.select("item_id", tier.alias("tier"), cut.alias("cut"))


@query("""WITH p AS (SELECT d.source, CASE WHEN contains(d.text, b.w) THEN 'exact' WHEN contains(lower(d.text), lower(b.w)) THEN 'case-insensitive' WHEN contains(regexp_replace(lower(d.text), '[|•$\\s]', '', 'g'), lower(b.w)) THEN 'table-normalized' ELSE 'no-match' END AS tier FROM documents d, (SELECT regexp_extract(text, '^[A-Za-z]+') AS w FROM benchmark WHERE item_id < 8) b WHERE b.w <> '')
SELECT source, count(*) AS n, count(*) FILTER (tier = 'exact') AS n_exact, count(*) FILTER (tier = 'case-insensitive') AS n_case_insensitive, count(*) FILTER (tier = 'no-match') AS n_no_match FROM p GROUP BY 1""")
def q_tier_counts(spark, d):
    words = table(spark, d, "benchmark").where("item_id < 8").select(F.regexp_extract("text", "^[A-Za-z]+", 0).alias("w")).where("w <> ''")  # eight stated quotes
    p = quotes.tiers(table(spark, d, "documents").select("source", "text"), words, "text", "w")
    return quotes.tier_counts(p, ["source"]).select("source", "n", "n_exact", "n_case_insensitive", "n_no_match")


_COVER = """s AS (SELECT conv_id, 'mda' AS section, CASE WHEN max(CASE WHEN turn = 0 THEN length(text) END) > 150 THEN 'high' END AS c, max(CASE WHEN turn = 0 THEN text END) AS t, CASE WHEN conv_id % 3 = 0 THEN 'failed' ELSE 'low' END AS bc, 'base' AS bt FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'risk-factors', CASE WHEN conv_id % 4 = 0 THEN 'missing' ELSE 'high' END, 'text', NULL, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE 'base' END FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {_COVER}, u AS (SELECT *, coalesce(length(trim(t, ' ')) > 0, false) AND coalesce(c, 'high') IN ('high', 'low') AS q, coalesce(length(trim(bt, ' ')) > 0, false) AND coalesce(bc, 'high') IN ('high', 'low') AS k, CASE section WHEN 'mda' THEN 'MD&A' ELSE 'risk factors' END AS label FROM s),
w AS (SELECT *, CASE WHEN NOT q THEN '10-Q ' || label || ' incompletely parsed (section ' || CASE WHEN coalesce(c, 'missing') = 'missing' THEN 'missing' ELSE 'failed extraction' END || ') — ' || label || ' change detection not performed.' WHEN NOT k THEN '10-K baseline ' || label || ' incompletely parsed (section ' || CASE WHEN coalesce(bc, 'missing') = 'missing' THEN 'missing' ELSE 'failed extraction' END || ') — ' || label || ' changes could not be compared against the annual baseline.' END AS warning FROM u),
g AS (SELECT conv_id, coalesce(string_agg(warning, ' / ' ORDER BY section) FILTER (warning IS NOT NULL), '') AS warnings, bool_and(section <> 'mda' OR (q AND k)) AS mda_assessed FROM w GROUP BY 1), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, warnings, mda_assessed, n || CASE WHEN mda_assessed THEN CASE WHEN n = 1 THEN ' change' ELSE ' changes' END ELSE CASE WHEN n = 1 THEN ' risk-factor change' ELSE ' risk-factor changes' END || '; MD&A not assessed' END AS headline FROM g JOIN n USING (conv_id)""")
def q_coverage(spark, d):
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("t"), F.count(F.lit(1)).alias("n"))
    i = F.col("conv_id")
    null = F.lit(None).cast("string")
    mda = g.select(i, F.lit("mda").alias("section"), F.col("t"), F.when(F.length("t") > 150, "high").alias("c"), F.lit("base").alias("bt"), F.when(i % 3 == 0, "failed").otherwise("low").alias("bc"))
    risk = g.select(i, F.lit("risk-factors").alias("section"), F.lit("text").alias("t"), F.when(i % 4 == 0, "missing").otherwise("high").alias("c"), F.when(i % 5 == 0, " ").otherwise("base").alias("bt"), null.alias("bc"))
    out = quotes.coverage(mda.unionByName(risk), "conv_id", "section", "t", "c", "bt", "bc").join(g.select("conv_id", "n"), "conv_id")
    return out.select("conv_id", F.array_join("warnings", " / ").alias("warnings"), "mda_assessed", quotes.headline(F.col("n"), F.col("mda_assessed")).alias("headline"))


# --- briefs

_METRICS = "m AS (SELECT user_id, event_id, upper(event_type) || '!' AS label, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, floor(value / 25) AS value, CASE WHEN event_id % 3 = 0 THEN value END AS prior FROM events)"


@query(f"""WITH {_METRICS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, label, period, value ORDER BY event_id) AS rn FROM m) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY prior IS NULL, event_id) AS INTEGER) AS position FROM o WHERE rn = 1""")
def q_first_metrics(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.concat(F.upper("event_type"), F.lit("!")).alias("label"), F.col("ts").cast("date").cast("string").alias("period"), F.floor(F.col("value") / 25).alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("prior"))
    return briefs.first_metrics(e, ["user_id"], "label", "period", "value", "prior", "event_id").select("user_id", "event_id", "position")


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 2 = 1 AS checkable, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS key FROM conversations WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS rn FROM c)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY checkable DESC, turn) AS INTEGER) AS position FROM o WHERE rn = 1""")
def q_claims(spark, d):
    c = table(spark, d, "conversations").where(F.col("text").isNotNull()).withColumn("checkable", F.col("turn") % 2 == 1)
    return briefs.claims(c, ["conv_id"], "text", "checkable", "turn").select("conv_id", "turn", "position")


@query("""WITH g AS (SELECT user_id, count(*) FILTER (value >= 30) AS n_kept, count(*) FILTER (value < 30) AS n_dropped FROM events GROUP BY 1) SELECT *, coalesce(n_dropped / nullif(n_kept + n_dropped, 0) > 0.25, false) AS suspect FROM g""")
def q_drop_rate(spark, d):
    return briefs.drop_rate(table(spark, d, "events"), ["user_id"], F.col("value") >= 30)


_FLAGS = """f AS (SELECT user_id, event_type AS category, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS severity, 'claim number ' || event_id % 5 AS claim, event_id FROM events),
m AS (SELECT user_id, category, claim, count(*) AS occurrences, max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS rank FROM f GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, occurrences DESC, category, claim) AS k FROM m)"""


def _flags(spark, d):
    e = table(spark, d, "events")
    severity = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high")
    f = e.select("user_id", F.col("event_type").alias("category"), severity.alias("severity"), F.concat(F.lit("claim number "), (F.col("event_id") % 5).cast("string")).alias("claim"), "event_id")
    return briefs.merge_flags(f, ["user_id"], "category", "claim", "severity", "event_id", "event_id")


@query(f"WITH {_FLAGS} SELECT user_id, category, claim, occurrences, CAST(k AS INTEGER) AS k FROM o")
def q_order_flags(spark, d):
    w = Window.partitionBy("user_id").orderBy(rank_of("severity", SEVERITY_RANK, -1).desc(), F.col("occurrences").desc(), "category", "claim")
    f = briefs.order_flags(_flags(spark, d), "claim")
    return f.select("user_id", "category", "claim", "occurrences", F.row_number().over(w).alias("k"))


@query("""SELECT conv_id, turn, CASE WHEN n >= 200 AND marks / n >= 0.04 AND caps / greatest(letters, 1) > 0.02 THEN true ELSE false END AS written FROM (SELECT doc_id AS conv_id, CAST(0 AS INTEGER) AS turn, len(regexp_split_to_array(trim(text, ' '), '\\s+')) AS n, length(regexp_replace(trim(text, ' '), '[^.,;:!?]', '', 'g')) AS marks, length(regexp_replace(trim(text, ' '), '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(trim(text, ' '), '[^A-Za-z]', '', 'g')) AS letters FROM documents)""")
def q_looks_written(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), transcripts.looks_written("text").alias("written"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn * 10 END AS time, turn AS idx, '* ' || text AS t FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn > 0)), c AS (SELECT conv_id, turn * 10 AS time, turn AS idx, text FROM conversations),
j AS (SELECT c.*, coalesce(a.t, b.t) AS clean FROM c LEFT JOIN l a ON a.conv_id = c.conv_id AND a.time = c.time LEFT JOIN l b ON b.conv_id = c.conv_id AND b.idx = c.idx), s AS (SELECT *, avg(CASE WHEN clean IS NOT NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY conv_id) AS share FROM j)
SELECT conv_id, idx, CASE WHEN share >= 0.5 THEN coalesce(clean, text) ELSE text END AS text FROM s""")
def q_realign(spark, d):
    c = table(spark, d, "conversations")
    lines = c.where(~((F.col("conv_id") % 3 == 0) & (F.col("turn") > 0))).select("conv_id", F.when(F.col("turn") % 2 == 0, F.col("turn") * 10).alias("time"), F.col("turn").alias("idx"), F.concat(F.lit("* "), F.col("text")).alias("text"))
    cues = c.select("conv_id", (F.col("turn") * 10).alias("time"), F.col("turn").alias("idx"), "text")
    return transcripts.realign(lines, cues, ["conv_id"], "time", "idx", "text").select("conv_id", "idx", "text")


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[.!?]+', '', 'g'), '\s+', ' ', 'g'), ' ') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN NULL ELSE 'Acme Inc. makes things. It sells them to U.S. firms too.' END AS two, CASE WHEN s = '' THEN NULL WHEN length(s) <= 300 THEN s ELSE rtrim(left(s, 299), ' ') || '…' END AS one FROM t""")
def q_business_summary(spark, d):
    cut = F.udf(snippets.summary, "string")
    s = F.trim(F.regexp_replace(F.regexp_replace("text", "[.!?]+", ""), r"\s+", " "))
    two = F.when(s != "", F.concat(F.lit("Acme Inc. makes  things. It sells them to U.S. firms too. "), s, F.lit(".")))
    return table(spark, d, "documents").select("doc_id", cut(two).alias("two"), cut(s).alias("one"))


