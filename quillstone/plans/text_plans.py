"""Queries on documents, quotes, search, pages, conversations, and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import ONE_TIME_PHRASES, PROTECTED_PHRASES, STRIP_RULES
from ..functions.expr import token_estimate
from ..operators import retrieval as R
from ..operators.events import surface_new
from ..session import scratch
from ..sources import filings as SF
from ..streaming import events as ST
from ..text import boilerplate, briefs, chunks, layout, quotes, recurrence, transcripts
from .base import query, table

# Terms of a ranking, and terms of two searches.
_TERMS = ("the", "tion", "and", "er")
_SEARCH = ((1, "the reanti of licensed heon token"), (2, "menta eau und nicht der apache license"), (3, "password inoner"))


@query(r"""WITH t AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^ \t]', '', 'g')) AS free FROM documents)
SELECT doc_id, CAST(ceil(letters / 3.6::DOUBLE + digits / 2.0::DOUBLE + (n - letters - digits - free) * 0.8::DOUBLE) AS BIGINT) AS tokens FROM t""")
def q_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate("text").alias("tokens"))


_TF = " + ".join(f"CASE WHEN length(t) > length(replace(t, '{x}', '')) THEN 1 + ln((length(t) - length(replace(t, '{x}', ''))) / {len(x)}) ELSE 0 END" for x in _TERMS)


@query(f"WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, round(CAST({_TF} AS DOUBLE), 6) AS score FROM l) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def q_term_rank(spark, d):
    return R.term_rank(table(spark, d, "documents"), "doc_id", "text", _TERMS, 50)


def _rule_sql(text: str) -> str:
    def one(options) -> str:
        return " OR ".join("(" + " AND ".join(f"regexp_matches({text}, '{p}')" for p in every) + ")" for every in options)

    return "CASE " + " ".join(f"WHEN {one(o)} THEN '{n}'" for n, o in _RULES) + " END"


# Rules that these texts can meet, beside the fixed ones: licence lines, tables without their pipes, shouting.
_RULES = (("licence-line", ((r"(?i)licensed under",), (r"(?i)released under",))), ("shouting", ((r"^[A-ZÀ-Ü!., ]+$", r"!!"),)), *((n, o) for n, o in STRIP_RULES if n in ("page-furniture", "exhibit-index")))
_PROTECTED = "(" + " OR ".join(f"contains(lower(line), '{p}')" for p in PROTECTED_PHRASES) + ")"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line, {_rule_sql('line')} AS rule FROM lines) SELECT doc_id, rule, count(*) AS blocks_removed, CAST(sum(length(line)) AS BIGINT) AS chars_removed FROM m WHERE rule IS NOT NULL AND NOT {_PROTECTED} GROUP BY 1, 2""")
def q_strip_rules(spark, d):
    marked = boilerplate.mark(_lines(spark, d), "line", None, _RULES)
    return boilerplate.report(marked, ["doc_id"], F.length("line"))


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line, {_rule_sql('line')} AS rule FROM lines), s AS (SELECT *, rule IS NOT NULL AND NOT {_PROTECTED} AS stripped, rule IS NOT NULL AND {_PROTECTED} AS kept FROM m),
g AS (SELECT doc_id, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS chars_before, CAST(coalesce(sum(CASE WHEN NOT stripped THEN length(line) END), 0) AS BIGINT) AS chars_after, count(*) FILTER (kept) AS n_protected FROM s GROUP BY 1)
SELECT *, round(coalesce((chars_before - chars_after) / nullif(chars_before, 0), 0), 6) AS share, coalesce((chars_before - chars_after) / nullif(chars_before, 0), 0) > 0.5 AS suspect FROM g""")
def q_strip_totals(spark, d):
    t = boilerplate.totals(boilerplate.mark(_lines(spark, d), "line", None, _RULES), ["doc_id"], F.length("line"))
    return t.select("doc_id", "chars_before", "chars_after", "n_protected", F.round("share", 6).alias("share"), "suspect")


# A quote of each item: its first ten words, in another reading by the item's number; looked for in every document.
_QUOTE = "CASE item_id % 4 WHEN 0 THEN q WHEN 1 THEN translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN replace(q, ' ', '  ') ELSE q || ' nowhere' END"
_SP = r"trim(regexp_replace(replace({0}, chr(160), ' '), '\s+', ' ', 'g'))"
_PU = _SP.format("translate({0}, '‘’‚‛“”„‟–—−', '''''''''\"\"\"\"---')")
_TA = r"regexp_replace(lower(" + _PU + r"), '[|•$\s]', '', 'g')"


_FORMS_OF = "{0} AS f0, " + _SP + " AS f1, lower({0}) AS f2, lower(" + _PU + ") AS f3, " + _TA + " AS f4"
_TIER_SQL = "CASE " + " ".join(f"WHEN contains(t.f{i}, q.f{i}) THEN '{name}'" for i, name in enumerate(quotes.TIERS[:-1])) + " END"


@query(f"""WITH q0 AS (SELECT item_id, trim(regexp_extract(text, '^(\\S+\\s+){{0,9}}\\S+')) AS q FROM benchmark), q1 AS (SELECT item_id, {_QUOTE} AS quote FROM q0), q AS MATERIALIZED (SELECT item_id, {_FORMS_OF.format('quote')} FROM q1),
t AS MATERIALIZED (SELECT doc_id, {_FORMS_OF.format('text')} FROM documents) SELECT doc_id, item_id, {_TIER_SQL} AS tier FROM t JOIN q ON contains(t.f4, q.f4) WHERE length(q.f4) > 0""")
def q_quote_tiers(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_extract("text", r"^(\S+\s+){0,9}\S+", 0)).alias("q"))
    q = b.select("item_id", F.expr(_QUOTE).alias("quote"))
    return quotes.tier_pairs(table(spark, d, "documents").select("doc_id", "text"), q, "text", "quote").select("doc_id", "item_id", "tier")


@query(f"""WITH q0 AS (SELECT item_id, trim(regexp_extract(text, '^(\\S+\\s+){{0,9}}\\S+')) AS quote FROM benchmark), q AS MATERIALIZED (SELECT item_id, lower({_PU.format('quote')}) AS q FROM q0), t AS MATERIALIZED (SELECT lower({_PU.format('text')}) AS t FROM documents)
SELECT item_id, count(*) AS n_checked, count(*) FILTER (length(q) >= 12 AND contains(t, q)) AS n_verified FROM t, q GROUP BY 1""")
def q_quote_verify(spark, d):
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_extract("text", r"^(\S+\s+){0,9}\S+", 0)).alias("quote"))
    n = quotes.verified_pairs(docs.select("text"), q, "text", "quote").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    checked = docs.agg(F.count(F.lit(1)).alias("n_checked"))  # one row
    return q.join(n, "item_id", "left").crossJoin(F.broadcast(checked)).select("item_id", "n_checked", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_verified"))


@query()  # all pairs of lines are too many for SQL; tests hold it against brute force
def q_recurrence(spark, d):
    lines = table(spark, d, "documents").select("source", F.col("doc_id").alias("filing"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    p = lines.withColumns({"ord": F.col("filing"), "claim_id": F.struct("filing", "line")})
    got = recurrence.repeated(p, p, "source", filings=1)
    return got.select(F.col("claim_id.filing").alias("claim_id"), F.col("claim_id.line").alias("line"), "source", "n_prior", "severity")


_PHRASES = ("released under the mit", *ONE_TIME_PHRASES)


@query(f"""WITH e AS (SELECT DISTINCT source, doc_id, phrase FROM documents, (SELECT unnest([{', '.join(repr(p) for p in _PHRASES)}]) AS phrase) WHERE contains(lower(text), phrase)), n AS (SELECT *, count(*) OVER (PARTITION BY source, phrase ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM e)
SELECT source, doc_id, phrase, n_prior, CASE WHEN n_prior >= 4 THEN 'high' ELSE 'medium' END AS severity FROM n WHERE n_prior >= 1""")
def q_one_time(spark, d):
    f = table(spark, d, "documents").select("source", F.col("doc_id").alias("filing"), F.col("doc_id").alias("ord"), "text")
    return recurrence.one_time(f, "source", _PHRASES, least=1).select("source", F.col("filing").alias("doc_id"), "phrase", "n_prior", "severity")


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN length(text) > 400 THEN 'high' WHEN length(text) > 200 THEN 'medium' ELSE 'low' END AS severity FROM conversations WHERE text IS NOT NULL),
k AS (SELECT *, role || '|' || array_to_string(regexp_extract_all(text, '[0-9][0-9,.]*'), ',') || '|' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: length(w) > 3)[1:8], ' ') AS key FROM c)
SELECT key, count(*) AS occurrences, count(DISTINCT conv_id) AS n_chunks, CASE max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity FROM k GROUP BY 1""")
def q_dedupe_claims(spark, d):
    severity = F.when(F.length("text") > 400, "high").when(F.length("text") > 200, "medium").otherwise("low")
    c = table(spark, d, "conversations").where(F.col("text").isNotNull()).withColumns({"severity": severity, "ord": F.struct("conv_id", "turn")})
    return briefs.merge_flags(c, [], "role", "text", "severity", "conv_id", "ord").select("key", "occurrences", "n_chunks", "severity")


@query(f"""WITH {_LINES}, o AS (SELECT doc_id, ord, line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS ord)), k AS (SELECT doc_id, ord, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS key FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS rn FROM k) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (rn = 1) AS n_first FROM r GROUP BY 1""")
def q_first_lines(spark, d):
    lines = _lines(spark, d)
    kept = briefs.first_texts(lines, ["doc_id"], "line", "ordinal").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_first"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines")).join(kept, "doc_id")


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (regexp_matches(role, '(?i)assistant')) AS first FROM conversations GROUP BY 1) SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CASE WHEN first IS NOT NULL AND turn >= first THEN 'qa' ELSE 'prepared' END AS segment FROM conversations JOIN f USING (conv_id)""")
def q_transcript_segment(spark, d):
    return transcripts.segment(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "(?i)assistant").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "segment")


@query("""SELECT conv_id, count(*) AS n_turns, string_agg('[turn ' || turn || ' — ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '[turn ' || turn || ' — ' || role || ']' || chr(10) || text) AS text FROM conversations GROUP BY 1""")
def q_transcript_text(spark, d):
    return transcripts.whole_text(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")


@query()
def q_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    blocks = layout.blocks(docs, ["doc_id"], "text", markdown=True)
    return chunks.chunk(blocks, ["doc_id"], most=800, least=400, repeated=40).select("doc_id", "id", "n", "total", "n_blocks", "has_table", "tokens")


@query()
def q_html_blocks(spark, d):
    b = layout.blocks(table(spark, d, "pages").select("page_id", "html"), ["page_id"], "html")
    return b.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_Q = "q(query, term) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, s in _SEARCH for t in dict.fromkeys(w for w in s.split() if len(w) > 1 and w not in ("the", "and", "or", "not", "near", "for", "was", "were", "are", "its", "this", "that"))) + ")"
_BM25 = f"""{_Q}, l AS (SELECT doc_id, {_TOKENS} AS t FROM documents), dl AS (SELECT doc_id, t, len(t) AS dl FROM l), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dl) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, greatest(ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, st GROUP BY term, n_docs),
h AS (SELECT query, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bm AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 30)"""


def _queries(spark):
    return spark.createDataFrame(list(_SEARCH), "query int, words string").select("query", R.query_terms(F.col("words")).alias("terms"))


def _bm25(spark, d):
    return R.bm25(table(spark, d, "documents"), _queries(spark), "doc_id", "text", "query", "terms", 30)


@query(f"WITH {_BM25} SELECT query, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def q_bm25(spark, d):
    return _bm25(spark, d).select("query", "doc_id", "score", "rank")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_KNN = f"""kq AS (SELECT CAST(vec_id + 1 AS INTEGER) AS query, embedding AS q FROM embeddings WHERE vec_id < 3), kh AS (SELECT query, vec_id, round(coalesce({_DOT.format('embedding', 'q')} / nullif(sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')}), 0), 0), 6) AS score FROM embeddings, kq),
nn AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM kh QUALIFY rank <= 30)"""


def _knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id < 3").select((F.col("vec_id") + 1).cast("int").alias("query"), F.col("embedding").alias("q"))
    return R.knn(e, q, "vec_id", "embedding", "query", "q", 30)


@query(f"WITH {_KNN} SELECT query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM nn")
def q_cosine(spark, d):
    return _knn(spark, d).select("query", "vec_id", "score", "rank")


@query(f"""WITH {_BM25}, {_KNN}, a AS (SELECT query, doc_id, rank, 'keyword' AS arm FROM bm UNION ALL SELECT query, vec_id, rank, 'vector' FROM nn), g AS (SELECT query, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT arm, ',' ORDER BY arm) AS matched_by FROM a GROUP BY 1, 2)
SELECT query, doc_id, score, matched_by, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 5""")
def q_rrf(spark, d):
    arms = {"keyword": _bm25(spark, d).select("query", "doc_id", "rank"), "vector": _knn(spark, d).select("query", F.col("vec_id").alias("doc_id"), "rank")}
    return R.fuse(arms, "query", "doc_id").select("query", "doc_id", "score", "matched_by", "rank")


@query(f"WITH b AS (SELECT substr(text, 1, 60) AS quote FROM benchmark WHERE item_id = 11) SELECT doc_id FROM documents, b WHERE contains(lower({_PU.format('text')}), lower({_PU.format('quote')})) ORDER BY doc_id LIMIT 50")
def q_exact_quote(spark, d):
    quote = table(spark, d, "benchmark").where("item_id = 11").select(F.substring("text", 1, 60)).first()[0]  # one stated quote
    return R.find_quote(table(spark, d, "documents"), "doc_id", "text", quote)


_ESTIMATE = r"CAST(ceil(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) / 3.6::DOUBLE + length(regexp_replace(text, '[^0-9]', '', 'g')) / 2.0::DOUBLE + (length(text) - length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) - length(regexp_replace(text, '[^0-9]', '', 'g')) - length(regexp_replace(text, '[^ \t]', '', 'g'))) * 0.8::DOUBLE) AS BIGINT)"


@query(f"""WITH x AS (SELECT source, doc_id, {_ESTIMATE} AS tokens FROM documents), h AS (SELECT source, tokens AS s, count(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT source, s, sum(n) OVER w AS met, sum(s * n) OVER w AS used, sum(n) OVER (PARTITION BY source) AS all_ FROM h WINDOW w AS (PARTITION BY source ORDER BY s)),
f AS (SELECT source, max(s) AS most, max(met) AS met, max(used) AS used FROM c WHERE s * (all_ - met) + used <= 20000 GROUP BY 1), g AS (SELECT x.*, coalesce(f.most, -1) AS most, 20000 - coalesce(f.used, 0) AS rest, count(*) OVER (PARTITION BY x.source) - coalesce(f.met, 0) AS open_ FROM x LEFT JOIN f USING (source)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, tokens > most ORDER BY doc_id) AS place FROM g)
SELECT source, doc_id, tokens, CAST(CASE WHEN tokens <= most THEN tokens ELSE rest // open_ + CASE WHEN place <= rest % open_ THEN 1 ELSE 0 END END AS BIGINT) AS share FROM r""")
def q_waterfill(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", token_estimate("text").alias("tokens"))
    return chunks.allocate(x, ["source"], "doc_id", "tokens", 20_000)


@query(f"""WITH RECURSIVE {_LINES.replace("unnest(string_split(text, chr(10))) AS line", "unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord")}, b AS (SELECT doc_id, ord, ord % 5 = 0 AS head, {_ESTIMATE} AS n FROM lines),
w AS (SELECT doc_id, ord, n AS size, 0 AS part FROM b WHERE ord = 0 UNION ALL SELECT b.doc_id, b.ord, CASE WHEN w.size + b.n > 300 OR (w.size >= 150 AND b.head) THEN b.n ELSE w.size + b.n END, CASE WHEN w.size + b.n > 300 OR (w.size >= 150 AND b.head) THEN w.part + 1 ELSE w.part END FROM w JOIN b ON b.doc_id = w.doc_id AND b.ord = w.ord + 1)
SELECT doc_id, CAST(part AS INTEGER) AS n, CAST(max(part) OVER (PARTITION BY doc_id) + 1 AS INTEGER) AS total, CAST(count(*) AS INTEGER) AS n_blocks FROM w GROUP BY doc_id, part""")
def q_pack_blocks(spark, d):
    b = _lines(spark, d).select("doc_id", "ordinal", F.when(F.col("ordinal") % 5 == 0, "heading").otherwise("para").alias("kind"), F.col("line").alias("markdown"))
    return chunks.chunk(b, ["doc_id"], most=300, least=150, repeated=0).select("doc_id", "n", "total", "n_blocks")


@query("""WITH s AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), y AS (SELECT unnest(range(year(a), year(b) + 2)) AS y FROM s),
f AS (SELECT make_date(y, m, d) AS h FROM y, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) v(m, d)), o AS (SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END AS h FROM f),
m AS (SELECT make_date(y, m, 1) AS one, w, n FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, w, n)), l AS (SELECT make_date(y, 5, 31) AS e FROM y),
h AS (SELECT h FROM o UNION ALL SELECT CAST(one + CAST((w - isodow(one) + 7) % 7 + 7 * (n - 1) AS INTEGER) AS DATE) FROM m UNION ALL SELECT CAST(e - CAST((isodow(e) + 6) % 7 AS INTEGER) AS DATE) FROM l),
c AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1), e AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT e.date, coalesce(n_orders, 0) AS n_orders FROM e LEFT JOIN c ON e.date = c.date WHERE isodow(e.date) < 6 AND e.date NOT IN (SELECT CAST(h AS DATE) FROM h)""")
def q_business_days(spark, d):
    """The business days from the first order to the last, with their orders."""
    orders = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    first, last = orders.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return SF.business_days(spark, first, last).join(orders, "date", "left").select("date", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("""WITH l AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '4' ELSE 'S-1' END AS form, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderkey % 7 <> 0)
SELECT cik, form, filing_date, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-98-000001' AS accession FROM l WHERE filing_date BETWEEN DATE '1998-03-02' AND DATE '1998-03-31' AND isodow(filing_date) < 6 AND form IN ('10-K', '10-K/A', '4') AND cik IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_acctbal > 0)""")
def q_index_sweep(spark, d):
    form = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '4' ELSE 'S-1' END")
    name = F.concat(F.lit("edgar/data/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-98-000001.txt"))
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit("CIK|Company Name|Form Type")).otherwise(F.concat_ws("|", F.col("o_custkey").cast("string"), F.lit("NAME"), form, date, name))
    index = SF.master_index(table(spark, d, "orders").select(line.alias("value")))
    ciks = table(spark, d, "customer").where("c_acctbal > 0").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))
    return SF.sweep(index, SF.business_days(spark, "1998-03-02", "1998-03-31"), ciks, ["10-K", "4"]).select("cik", "form", "filing_date", "accession")


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return ST.read(spark, f"{d}/events.parque[t]", schema).withColumn("at", F.col("ts").cast("timestamp"))


def _checkpoint(spark) -> str:
    return scratch(spark, "stream")


@query("SELECT event_type || ':' || user_id AS key, count(*) > 0 AS seen FROM events GROUP BY 1")
def q_stream_dedupe(spark, d):
    keyed = _stream(spark, d).select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "at")
    at = _checkpoint(spark)
    out = ST.run_to_table(ST.surface_once(keyed, ["key"], "at", "60 days"), f"{at}/out", f"{at}/state")
    return out.select("key", F.lit(True).alias("seen"))


@query("""SELECT user_id, CAST(day AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS n_kinds FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2""")
def q_stream_cluster(spark, d):
    s = _stream(spark, d)
    kinds = F.size(F.collect_set("event_type")).cast("bigint")
    c = ST.sliding_clusters(s, ["user_id"], "at", "1 day", "1 day", "3 days", n=F.count(F.lit(1)), n_kinds=kinds)
    out = ST.run_to_latest(c, _checkpoint(spark), ["user_id", "window_start"])
    return out.select("user_id", F.to_date("window_start").alias("day"), "n", "n_kinds")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents WHERE doc_id >= 100 AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id < 100 AND s.lang = documents.lang AND s.source = documents.source)) WHERE rn = 1")
def q_new_feeds(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "lang")
    return surface_new(docs.where("doc_id >= 100"), docs.where("doc_id < 100").distinct(), ["lang", "source"], [F.col("doc_id")]).select("source", "doc_id", "lang")
