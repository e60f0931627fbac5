"""Queries on what is kept between runs: a search index, a table of facts, remembered replies, queues of jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import calls, fact_store, jobs, medians, search_index
from ..session import scratch, written
from ..sources import days, sinks
from ..streaming import events as ST
from .base import events, query, table
from .series_plans import _FACTS, _facts
from .text_plans import _BM25, _queries, _stream


@query(f"WITH {_BM25} SELECT query, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def q_indexed_search(spark, d):
    """The same rows as q_bm25, from an index that has seen a filing inserted, replaced and removed. Ten documents are a filing."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).cast("string").alias("filing"), "text")
    nth = F.floor(F.col("doc_id") / 10) % 10
    index = search_index.SearchIndex(spark, scratch(spark, "index"))
    draft = docs.where(nth < 2).withColumn("text", F.concat(F.lit("password the "), F.coalesce("text", F.lit(""))))
    index.add(docs.where(nth >= 2).unionByName(draft).unionByName(draft.withColumn("filing", F.concat(F.lit("drafts/"), "filing"))), "doc_id", "filing", "text")
    index.add(docs.where(nth < 2), "doc_id", "filing", "text")
    index.remove(draft.select(F.concat(F.lit("drafts/"), "filing").alias("filing")), "filing")
    return index.search(_queries(spark), "query", "terms").select("query", F.col("doc").alias("doc_id"), "score", "rank")


@query(f"""WITH RECURSIVE {_FACTS}, b AS (SELECT *, min(priority) OVER (PARTITION BY entity, fy, fq) AS best FROM facts), o AS (SELECT *, row_number() OVER (PARTITION BY entity, fy, fq ORDER BY filed, accn, line, val) AS rn FROM b WHERE priority = best),
f AS (SELECT entity, fy, fq, rn, val AS now, CAST(NULL AS DOUBLE) AS was FROM o WHERE rn = 1
 UNION ALL SELECT f.entity, f.fy, f.fq, o.rn, CASE WHEN abs(f.now - o.val) > 0.005 * greatest(abs(f.now), abs(o.val), 1.0) THEN o.val ELSE f.now END,
  CASE WHEN abs(f.now - o.val) > 0.005 * greatest(abs(f.now), abs(o.val), 1.0) THEN coalesce(f.was, f.now) ELSE f.was END FROM f JOIN o ON o.entity = f.entity AND o.fy = f.fy AND o.fq = f.fq AND o.rn = f.rn + 1)
SELECT entity, fy, fq, now AS value, was AS restated_from, CAST(rn AS INTEGER) AS n_reports FROM f QUALIFY row_number() OVER (PARTITION BY entity, fy, fq ORDER BY rn DESC) = 1""")
def q_fact_batches(spark, d):
    """Points of all reports of the best tag, added in three batches that are not in order of filing, the first of them twice."""
    reports = _facts(spark, d).select("entity", "fy", "fq", "filed", "accn", "line", F.col("val").alias("value"), "priority")
    reports = written(reports, "reports")  # four batches are cut from it
    store = fact_store.FactStore(spark, scratch(spark, "facts"), "entity bigint, fy int, fq int", "accn bigint, line int", buckets=4)
    for part in (2, 0, 2, 1):
        store.add(reports.where(F.col("accn") % 3 == part))
    return store.points()


_REPLY = "verdict string not null, score double not null, notes array<string>"


def _unsteady(prompt: str):
    """A deterministic stand-in for a model: by the length of the text it answers well, in a fence, with a wrong type (mended when told), cut off (mended when told), with a wrong type again and again, or fails."""
    import json

    first = prompt.split("\n\n---\n")[0]
    told = first != prompt
    how, good = len(first) % 6, json.dumps({"verdict": "long" if len(first) % 2 else "no-edge", "score": len(first) / 4})
    if how == 1:
        return f"```json\n{good}\n```"
    if how == 2 and not told:
        return json.dumps({"verdict": 7, "score": "high"})
    if how == 3 and not told:
        return good[: len(good) // 2], True
    if how == 4:
        return json.dumps({"score": 1})
    if how == 5:
        raise TimeoutError("no reply")
    return good


_ASKED = """SELECT doc_id, text, length(text) % 6 AS how, length(text) AS n FROM documents"""


@query(f"""SELECT doc_id, CASE WHEN how <= 3 THEN CASE WHEN n % 2 = 1 THEN 'long' ELSE 'no-edge' END END AS verdict, CASE WHEN how <= 3 THEN n / 4.0::DOUBLE END AS score,
CASE WHEN text IS NULL OR how IN (0, 1, 5) THEN 1 ELSE 2 END AS rounds, CASE WHEN text IS NULL THEN 'no prompt' WHEN how = 4 THEN 'verdict: required' WHEN how = 5 THEN 'TimeoutError: no reply' END AS error FROM ({_ASKED})""")
def q_validated_reply(spark, d):
    """Replies to every whole text under a schema, repaired in a second round where they broke it; equal texts are asked once."""
    got = calls.ask(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", _unsteady, _REPLY, context=1 << 40)
    value = F.from_json("value", "verdict string, score double")
    return got.select("doc_id", value["verdict"].alias("verdict"), value["score"].alias("score"), "rounds", "error")


@query("""WITH p AS (SELECT lang || ' ' || source AS prompt, doc_id FROM documents), k AS (SELECT DISTINCT prompt FROM p WHERE prompt IS NOT NULL)
SELECT doc_id, 'reply to ' || p.prompt AS reply, (SELECT count(*) FROM k) AS n_calls, CASE WHEN p.prompt IS NULL THEN 'no prompt' END AS error FROM p""")
def q_call_once(spark, d):
    """Prompts that many rows share: half of the rows in a first run, all in a second, and the number of replies that were paid for."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(" "), "source").alias("prompt"))
    memo = sinks.Table(spark, scratch(spark, "memo"), calls.MEMO, ["key"], 4)
    model = lambda prompt: f"reply to {prompt}"
    calls.call_once(docs.where("doc_id % 2 = 0"), "prompt", model, memo)
    got = calls.call_once(docs, "prompt", model, memo)
    return got.crossJoin(F.broadcast(memo.read().agg(F.count(F.lit(1)).alias("n_calls")))).select("doc_id", "reply", "n_calls", "error")  # one row


def _analyst(transcript: str) -> str:
    """A script: asks for the largest order, then for its lines and a tool that is not there, and submits; first without a verdict."""
    import json

    said = transcript.split("\n> ")
    if len(said) == 1:
        return json.dumps({"calls": [{"tool": "largest_order", "input": int(transcript.split()[1])}]})
    order = said[1].split("\n", 1)[1]
    if order == "No result.":
        return json.dumps({"submit": {"verdict": "no-edge", "lines": 0}})
    if len(said) == 2:
        return json.dumps({"calls": [{"tool": "lines", "input": int(order)}, {"tool": "weather", "input": None}]})
    lines = said[2].split("\n", 1)[1]
    submit = {"lines": 0 if lines == "No result." else int(lines)}
    return json.dumps({"submit": submit if len(said) == 4 else submit | {"verdict": "long"}})


@query("""WITH o AS (SELECT o_custkey AS c, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY 1), n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c_custkey, CASE WHEN o.k IS NULL THEN 'no-edge' ELSE 'long' END AS verdict, coalesce(n.n, 0) AS lines, CASE WHEN o.k IS NULL THEN 2 ELSE 4 END AS rounds, CASE WHEN o.k IS NULL THEN 1 ELSE 3 END AS n_calls
FROM customer LEFT JOIN o ON c = c_custkey LEFT JOIN n ON n.k = o.k""")
def q_tool_rounds(spark, d):
    """Every customer is assessed by a script that asks two tools, one of them in vain, and mends its submission."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    best = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("output"))
    counted = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("output"))
    tools = {
        "largest_order": lambda asked: asked.join(best, F.col("input").cast("bigint") == F.col("o_custkey")).select("request", "output"),
        "lines": lambda asked: asked.join(counted, F.col("input").cast("bigint") == F.col("l_orderkey")).select("request", "output"),
    }
    briefs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("brief"))
    got = calls.converse(briefs, ["c_custkey"], "brief", _analyst, tools, "verdict string not null, lines bigint not null")
    value = F.from_json("value", "verdict string, lines bigint")
    return got.select("c_custkey", value["verdict"].alias("verdict"), value["lines"].alias("lines"), "rounds", "n_calls")


@query("""WITH j AS (SELECT o_orderkey AS job, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT job, CASE WHEN rn <= 3 THEN 'done' WHEN rn <= 5 THEN 'failed' WHEN rn <= 8 THEN 'running' ELSE 'pending' END AS status, CAST(CASE WHEN rn <= 3 THEN 1 WHEN rn <= 8 THEN 2 ELSE 0 END AS INTEGER) AS attempts,
CASE WHEN rn <= 3 THEN 'a' WHEN rn <= 8 THEN 'c' END AS worker FROM j""")
def q_job_claims(spark, d):
    """Orders as jobs: a claims the three oldest and ends them, b claims five and dies, c takes those over after the lease and fails two."""
    queue = jobs.JobQueue(spark, scratch(spark, "jobs"), 4)
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    queue.enqueue(table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("enqueued")))
    first = queue.claim("a", at(0), 3)
    queue.claim("b", at(1), 5)
    queue.complete("a", first, at(2))
    over = queue.claim("c", at(40), 5)
    queue.fail("c", over[:2], at(41), "no text")
    return queue.read().select("job", "status", "attempts", "worker")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), w AS (SELECT DISTINCT user_id, day FROM d WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY),
c AS (SELECT w.user_id, w.day, string_agg(DISTINCT d.event_type, ',' ORDER BY d.event_type) AS kinds, count(DISTINCT d.event_type) AS n_kinds FROM w JOIN d ON d.user_id = w.user_id AND d.day BETWEEN w.day - 7 AND w.day GROUP BY 1, 2 HAVING count(DISTINCT d.event_type) >= 3),
e AS (SELECT user_id, min(day) AS day FROM c GROUP BY 1 UNION ALL SELECT e.user_id, (SELECT min(c.day) FROM c WHERE c.user_id = e.user_id AND c.day > e.day + 7) AS day FROM e WHERE e.day IS NOT NULL)
SELECT c.user_id, c.day, kinds, n_kinds FROM c JOIN e ON c.user_id = e.user_id AND c.day = e.day""")
def q_stream_confluence(spark, d):
    """Users with three kinds of events within a week and a day, told of once while it lasts, over a stream."""
    s = _stream(spark, d).where("user_id is not null")
    at = scratch(spark, "confluence")
    return ST.run_to_table(ST.confluence_once(s, "user_id", "event_type", "at", 7, 3), f"{at}/out", f"{at}/state")


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_large_medians(spark, d):
    """Exact medians of a few groups that hold all lines."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    m = medians.medians(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return m.join(lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), ["l_returnflag", "l_linestatus"])


@query("""SELECT 'orders' AS source, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS latest, false AS failed FROM orders UNION ALL SELECT 'events', count(*), CAST(max(ts) AS DATE), false FROM events
UNION ALL SELECT 'parts', count(*), NULL, false FROM part UNION ALL SELECT 'texts', NULL, NULL, true""")
def q_isolated_feeds(spark, d):
    """Four sources, one of which cannot be read to its end (texts that are no numbers)."""
    rows, issues = days.gather(
        spark,
        {
            "orders": lambda: table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("date")),
            "texts": lambda: table(spark, d, "documents").select(F.concat(F.lit("no number "), "text").cast("bigint").alias("key")),
            "events": lambda: events(spark, d).select(F.col("event_id").alias("key"), F.col("day").alias("date")),
            "parts": lambda: table(spark, d, "part").select(F.col("p_partkey").alias("key")),
        },
    )
    read = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest")).withColumn("failed", F.lit(False))
    return read.unionByName(issues.select("source", F.lit(True).alias("failed")), allowMissingColumns=True)
