"""What is kept between runs, against plain folds: search index, facts in batches, replies, tool rounds, jobs."""

from __future__ import annotations

import datetime
import itertools
import json
import os
import random
import sys
import threading
import unicodedata
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.replies import bare, checked, violations
from quillstone.operators import calls, facts, retrieval
from quillstone.operators.fact_store import FactStore
from quillstone.operators.jobs import JobQueue
from quillstone.operators.joins import meet
from quillstone.operators.search_index import SearchIndex, counted, n_terms
from quillstone.sources.sinks import Conflict, Table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this folder
DOCS = "doc long, filing string, text string"


def corpus(n: int, seed: int, shift: int = 0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    some = [(i + shift, f"f{(i + shift) // 4}", " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randrange(1, 30)))) for i in range(n)]
    return [*some, (900 + shift, f"f{900 + shift}", None), (901 + shift, f"f{900 + shift}", "")]


def test_index_follows_its_filings(spark, tmp_path):
    queries = spark.createDataFrame([(1, ["w1", "w7"]), (2, ["w39", "unseen"]), (3, ["w0"])], "query int, terms array<string>")
    index = SearchIndex(spark, f"file://{tmp_path}/i", buckets=8)
    held: dict[int, tuple] = {}

    def same():
        docs = spark.createDataFrame(list(held.values()), DOCS)
        want = retrieval.bm25(docs, queries, "doc", "text", "query", "terms", 5).select("query", "doc", "score", "rank")
        assert sorted(map(tuple, index.search(queries, "query", "terms", 5).collect())) == sorted(map(tuple, want.collect()))

    def add(rows):
        filings = {r[1] for r in rows}
        for k in [k for k, r in held.items() if r[1] in filings]:
            del held[k]
        held.update({r[0]: r for r in rows})
        index.add(spark.createDataFrame(rows, DOCS), "doc", "filing", "text")

    assert index.search(queries, "query", "terms").count() == 0
    add(corpus(40, 1))
    same()
    add(corpus(12, 2, 100))  # more filings
    same()
    add([(r[0] + 5000, r[1], r[2]) for r in corpus(8, 3)])  # two filings replaced, with other documents
    same()
    index.remove(spark.createDataFrame([("f2",), ("none",)], "filing string"), "filing")
    for k in [k for k, r in held.items() if r[1] == "f2"]:
        del held[k]
    same()
    index.compact()
    same()
    state = index.store.state()[1]
    postings = index.store.read("postings", state)
    assert postings.join(index.store.read("filings", state), ["filing", "generation"], "left_anti").count() == 0
    # a search of one term reads its bucket only
    one = index.postings_of(spark.createDataFrame([("w3",)], "term string"), state)
    read = {os.path.dirname(f) for f in one.inputFiles() if "/data-postings" in f}
    assert len(read) == 1 and len({os.path.dirname(f) for f in postings.inputFiles()}) == 8


def test_terms_of_every_character(spark):
    """The index's terms are those of ranked search: on each character by itself, both patterns agree wherever both sides know the character."""
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    newer = spark.createDataFrame([("".join(known),)], "t string").select(F.regexp_extract_all("t", F.lit(r"\p{Cn}"), F.lit(0)))
    known = sorted(set(known) - set(newer.first()[0]))  # Java may know an older Unicode
    texts = [(i, "f", " ".join(known[at : at + 500])) for i, at in enumerate(range(0, len(known), 500))]
    df = spark.createDataFrame(texts, DOCS).withColumn("low", F.lower("text"))
    native = {r.doc: r.t for r in df.select("doc", retrieval.tokens(F.col("text")).alias("t")).collect()}
    got: dict = {}
    for r in df.select("doc", "filing", "low").mapInArrow(counted, "term string, doc long, filing string, tf int, dl int").collect():
        got.setdefault(r.doc, {})[r.term] = r.tf
        assert r.dl == len(native[r.doc])
    assert got == {d: dict(Counter(t)) for d, t in native.items() if t}
    assert {r.doc: r.n for r in df.select("doc", n_terms("low").alias("n")).collect()} == {d: len(t) for d, t in native.items()}


REPORTS = "k string, filed date, n int, value double, priority int, label string"


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


REPORT_ROWS = [
    ("a", day(1), 1, 100.0, 1, "first"), ("a", day(2), 1, 100.2, 1, "drift"), ("a", day(3), 1, 80.0, 1, "restated"), ("a", day(4), 1, 100.0, 1, "back"),
    ("b", day(5), 1, 7.0, 2, "worse tag"), ("b", day(1), 2, 9.0, 0, "best tag"), ("b", day(1), 1, 9.5, 0, "tie"), ("b", day(9), 1, 1.0, 1, "never counts"),
    ("c", day(3), 1, 0.0, 0, "zero"), ("c", day(3), 1, 0.004, 0, "small"),
]


def plain_points(rows):
    out, rows = {}, list(dict.fromkeys(rows))
    for k in {r[0] for r in rows}:
        best = min(r[4] for r in rows if r[0] == k)
        own = sorted((r[1], r[2], r[3], r[5]) for r in rows if r[0] == k and r[4] == best)
        now, was = own[0][2], None
        for *_, v, _ in own[1:]:
            if abs(v - now) > 0.005 * max(abs(v), abs(now), 1):
                now, was = v, now if was is None else was
        out[k] = (now, was, len(own), own[0][3])
    return out


def test_collapse_keeps_the_first_value(spark):
    rows = [r for r in REPORT_ROWS if r[0] == "a"]
    got = facts.collapse(spark.createDataFrame(rows, REPORTS), ["k"], "filed", "value", ["n"], ["label"]).first()
    assert tuple(got) == ("a", 100.0, 100.0, 4, "first") and plain_points(rows)["a"] == (100.0, 100.0, 4, "first")


@pytest.mark.parametrize("seed", range(4))
def test_facts_in_any_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    order = [*REPORT_ROWS, *rng.sample(REPORT_ROWS, 3)]  # some come twice
    rng.shuffle(order)
    cuts = sorted(rng.sample(range(1, len(order)), 2))
    store = FactStore(spark, f"file://{tmp_path}/s", "k string", "n int", "label string", buckets=2)
    for a, b in itertools.pairwise([0, *cuts, len(order)]):
        odd = [(None, day(1), 1, 5.0, 0, "no period"), ("a", day(9), 1, None, 0, "no value")]
        store.add(spark.createDataFrame([*order[a:b], *odd], REPORTS))
        assert {r.k: tuple(r)[1:] for r in store.points().collect()} == plain_points(order[:b])
    assert store.store.read("reports").count() == len(REPORT_ROWS)


def test_untouched_periods_are_not_written(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/s", "k string", "n int", "label string", buckets=8)
    store.add(spark.createDataFrame([(f"p{i}", day(1), 1, float(i), 0, "x") for i in range(50)], REPORTS))
    before = store.store.state()[1]["points"]
    store.add(spark.createDataFrame([("p1", day(2), 1, 99.0, 0, "y")], REPORTS))
    after = store.store.state()[1]["points"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_late_report_without_a_tie_counts_once(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/s", "k string", "n int", "label string", buckets=2)
    first = [("a", day(1), None, 1.0, 0, "x"), ("a", day(2), None, 9.0, 0, "y")]
    store.add(spark.createDataFrame(first, REPORTS))
    store.add(spark.createDataFrame([*first, ("a", day(1), 3, 5.0, 0, "z")], REPORTS))
    assert [tuple(r) for r in store.points().collect()] == [("a", 9.0, 1.0, 3, "x")] and store.store.read("reports").count() == 3


def test_no_bucket_is_written_by_one_task(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = FactStore(spark, f"file://{tmp_path}/s", "k string", "n int", "label string", buckets=1)
        store.add(spark.createDataFrame([(f"p{i}", day(1), 1, float(i), 0, "x") for i in range(50)], REPORTS))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("reports", "points"):
        ((folder,),) = store.store.state()[1][name].values()
        assert len([f for f in os.listdir(f"{tmp_path}/s/{folder}") if f.endswith(".parquet")]) > 1


# --- replies

SCHEMA = T.StructType(
    [
        T.StructField("a", T.StringType(), False), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("xs", T.ArrayType(T.StructType([T.StructField("b", T.BooleanType())]))), T.StructField("m", T.MapType(T.StringType(), T.LongType())),
    ]
)


def test_violations():
    assert violations({"a": "s", "n": 3, "x": 1, "xs": [{"b": True}, {}], "m": {"k": 1}, "more": 1}, SCHEMA) == []
    assert violations({"a": 1, "n": 1.5, "x": "1", "xs": [{"b": 0}, 3], "m": {"k": "v"}}, SCHEMA) == [
        "a: expected string, received integer", "n: expected integer, received number", "x: expected number, received string",
        "xs.0.b: expected boolean, received integer", "xs.1: expected object, received integer", "m.k: expected integer, received string",
    ]
    assert violations({}, SCHEMA) == ["a: required"] and violations([], SCHEMA) == ["(reply): expected object, received array"]
    assert violations({"a": "s", "n": 1 << 40}, SCHEMA) == ["n: expected integer, received integer"] and violations({"a": "s", "n": True}, SCHEMA)


def test_bare_replies():
    assert bare('```json\n{"a": 1}\n```') == '{"a": 1}' and bare('Sure: {"a": 1}') == '{"a": 1}' and bare("no") == "no"
    assert checked('{"a": "s", "n": 2}', SCHEMA) == ('{"a": "s", "n": 2}', None)
    assert checked('{"a": "s"', SCHEMA)[1].startswith("no JSON") and checked(None, SCHEMA)[0] is None


def counting(path: str):
    """A model that leaves a line for each call in a file."""

    def model(prompt: str) -> str:
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if "fail" in prompt and not os.path.exists(path + ".mended"):
            raise OSError("down")
        return prompt.upper()

    return model


def asked(path: str) -> list[str]:
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_each_prompt_is_called_once(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr("quillstone.operators.joins.SENT_VALUES", sent)
    log, memo = str(tmp_path / "log"), Table(spark, f"file://{tmp_path}/memo", calls.MEMO, ["key"], 2)
    rows = [(i, ["x", "y", "fail", None][i % 4], "clash") for i in range(40)] + [(99, "long " * 60_000, "clash")]
    df = spark.createDataFrame(rows, "id int, p string, reply0 string").repartition(6)
    first = {r.id: (r.reply, r.error) for r in calls.call_once(df, "p", counting(log), memo).collect()}
    assert first[0] == ("X", None) and first[2] == (None, "OSError: down") and first[3] == (None, "no prompt") and "context" in first[99][1] and len(first) == 41
    assert sorted(asked(log)) == ["fail", "x", "y"]
    more = df.unionByName(spark.createDataFrame([(200, "z", "")], df.schema))
    open(log + ".mended", "w").close()
    second = {r.id: r.reply for r in calls.call_once(more, "p", counting(log), memo).collect()}
    assert second[0] == "X" and second[2] == "FAIL" and second[200] == "Z"
    assert sorted(asked(log)) == ["fail", "fail", "x", "y", "z"]  # what failed is tried again, nothing else
    assert memo.read().count() == 4


def test_memo_meets_another_run(spark, tmp_path, monkeypatch):
    """A run that commits first makes the other one commit again; its replies are kept."""
    path = f"file://{tmp_path}/memo"
    memo, other = (Table(spark, path, calls.MEMO, ["key"], 2) for _ in range(2))
    df = spark.createDataFrame([(1, "p"), (2, "q")], "id int, p string")
    tries, insert = [], memo.insert_absent

    def late(batch, order):
        if not tries:
            other.insert_absent(df.where("id = 1").select(calls.key_of("p").alias("key"), F.lit("earlier").alias("reply"), F.lit(False).alias("cut_off")), [F.col("key")])
            tries.append(1)
            raise Conflict("another was faster")
        return insert(batch, order)

    monkeypatch.setattr(memo, "insert_absent", late)
    assert {r.id: r.reply for r in calls.call_once(df, "p", str.upper, memo).collect()} == {1: "earlier", 2: "Q"}


def test_replies_are_repaired(spark):
    def model(prompt):
        word = prompt.split()[0]
        if word == "shout" and "---" in prompt:
            raise ZeroDivisionError("division by zero")
        good = '{"a": "ok"}'
        return {"good": good, "typed": good if "a: expected string" in prompt else '{"a": 1}', "cut": good if "Be brief" in prompt else ('{"a": "o', True), "never": '{"n": 1}', "shout": "no json"}[word]

    df = spark.createDataFrame([(w,) for w in ("good", "typed", "cut", "never", "shout", "good")] + [(None,)], "p string").withColumn("id", F.monotonically_increasing_id())
    got = {(r.p, r.value, r.rounds, r.error) for r in calls.ask(df, ["p", "id"], "p", model, "a string not null, n int").collect()}
    assert got == {
        ("good", '{"a": "ok"}', 1, None), ("typed", '{"a": "ok"}', 2, None), ("cut", '{"a": "ok"}', 2, None), ("never", None, 2, "a: required"),
        ("shout", None, 2, "ZeroDivisionError: division by zero"), (None, None, 1, "no prompt"),
    }
    one = calls.ask(df.where("p = 'typed'"), ["p"], "p", model, "a string not null", rounds=1).first()
    assert (one.value, one.rounds, one.error) == (None, 1, "a: expected string, received integer")
    assert calls.ask(df.limit(0), ["p"], "p", model, "a string not null").count() == 0


@pytest.mark.parametrize("remembered", [False, True])
def test_only_prompts_that_are_asked_again_are_written(spark, tmp_path, monkeypatch, remembered):
    held, written = [], calls.written
    monkeypatch.setattr(calls, "written", lambda df, name: held.append(written(df, name)) or held[-1])
    word = "long " * 50
    model = lambda prompt: '{"a": "ok"}' if prompt.startswith("good") or "---" in prompt else '{"a": 1}'
    df = spark.createDataFrame([(i, f"{'typed' if i < 2 else 'good'} {i // 2} {word}") for i in range(20)] + [(20, None)], "id int, p string")
    memo = Table(spark, f"file://{tmp_path}/memo", calls.MEMO, ["key"], 2) if remembered else None
    got = {r.id: tuple(r)[1:] for r in calls.ask(df, ["id"], "p", model, "a string not null", memo=memo).collect()}
    assert got == {i: ('{"a": "ok"}', 2 if i < 2 else 1, None) for i in range(20)} | {20: (None, 1, "no prompt")}
    texts = [v for w in held for row in w.collect() for v in row if isinstance(v, str) and word in v]
    assert len(texts) == 1 and texts[0].startswith("typed")


def test_only_prompts_of_many_rows_are_repeated(spark, monkeypatch):
    monkeypatch.setattr("quillstone.operators.joins.SENT_VALUES", 0)
    monkeypatch.setattr(calls, "OFTEN", 5)
    df = spark.createDataFrame([(i, "many" if i < 30 else None if i < 35 else f"one {i}") for i in range(50)], "id int, p string")
    got = calls.ask(df, ["id"], "p", lambda prompt: json.dumps({"a": prompt}), "a string not null")
    said = {r.id: r.value and json.loads(r.value)["a"] for r in got.collect()}
    assert said == {r.id: r.p for r in df.collect()}
    right = got.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "__often" in right and "BroadcastHashJoin" in right


# --- tool rounds


def script(transcript: str) -> str:
    """Counts down from the number in its brief by asking the tool, and submits; 13 never does, 7 fails."""
    said = transcript.split("\n> ")
    n = int(transcript.split()[0])
    if n == 7:
        raise ValueError("seven")
    last = n if len(said) == 1 else said[-1].split("\n", 1)[1]
    if n == 13 or not str(last).isdigit() and last != "0":
        return json.dumps({"calls": [{"tool": "minus", "input": 5}]}) if n == 13 else json.dumps({"submit": {"steps": len(said) - 1}})
    return json.dumps({"calls": [{"tool": "minus", "input": int(last)}]}) if int(last) else json.dumps({"submit": {"steps": len(said) - 1}})


def by_row(brief: str, rounds: int):
    transcript, n_calls = brief, 0
    for n in range(1, rounds + 1):
        try:
            turn = json.loads(script(transcript))
        except Exception as e:
            return None, n, n_calls, f"{type(e).__name__}: {e}"
        if "submit" in turn:
            return json.dumps(turn["submit"]), n, n_calls, None
        for c in turn["calls"]:
            n_calls += 1
            transcript += f"\n> {c['tool']} {json.dumps(c['input'])}\n{c['input'] - 1 if c['input'] != 4 else 'No result.'}"
    return None, rounds, n_calls, f"no value after {rounds} rounds"


def test_tool_rounds_equal_a_loop_over_rows(spark):
    briefs = [(i, f"{i} is the number") for i in (0, 1, 2, 3, 5, 6, 7, 9, 13)]
    tools = {"minus": lambda asked: asked.where("input <> '4'").select("request", (F.col("input").cast("int") - 1).alias("output"))}
    got = calls.converse(spark.createDataFrame(briefs, "id int, brief string"), ["id"], "brief", script, tools, "steps int not null", rounds=6)
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {i: by_row(b, 6) for i, b in briefs}


def test_tool_rounds_of_nobody(spark):
    assert calls.converse(spark.createDataFrame([], "id int, brief string"), ["id"], "brief", script, {}, "steps int not null").count() == 0
    long = spark.createDataFrame([(1, "1 " + "word " * 60_000)], "id int, brief string")
    assert "context" in calls.converse(long, ["id"], "brief", script, {}, "steps int not null").first().error


# --- jobs


def test_workers_share_a_queue(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    path = f"file://{tmp_path}/q"
    queue = JobQueue(spark, path, buckets=2)
    queue.enqueue(spark.createDataFrame([(i, at(-i)) for i in range(9)], "job long, enqueued timestamp_ntz"))
    got: dict[str, list[int]] = {}

    def work(name: str):
        mine = JobQueue(spark, path, buckets=2)
        while jobs := mine.claim(name, at(0), 2):
            got.setdefault(name, []).extend(jobs)

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    while jobs := queue.claim("rest", at(0), 9):  # what conflicts left
        got.setdefault("rest", []).extend(jobs)
    every = [j for js in got.values() for j in js]
    assert sorted(every) == list(range(9)) and len(set(every)) == 9  # each exactly once
    assert {r.attempts for r in queue.read().collect()} == {1}
    owner = {j: w for w, js in got.items() for j in js}
    assert queue.complete(owner[0], [0], at(1)) == 1 and queue.complete(owner[0], [0], at(1)) == 0
    assert queue.complete("stranger", [1], at(1)) == 0
    assert queue.fail(owner[1], [1], at(1), "bad", most_attempts=2) == 1 and queue.requeue(owner[2], [2]) == 1
    assert queue.claim("late", at(20), 9) == [2, 1]  # the others run within their lease; older jobs come first
    assert queue.fail("late", [1], at(21), "bad again", most_attempts=2) == 1
    assert sorted(queue.claim("later", at(31), 9)) == [3, 4, 5, 6, 7, 8]  # left by their workers
    state = {r.job: (r.status, r.attempts) for r in queue.read().collect()}
    assert state[0] == ("done", 1) and state[1] == ("failed", 2) and state[2] == ("running", 2) and state[8] == ("running", 2)
    queue.enqueue(spark.createDataFrame([(0, at(0)), (50, at(0))], "job long, enqueued timestamp_ntz"))
    assert queue.read().count() == 10 and queue.claim("x", at(32), 9) == [50]


def test_a_queue_that_is_always_faster(spark, tmp_path, monkeypatch):
    queue = JobQueue(spark, f"file://{tmp_path}/q", buckets=2)
    queue.enqueue(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "job long, enqueued timestamp_ntz"))
    tries = []
    monkeypatch.setattr("quillstone.sources.sinks.Transaction.commit", lambda self: tries.append(1) or (_ for _ in ()).throw(Conflict("x")))
    assert queue.claim("w", datetime.datetime(2024, 1, 1)) == [] and len(tries) == 5


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_meet(spark, monkeypatch, sent):
    monkeypatch.setattr("quillstone.operators.joins.SENT_VALUES", sent)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(60)] + [(99, None)], "id int, k string")
    summary = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, n int")
    got = meet(rows, summary, "k", F.xxhash64("id"))
    assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, 1 if r.k == "hot" else None) for r in rows.collect())
