"""Calls of a model over rows: each prompt once, replies validated and repaired, rounds of tools.

A model is a function from a prompt to a reply, or to a reply and whether it was cut
off. It is called batch by batch on the executors, at most once for a distinct
prompt; what it answered is written before anything else uses it, so that no later
step calls it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions.replies import checked
from ..session import written
from ..sources.sinks import Conflict, Table
from .joins import meet

MEMO = "key string, reply string, cut_off boolean"
#: A model's context and the room that a reply needs, in tokens.
CONTEXT, RESERVE = 16_000, 7_168
#: Rows that share a prompt, from which on they meet its outcome in slices.
OFTEN = 10_000
#: Commits that another writer may make first before a run gives up.
TRIES = 5

Model = Callable[[str], "str | tuple[str, bool]"]


def key_of(prompt: str | Column) -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


def replies(prompts: DataFrame, model: Model, context: int = CONTEXT, reserve: int = RESERVE, whole: bool = False) -> DataFrame:
    """prompts has (key, prompt). key, reply, cut_off, error, and the prompt if `whole`: a prompt that leaves no room for a reply is refused, not shortened; a call that raises is a row with an error."""
    from ..text.tokens import estimate

    def one(prompt: str | None) -> tuple:
        if prompt is None:
            return None, None, "no prompt"
        need = estimate(prompt) + reserve
        if need > context:
            return None, None, f"prompt and reply need {need} tokens, the context has {context}"
        try:
            got = model(prompt)
        except Exception as e:  # a failed call is a result
            return None, None, f"{type(e).__name__}: {e}"
        text, cut = got if isinstance(got, tuple) else (got, False)
        return text, cut, None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [one(p) for p in pdf["prompt"]]
            more = {"prompt": pdf["prompt"]} if whole else {}
            yield pd.DataFrame({"key": pdf["key"], "reply": [o[0] for o in out], "cut_off": pd.array([o[1] for o in out], "boolean"), "error": [o[2] for o in out], **more})

    return prompts.select("key", "prompt").mapInPandas(run, f"{MEMO}, error string{', prompt string' if whole else ''}")


def call_once(df: DataFrame, prompt: str, model: Model, memo: Table | None = None, context: int = CONTEXT, reserve: int = RESERVE) -> DataFrame:
    """df with reply, cut_off and error of its prompts.

    Distinct prompts that the memo does not hold are called, once each whatever rows
    share them, and what succeeded is inserted in one transaction; of two runs that
    meet, the second finds the first's replies and keeps them. Failures are not
    remembered: the next run tries them again. Null prompts give an error.
    """
    rows = df.withColumn("key", key_of(prompt))
    asked = rows.where(F.col(prompt).isNotNull()).groupBy("key").agg(F.first(prompt).alias("prompt"))
    if memo is not None:
        asked = asked.join(memo.read().select("key"), "key", "left_anti")
    called = written(replies(asked, model, context, reserve), "replies")
    known = called
    if memo is not None:
        for left in reversed(range(TRIES)):
            try:
                memo.insert_absent(called.where("error IS NULL").select("key", "reply", "cut_off"), [F.col("key")])
                break
            except Conflict:
                if not left:
                    raise
        mine = rows.select("key").distinct()
        known = written(memo.read().join(mine, "key", "left_semi").withColumn("error", F.lit(None).cast("string")).unionByName(called.where("error IS NOT NULL")), "known")
    size = F.lit(4) + F.floor(F.coalesce(F.length("reply"), F.lit(0)) / 8)
    out = meet(rows, known, "key", F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map"))), size)
    return out.withColumn("error", F.when(F.col(prompt).isNull(), "no prompt").otherwise(F.col("error"))).drop("key")


# What a second prompt adds, and what it asks for after a reply that was cut off.
_WRONG = "\n\n---\nThe last reply did not pass:\n{}\n\nReply again with the corrected JSON only."
_SHORTER = "\n\n---\nThe last reply was cut off before its end. Be brief: reply with complete JSON and the most important entries only."


def _judged(schema: DataType) -> Callable:
    """Of each reply its value or what is wrong; the prompt stays only where something more is to be asked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for prompt, reply, cut, failed in zip(pdf["prompt"], pdf["reply"], pdf["cut_off"], pdf["error"], strict=True):
                value, wrong = (None, None) if failed is not None else checked(reply, schema)
                more = None if wrong is None else _SHORTER if cut is True or cut == 1 else _WRONG.format(wrong)
                out.append((value, failed if failed is not None else "cut off" if more == _SHORTER else wrong, more, None if more is None else prompt))
            yield pd.DataFrame({"of": pdf["of"], "value": [o[0] for o in out], "error": [o[1] for o in out], "more": [o[2] for o in out], "prompt": [o[3] for o in out]})

    return run


def ask(df: DataFrame, key: list[str], prompt: str, model: Model, schema: DataType | str, rounds: int = 2, memo: Table | None = None, context: int = CONTEXT, reserve: int = RESERVE) -> DataFrame:
    """key, value (valid JSON or null), rounds, error: replies that break the schema go into another round, with what is wrong in the prompt; only those prompts do.

    schema: a struct whose fields that may not be null are required. A failed call
    is not repaired. After the last round the error of a row that never passed stays.
    Prompts are shuffled once, to find the distinct ones. The rounds are of distinct
    prompts, known by their hash (of); rows, without their prompts, meet the outcome.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = df.select(*key, key_of(prompt).alias("__of"))
    open_ = df.where(F.col(prompt).isNotNull()).groupBy(key_of(prompt).alias("of")).agg(F.first(prompt).alias("prompt"))
    done = []
    for n in range(1, rounds + 1):
        # what is added could make two prompts equal; they are one call then
        if memo is not None or n > 1 and not open_.groupBy(key_of("prompt")).count().where("count > 1").isEmpty():
            answered = call_once(open_, "prompt", model, memo, context, reserve)
        else:
            answered = replies(open_.select(F.col("of").alias("key"), "prompt"), model, context, reserve, whole=True).withColumnRenamed("key", "of")
        judged = answered.select("of", "prompt", "reply", "cut_off", "error").mapInPandas(_judged(schema), "of string, value string, error string, more string, prompt string")
        judged = written(judged if n < rounds else judged.drop("prompt"), f"round-{n}")
        over = F.col("more").isNull() if n < rounds else F.lit(True)
        done.append(judged.where(over).select(F.col("of").alias("__of"), "value", F.lit(n).alias("rounds"), "error"))
        if n < rounds:
            open_ = judged.where(~over).select("of", F.concat("prompt", "more").alias("prompt"))
            if open_.isEmpty():
                break
    outcome = done[0]
    for part in done[1:]:
        outcome = outcome.unionByName(part)
    size = F.lit(12) + F.floor((F.coalesce(F.length("value"), F.lit(0)) + F.coalesce(F.length("error"), F.lit(0))) / 8)
    out = meet(rows, outcome, "__of", F.xxhash64(*(F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith("map"))), size, often=lambda: written(rows.groupBy("__of").count().where(F.col("__of").isNotNull() & (F.col("count") > OFTEN)).select("__of"), "often"))
    none = F.col("__of").isNull()
    return out.select(*key, "value", F.when(none, 1).otherwise(F.col("rounds")).alias("rounds"), F.when(none, "no prompt").otherwise(F.col("error")).alias("error"))


Tool = Callable[[DataFrame], DataFrame]
_TURN = "__calls array<struct<tool: string, input: string>>, value string, __wrong string, error string"


def _turns(model: Model, schema: DataType, context: int, reserve: int) -> Callable:
    """The model's reply to each transcript: a list of tool requests, or an answer under the schema, or what is wrong."""
    import json

    from ..text.tokens import estimate

    def one(transcript: str) -> tuple[list | None, str | None, str | None, str | None]:
        need = estimate(transcript) + reserve
        if need > context:
            return None, None, None, f"transcript and reply need {need} tokens, the context has {context}"
        try:
            got = model(transcript)
            turn = json.loads(got[0] if isinstance(got, tuple) else got)
            if "submit" in turn:
                value, wrong = checked(json.dumps(turn["submit"]), schema)
                return None, value, wrong, None
            return [(str(c["tool"]), json.dumps(c.get("input"), sort_keys=True)) for c in turn["calls"]], None, None, None
        except Exception as e:  # a failed call ends its row
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [one(t) for t in pdf["__transcript"]]
            calls = [None if c is None else [{"tool": t, "input": i} for t, i in c] for c, *_ in out]
            yield pdf.assign(__calls=calls, value=[o[1] for o in out], __wrong=[o[2] for o in out], error=[o[3] for o in out])

    return run


def converse(df: DataFrame, key: list[str], prompt: str, model: Model, tools: dict[str, Tool], schema: DataType | str, rounds: int = 16, context: int = CONTEXT, reserve: int = RESERVE) -> DataFrame:
    """key, value, rounds, n_calls, error: the model asks tools, reads their answers and submits a value under the schema, in at most `rounds` rounds.

    Its reply is JSON: {"calls": [{"tool", "input"}, ...]} or {"submit": value}. tools:
    for each name a function of a DataFrame (request, input: JSON) to (request, output:
    text), so the requests of all rows of a round are one join of each tool; a request
    without an output is told so, and one of an unknown tool which tools there are. A
    value that breaks the schema is answered with what is wrong. The answers are added
    to the transcript in the order of the requests; rows that have a value or an error
    leave. Each round's state is written, so a lost executor repeats no call of a
    round that is over. Keys are unique.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = tuple(sorted(tools))
    open_ = df.select(*key, F.col(prompt).alias("__transcript"), F.lit(0).alias("n_calls"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema.fields)
    done = []
    for n in range(1, rounds + 1):
        turn = written(open_.mapInPandas(_turns(model, schema, context, reserve), f"{types}, {_TURN}"), f"turn-{n}")
        over = F.col("value").isNotNull() | F.col("error").isNotNull()
        count = F.col("n_calls") + F.coalesce(F.size("__calls"), F.lit(0))
        done.append(turn.where(over).select(*key, "value", F.lit(n).alias("rounds"), "n_calls", "error"))
        rest = turn.where(~over)
        if n == rounds:
            done.append(rest.select(*key, "value", F.lit(n).alias("rounds"), count.alias("n_calls"), F.lit(f"no value after {rounds} rounds").alias("error")))
            break
        if rest.isEmpty():
            break
        each = rest.where(F.size("__calls") > 0).select(*key, F.posexplode("__calls").alias("__at", "__c"))
        each = written(each.select(*key, "__at", "__c.tool", "__c.input", F.sha2(F.concat_ws("\u0001", "__c.tool", "__c.input"), 256).alias("request")), f"requests-{n}")
        # equal requests of different rows are one
        asked = each.groupBy("request").agg(F.first("tool").alias("tool"), F.first("input").alias("input"))
        outputs = asked.where(~F.col("tool").isin(*names)).select("request", F.concat(F.lit("Unknown tool; there are: "), F.lit(", ".join(names))).alias("output"))
        for name in names:
            got = tools[name](asked.where(F.col("tool") == name).select("request", "input"))
            outputs = outputs.unionByName(got.select("request", F.col("output").cast("string").alias("output")))
        answered = each.join(outputs.groupBy("request").agg(F.min("output").alias("output")), "request", "left")
        line = F.concat(F.lit("\n> "), "tool", F.lit(" "), "input", F.lit("\n"), F.coalesce("output", F.lit("No result.")))
        said = answered.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", line.alias("line")))), lambda x: x["line"]), "").alias("__said"))
        told = F.coalesce(F.col("__said"), F.when(F.col("__wrong").isNotNull(), F.concat(F.lit("\n> submit\nNot accepted:\n"), "__wrong")).otherwise(F.lit("\nAsk a tool or submit.")))
        open_ = written(rest.join(said, key, "left").select(*key, F.concat("__transcript", told).alias("__transcript"), count.alias("n_calls")), f"state-{n}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
