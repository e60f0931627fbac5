"""Calls and captions: segments, ordered text, merged cues, realigned lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div


def segment(turns: DataFrame, call: list[str], position: str, title: str, pattern: str = "(?i)analyst") -> DataFrame:
    """prepared until the first turn whose title matches, qa from there on."""
    first = F.min(F.when(F.col(title).rlike(pattern), F.col(position))).over(Window.partitionBy(*call))
    return turns.withColumn("segment", F.when(first.isNotNull() & (F.col(position) >= first), "qa").otherwise("prepared"))


def whole_text(turns: DataFrame, call: list[str], position: str, speaker: str, text: str, title: str | None = None) -> DataFrame:
    """Each call as one text, its turns in order under '[turn i — speaker, title]'."""
    who = F.concat_ws(", ", F.col(speaker), F.col(title)) if title else F.col(speaker)
    line = F.concat(F.lit("[turn "), F.col(position).cast("string"), F.lit(" — "), who, F.lit("]\n"), F.col(text))
    g = turns.groupBy(*call).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("line")))).alias("t"), F.count(F.lit(1)).alias("n_turns"))
    return g.select(*call, "n_turns", F.array_join(F.transform("t", lambda x: x["line"]), "\n\n").alias("text"))


def merge_cues(cues: DataFrame, video: list[str], start: str, end: str, text: str, seconds: float = 10.0) -> DataFrame:
    """Cues joined while the joined one stays under ten seconds; a video is one group."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cues.select(*video).schema.fields)

    def run(ks, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for a, b, t in pdf.sort_values([start, end])[[start, end, text]].itertuples(index=False, name=None):
            if out and b - out[-1][0] < seconds:
                out[-1][1] = b
                out[-1][2] = " ".join(f"{out[-1][2]} {t}".split())
            else:
                out.append([a, b, t])
        return pd.DataFrame([(*ks, *r) for r in out], columns=[*video, start, end, text])

    return cues.select(*video, start, end, text).groupBy(*video).applyInPandas(run, f"{types}, {start} double, {end} double, {text} string")


def looks_written(text: str) -> Column:
    """200 words or more, 0.04 marks a word, more than 2 % capitals: a person typed it."""
    c = F.trim(F.coalesce(F.col(text), F.lit("")))
    words = F.when(c == "", 0).otherwise(F.size(F.split(c, r"\s+")))
    marks, capitals, letters = (F.length(F.regexp_replace(c, p, "")) for p in ("[^.,;:!?]", "[^A-Z]", "[^A-Za-z]"))
    return (words >= 200) & (marks / F.greatest(words, F.lit(1)) >= 0.04) & (capitals / F.greatest(letters, F.lit(1)) > 0.02)


def realign(lines: DataFrame, cues: DataFrame, video: list[str], time: str, index: str, text: str) -> DataFrame:
    """Cleaned lines on their cues: by time, else by index; where less than half the cues find a line, the cues stay as they were."""
    by_time = lines.where(F.col(time).isNotNull()).select(*video, time, F.col(text).alias("t1")).dropDuplicates([*video, time])
    by_index = lines.select(*video, index, F.col(text).alias("t2")).dropDuplicates([*video, index])
    j = cues.join(by_time, [*video, time], "left").join(by_index, [*video, index], "left")
    share = F.avg(F.coalesce("t1", "t2").isNotNull().cast("double")).over(Window.partitionBy(*video))
    return j.withColumn("clean", F.coalesce("t1", "t2")).withColumn(text, F.when(share >= 0.5, F.coalesce("clean", text)).otherwise(F.col(text))).drop("t1", "t2", "clean")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def bull_index(df: DataFrame) -> DataFrame:
    """2 * strong buys + buys - (sells + 2 * strong sells), and all ratings."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    return df.withColumns({"bull_index": 2 * c("strong_buy") + c("buy") - (c("sell") + 2 * c("strong_sell")), "total": c("strong_buy") + c("buy") + c("hold") + c("sell") + c("strong_sell")})


def month_change(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Against the row before; no change counts as up."""
    prior = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    out = df.withColumn("prior", prior)
    delta = F.col(value) - F.col("prior")
    return out.withColumns({"delta": delta, "share": safe_div(delta, F.abs("prior")), "direction": F.when(F.col("prior").isNotNull(), F.when(delta >= 0, "up").otherwise("down"))})
