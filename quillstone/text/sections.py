"""Sections of a filing by scored anchors, and items of a current report."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import first_of

# Sections by item, with title words where item numbers repeat; and what each signal of an anchor is worth.
TENK_ITEMS = (("business", "1", ()), ("risk-factors", "1A", ()), ("properties", "2", ()), ("legal-proceedings", "3", ()), ("mda", "7", ()), ("quant-risk", "7A", ()), ("financial-statements", "8", ()))
TENQ_ITEMS = (("financial-statements", "1", ("financial statements",)), ("mda", "2", ("management's discussion",)), ("quant-risk", "3", ()), ("risk-factors", "1A", ()))
SIGNALS = {"heading": 4, "bold_tag": 2, "bold_style": 3, "large_font": 2, "capitals": 2, "top_level": 2, "in_table": -5, "blue": -4, "link": -3, "page_number": -4, "long": -3}
LEAST_SCORE = -2
# Items of a current report and their severity.
EIGHTK_SEVERITY = {
    "critical": ("1.03", "2.04", "3.01", "4.01", "4.02"),
    "high": ("1.02", "2.05", "2.06", "3.02", "3.03", "5.02"),
    "medium": ("1.01", "2.01", "2.02", "2.03", "5.01", "5.03"),
    "low": ("7.01", "8.01", "9.01"),
}
_ITEM = re.compile(r"^\s*item\s+(\d{1,2}[a-c]?)\b", re.IGNORECASE)
_PAGE = re.compile(r"\s\d{1,3}\s*$")


class _Anchors(HTMLParser):
    """Elements whose text starts like an item, with their signals, and the whole text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.size = 0
        self.parts: list[str] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        style = re.sub(r"\s+", " ", dict(attrs).get("style") or "").lower()
        if tag in ("br", "hr", "img", "input", "meta", "link"):
            return
        bold = re.search(r"font-weight: ?(bold|[6-9]00)", style) is not None
        m = re.search(r"font-size: ?([\d.]+)(pt|px)", style)
        large = m is not None and float(m[1]) >= (12 if m[2] == "pt" else 16)
        blue = re.search(r"color: ?(blue|#0000(ff|ee))", style) is not None
        for e in self.open:  # a style inside counts for what is around it
            e["bold_style"] |= bold
            e["large_font"] |= large
        self.open.append({"tag": tag, "bold_style": bold, "large_font": large, "blue": blue, "at": self.size, "depth": len([e for e in self.open if e["tag"] not in ("html", "body")]), "in_table": any(e["tag"] == "table" for e in self.open)})

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                for e in self.open[i:]:
                    self._close(e)
                del self.open[i:]
                return

    def handle_data(self, data):
        if any(e["tag"] in ("script", "style", "head") for e in self.open):
            return
        self.parts.append(data)
        self.size += len(data)

    def _close(self, e: dict) -> None:
        text = "".join(self.parts)[e["at"] : self.size].strip() if self.size - e["at"] <= 600 else ""
        m = _ITEM.match(text) if 0 < len(text) <= 500 else None
        if not m:
            return
        s = {
            "heading": e["tag"] in ("h1", "h2", "h3", "h4"),
            "bold_tag": e["tag"] in ("b", "strong"),
            "bold_style": e["bold_style"],
            "large_font": e["large_font"],
            "capitals": len(text) < 200 and text == text.upper(),
            "top_level": e["depth"] <= 1,
            "in_table": e["in_table"],
            "blue": e["blue"],
            "link": e["tag"] == "a",
            "page_number": _PAGE.search(text) is not None,
            "long": len(text) > 300,
        }
        self.found.append({"item": m[1].upper(), "at": e["at"], "title": re.sub(r"\s+", " ", text)[:200], "score": sum(SIGNALS[k] for k, v in s.items() if v)})


def anchors(html: str | None) -> tuple[list[dict], str]:
    p = _Anchors()
    p.feed(html or "")
    p.close()
    near: list[dict] = []
    for a in sorted(p.found, key=lambda a: a["at"]):  # elements around one another: the longer title, the better score
        if near and near[-1]["item"] == a["item"] and a["at"] - near[-1]["at"] <= 5:
            old = near[-1]
            near[-1] = {**(a if len(a["title"]) > len(old["title"]) else old), "score": max(a["score"], old["score"]), "at": old["at"]}
        else:
            near.append(a)
    return near, "".join(p.parts)


def cut(html: str | None, items: tuple, stub: int) -> list[tuple]:
    """(section, score, text, bundled_from) of one filing's sections, in the order of their places."""
    found, body = anchors(html)
    best = {}
    for section, item, words in items:
        fit = [a for a in found if a["item"] == item and a["score"] >= LEAST_SCORE and (not words or any(w in a["title"].lower() for w in words))]
        if fit:
            best[section] = max(fit, key=lambda a: (a["score"], a["at"]))
    placed = sorted(best.items(), key=lambda x: (x[1]["at"], x[0]))
    ends = [a["at"] for _, a in placed[1:]] + [len(body)]
    texts = [body[a["at"] : end].strip(" ") for (_, a), end in zip(placed, ends)]
    whole = [i for i, t in enumerate(texts) if len(t) >= stub]
    out = []
    for i, (section, a) in enumerate(placed):
        other = None if len(texts[i]) >= stub else next((j for j in whole if j > i), next((j for j in reversed(whole) if j < i), None))
        out.append((section, a["score"], texts[i], None) if other is None else (section, a["score"], texts[other], placed[other][0]))
    return out


def sections(filings: DataFrame, key: str, html: str, items: tuple = TENK_ITEMS, stub: int = 200) -> DataFrame:
    """A row for each section found: key, section, score, text, bundled_from.

    Of an item's anchors (those with its title words, where it has any) the best
    score wins, the later of equals; below -2 the section is missing. A section
    runs to the next chosen anchor; a stub takes the text of the nearest one that
    is none, forward first. Anchors are chosen and sections cut where the filing is
    read, so no text is shuffled; each row is a filing of its own, keys that repeat
    or are null included, and a null filing has no sections.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(k, *r) for k, h in zip(pdf[key], pdf[html]) for r in cut(h, items, stub)]
            yield pd.DataFrame(rows, columns=[key, "section", "score", "text", "bundled_from"])

    kind = filings.schema[key].dataType.simpleString()
    return filings.select(key, html).mapInPandas(run, f"`{key}` {kind}, section string, score int, text string, bundled_from string")


def item_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s) for s, ns in EIGHTK_SEVERITY.items() for n in ns], "number string, severity string")


def eightk_items(blocks: DataFrame, key: str) -> DataFrame:
    """Items of current reports from their blocks: a short block that is no table and starts with 'Item N.NN' opens one; unknown items are low."""
    number = F.regexp_extract("text", r"(?i)^\s*item\s+([0-9]\.[0-9]{2})", 1)
    starts = (number != "") & (F.col("kind") != "table") & (F.length("text") <= 300)
    w = Window.partitionBy(key).orderBy("ordinal")
    marked = blocks.withColumns({"starts": starts, "number": F.when(starts, number)}).withColumn("part", F.sum(F.col("starts").cast("int")).over(w))
    g = marked.where("part > 0").groupBy(key, "part").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("ordinal", "markdown"))).alias("b"))
    body = F.array_join(F.transform(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), lambda x: x["markdown"]), "\n\n")
    out = g.select(key, "part", "number", body.alias("body")).join(F.broadcast(item_table(blocks.sparkSession)), "number", "left")
    return out.withColumns({"known": F.col("severity").isNotNull(), "severity": F.coalesce("severity", F.lit("low"))})


def length_confidence(length: Column, floor: Column) -> Column:
    return first_of((length < floor * 0.3, "failed"), (length < floor, "low"), otherwise="high")


def locate(section: str, blocks: list[str], probe: int = 200, least: int = 40) -> tuple[int, int] | None:
    """The first and last of a document's blocks that a section covers: its letters and digits, head and tail, looked up in theirs."""
    squash = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    text = squash(section)
    if len(text) < least:
        return None
    ends, joined = [], ""
    for b in blocks:
        joined += squash(b)
        ends.append(len(joined))
    start = joined.find(text[:probe])
    if start < 0:
        return None
    stop = joined.find(text[-probe:], start)
    stop = len(joined) if stop < 0 else stop + min(probe, len(text))
    first = next(i for i, e in enumerate(ends) if e > start)
    last = next(i for i, e in enumerate(ends) if e >= stop)
    return first, last


def located(df: DataFrame, keep: list[str], section: str, blocks: str) -> DataFrame:
    """locate() for a section's text and its document's blocks (an array): keep, first, last; sections that are not found are left out. Each is looked up once, in Arrow batches."""

    @F.pandas_udf("array<array<int>>")
    def found(texts: pd.Series, parts: pd.Series) -> pd.Series:
        at = (locate(t or "", [] if b is None else [x or "" for x in b]) for t, b in zip(texts, parts))
        return pd.Series([[] if x is None else [list(x)] for x in at], dtype=object)

    return df.select(*keep, F.explode(found(section, blocks)).alias("__at")).select(*keep, F.col("__at")[0].alias("first"), F.col("__at")[1].alias("last"))
