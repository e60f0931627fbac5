"""Chunks of a section under a token budget, with a prose overlap; budgets shared out over parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import row_by_row
from .tokens import estimate, head, tail

# The marks around what is repeated.
OVERLAP = "[context: end of previous chunk, for continuity only]"
OVERLAP_END = "[end of context — new material begins here]"
TABLE_GOES_ON = "[table continues from previous chunk]"
MOST, LEAST, REPEATED = 8000, 4000, 200

#: Parts that the first rows of a size are found in before they are found among all of its rows.
SPREAD = 64


def split_table(markdown: str, most: int = MOST) -> list[str]:
    """A table beyond the budget in row groups, each under the captions and header; one whose header alone takes four fifths stays whole."""
    lines = markdown.split("\n")
    at = next((i for i, line in enumerate(lines) if line.startswith("|")), None)
    if at is None:
        return [markdown]
    top, rows = lines[: at + 2], lines[at + 2 :]
    base = estimate("\n".join(top))
    if base >= most * 0.8:
        return [markdown]
    groups, size = [], base
    for row in rows:
        n = estimate(row) + 1
        if groups and size + n <= most:
            groups[-1].append(row)
            size += n
        else:
            groups.append([row])
            size = base + n
    texts = ["\n".join([*top, *g]) for g in groups] or [markdown]
    return [t if i == 0 else f"{TABLE_GOES_ON}\n{t}" for i, t in enumerate(texts)]


def pack(parts: list[tuple[str, str]], most: int = MOST, least: int = LEAST, repeated: int = REPEATED) -> list[dict]:
    """parts: (kind, markdown) in order. A chunk ends before what would overflow it, and before a heading once it has `least` tokens."""
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for kind, text in ((k, t) for k, m in parts for t in (split_table(m, most) if k == "table" and estimate(m) > most else [m])):
        n = estimate(text)
        if groups[-1] and (size + n > most or (size >= least and kind == "heading")):
            groups.append([])
            size = 0
        groups[-1].append((kind, text))
        size += n
    out = []
    groups = [g for g in groups if g]
    for i, g in enumerate(groups):
        before = ""
        if i and repeated > 0:
            prose = "\n\n".join(t for k, t in groups[i - 1] if k != "table")
            end = tail(prose, repeated) if prose else ""
            before = f"{OVERLAP}\n{end}\n{OVERLAP_END}\n\n" if end.strip() else ""
        text = before + "\n\n".join(t for _, t in g)
        out.append({"n": i, "total": len(groups), "n_blocks": len(g), "has_table": any(k == "table" for k, _ in g), "tokens": estimate(text), "text": text})
    return out


def chunk(blocks: DataFrame, key: list[str], most: int = MOST, least: int = LEAST, repeated: int = REPEATED) -> DataFrame:
    """blocks: key, ordinal, kind, markdown. A row for each chunk. A section's blocks are gathered in the JVM and packed section by section."""
    g = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "markdown"))).alias("__b"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*key).schema.fields)
    kinds = {"id": pa.string(), "n": pa.int32(), "total": pa.int32(), "n_blocks": pa.int32(), "has_table": pa.bool_(), "tokens": pa.int64(), "text": pa.string()}

    def rows(section: list[dict], *names) -> Iterator[tuple]:
        for r in pack([(x["kind"], x["markdown"]) for x in section], most, least, repeated):
            yield (":".join([*map(str, names), str(r["n"])]), *r.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from row_by_row(batch, rows, kinds)

    return g.mapInArrow(run, f"{types}, id string, n int, total int, n_blocks int, has_table boolean, tokens bigint, text string")


def body_only(text: str):
    """A chunk without what it repeats."""
    at = F.instr(F.col(text), OVERLAP_END)
    return F.when(at == 0, F.col(text)).otherwise(F.ltrim(F.regexp_replace(F.expr(f"substring(`{text}`, instr(`{text}`, '{OVERLAP_END}') + {len(OVERLAP_END)})"), r"^\s+", "")))


def paragraphs(text: str | None, size: int = 4000) -> list[str]:
    """Paragraphs joined up to about `size` characters; a paragraph half as long again is cut hard."""
    out, now = [], ""
    for p in re.split(r"\n\s*\n", text or ""):
        pieces = [p[i : i + size] for i in range(0, len(p), size)] if len(p) > size * 1.5 else [p]
        for x in pieces:
            if now and len(now) + len(x) + 2 > size:
                out.append(now)
                now = ""
            now = f"{now}\n\n{x}" if now else x
    return [*out, now] if now.strip() else out


def water_fill(sizes: list[int], budget: int) -> list[int]:
    """Shares of a budget: whoever needs less than an even share of the rest gets what it needs, the others split what is left evenly."""
    out, left, open_ = [0] * len(sizes), budget, set(range(len(sizes)))
    while open_:
        share = left // len(open_)
        small = [i for i in open_ if sizes[i] <= share]
        if not small:
            for k, i in enumerate(sorted(open_)):
                out[i] = share + (k < left - share * len(open_))
            break
        for i in small:
            out[i] = sizes[i]
            left -= sizes[i]
            open_.discard(i)
    return out


def fit(ranked: list[tuple[int, int]], budget: int) -> list[int]:
    """(position, size) in order of rank: take what still fits, pass over what does not; the positions in order."""
    took, left = [], budget
    for at, size in ranked:
        if size <= left:
            took.append(at)
            left -= size
    return sorted(took)


def allocate(df: DataFrame, by: list[str], part: str, size: str, budget: int) -> DataFrame:
    """water_fill() of each key's parts (a number, distinct in a key; the first parts in order get what is left over of even shares).

    Only a histogram of sizes is put in order by key: a size is met in full while
    all smaller ones and it, taken for every part that is left, stay within the
    budget. That fixes the level; the rest is a projection. Where parts share a
    left-over, they are numbered within ranges of `part`, so no key is sorted in
    one task.
    """
    df = df.select(*by, part, F.col(size).cast("bigint").alias(size))
    sizes = df.groupBy(*by, size).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    below = w.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    level = sizes.withColumns({"__n": F.sum("n").over(w), "__met": F.coalesce(F.sum("n").over(below), F.lit(0)), "__used": F.coalesce(F.sum(F.col(size) * F.col("n")).over(below), F.lit(0))})
    full = F.col(size) * (F.col("__n") - F.col("__met")) <= budget - F.col("__used")
    ends = level.withColumn("__full", full).groupBy(*by).agg(F.max("__n").alias("__n"), F.max(F.when(F.col("__full"), F.col(size))).alias("__most"), F.coalesce(F.sum(F.when(F.col("__full"), F.col("n"))), F.lit(0)).alias("__met"), F.coalesce(F.sum(F.when(F.col("__full"), F.col(size) * F.col("n"))), F.lit(0)).alias("__used"))
    left, open_ = budget - F.col("__used"), F.col("__n") - F.col("__met")
    share = F.when(open_ > 0, F.floor(left / F.greatest(open_, F.lit(1))).cast("bigint")).otherwise(0)
    ends = ends.withColumn("__share", share).withColumn("__over", F.when(open_ > 0, left - F.col("__share") * open_).otherwise(0)).select(*by, "__most", "__share", "__over")
    j = df.join(ends, by).withColumn("__open", F.col("__most").isNull() | (F.col(size) > F.col("__most")))
    # the open parts of keys with a left-over, numbered: ranges of part by their quantiles, counts before, places within
    spread = j.where(F.col("__open") & (F.col("__over") > 0)).select(*by, part)
    cuts = spread.groupBy(*by).agg(F.percentile_approx(part, F.array(*(F.lit(i / 32) for i in range(1, 32))), F.lit(1000)).alias("__cuts"))
    ranged = spread.join(cuts, by).select(*by, part, F.size(F.filter("__cuts", lambda c: c < F.col(part))).alias("__range"))
    before = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(part)) + F.col("__before")
    placed = ranged.join(before, [*by, "__range"]).select(*by, part, place.alias("__place"))
    out = j.join(placed, [*by, part], "left")
    got = F.when(F.col("__open"), F.col("__share") + (F.coalesce(F.col("__place") <= F.col("__over"), F.lit(False))).cast("bigint")).otherwise(F.col(size))
    return out.select(*by, part, size, got.alias("share"))


def paragraph_chunks(df: DataFrame, keep: list[str], text: str, size: int = 4000) -> DataFrame:
    """A row for each of paragraphs(): keep, part (from 0), text."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paragraphs(t, size))

    return df.select(*keep, F.posexplode(cut(text)).alias("part", "text"))


def fit_budget(df: DataFrame, by: list[str], rank: list[str], position: str, size: str, budget: int) -> DataFrame:
    """Of each key the rows that fit() takes in the order of rank (then position): by, position. Rows without a size are not taken; no size is below zero.

    What was taken shrinks the budget for what follows. So of rows of one size those
    taken come first: after one of them did not fit, none does. Of a size only as many
    can be taken as the budget holds, so only its first budget / size rows can matter;
    rows of size zero always fit. What is left of a key is bounded by the budget, not by
    the key: at most the sum of budget / size over its distinct sizes, which is under
    budget * (1 + ln(budget)). That is folded by fit(). The first rows of a size are
    found within SPREAD parts of it first, so no task sorts a key or a size whole.
    """
    x = df.select(*by, *(F.col(c).alias(f"__r{i}") for i, c in enumerate(rank)), F.col(position).alias("__p"), F.col(size).cast("bigint").alias("__s"))
    free = x.where("__s = 0").select(*by, F.col("__p").alias(position))
    order = [f"__r{i}" for i in range(len(rank))] + ["__p"]
    x = x.where((F.col("__s") > 0) & (F.col("__s") <= budget)).withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(SPREAD)))
    holds = F.floor(F.lit(budget) / F.col("__s"))
    for within in ([*by, "__s", "__part"], [*by, "__s"]):
        x = x.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("__n") <= holds)
    kind = df.schema[position].dataType.simpleString()

    @F.pandas_udf(f"array<{kind}>")
    def taken(positions: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[p[i] for i in fit(list(enumerate(s)), budget)] for p, s in zip(positions, sizes)], dtype=object)

    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "__s"))).alias("__e"))
    return g.select(*by, F.explode(taken(F.col("__e.__p"), F.col("__e.__s"))).alias(position)).unionByName(free)


def trim(lists: dict[str, list[str]], floors: dict[str, int], target: int) -> dict[str, list[str]]:
    """Drop the last entry of each list in the order of floors, down to its floor, until the whole is within the target."""
    total = sum(estimate(x) for xs in lists.values() for x in xs)
    out = {k: list(v) for k, v in lists.items()}
    for name, floor in floors.items():
        while total > target and len(out[name]) > floor:
            total -= estimate(out[name].pop())
    return out


def truncate(text: str | None, most: int) -> str | None:
    return None if text is None else head(text, most)
