"""Findings, briefs and digests as text; projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SEVERITY_RANK
from ..functions.expr import first_of, rank_of


# How states and verdicts are shown.
HEALTH_LABEL = {"green": "🟢 Hold", "amber": "🟡 Watch", "red": "🔴 Exit"}
VERDICT_MARK = {"Strong": "🟢", "Watchlist": "🟡", "Pass": "🔴"}


def money(x: Column) -> Column:
    """$1.2B, $3.4M, $5K or $6."""
    a = F.abs(x)
    return first_of((x.isNull(), F.lit("n/a")), (a >= 1e9, F.format_string("$%.1fB", x / 1e9)), (a >= 1e6, F.format_string("$%.1fM", x / 1e6)), (a >= 1e3, F.format_string("$%.0fK", x / 1e3)), otherwise=F.format_string("$%.0f", x))


def percent(x: Column, signed: bool = True) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%+.1f%%" if signed else "%.1f%%", x * 100))


def digest(flips: DataFrame, thesis: str, item: str) -> DataFrame:
    """One text for each thesis: its items that changed, one a line."""
    line = F.concat(F.lit("- "), F.col(item).cast("string"), F.lit(": "), F.col("prior"), F.lit(" -> "), F.col("status"))
    g = flips.groupBy(thesis).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), line.alias("line")))).alias("l"))
    return g.select(thesis, F.concat(F.lit("## "), F.col(thesis).cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def brief(flags: DataFrame, by: str, most: int = 20) -> DataFrame:
    """A filing's merged flags in order of severity and occurrences (at most 20 are shown)."""
    rank = rank_of("severity", SEVERITY_RANK, -1)
    times = F.when(F.col("occurrences") > 1, F.concat(F.lit(" ×"), F.col("occurrences").cast("string"))).otherwise("")
    line = F.concat(F.lit("- **"), F.col("category"), F.lit("** ("), F.col("severity"), times, F.lit("): "), F.col("claim"))
    g = flags.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-rank).alias("r"), (-F.col("occurrences")).alias("o"), F.col("category").alias("c"), line.alias("line")))).alias("l"))
    return g.select(by, F.array_join(F.transform(F.slice("l", 1, most), lambda x: x["line"]), "\n").alias("text"))


def _lines(df: DataFrame, by: str, order: list[Column], line: Column, name: str, most: int | None = None) -> DataFrame:
    """One text for each key: its lines in order, at most so many."""
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("line")))).alias("l"))
    shown = F.slice("l", 1, most) if most else F.col("l")
    return g.select(by, F.array_join(F.transform(shown, lambda x: x["line"]), "\n").alias(name))


def brief_markdown(filings: DataFrame, by: str, flags: DataFrame, metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """A filing's brief as markdown: title, flags (or that there are none), metrics and claims where there are any, and how it came about.

    filings: by, ticker, form, filing_date, chunks, failed, dropped. flags: category,
    severity, claim, occurrences, quote. metrics: label, value, unit, period, prior
    (or null), quote, position. claims: claim, checkable, quote, position.
    """
    rank = rank_of("severity", SEVERITY_RANK, -1)
    raised = F.when(F.col("occurrences") > 1, F.concat(F.lit(" _(raised in "), F.col("occurrences").cast("string"), F.lit(" chunks)_"))).otherwise("")
    quoted = F.concat(F.lit('\n  - quote: "'), F.col("quote"), F.lit('"'))
    flag = F.concat(F.lit("- **["), F.col("severity"), F.lit("] "), F.col("category"), F.lit("** — "), F.col("claim"), raised, quoted)
    prior = F.when(F.col("prior").isNotNull(), F.concat(F.lit(" (prior: "), F.col("prior"), F.lit(")"))).otherwise("")
    metric = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.coalesce("value", F.lit("n/a")), F.lit(" "), F.col("unit"), F.lit(" — "), F.col("period"), prior, quoted)
    claim = F.concat(F.lit("- "), F.col("claim"), F.when(F.col("checkable"), " _(checkable)_").otherwise(""), quoted)
    parts = filings.join(_lines(flags, by, [-rank, -F.col("occurrences"), F.col("category"), F.col("claim")], flag, "__f"), by, "left")
    parts = parts.join(_lines(metrics, by, [F.col("position")], metric, "__m"), by, "left").join(_lines(claims, by, [F.col("position")], claim, "__c"), by, "left")
    part = lambda title, c, none: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n## {title}\n"), F.col(c))).otherwise(none)
    title = F.concat(F.lit("# "), F.col("ticker"), F.lit(" — "), F.col("form"), F.lit(" filed "), F.col("filing_date"))
    end = F.concat(F.lit("\n\n_"), F.col("chunks").cast("string"), F.lit(" chunks processed, "), F.col("failed").cast("string"), F.lit(" failed, "), F.col("dropped").cast("string"), F.lit(" findings dropped for unverifiable quotes._"))
    return parts.select(by, F.concat(title, part("Flags", "__f", "\n\n## Flags\n_none raised_"), part("Metrics", "__m", ""), part("Management claims", "__c", ""), end).alias("text"))


def card_markdown(cards: DataFrame, dimensions: DataFrame, by: str) -> DataFrame:
    """A decision card: verdict, score, summary, and its dimensions as a table.

    cards: by, verdict, score, summary. dimensions: by, position, label, score, spread (or null), uncertainty, weight.
    """
    one, two = (lambda p: lambda c: F.format_string(f"%.{p}f", F.col(c)))(1), (lambda p: lambda c: F.format_string(f"%.{p}f", F.col(c)))(2)
    row = F.concat(F.lit("| "), F.col("label"), F.lit(" | **"), one("score"), F.lit("** | "), F.coalesce(F.when(F.col("spread").isNotNull(), one("spread")), F.lit("—")), F.lit(" | "), F.when(F.col("uncertainty") == "high", "⚠️ **high**").otherwise(F.col("uncertainty")), F.lit(" | "), two("weight"), F.lit(" |"))
    table = _lines(dimensions, by, [F.col("position")], row, "__t")
    mark = first_of(*((F.col("verdict") == v, m) for v, m in VERDICT_MARK.items()), otherwise="⚪")
    head = F.concat(F.lit("# "), F.col(by).cast("string"), F.lit(" — Decision Card\n\n**Verdict:** "), mark, F.lit(" "), F.col("verdict"), F.lit("  •  **Weighted score:** "), one("score"), F.lit(" / 10\n\n## Summary\n\n"), F.col("summary"))
    body = F.concat(F.lit("\n\n## Dimension scores\n\n| Dimension | Score | Range | Uncertainty | Effective weight |\n|---|---|---|---|---|\n"), F.col("__t"))
    return cards.join(table, by, "left").select(by, F.concat(head, F.coalesce(body, F.lit(""))).alias("text"))


def escape(x: Column) -> Column:
    """Text that stands for itself in HTML."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    return x


def digest_html(flips: DataFrame, thesis: str, label: str, base: str) -> DataFrame:
    """One mail for each thesis: subject, and its changed items as an HTML list with a link."""
    named = lambda c: first_of(*((F.col(c) == k, v) for k, v in HEALTH_LABEL.items()))
    item = F.concat(F.lit("<li><b>"), escape(F.col(label)), F.lit("</b>: "), named("prior"), F.lit(" → "), named("status"), F.lit("</li>"))
    g = flips.groupBy(thesis).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("i"), item.alias("line")))).alias("l"))
    n = F.size("l")
    subject = F.concat(n.cast("string"), F.when(n == 1, " thesis state change").otherwise(" thesis state changes"))
    link = F.concat(F.lit(f'<a href="{base}/theses/'), F.url_encode(F.col(thesis).cast("string")), F.lit('">open</a>'))
    return g.select(thesis, subject.alias("subject"), F.concat(F.lit("<ul>"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</ul>"), link).alias("html"))


def trends_json(findings: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A key's findings as one JSON array, in the order of their columns."""
    return findings.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("json"))
