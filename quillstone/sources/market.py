"""Market and feed sources: bars, year-end closes, revisions, scraped indexes, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(df: DataFrame, symbol: str, date: str, close: str, adjusted: str) -> DataFrame:
    """Daily bars with a close; an adjusted close that is missing or not positive is the close."""
    adj = F.when(F.col(adjusted) > 0, F.col(adjusted)).otherwise(F.col(close))
    return df.where(F.col(close).isNotNull()).select(symbol, date, F.col(close).alias("raw_close"), adj.alias("close"))


def year_end_closes(df: DataFrame, symbol: str, date: str, close: str) -> DataFrame:
    """The last bar of each calendar year."""
    return df.where(F.col(close).isNotNull()).groupBy(symbol, F.year(date).alias("year")).agg(F.max_by(close, date).alias("close"), F.max(date).alias("date"))


def union_feeds(feeds: list[DataFrame], date: str, *ties: str) -> DataFrame:
    """All feeds, newest first; columns that a feed lacks are null."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.col(date).desc(), *ties)


def with_prior_month(df: DataFrame, symbol: str, date: str, value: str) -> DataFrame:
    return df.withColumn(f"prior_{value}", F.lag(value).over(Window.partitionBy(symbol).orderBy(date)))


def scraped_index(html: Column, label: str) -> Column:
    """The first number after a label in a page (thousands separators allowed); above 0, else null."""
    number = F.regexp_extract(html, rf"(?is){label}.{{0,200}}?([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    value = F.expr("try_cast(null as double)") if number is None else F.regexp_replace(number, ",", "").try_cast("double")
    return F.when(value > 0, value)


def capture_times(json: Column) -> Column:
    """14-digit capture times of an archive's JSON rows; the column is found by the header row."""
    rows = F.from_json(json, "array<array<string>>")
    at = F.array_position(rows[0], "timestamp").cast("int")
    stamps = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.try_element_at(r, at))
    return F.filter(F.when(at > 0, stamps), lambda t: t.rlike("^[0-9]{14}$"))


def caption_cues(json: Column) -> Column:
    """Cues (start, end, text) of JSON captions, in whole seconds (half up); empty ones go."""
    events = F.from_json(json, "struct<events: array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>>")["events"]
    whole = lambda ms: F.floor(ms / 1000 + 0.5).cast("double")
    start = lambda e: F.coalesce(e["tStartMs"], F.lit(0.0))
    text = lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    cue = lambda e: F.struct(whole(start(e)).alias("start"), whole(start(e) + F.coalesce(e["dDurationMs"], F.lit(0.0))).alias("end"), text(e).alias("text"))
    return F.filter(F.transform(F.filter(events, lambda e: e["segs"].isNotNull()), cue), lambda c: c["text"] != "")


def chapters(description: Column) -> Column:
    """Lines that start with a time: (seconds, title). Fewer than three, or times out of order, are no chapters: an empty array."""
    line = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s+[-–—]?\s*(\S.*)$"
    lines = F.filter(F.transform(F.split(description, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(line))

    def one(x: Column) -> Column:
        a, b, c = (F.regexp_extract(x, line, i) for i in (1, 2, 3))
        seconds = F.when(c == "", a.cast("int") * 60 + b.cast("int")).otherwise(a.cast("int") * 3600 + b.cast("int") * 60 + c.try_cast("int"))
        return F.struct(seconds.alias("seconds"), F.trim(F.regexp_extract(x, line, 4)).alias("title"))

    found = F.transform(lines, one)
    later = F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda x: x["seconds"])
    ordered = F.forall(F.arrays_zip(F.slice(F.transform(found, lambda x: x["seconds"]), 1, F.greatest(F.size(found) - 1, F.lit(0))).alias("a"), later.alias("b")), lambda z: z["a"] <= z["b"])
    return F.when((F.size(found) >= 3) & ordered, found).otherwise(F.slice(found, 1, 0))


def timed_text(xml: Column) -> Column:
    """Cues (start, end, text) of captions as XML text elements, whole seconds (half up); entities are read, empty ones go."""
    element = r'<text\s+start="([0-9.]+)"\s+dur="([0-9.]+)"[^>]*>([\s\S]*?)</text>'
    whole = lambda x: F.floor(x + 0.5).cast("double")

    def one(m: Column) -> Column:
        start, length, text = (F.regexp_extract(m, element, i) for i in (1, 2, 3))
        for mark, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
            text = F.replace(text, F.lit(mark), F.lit(plain))
        return F.struct(whole(start.cast("double")).alias("start"), whole(start.cast("double") + length.cast("double")).alias("end"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))

    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(element), F.lit(0)), one), lambda c: c["text"] != "")


def market_snapshot(quotes: DataFrame, symbol: str, price: str, cap: str, high: str, low: str, volume_3m: str, volume_10d: str) -> DataFrame:
    """ticker, price, market_cap, high_52w, low_52w and avg_dollar_volume (of three months, else ten days; null without a price)."""
    volume = F.coalesce(volume_3m, volume_10d)
    return quotes.select(F.upper(symbol).alias("ticker"), F.col(price).alias("price"), F.col(cap).alias("market_cap"), F.col(high).alias("high_52w"), F.col(low).alias("low_52w"), (F.col(price) * volume).alias("avg_dollar_volume"))


ESTIMATES = "array<struct<symbol: string, date: string, revenueAvg: double, revenueLow: double, revenueHigh: double, epsAvg: double, epsLow: double, epsHigh: double, numAnalystsRevenue: int, numAnalystsEps: int>>"


def consensus_estimates(replies: DataFrame, json: str, limit: int = 8) -> DataFrame:
    """A row for each estimate of each reply (at most `limit` of a symbol, by date): symbol, date, position, and the figures, null where the reply has none."""
    each = replies.select(F.explode(F.from_json(json, ESTIMATES)).alias("e")).select("e.*").withColumns({"symbol": F.upper("symbol"), "date": F.to_date("date")})
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("date", "revenueAvg", "epsAvg"))
    return each.withColumn("position", place).where(F.col("position") <= limit)


def video_id(url: Column) -> Column:
    """The eleven characters of a video's address, or null."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", 1)
    return F.nullif(found, F.lit(""))


def identity(*parts: Column, n: int = 12) -> Column:
    """A short key of contents."""
    return F.substring(F.sha1(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))))), 1, n)
