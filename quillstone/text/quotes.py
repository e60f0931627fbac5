"""Quotes against the text they are said to come from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_of, norm_punct, norm_space, norm_table
from ..operators.views import section_usable

TIERS = ("exact", "whitespace-normalized", "case-insensitive", "punctuation-normalized", "table-normalized", "no-match")
LEAST_QUOTE = 12
_FORMS = (lambda c: c, norm_space, F.lower, lambda c: F.lower(norm_punct(c)), norm_table)


def tier(text: Column, quote: Column) -> Column:
    """The strictest reading under which the text holds the quote."""
    return first_of(*((form(text).contains(form(quote)), name) for form, name in zip(_FORMS, TIERS, strict=False)), otherwise=TIERS[-1])


_SIGMA = lambda c: F.translate(c, "ς", "σ")  # noqa: E731  (Java lower-cases a last sigma otherwise)
#: Bytes of quotes that go to every task at once; more of them take another pass over the texts.
BLOCK_BYTES = 32 << 20


def _blocks(quotes: DataFrame, quote: str, limit: int) -> Iterator[list[tuple[str, int]]]:
    """(weakest reading, number) of the quotes, in blocks of about so many bytes: one on the driver at a time."""
    key = _SIGMA(norm_table(quote))
    block, size = [], 0
    for r in quotes.select("__q", key.alias("key")).where("length(key) > 0").toLocalIterator():
        block.append((r["key"], r["__q"]))
        size += len(r["key"].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def held_pairs(texts: DataFrame, quotes: DataFrame, text: str, quote: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts with the quotes that they hold in the weakest reading (which every other implies): the columns of both.

    One walk over each text finds all quotes of a block (Aho-Corasick), so no pair
    is looked at that does not match. A quote without a character in that reading,
    and a null, is in no text. Columns of the same name are an error.
    """
    spark = texts.sparkSession
    # the quotes are few beside the texts; written once, so that their numbers hold
    numbered = quotes.withColumn("__q", F.xxhash64(*(F.col(f"`{c}`") for c in quotes.columns))).dropDuplicates(["__q"])
    read = texts.withColumn("__key", _SIGMA(norm_table(text))).where(F.col("__key").isNotNull())
    out = None
    for block in _blocks(numbered, quote, block_bytes):
        found = _find(read, spark.sparkContext.broadcast(block))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.limit(0).withColumn("__q", F.lit(0).cast("bigint"))
    return out.join(numbered, "__q").drop("__q")


def _find(read: DataFrame, block) -> DataFrame:
    names = read.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for key, number in block.value:
            numbers.setdefault(key, []).append(number)
        tree = ahocorasick.Automaton()
        for key, those in numbers.items():
            tree.add_word(key, those)
        tree.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, key in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                hit = {n for _, those in tree.iter(key) for n in those}
                at += [i] * len(hit)
                found += sorted(hit)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), pa.array(found, pa.int64())], names=[*names, "__q"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return read.mapInArrow(run, f"{types}, __q bigint")


def tier_pairs(texts: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Each text with each quote that it holds under any reading: the other columns of both, and tier. All other pairs are no-match."""
    p = held_pairs(texts, quotes, text, quote)
    names = [c for c in (*texts.columns, *quotes.columns) if c not in (text, quote)]
    return p.select(*names, tier(F.col(text), F.col(quote)).alias("tier"))


def tiers(texts: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Every text with every one of a few quotes (they are sent to all tasks): the other columns of both, and tier.

    A text is lower-cased and brought to its weakest reading once, not once for each
    quote. What the weakest reading does not hold has no match; where a quote is
    letters and digits alone, folding white space and punctuation finds nothing more.
    The other readings are made for the pairs that are left.
    """
    weak = lambda c: _SIGMA(norm_table(c))
    names = [c for c in quotes.columns if c != quote]
    q = quotes.select(F.struct(*names, F.col(quote).alias("__q"), F.lower(quote).alias("__low"), weak(quote).alias("__weak"), F.col(quote).rlike(r"\A[A-Za-z0-9]+\z").alias("__plain")).alias("q"))
    all_ = F.broadcast(q.agg(F.collect_list("q").alias("__quotes")))  # one row: in a join of pairs Spark would make a text's readings for each pair
    t = texts.withColumns({"__lower": F.lower(text), "__weak": weak(text)}).crossJoin(all_)

    def of(q: Column) -> Column:
        found = (
            F.when(F.col(text).contains(q["__q"]), TIERS[0])
            .when(q["__plain"] & F.col("__lower").contains(q["__low"]), "case-insensitive")
            .when(F.coalesce(~F.col("__weak").contains(q["__weak"]), F.lit(True)), TIERS[-1])
            .when(q["__plain"], "table-normalized")
            .otherwise(tier(F.col(text), q["__q"]))
        )
        return F.struct(*(q[c].alias(c) for c in names), found.alias("tier"))

    each = t.select(*(c for c in texts.columns if c != text), F.explode_outer(F.transform("__quotes", of)).alias("__p"))
    return each.where("__p IS NOT NULL").select(*(c for c in texts.columns if c != text), "__p.*")


def verified_pairs(texts: DataFrame, quotes: DataFrame, text: str, quote: str, least: int = LEAST_QUOTE) -> DataFrame:
    """Each text with each quote that is verified in it: the other columns of both."""
    p = held_pairs(texts, quotes, text, quote)
    names = [c for c in (*texts.columns, *quotes.columns) if c not in (text, quote)]
    return p.where(verified(F.col(text), F.col(quote), least)).select(*names)


def with_window(text: Column, quote: Column, words: int = 25) -> tuple[Column, Column]:
    """The tier, of the quote's first 25 words if it has more and is not found whole; and whether that was so."""
    whole = tier(text, quote)
    parts = F.split(F.trim(quote), r"\s+")
    head = F.array_join(F.slice(parts, 1, words), " ")
    cut = (whole == "no-match") & (F.size(parts) > words)
    return F.when(cut, tier(text, head)).otherwise(whole), cut


def verified(text: Column, quote: Column, least: int = LEAST_QUOTE) -> Column:
    """A quote of 12 characters or more that the text holds, but for case, quotes, dashes and white space."""
    q = F.lower(norm_punct(quote))
    return (F.length(q) >= least) & F.lower(norm_punct(text)).contains(q)


def tier_counts(pairs: DataFrame, by: list[str], column: str = "tier") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(column) == t).alias("n_" + t.replace("-", "_")) for t in TIERS))


# The compared sections in order, as warnings name them, and the warnings ({0}: the section's name, {1}: how it failed).
COMPARED = (("mda", "MD&A"), ("risk-factors", "risk factors"))
QUARTER_WARNING = "10-Q {0} incompletely parsed (section {1}) — {0} change detection not performed."
BASE_WARNING = "10-K baseline {0} incompletely parsed (section {1}) — {0} changes could not be compared against the annual baseline."


def coverage(df: DataFrame, key: str, section: str, text: str, confidence: str, base_text: str, base_confidence: str) -> DataFrame:
    """By key: warnings (an array, in the order of the sections) on sections that could not be compared, and whether the MD&A was.

    df: a row for each key and section, with its text and confidence in the
    quarterly filing and in the annual one. A section without a row is missing in
    both. The quarter's fault is named before the base's.
    """
    usable, base = section_usable(F.col(confidence), F.col(text)), section_usable(F.col(base_confidence), F.col(base_text))
    how = lambda c: F.when(F.coalesce(c, F.lit("missing")) == "missing", "missing").otherwise("failed extraction")
    named = F.create_map(*(F.lit(x) for pair in COMPARED for x in pair))
    sections = F.broadcast(df.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(COMPARED)], f"__at int, {section} string"))
    every = df.select(key).distinct().crossJoin(sections)  # two fixed rows
    j = every.join(df.withColumns({"__q": usable, "__k": base}), [key, section], "left")
    label = named[F.col(section)]
    said = lambda text, why: F.replace(F.replace(F.lit(text), F.lit("{0}"), label), F.lit("{1}"), why)
    quarter, annual = said(QUARTER_WARNING, how(F.col(confidence))), said(BASE_WARNING, how(F.col(base_confidence)))
    q, k = F.coalesce("__q", F.lit(False)), F.coalesce("__k", F.lit(False))
    each = j.withColumns({"__w": F.when(~q, quarter).when(~k, annual), "__ok": q & k})
    g = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("__w").isNotNull(), F.struct("__at", "__w")))).alias("__ws"), F.bool_and((F.col(section) != "mda") | F.col("__ok")).alias("mda_assessed"))
    return g.select(key, F.transform("__ws", lambda x: x["__w"]).alias("warnings"), "mda_assessed")


def headline(changes: Column, mda_assessed: Column) -> Column:
    """The number of changes, and what it covers."""
    n = changes.cast("string")
    one = changes == 1
    return F.when(mda_assessed, F.concat(n, F.when(one, " change").otherwise(" changes"))).otherwise(F.concat(n, F.when(one, " risk-factor change").otherwise(" risk-factor changes"), F.lit("; MD&A not assessed")))
