"""Hybrid search: BM25 over postings, cosine over vectors, reciprocal-rank fusion, exact quotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import SEARCH_STOPWORDS
from ..functions.expr import norm_punct, safe_div
from ..session import written

# BM25's parameters, its least idf, and the fusion constant.
K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60


TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits (in any script)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct terms of a query: runs of a-z, 0-9 and inner dots, longer than one, without operators and stop words."""
    parts = F.transform(F.split(F.lower(text), "[^a-z0-9.]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*SEARCH_STOPWORDS)))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, terms: str, n: int = 30) -> DataFrame:
    """The n best documents of each query: query, doc, score, rank.

    queries (a stated few) have an array of distinct terms. Postings are built for
    their terms only: the set of all terms is one row, so texts lose every other
    token before anything is exploded. Texts are read once: lengths and hits are a
    small table, which the counts, the idf and the scores come from. idf is floored, and each partition keeps its
    own n best before ranks are taken.
    """
    each = queries.select(query, F.explode(terms).alias("term"))
    plain = F.sort_array(F.collect_set(F.when(F.col("term").rlike("^[a-z0-9]+$"), F.col("term"))))  # no token has anything else
    wanted = F.broadcast(each.agg(F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(plain, "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("__w")))  # one row, of the queries' terms
    low = F.lower(text)
    lengths = docs.crossJoin(wanted).select(doc, F.regexp_count(low, F.lit(TOKEN)).alias("dl"), F.regexp_extract_all(low, F.col("__w"), F.lit(1)).alias("hit"))
    lengths = written(lengths, "lengths")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = lengths.select(doc, "dl", F.explode("hit").alias("term")).groupBy(doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf, part = score_part()
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")  # stats is one row
    hits = each.join(tf, "term").join(weights, "term").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(hits, query, [F.col("score").desc(), F.col(doc)], n)


def score_part() -> tuple[Column, Column]:
    """A term's idf (from n_docs and df; floored), and what it adds to a document's score (from idf, tf, dl and avgdl)."""
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    return idf, F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def ranked(hits: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n)  # Spark keeps n of each partition first (group limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length; null where the dimensions differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.coalesce(safe_div(dot(a, b), norm), F.lit(0.0)))


def knn(vectors: DataFrame, queries: DataFrame, vec: str, embedding: str, query: str, query_embedding: str, n: int = 30) -> DataFrame:
    """The n nearest vectors of each query. queries are a stated few; they go to every task (Spark checks their size)."""
    q = queries.select(query, F.col(query_embedding).alias("__q"))
    hits = vectors.crossJoin(q).select(query, vec, F.round(cosine(F.col(embedding), F.col("__q")), 6).alias("score")).where(F.col("score").isNotNull())
    return ranked(hits, query, [F.col("score").desc(), F.col(vec)], n)


def fuse(arms: dict[str, DataFrame], query: str, doc: str, n: int = 5, k: int = FUSION) -> DataFrame:
    """Sum of 1 / (k + rank) over the arms that hold a document, and which those are."""
    every = None
    for name, arm in arms.items():
        part = arm.select(query, F.col(doc), "rank", F.lit(name).alias("arm"))
        every = part if every is None else every.unionByName(part)
    g = every.groupBy(query, doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("matched_by"))
    return ranked(g.withColumn("score", F.round("s", 9)).drop("s"), query, [F.col("score").desc(), F.col(doc)], n)


def find_quote(docs: DataFrame, doc: str, text: str, quote: str, least: int = 12, n: int = 50) -> DataFrame:
    """Documents that hold a quote (white space, quotes, dashes and case folded); a quote under 12 characters finds none."""
    q = F.lower(norm_punct(F.lit(quote)))
    return docs.where((F.length(q) >= least) & F.lower(norm_punct(text)).contains(q)).select(doc).orderBy(doc).limit(n)


def reindex(index: DataFrame, new: DataFrame, filing: str) -> DataFrame:
    """A filing that is indexed again replaces what it had."""
    return index.join(new.select(filing).distinct(), filing, "left_anti").unionByName(new)


def search_filter(df: DataFrame, ticker: str | None = None, filing: str | None = None, exclude: str | None = None, forms: list[str] | None = None, sections: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Conditions that were given, all of them; Spark pushes them into the scan."""
    for given, condition in ((ticker, lambda: F.upper("ticker") == ticker.upper()), (filing, lambda: F.col("accession") == filing), (exclude, lambda: F.col("accession") != exclude), (forms, lambda: F.col("form").isin(*forms)), (sections, lambda: F.col("section").isin(*sections)), (since, lambda: F.col("filing_date") >= F.lit(since).cast("date"))):
        df = df.where(condition()) if given is not None else df
    return df


def metric_history(wide: DataFrame, by: list[str], metrics: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """Named metrics in long form; a name that is not exposed is an error that lists those that are."""
    unknown = [m for m in metrics if m not in allowed]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(allowed)}")
    return wide.select(*by, *metrics).unpivot(by, metrics, "metric", "value")


def term_rank(docs: DataFrame, doc: str, text: str, terms: tuple[str, ...], n: int) -> DataFrame:
    """Sum over terms of 1 + ln(occurrences), substrings counted without overlap; best first."""
    low = F.lower(text)
    score = F.lit(0.0)
    for t in terms:
        count = (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
        score = score + F.when(count > 0, 1 + F.ln(count)).otherwise(0.0)
    out = docs.select(doc, F.round(score, 6).alias("score"))
    return out.where("score > 0").orderBy(F.col("score").desc(), doc).limit(n)


def embed(df: DataFrame, text: str, model, column: str = "embedding") -> DataFrame:
    """model: a function from a list of texts to a list of equal-length float lists; called batch by batch on the executors."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = [v for i in range(0, len(texts), 16) for v in model(texts.iloc[i : i + 16].tolist())]
        if len({len(v) for v in out}) > 1:
            raise ValueError("embeddings of different dimensions")
        return pd.Series(out)

    return df.withColumn(column, run(F.col(text)))


def pack_floats(column: str):
    """An array of numbers as 32-bit floats on end, little-endian."""
    import numpy as np

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(column)


def unpack_floats(column: str):
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(column)
