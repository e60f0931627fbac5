"""Dimension and fixture sources: ticker and company tables, day folders, quotes in batches, proxy texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_SCHEMA = "cik string, name string, sic string, sicDescription string, tickers array<string>, exchanges array<string>"


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits) and title of a JSON object of rows."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", "map<string, struct<cik_str: long, ticker: string, title: string>>")
    return text.select(F.explode(F.map_values(rows)).alias("r")).select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), "r.title")


def company_profiles(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(PROFILE_SCHEMA).option("multiLine", True).json(path)
    return p.select(F.lpad("cik", 10, "0").alias("cik"), "name", F.col("sic").try_cast("int").alias("sic"), F.col("sicDescription").alias("industry"), "tickers", "exchanges")


def day_folders(spark: SparkSession, path: str, since: str, until: str, column: str = "date") -> DataFrame:
    """Index lines in folders date=YYYY-MM-DD; only the folders of those days are read, and a day without one has no rows."""
    return spark.read.option("basePath", path).text(path).where(F.col(column).between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file, with the folder's name as ticker."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("ticker", F.element_at(F.split(F.input_file_name(), "/"), -2))


def quotes(symbols: DataFrame, symbol: str, fetch: Callable[[list[str]], dict[str, float]], size: int = 40) -> DataFrame:
    """symbol, price, error: fetch on batches of 40; a batch that fails gives rows with its error, the others go on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            names = pdf[symbol].tolist()
            rows = []
            for i in range(0, len(names), size):
                batch = names[i : i + size]
                try:
                    got = fetch(batch)
                    rows += [(n, got.get(n), None) for n in batch]
                except Exception as e:  # noqa: BLE001 - a failed batch is a result
                    rows += [(n, None, f"{type(e).__name__}: {e}") for n in batch]
            yield pd.DataFrame(rows, columns=["symbol", "price", "error"])

    return symbols.select(symbol).mapInPandas(run, "symbol string, price double, error string")


def proxy_text(filings: DataFrame, key: str, html: str) -> DataFrame:
    """A filing's whole text, white space collapsed."""
    from ..text.layout import blocks

    b = blocks(filings, [key], html)
    g = b.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("b"))
    return g.select(key, F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"))
