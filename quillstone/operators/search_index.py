"""A kept index for ranked search: postings by term, replaced by filing.

Tables of a Store, so that searches see whole states and writers never mix:

* filings: the generation of each filing that counts, its documents and their length
  in all. Numbers of documents and their mean length are sums of these few rows.
* postings: term, doc, filing, generation, occurrences, length of the document; cut by
  term and sorted by it, so that a search reads the buckets of its terms and, of
  their files, the row groups that can hold them.

Indexing a filing again writes postings of a new generation and moves the filing on;
what older generations left is no longer met, and goes when the index is compacted.
So a filing is replaced without reading or writing any other's postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ..sources.sinks import Store
from .retrieval import ranked, score_part

#: Buckets of terms; files that a bucket goes to when the index is compacted, one for each ROWS of the whole, at most FILES.
BUCKETS, FILES, ROWS = 16, 64, 1 << 24
POSTINGS = "term string, doc bigint, filing string, generation bigint, tf int, dl int"
#: What retrieval.TOKEN finds, letters and digits of any script, as Python says it (they differ in characters that only one of the two's Unicode versions knows); postings that a task holds before they leave.
WORD, HELD = re.compile(r"[^\W_]+"), 1 << 17
FILINGS = "filing string, generation bigint, n_docs bigint, n_texts bigint, length bigint"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, filing, lower-cased text or null) to the terms of each text: term, doc, filing, tf, dl. Rows leave as they fill, so that no batch of texts has to be held as postings."""

    def out(batch: pa.RecordBatch, at: list[int], each: list[Counter]) -> pa.RecordBatch:
        sizes, rows = [len(c) for c in each], pa.array(at)
        many = pa.array(np.repeat(np.arange(len(at)), sizes))
        term, tf = pa.array((t for c in each for t in c), pa.string()), pa.array((n for c in each for n in c.values()), pa.int32())
        dl = pa.array([c.total() for c in each], pa.int32()).take(many)
        return pa.RecordBatch.from_arrays([term, batch.column(0).take(rows).take(many), batch.column(1).take(rows).take(many), tf, dl], ["term", "doc", "filing", "tf", "dl"])

    for batch in batches:
        at, each, held = [], [], 0
        for i, text in enumerate(batch.column(2)):
            terms = Counter(WORD.findall(text.as_py() or ""))
            if terms:
                at.append(i)
                each.append(terms)
                held += len(terms)
            if held >= HELD:
                yield out(batch, at, each)
                at, each, held = [], [], 0
        if held:
            yield out(batch, at, each)


@F.pandas_udf(T.LongType())
def n_terms(low: pd.Series) -> pd.Series:
    """How many terms a lower-cased text has; null has none."""
    return low.map(lambda t: None if t is None else len(WORD.findall(t))).astype("Int64")


class SearchIndex:
    """docs: of bigint ids; filings: any text. A document belongs to one filing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.store = Store(spark, path, {"filings": (FILINGS, ["filing"]), "postings": (POSTINGS, ["term"])}, buckets)

    def add(self, docs: DataFrame, doc: str, filing: str, text: str) -> None:
        """Index the documents of whole filings; what those filings had before is replaced. A null text has no terms and no length but counts as a document; a null filing is none and goes unindexed."""
        change = self.store.transaction()
        generation = F.lit(change.number + 1).cast("bigint")
        own = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(filing).cast("string").alias("filing"), F.col(text).alias("text")).where(F.col("filing").isNotNull())
        # a document's terms are counted in its row and written where they are: neither texts nor postings are shuffled
        low = own.select("doc", "filing", F.lower("text").alias("low"))
        postings = low.where(F.col("low").isNotNull()).mapInArrow(counted, "term string, doc bigint, filing string, tf int, dl int")
        change.append("postings", postings.select("term", "doc", "filing", generation.alias("generation"), "tf", "dl"), 0, ("term",))
        lengths = low.select("filing", n_terms("low").alias("dl"))
        sums = lengths.groupBy("filing").agg(F.count(F.lit(1)).alias("n_docs"), F.count("dl").alias("n_texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).withColumn("generation", generation)
        change.upsert("filings", sums, [F.col("generation").desc()])
        change.commit()

    def _files(self, rows: int) -> int:
        return max(1, min(FILES, rows // ROWS))

    def remove(self, filings: DataFrame, filing: str) -> None:
        """Filings (a column of their names) are found no more."""
        change = self.store.transaction()
        change.delete("filings", filings.select(F.col(filing).cast("string").alias("filing")))
        change.commit()

    def compact(self) -> None:
        """Postings of generations that do not count go for good, and each bucket becomes as few files as its rows allow (a batch leaves a file for each task and bucket)."""
        change = self.store.transaction()
        state = self.store.state()[1]
        living = written(self._living(state, self.store.read("postings", state)), "living")
        change.rewrite_all("postings", living, self._files(living.count()), ("term",))
        change.commit()
        self.store.vacuum(1)

    def _living(self, state: dict, postings: DataFrame) -> DataFrame:
        return postings.join(self.store.read("filings", state).select("filing", "generation"), ["filing", "generation"], "left_semi")

    def postings_of(self, terms: DataFrame, state: dict) -> DataFrame:
        """The postings that count of distinct terms (column term; a stated few): only their buckets are read, and the terms are pushed down."""
        names = [r[0] for r in terms.select("term").distinct().collect()]
        buckets = self.store.buckets_of("postings", terms)
        return self._living(state, self.store.read("postings", state, buckets).where(F.col("term").isin(names)))

    def search(self, queries: DataFrame, query: str, terms: str, n: int = 30) -> DataFrame:
        """The n best documents of each query: query, doc, score, rank, as bm25() gives them over the same documents."""
        state = self.store.state()[1]
        each = queries.select(query, F.explode(terms).alias("term"))
        found = written(self.postings_of(each, state), "found")
        stats = self.store.read("filings", state).agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_texts")).alias("avgdl"))
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf, part = score_part()
        weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")  # stats is one row
        hits = each.join(found, "term").join(weights, "term").groupBy(query, "doc").agg(F.round(F.sum(part), 6).alias("score"))
        return ranked(hits, query, [F.col("score").desc(), F.col("doc")], n)
