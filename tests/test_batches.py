"""Memory of tasks that go through texts row by row."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.text import batches, chunks, layout


def test_rows_leave_as_they_are_made():
    """A batch of 200 rows that make 0.5 MB each: no more than a few of them are held at once."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(200)), "text": ["x"] * 200})
    made = lambda text, k: (("y" * 1000, k) for _ in range(500))
    tracemalloc.start()
    rows = 0
    for out in batches.row_by_row(batch, made, {"text": pa.string(), "of": pa.int64()}):
        assert out.column("k").to_pylist() == out.column("of").to_pylist()
        rows += out.num_rows
        del out
    assert rows == 100_000 and tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_blocks_of_large_pages(spark):
    """Pages whose blocks take several batches: every block in order, keys that are null or texts too."""
    page = "<table><tr><td>a</td><td>1</td></tr></table>" + "".join(f"<p>paragraph {i} {'z' * 500}</p>" for i in range(12_000))
    df = spark.createDataFrame([("a", 1, page), (None, 2, "<h1>Title</h1>"), ("c", None, None)], "k string, j int, html string").coalesce(1)
    got = layout.blocks(df, ["k", "j"], "html").groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("d")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, 12_001, 12_000, 12_001), (None, 2, 1, 0, 1)]


def test_layout_goes_on_without_pandas(spark):
    """Blocks and chunks leave in Arrow batches of bounded size, not as one frame for a whole input batch."""
    df = spark.createDataFrame([(1, "one\n\ntwo")], "k long, text string")
    plan = layout.blocks(df, ["k"], "text", markdown=True)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_chunks_section_by_section(spark, monkeypatch):
    """Sections go through the common step, one at a time; ids from keys of several types, a key that is null among them."""
    monkeypatch.setattr(chunks, "row_by_row", chunks.row_by_row)  # absent before
    blocks = [("a", 1, i, "para", f"w{i} " * 30) for i in range(40)] + [(None, 2, 0, "heading", "only one")]
    df = spark.createDataFrame(blocks, "k string, j int, ordinal int, kind string, markdown string")
    got = sorted(map(tuple, chunks.chunk(df, ["k", "j"], most=100, least=50, repeated=0).select("k", "j", "id", "n", "total", "n_blocks").collect()), key=str)
    want = [(k, j, f"{k}:{j}:{r['n']}", r["n"], r["total"], r["n_blocks"]) for k, j in (("a", 1), (None, 2)) for r in chunks.pack([(x[3], x[4]) for x in blocks if x[0] == k], 100, 50, 0)]
    assert got == sorted(want, key=str) and len(want) > 10
