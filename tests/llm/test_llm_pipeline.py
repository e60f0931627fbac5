"""The pipeline's stages on the smallest tables, and its parts' decisions against plain versions."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from quillstone.llm import common, decontamination, simhash

    docs = common.documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = common.materialise(stage(spark, docs, SF), "stage")
        left[name] = docs.count()
        if name != "best-fit packing":
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
        if name == "SimHash near-dedup":
            assert docs.count() == simhash.grouped(before).select("component_id").distinct().count()
        if name == "benchmark decontamination":
            assert decontamination.contained(docs, common.documents(spark, SF, "benchmark")).count() == 0
        if name == "secret scans":
            assert docs.count() == before.count() and docs.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0
    assert left["quality classifier"] > left["SimHash near-dedup"] >= left["benchmark decontamination"] == left["secret scans"]
    assert docs.select("doc_id").distinct().count() == left["secret scans"]


def test_labels_keep_good(spark):
    import corpus_pipeline
    from quillstone.llm import common

    larger = SF.replace("0.001", "0.01")  # below some hundred positives the model is only a guess
    kept = corpus_pipeline.keep_quality(spark, common.documents(spark, larger), larger)
    labels = common.documents(spark, larger, "labels")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert kept.join(good, "doc_id").count() >= 0.98 * good.count() and kept.join(bad, "doc_id").count() <= 0.4 * bad.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, root long, spans string, n_tokens string, __row long"


def _tables(spark, path, docs, labels, benchmark):
    spark.createDataFrame(docs, ODD).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("labelled", (True, False))
def test_odd_input_through_all_stages(spark, tmp_path, odd_rows, labelled):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with names the operators use."""
    import corpus_pipeline
    from quillstone.llm import common

    docs = [(*r, None, 7, None, "x", "y", 1) for r in odd_rows]
    labels = [(i % 9 if i else None, i % 2, None) for i in range(20)] + [(4, None, 0)] if labelled else []
    sf = _tables(spark, tmp_path / "sf", docs, labels, [(1, "word3 word4 word5 word6 word7 word8"), (None, "q"), (2, None), (2, "")])
    rows = common.documents(spark, sf)
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = common.materialise(stage(spark, rows, sf), "odd")
        if name != "best-fit packing":
            assert rows.columns == columns and rows.subtract(before.withColumn("text", before["text"])).count() <= (1 if name == "secret scans" else 0)
        if name == "SimHash near-dedup":
            assert rows.count() == rows.select("doc_id", "text").distinct().count()
        if name == "benchmark decontamination":
            assert rows.where("text like 'word0 word1%'").count() == 0
        if name == "secret scans":
            assert rows.where("text like '%hunter2secret%' or text like '%AKIA%'").count() == 0
            last = rows.count()
    assert rows.select("doc_id").distinct().count() <= last and corpus_pipeline.run(spark, sf).count() == rows.count()


def test_empty_tables_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    sf = _tables(spark, tmp_path / "sf", [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
