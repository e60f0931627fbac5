"""Queries of llm against their SQL, and every one of them run whole on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from quillstone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con, df = oracle.connect(SF), queries.QUERIES[name](spark, SF)
    assert not oracle.kinds(df, con, queries.ORACLE[name])
    assert not oracle.difference(df, con, queries.ORACLE[name])


COLUMNS = {
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_quality_classifier": "doc_id held_out score predicted",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_simhash_dedup": "doc_id fingerprint component_id",
    "op10_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in COLUMNS:
        assert set(COLUMNS[name].split()) <= set(df.columns) and df.count() == n
    else:
        assert df.count() > 0
