"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, html_extraction, license_scan, lm_scoring, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, token_counts, vector_codes
from .common import documents, held_out, tuned


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every text: their best passage's Dice."""
    tuned(spark)
    return license_scan.scan(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base test and the learned list's verdict."""
    tuned(spark)
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    rules = quality_rules.fit_rules(docs, labels)
    out = quality_rules.apply_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every text (lengths: words and one end) and their bins."""
    tuned(spark)
    return packing.pack_texts(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    tuned(spark)
    return decontamination.contained(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by a model that learnt from rows whose crc32 modulo 3 is not 1."""
    tuned(spark)
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, learn_from=~held_out("doc_id", 3, 1))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text; repositories are source and language, owners are sources."""
    tuned(spark)
    scanned = secret_scan.scan(documents(spark, sf_dir), F.concat_ws("/", "source", "lang"), F.col("source"))
    return secret_scan.digest(secret_scan.classify(scanned))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text keeps without windows of 50 words that a smaller doc_id has too."""
    tuned(spark)
    return substring_dedup.cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    tuned(spark)
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    tuned(spark)
    groups = simhash.grouped(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text by a model that learnt from rows whose crc32 modulo 7 is not 2."""
    tuned(spark)
    scored = lm_scoring.score(documents(spark, sf_dir), ~held_out("doc_id", 7, 2))
    return scored.withColumn("held_out", held_out("doc_id", 7, 2))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every whole vector, their errors and the codebooks' digest."""
    tuned(spark, 8192)
    coded, books = vector_codes.compress(documents(spark, sf_dir, "embeddings"))
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, against all vectors; every seventh label is moved on by one first."""
    tuned(spark, 8192)
    rows = documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    tuned(spark)
    return html_extraction.extract(documents(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_rules,
        op3_best_fit_packing,
        op4_decontamination,
        op5_quality_classifier,
        op6_secret_scan,
        op7_substring_dedup,
        op8_token_counts,
        op9_simhash_dedup,
        op10_lm_scoring,
        op11_vector_codes,
        op12_hard_negatives,
        op13_html_extraction,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: The others cannot be put into SQL whole (learned models, merges, spans of regular expressions, 64-bit hashes): tests hold them against brute force.
_WHOLE_VECTORS = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"


def _code_rounds(rounds: int) -> str:
    """Assignments and moved entries of each round; distances are |x|**2 - 2 x.c + |c|**2, whole numbers that doubles hold."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT id, label, p, any_value(x.c) AS c, min(struct_pack(d := list_dot_product(x.c, x.c) - 2 * list_dot_product(x.c, b.c) + list_dot_product(b.c, b.c), e := e)) AS best
 FROM x JOIN b{k} b USING (p) GROUP BY id, label, p)""")
        if k < rounds:
            out.append(f"""m{k} AS (SELECT p, best.e AS e, i, sum(CAST(c[i] AS BIGINT)) AS s, count(*) AS n FROM (SELECT p, best, c, unnest(range(1, len(c) + 1)) AS i FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM m{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON b.p = n.p AND b.e = n.e)""")
    return ",\n".join(out)


ORACLE: dict[str, str] = {
    "op11_vector_codes": f"""WITH v AS (SELECT vec_id AS id, label, {_INTEGERS} AS c FROM embeddings WHERE {_WHOLE_VECTORS}),
x AS MATERIALIZED (SELECT id, label, p, c[p * w + 1 : p * w + w] AS c FROM (SELECT *, len(c) // 16 AS w, unnest(range(16)) AS p FROM v)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, c FROM x QUALIFY e < 64),
{_code_rounds(2)},
o AS (SELECT id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY id, label),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS digest FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM b2))
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o, h""",
    "op12_hard_negatives": f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS c FROM embeddings WHERE label IS NOT NULL AND {_WHOLE_VECTORS}),
s AS MATERIALIZED (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score FROM v a, v r WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    # these pages mark their articles: what the operator leaves of them is the article
    "op13_html_extraction": r"""WITH m AS (SELECT row_number() OVER () AS k, page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
s AS (SELECT k, unnest(x) AS b, unnest(range(len(x))) AS i FROM (SELECT k, regexp_split_to_array(replace(a, '<br>', ' '), '</?p>|</?h1>') AS x FROM m)),
d AS (SELECT k, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS b FROM s),
t AS (SELECT k, string_agg(b, chr(10) || chr(10) ORDER BY i) AS text FROM d WHERE b <> '' GROUP BY k)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM m LEFT JOIN t USING (k)""",
    "op4_decontamination": f"""WITH i AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {_LETTERS} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS shingle FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS (SELECT doc_id, n, w FROM (SELECT doc_id, {_LETTERS} AS w FROM documents), (SELECT DISTINCT n FROM i)),
t AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS shingle FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d)),
q AS (SELECT item_id, count(*) AS q FROM s GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS c FROM t JOIN s USING (n, shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, c / CAST(q AS DOUBLE) AS containment FROM h JOIN q USING (item_id) WHERE c / CAST(q AS DOUBLE) >= 0.8 - 1e-9""",
    "op7_substring_dedup": r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS least FROM v),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM m WHERE least < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
g AS (SELECT x.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}
