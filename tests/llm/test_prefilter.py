"""The secret scan's prefilter passes every alternative of every kind."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quillstone.llm import secret_scan

# One minimal text for each alternative of each kind.
EXAMPLES = {
    "assign": ["password=abcdefgh", "passwd=abcdefgh", "secret=abcdefgh", "token=abcdefgh", "apikey=abcdefgh", "api_key=abcdefgh", "PASSWD' : 'abcdefgh"],
    "access": ["AKIAABCDEFGHIJKL"],
    "hex": ["0123456789abcdef" * 2],
    "pem": ["-----BEGIN PRIVATE KEY-----" + "A" * 20, "-----BEGIN RSA PRIVATE KEY-----" + "A" * 20],
    "jwt": ["eyJabcdefgh.eyJabcdefgh.abcdefgh"],
    "vendor": [*(f"gh{c}_" + "a" * 36 for c in "pousr"), *(f"xox{c}-abcdefghijk" for c in "abprs"), "sk_live_" + "a" * 16, "AIza" + "a" * 35],
    "url": ["://u:abcdef@"],
    "bearer": ["Bearer " + "a" * 20, "bearer " + "a" * 20],
}


def test_prefilter_passes_every_alternative():
    assert EXAMPLES.keys() == secret_scan.KINDS.keys()
    for kind, texts in EXAMPLES.items():
        for text in texts:
            assert kind in {c[0] for c in secret_scan.candidates(text)}, text
            assert pc.match_substring_regex(pa.array([text]), secret_scan._ANY)[0].as_py(), text


def test_passwd_is_found_and_redacted(spark):
    df = spark.createDataFrame([(1, "x passwd = abcdefgh12 y", "r", "o"), (2, "PASSWD: abcdefgh12", "r", "o"), (3, "passwd = short", "r", "o")], "doc_id long, text string, repo string, owner string")
    out = secret_scan.digest(secret_scan.classify(secret_scan.scan(df, F.col("repo"), F.col("owner"))))
    assert {r.doc_id: (r.n_assign, r.spans) for r in out.collect()} == {1: (1, "assign:2:21"), 2: (1, "assign:0:18"), 3: (0, "")}
    clean = {r.doc_id: r.text for r in secret_scan.redact(df, F.col("repo"), F.col("owner")).collect()}
    assert clean == {1: "x [SECRET] y", 2: "[SECRET]", 3: "passwd = short"}


def test_key_ends_where_its_lines_end():
    body = "\n".join("MIIEowIBAAKCAQEA" + "abcdEFGH0123+/Zz" * 3 for _ in range(4))
    prose = "\nAnd then a whole paragraph of prose with words of all lengths goes on and on until the next mark"
    for head in ("", "RSA "):
        whole = f"-----BEGIN {head}PRIVATE KEY-----\n{body}\nshort==\n-----END {head}PRIVATE KEY-----"
        (found,) = [c for c in secret_scan.candidates("x " + whole + prose) if c[0] == "pem"]
        assert found[1:3] == (2, 2 + len(whole))
        cut = f"-----BEGIN {head}PRIVATE KEY-----\n{body}"
        (found,) = [c for c in secret_scan.candidates(cut + prose) if c[0] == "pem"]
        assert found[1:3] == (0, len(cut))
    assert not [c for c in secret_scan.candidates("-----BEGIN PRIVATE KEY-----" + prose) if c[0] == "pem"]


def test_cut_in_one_walk():
    import random

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("abcé語", k=rng.randrange(0, 30)))
        spans = [tuple(sorted(rng.choices(range(len(text) + 1), k=2))) for _ in range(rng.randrange(0, 5))]
        spans = [(a, b) for a, b in spans if a < b]
        gone = {i for a, b in spans for i in range(a, b)}
        got = secret_scan.cut(text, [a for a, _ in spans], [b for _, b in spans], "#")
        assert got.replace("#", "") == "".join(c for i, c in enumerate(text) if i not in gone)
    assert secret_scan.cut(None, [], [], "#") is None and secret_scan.cut("abcdef", [1, 2, 4], [3, 4, 5], "#") == "a##f"
