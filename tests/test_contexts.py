"""Contexts over and under their ceiling, coverage warnings, tripwires, look-back, trims and renderers on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstone.operators import views as V
from quillstone.sources import sinks
from quillstone.text import briefs, contexts, quotes, sections, snippets


def test_whole_if_it_fits():
    assert contexts.assemble([("a", "x" * 1200), ("b", ""), ("c", "yy")], ()) == "### a (1,200 chars)\n\n" + "x" * 1200 + "\n\n---\n\n### c (2 chars)\n\nyy"
    assert contexts.assemble([], ()) == ""


def test_most_relevant_parts_in_order():
    parts = [("debt " * (3 if i in (2, 7) else 0) + f"part{i} ").ljust(90, ".") for i in range(10)]
    text = "\n\n".join(parts)
    got = contexts.assemble([("notes", text), ("small", "s" * 50)], ("debt",), ceiling=300, part=100)
    body = got.split("\n\n---\n\n")[0]
    assert body.index("part2") < body.index("part7") and body.count("part") == 2 and body.count(contexts.ELIDED) == 2  # a gap, and what follows the last part
    assert got.endswith("### small (50 chars)\n\n" + "s" * 50)
    assert body.startswith(f"### notes ({len(body.split(chr(10) + chr(10), 1)[1]):,} of {len(text):,} chars, selected)")


def test_each_section_gets_its_share():
    rng = random.Random(2)
    for _ in range(40):
        srcs = [(n, "\n\n".join("w" * rng.randrange(20, 120) for _ in range(rng.randrange(1, 30)))) for n in "abc"]
        got = contexts.assemble(srcs, (), ceiling=900, part=100)
        kept = got.replace(contexts.ELIDED, "").split("\n\n---\n\n")
        if sum(len(t) for _, t in srcs) > 900:
            assert sum(x.count("w") for x in kept) <= 900 and len(kept) == 3


def test_bundled_sections(spark):
    s = spark.createDataFrame([(1, "risk-factors", "r", ["mda", "risk-factors"]), (1, "mda", "m", None), (1, "proxy", "", None), (2, "business", "b", None)], "k int, section string, text string, bundled array<string>")
    got = {(r.k, r.dimension): r.sources for r in contexts.contexts(s, "k", {}).collect()}
    assert got[1, "moatDurability"] == "risk-factors, mda" and got[1, "cyclicalityAwareness"] == "risk-factors, mda" and got[2, "moatDurability"] == "business"
    assert (1, "insiderAlignment") not in got


def test_coverage(spark):
    rows = [(1, "mda", "text", "high", "base", None), (1, "risk-factors", " ", "high", "base", "high"), (2, "mda", "t", "high", "t", "failed"), (2, "risk-factors", "t", None, "t", "low"), (3, "risk-factors", "t", "high", "t", "high")]
    df = spark.createDataFrame(rows, "k int, section string, t string, c string, bt string, bc string")
    got = {r.k: (r.warnings, r.mda_assessed) for r in quotes.coverage(df, "k", "section", "t", "c", "bt", "bc").collect()}
    assert got[1] == (["10-Q risk factors incompletely parsed (section failed extraction) — risk factors change detection not performed."], True)
    assert got[2] == (["10-K baseline MD&A incompletely parsed (section failed extraction) — MD&A changes could not be compared against the annual baseline."], False)
    assert got[3] == (["10-Q MD&A incompletely parsed (section missing) — MD&A change detection not performed."], False)
    one = spark.range(1).select(quotes.headline(F.lit(1), F.lit(True)).alias("a"), quotes.headline(F.lit(2), F.lit(False)).alias("b")).first()
    assert tuple(one) == ("1 change", "2 risk-factor changes; MD&A not assessed")


def test_tripwires(spark):
    rows = [("weakens", "weakens", 0.6), ("strengthens", "weakens", 0.9), ("strengthens", "either", 0.3), ("neutral", "either", 0.9), ("weakens", "strengthens", 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, w string, m double")
    assert [r.a for r in df.orderBy("i").select(V.adverse(F.col("d"), F.col("w")).alias("a")).collect()] == [True, False, True, False, False]
    assert [r.status for r in V.provisional(df, ["i"], "d", "w", "m").orderBy("i").collect()] == ["red", "green", "amber", "green", "green"]


def test_trim(spark):
    rng = random.Random(6)
    floors = {"metrics": 1, "claims": 2, "flags": 0}
    for _ in range(3):
        rows = [(k, x, p, rng.randrange(1, 50)) for k in range(12) for x in floors for p in range(rng.randrange(0, 6))]
        df = spark.createDataFrame(rows, "k int, list string, p int, n int")
        got = {(r.k, r.list, r.p) for r in briefs.trim_to(df, ["k"], "list", "p", "n", floors, 120).collect()}
        for k in range(12):
            lists = {x: sorted((p, n) for kk, xx, p, n in rows if kk == k and xx == x) for x in floors}
            total = sum(n for v in lists.values() for _, n in v)
            for x, floor in floors.items():
                while total > 120 and len(lists[x]) > floor:
                    total -= lists[x].pop()[1]
            assert {(x, p) for kk, x, p in got if kk == k} == {(x, p) for x, v in lists.items() for p, _ in v}


def test_locate_and_snippet(spark):
    blocks = ["Intro words of the filing that go on.", "Risk factors: many things may happen to us.", "And more of them, at length, in this block.", "The end of it all, and nothing else."]
    assert sections.locate("RISK FACTORS — many things may happen to us! And more of them, at length, in this block", blocks) == (1, 2)
    assert sections.locate("short", blocks) is None and sections.locate("x" * 60, blocks) is None
    text = "\n".join(["nothing"] * 30 + ["| a | b |", "| --- | --- |", "| revenue 2024 | 42 |", "| other | 1 |"] + ["nothing"] * 30)
    cut, above = snippets.snippet(text, "revenue 42", 60)
    assert "revenue 2024" in cut and "| --- | --- |" in cut
    df = spark.createDataFrame([(1, "a b/c"), (2, "k" * 181)], "i int, k string")
    names = [r.p for r in df.orderBy("i").select(sinks.cache_key(F.lit("ns"), F.col("k")).alias("p")).collect()]
    assert names[0] == "ns/a_b_c.json" and len(names[1]) == len("ns/") + 40 + len(".json")
