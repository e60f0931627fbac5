"""Operators that cut hot keys into pieces, against their plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import asof, portfolio
from quillstone.text import chunks


@pytest.mark.parametrize("join", (asof.backward, asof.forward))
def test_asof_in_pieces(spark, join):
    rng = random.Random(4)
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(200)) for i in range(300)]
    right = sorted({(rng.choice(["hot", "hot", "a", None]), rng.randrange(200)) for _ in range(80)}, key=str)
    days = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    a = spark.createDataFrame(left, "i int, k string, d int").withColumn("at", days("d"))
    b = spark.createDataFrame([(k, d, d * 1.5) for k, d in right], "k string, d int, v double").withColumn("date", days("d"))
    rows = lambda pieces: sorted((r.i, str(r.date), str(r.v)) for r in join(a, b.drop("d"), ["k"], "at", "date", ["v"], pieces=pieces).collect())
    want = []
    for i, k, d in left:
        hit = [x for kk, x in right if kk == k and (x <= d if join is asof.backward else x >= d)]
        v = (max(hit) if join is asof.backward else min(hit)) if hit else None
        want.append((i, None if v is None else v * 1.5))
    for pieces in (1, 2, 7, 500):
        got = rows(pieces)
        assert [(i, v) for i, _, v in got] == [(i, str(v)) for i, v in sorted(want)], pieces


def test_water_level(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        n = rng.randrange(1, 60)
        rows += [(k, p, rng.choice([0, 1, 5, rng.randrange(100), rng.randrange(1000)])) for p in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k int, p int, s int")
    for budget in (0, 7, 300, 1000, 10**7):
        got = {(r.k, r.p): r.share for r in chunks.allocate(df, ["k"], "p", "s", budget).collect()}
        assert len(got) == len(rows)
        for k in range(40):
            parts = sorted((p, s) for kk, p, s in rows if kk == k)
            assert [got[k, p] for p, _ in parts] == chunks.water_fill([s for _, s in parts], budget), (budget, parts)


def test_benchmark_calendar(spark):
    b = spark.createDataFrame([("2024-01-03", 1.0), ("2024-01-05", 2.0), ("2024-01-05", 3.0)], "d string, close double").select(F.to_date("d").alias("date"), "close")
    got = {str(r.date): r.close for r in portfolio.calendar(b).where("date <= '2024-01-07'").collect()}
    assert got == {"2024-01-03": 1.0, "2024-01-04": 1.0, "2024-01-05": 3.0, "2024-01-06": 3.0, "2024-01-07": 3.0}
    assert portfolio.calendar(b.limit(0)).count() == 0


def test_budget_of_any_key(spark):
    """Sizes of zero, none, ties of rank, sizes beyond the budget, a null key; against the fold over all rows."""
    rng = random.Random(7)
    rows = []
    for k in [*range(30), None]:
        for p in rng.sample(range(1000), rng.randrange(1, 120)):
            rows.append((k, rng.randrange(6), p, rng.choice([None, 0, 1, 1, 2, 64, rng.randrange(40), rng.randrange(3000)])))
    df = spark.createDataFrame(rows, "k int, r int, p long, s int").withColumn("extra", F.lit(1))
    for budget in (0, 1, 63, 500, 10**6):
        got = sorted(((r.k, r.p) for r in chunks.fit_budget(df, ["k"], ["r"], "p", "s", budget).collect()), key=str)
        want = []
        for k in [*range(30), None]:
            ranked = [(p, s) for kk, _, p, s in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])) if s is not None]
            want += [(k, p) for p in chunks.fit(ranked, budget)]
        assert got == sorted(want, key=str), budget
    assert chunks.fit_budget(df.limit(0), ["k"], ["r"], "p", "s", 9).count() == 0


def test_budget_of_a_key_with_a_million_rows(spark):
    n, budget = 1_000_000, 5_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"), F.col("id").alias("p"), (F.lit(1) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700))).alias("s"))
    got = sorted(r.p for r in chunks.fit_budget(df, ["k"], ["r"], "p", "s", budget).select("p").collect())
    ranked = [(p, s) for _, p, s in sorted(df.select("r", "p", "s").toPandas().itertuples(index=False, name=None))]
    assert got == chunks.fit(ranked, budget)
