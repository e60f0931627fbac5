"""Facts, series, trends and inflections on small frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillstone.operators import facts, inflections, scores, solver
from quillstone.operators import series as S
from quillstone.operators import trends as T


def d(s):
    return dt.date.fromisoformat(s)


def test_spans(spark):
    rows = [("a", "2020-01-01", "2020-03-31", "Q1"), ("b", "2020-01-01", "2020-09-30", "Q3"), ("c", "2020-01-01", "2020-12-31", "FY"), ("e", "2020-01-01", "2020-12-31", "Q4"), ("f", "2019-12-29", "2020-04-05", "Q1")]
    df = spark.createDataFrame([(k, d(a), d(b), fp) for k, a, b, fp in rows], "k string, start date, end date, fp string")
    got = {r.k: r.kind for r in df.select("k", facts.span_kind("start", "end", "fp").alias("kind")).collect()}
    assert got == {"a": "quarter", "b": None, "c": "annual", "e": None, "f": "quarter"}  # cumulatives are no quarter


def test_claim_takes_whole_periods(spark):
    df = spark.createDataFrame([("x", 1, "new", 0, 5.0), ("x", 1, "old", 1, 6.0), ("x", 2, "old", 1, 7.0)], "e string, p int, tag string, priority int, v double")
    assert sorted((r.p, r.v) for r in facts.claim(df, ["e", "p"]).collect()) == [(1, 5.0), (2, 7.0)]


def reports(spark, *values):
    rows = [("x", d(f"2020-0{i + 1}-01"), float(v), f"l{i}") for i, v in enumerate(values)]
    return facts.collapse(spark.createDataFrame(rows, "e string, filed date, v double, label string"), ["e"], "filed", "v", [], ["label"]).first()


def test_collapse(spark):
    assert (r := reports(spark, 100, 100)).value == 100 and r.restated_from is None and r.label == "l0"
    assert (r := reports(spark, 100, 110)).value == 110 and r.restated_from == 100
    assert (r := reports(spark, 1000, 1004, 1008)).value == 1008  # 0.8 % from the first, whose value still stands
    assert (r := reports(spark, 1000, 1004, 1004.5)).value == 1000 and r.restated_from is None  # drifts add up to nothing
    assert (r := reports(spark, 100, 110, 100)).value == 100 and r.restated_from == 100  # it was restated, though twice


def test_scale(spark):
    rows = [("x", i, v) for i, v in enumerate([100e6, 110e6, 120e6, 130.0, 0.0])]
    got = {r.i: (r.v, r.repaired) for r in facts.repair_scale(spark.createDataFrame(rows, "e string, i int, v double"), ["e"], "v").collect()}
    assert got[3] == (130e6, True) and got[0] == (100e6, False) and got[4] == (0.0, False)
    few = facts.repair_scale(spark.createDataFrame(rows[1:4], "e string, i int, v double"), ["e"], "v")
    assert not few.where("repaired").count()


def test_residual_quarter(spark):
    rows = [("x", 2020, p, v) for p, v in (("Q1", 1.0), ("Q2", 2.0), ("Q3", 3.0), ("FY", 10.0))] + [("y", 2020, "Q1", 1.0), ("y", 2020, "FY", 9.0)]
    got = facts.residual_quarter(spark.createDataFrame(rows, "e string, fy int, fp string, v double"), ["e"], "fy", "fp", "v").where("derived").collect()
    assert [(r.e, r.fp, r.v) for r in got] == [("x", "Q4", 4.0)]


def test_annual_and_missing(spark):
    c = facts.concept_table(spark)
    assert c.select("concept").distinct().count() == 28 and c.where("kind = 'instant'").select("concept").distinct().count() == 16
    f = spark.createDataFrame([("x", "revenue"), ("x", "cash")], "e string, concept string")
    assert facts.missing(f, c, ["e"]).count() == 26
    rows = [("x", 2020, "revenue", 10.0), ("x", 2020, "cfo", 5.0), ("x", 2020, "capex", -2.0), ("x", 2021, "cfo", 5.0)]
    r = facts.annual_rows(spark.createDataFrame(rows, "e string, fy int, c string, v double"), ["e"], "fy", "c", "v").collect()
    assert len(r) == 1 and r[0].fcf == 3.0 and r[0].debt_to_equity is None and r[0].debt == 0.0


def quarters(spark, values, name="dso"):
    """Values by quarter from 2018 Q1, as year-over-year pairs of one metric."""
    rows = [("x", 2018 + i // 4, i % 4 + 1, name, None if v is None else float(v), len(values)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity string, fy int, fq int, metric string, value double, n_periods int")
    return S.yoy_pairs(df, ["entity", "metric"], "fy", "fq", ["value"])


def latest():
    return [F.col("fy").desc(), F.col("fq").desc()]


def found(spark, values, name="dso"):
    return T.detect(quarters(spark, values, name), T.detector_table(spark), ["entity"], latest()).collect()


def test_trends(spark):
    assert not found(spark, [50] * 8)
    assert not found(spark, [50, 50, 50, 90] * 3)  # a season is no trend
    assert not found(spark, [50] * 7 + [90])  # nor is one bad quarter
    r = found(spark, [50, 50, 50, 50, 50, 60, 61, 62])
    assert [(x.id, x.run, x.change, x.severity) for x in r] == [("dso-lengthening", 3, 12.0, "low")]
    assert found(spark, [50, 50, 50, 50, 60, 61, 62, 65])[0].severity == "high"  # four in a row, twice the least change
    assert not found(spark, [50, 50, 50, 60])
    assert [x.id for x in found(spark, [0.5] * 4 + [0.4] * 4, "grossMargin")] == ["gross-margin-eroding"]
    assert not found(spark, [50, 50, 50, 50, None, 60, 61, None])


def points(spark, values):
    return spark.createDataFrame([("x", i, float(v), 2e6) for i, v in enumerate(values)], "e string, i int, v double, revenue double")


def up():
    return [F.col("i")]


def down():
    return [F.col("i").desc()]


def test_dilution_and_buyback(spark):
    one = lambda f, v: [r.severity for r in f(points(spark, v), ["e"], up(), "v").collect()]
    assert one(inflections.dilution, [100, 130]) == ["critical"]
    assert one(inflections.dilution, [100, 112]) == ["high"]
    assert one(inflections.dilution, [100, 100, 100, 100, 130]) == ["critical"]
    assert one(inflections.dilution, [100, 3000]) == []  # a change of unit
    assert one(inflections.dilution, [100, 101]) == []
    assert one(inflections.buyback, [100, 94]) == ["critical"]
    assert one(inflections.buyback, [100, 50]) == []  # a reverse split
    assert one(inflections.buyback, [100, 99, 98.5, 98, 97.9]) == ["medium"]


def test_turn(spark):
    one = lambda v: [(r.run, r.severity) for r in inflections.turn(points(spark, v), ["e"], down(), "v", "revenue").collect()]
    assert one([-1, -1, 5]) == [(2, "high")]
    assert one([-1, -1, -1, -1, 5]) == [(4, "critical")]
    assert one([-1, 5]) == [] and one([5, 5]) == [] and one([-1, -1, -1]) == []


def test_runway_and_acceleration(spark):
    p = points(spark, [0, 0, 0, 0]).withColumns({"cash": F.lit(10.0), "fcf": F.lit(-4.0)})
    assert [(r.quarters, r.severity) for r in inflections.runway(p, ["e"], up(), "cash", "fcf").collect()] == [(2.5, "high")]
    assert not inflections.runway(p.withColumn("fcf", F.lit(1.0)), ["e"], up(), "cash", "fcf").count()
    a = points(spark, [1e6, 1e6, 1e6, 1e6, 1.1e6, 1.6e6])
    assert [r.severity for r in inflections.acceleration(a, ["e"], up(), "v").collect()] == ["critical"]
    assert not inflections.acceleration(points(spark, [1e6] * 6), ["e"], up(), "v").count()


def test_scores(spark):
    base = {c: 100.0 for c in scores.ANNUAL}
    rows = [("x", 2020, *base.values()), ("x", 2021, *base.values())]
    df = spark.createDataFrame(rows, "e string, fy int, " + ", ".join(f"{c} double" for c in base))
    m = scores.beneish(df, ["e"], "fy").first()
    assert m.m_score == round(-4.84 + 0.92 + 0.528 + 0.404 + 0.892 + 0.115 - 0.172 - 0.327, 3) and not m.flagged and m.dominant is None
    assert not scores.beneish(df.where("fy = 2021"), ["e"], "fy").count()
    lone = scores.beneish(df.drop("sga", "cfo"), ["e"], "fy").first()
    assert lone.n_missing == 2 and lone.SGAI == 1 and lone.TATA == 0
    assert scores.altman(df).first().zone == "safe" and scores.altman(df.drop("equity")).first().zone == "unknown"


def plain_implied(fcf, price, disc, mult):
    """The rule as a loop."""
    pv = lambda g: sum(fcf * (1 + g) ** t / (1 + disc) ** t for t in range(1, 11)) + fcf * (1 + g) ** 10 * mult / (1 + disc) ** 10
    lo, hi = -0.10, 0.50
    if fcf <= 0 or not pv(lo) <= price <= pv(hi):
        return None
    for _ in range(60):
        mid = (lo + hi) / 2
        if abs(pv(mid) - price) / price < 1e-3:
            return mid
        lo, hi = (mid, hi) if pv(mid) < price else (lo, mid)
    return (lo + hi) / 2


def test_implied_growth(spark):
    df = spark.createDataFrame([(1, 10.0, 300.0), (2, 10.0, 50.0), (3, -1.0, 300.0), (4, 10.0, 9000.0)], "k int, fcf double, price double")
    for r in solver.reverse_dcf(df, "fcf", "price").collect():
        want = plain_implied(r.fcf, r.price, r.discount, r.multiple)
        assert (r.implied_growth is None) == (want is None) and (want is None or abs(r.implied_growth - want) < 1e-12)
    x = spark.range(1).select(solver.stretched(F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("zero"), solver.stretched(F.lit(0.13), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("none"), solver.stretched(F.lit(0.13), F.lit(0.09), F.lit(0.0)).alias("near")).first()
    assert (x.zero, x.none, x.near) == (False, True, False)
