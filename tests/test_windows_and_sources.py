"""Boundary days, streamed confluence in any split, exact medians, days as a Data Source, sources that fail alone."""

from __future__ import annotations

import datetime
import random
import statistics
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillstone.operators import events as E
from quillstone.operators.medians import medians
from quillstone.sources.days import day_index, gather, weekdays
from quillstone.streaming import events as ST

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def day(i: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


def test_the_first_day_of_a_window_counts(spark):
    buys = spark.createDataFrame([(1, "a", day(0), 1.0, 1.0), (1, "b", day(14), 1.0, 1.0), (1, "c", day(-1), 1.0, 1.0)], "issuer int, owner string, date date, shares double, price double")
    assert E.insider_clusters(buys, "issuer", F.col("owner"), "date", "shares", "price", day(14).isoformat()).first().n_buyers == 2
    signals = spark.createDataFrame([(1, "x", day(0)), (1, "y", day(30)), (2, "x", day(0)), (2, "y", day(31))], "k int, kind string, date date")
    assert [r.k for r in E.confluence(signals, "k", "kind", "date", day(30).isoformat()).collect()] == [1]
    assert not E.confluence(signals.where("k = 2"), "k", "kind", "date", day(31).isoformat()).collect()


def test_equal_filings_stay(spark):
    f = spark.createDataFrame([(1, "S-1"), (1, "S-1"), (1, "S-1/A"), (2, None), (3, "none"), (4, "SC 13G/A")], "key2 int, form string")
    got = E.form_signals(f, E.form_table(spark), "form")
    assert sorted((r.key2, r.form) for r in got.collect()) == [(1, "S-1"), (1, "S-1"), (1, "S-1/A")]
    plan = E.form_signals(f, E.form_table(spark), "form")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1  # the forms', which are a few dozen


def told_once(rows, days, kinds, until):
    """Day by day: keys with enough kinds in the span, unless told of within it."""
    out = []
    for key in sorted({r[0] for r in rows}):
        told = None
        for d in sorted({r[2].date() for r in rows if r[0] == key}):
            if datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(days=1) > until:
                continue
            near = sorted({r[1] for r in rows if r[0] == key and 0 <= (d - r[2].date()).days <= days})
            if len(near) >= kinds and (told is None or (d - told).days > days):
                out.append((key, d, ",".join(near), len(near)))
                told = d
    return out


@pytest.mark.parametrize("seed,files", [(0, 1), (0, 5), (1, 9)])
def test_streamed_confluence_in_any_split(spark, tmp_path, seed, files):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted(((rng.randrange(4), rng.choice("abc"), start + datetime.timedelta(hours=rng.randrange(60 * 24))) for _ in range(90)), key=lambda r: r[2])
    rows.append((9, "z", start + datetime.timedelta(days=70)))
    # within the allowed lateness files may be out of order
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), files - 1)), len(rows)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows[a:b]
        rng.shuffle(part)
        df = spark.createDataFrame([*part, (None, "a", rows[a][2])], "k int, kind string, at timestamp").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema("k int, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = ST.run_to_table(ST.confluence_once(stream, "k", "kind", "at", 6, 2), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    want = told_once(rows, 6, 2, rows[-1][2] - datetime.timedelta(days=3))
    assert sorted((r.k, r.day, r.kinds, r.n_kinds) for r in got) == want and want


@pytest.mark.parametrize("ranges,at_end", [(4, 3), (16, 1), (4096, 1 << 16)])
def test_medians(spark, ranges, at_end):
    rng = random.Random(ranges)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(200)], "odd": [rng.random() for _ in range(301)], "ties": [1.0] * 150 + [2.0] * 150, "far": [0.0, 1e-300, 1e300, -1e308, 1e308, 5e-324, 3.0] * 9,
        "one": [7.0], "same": [4.0] * 77, "hot": [rng.choice([0.1, 0.2, 0.3]) for _ in range(900)], "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("odd", None), (None, 5.0), (None, 6.0), ("one", float("nan"))]
    got = {r.g: r["median"] for r in medians(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", ranges, at_end).collect()}
    want = {g: statistics.median(vs) if vs else None for g, vs in groups.items()} | {None: 5.5}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-15) if want[g] is not None else got[g] is None for g in want)
    assert medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0
    assert medians(spark.createDataFrame([(1.0,), (3.0,)], "v double"), [], "v").first()[0] == 2.0


LINES = {day(i): [f"{i}|a", f"{i}|b"] for i in range(0, 40) if day(i) != datetime.date(2024, 1, 15)}


def fetching(log: str):
    lines = LINES

    def fetch(date):
        with open(log, "a") as f:
            f.write(f"{date}\n")
        if date == datetime.date(2024, 1, 17):
            raise PermissionError("refused")
        return lines.get(date)

    return fetch


def test_days_as_a_source(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.dataSource.register(day_index(fetching(log), "days_of_test"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("days_of_test").option("since", "2024-01-01").option("until", "2024-01-31").load()
    got = sorted((r.date, r.line, r.error) for r in df.collect() if r.error is None)
    want = [(d, x, None) for d in weekdays(day(0), day(30)) for x in LINES.get(d, []) if d != datetime.date(2024, 1, 17)]
    assert got == want
    assert [(r.date, r.line, r.error) for r in df.where("error is not null").collect()] == [(datetime.date(2024, 1, 17), None, "PermissionError: refused")]
    open(log, "w").close()
    some = df.where((F.col("date") >= datetime.date(2024, 1, 9)) & (F.col("date") < datetime.date(2024, 1, 11)))
    assert {r.date for r in some.collect()} == {datetime.date(2024, 1, 9), datetime.date(2024, 1, 10)}
    assert set(open(log).read().split()) == {"2024-01-09", "2024-01-10"}  # no other day is asked for
    assert df.where(F.col("date") > datetime.date(2025, 1, 1)).count() == 0


def test_days_as_a_stream_go_on_where_they_were(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.dataSource.register(day_index(fetching(log), "days_streamed"))

    def run(until: str) -> list:
        stream = spark.readStream.format("days_streamed").option("since", "2024-01-01").option("until", until).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.date for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").collect())

    days = lambda n: sorted(d for d in weekdays(day(0), day(n)) for _ in LINES.get(d, []) if d != datetime.date(2024, 1, 17))
    assert run("2024-01-10") == days(9)
    open(log, "w").close()
    assert run("2024-01-25") == days(24)
    assert min(open(log).read().split()) == "2024-01-11"


def test_a_corrupt_source_fails_alone(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/good")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table PAR1")
    rows, issues = gather(spark, {"a": lambda: spark.read.parquet(f"{tmp_path}/good"), "b": lambda: spark.read.schema("id long").parquet(f"{tmp_path}/bad.parquet"), "c": lambda: spark.range(2).withColumn("x", F.lit(1)), "d": lambda: 1 / 0})
    assert sorted((r.source, r.id, r.x) for r in rows.collect()) == [("a", 0, None), ("a", 1, None), ("a", 2, None), ("c", 0, 1), ("c", 1, 1)]
    assert {r.source for r in issues.collect()} == {"b", "d"} and all(r.error for r in issues.collect())
    nothing, both = gather(spark, {"d": lambda: 1 / 0})
    assert nothing is None and both.count() == 1
