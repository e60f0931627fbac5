"""The keyed operators on streams; each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def surface_once(stream: DataFrame, key: list[str], time: str, late: str = "3 days") -> DataFrame:
    """Each key once, with state for as long as late rows may come: a key that comes back later than that is new again (surface_for_good keeps them all)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def sliding_clusters(stream: DataFrame, by: list[str], time: str, width: str, slide: str, late: str, **aggregates) -> DataFrame:
    """Trailing windows by key; a window is final once the watermark has passed it."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), *by)
    return g.agg(*(v.alias(k) for k, v in aggregates.items())).select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def sticky_status(stream: DataFrame, key: str, level: str, time: str, start: str = "green") -> DataFrame:
    """Status by key that stays until a signal changes it; a row for each change (key, at, from_status, to_status)."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = []
        every = pd.concat(list(parts)).sort_values([time, level])
        for at, new in every[[time, level]].itertuples(index=False, name=None):
            if new is not None and new != now:
                rows.append((k[0], at, now, new))
                now = new
        state.update((now,))
        yield pd.DataFrame(rows, columns=["key", "at", "from_status", "to_status"])

    out = f"key {kind}, at timestamp, from_status string, to_status string"
    return stream.select(key, level, time).groupBy(key).applyInPandasWithState(run, out, "status string", "append", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all there is, then read the result as a table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """The same into files, for results that do not fit the driver."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_key(by: str, last: str, n: str) -> Column:
    """A window's key: it changes when a later day or one more kind comes in, so growth surfaces again."""
    return F.concat_ws(":", F.col(by).cast("string"), F.col(last).cast("string"), F.col(n).cast("string"))


def run_to_latest(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Process all there is in update mode into files, one set a batch; read the last row of each key. Nothing is held on the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = df.sparkSession.read.parquet(f"{path}/out").drop("batch")
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), "__batch").alias("r"))
    return one.select(*key, "r.*")


def surface_for_good(stream: DataFrame, table, order: list[Column], checkpoint: str) -> None:
    """Each micro-batch's new keys go into a table that keeps them for ever; a batch that is run again inserts nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        table.insert_absent(batch, order)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def confluence_once(stream: DataFrame, by: str, kind: str, time: str, days: int = 30, kinds: int = 2, late: str = "3 days") -> DataFrame:
    """by, day, kinds, n_kinds: a key on the first day that ends a span of `days` days and itself with two or more kinds, and not again while a span still holds the last such day.

    A key's days wait in its state until the watermark has passed them and are then
    taken in order, so the result does not depend on how events are dealt into files or
    batches. State keeps each kind's last day and the last day that was told of, and
    goes when neither can count any more. Rows later than `late` are dropped by the
    watermark; a null key or kind is none.
    """
    stream = stream.where(F.col(by).isNotNull() & F.col(kind).isNotNull()).withWatermark(time, late)
    rows = stream.select(F.col(by).alias("key"), F.col(kind).cast("string").alias("kind"), F.col(time).alias("at"), F.unix_date(F.to_date(time)).alias("n_day"))

    def run(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting_days, waiting, names, last, told = state.get if state.exists else ([], [], [], [], None)
        pending, seen, out = {d: set(x) for d, x in zip(waiting_days, waiting, strict=True)}, dict(zip(names, last, strict=True)), []
        for part in parts:
            for day, name in part[["n_day", "kind"]].drop_duplicates().itertuples(index=False, name=None):
                pending.setdefault(int(day), set()).add(name)
        passed = state.getCurrentWatermarkMs()
        for day in sorted(d for d in pending if (d + 1) * DAY_MS <= passed):
            seen.update({x: day for x in pending.pop(day)})
            seen = {x: d for x, d in seen.items() if d >= day - days}
            if len(seen) >= kinds and (told is None or told < day - days):
                out.append((k[0], day, ",".join(sorted(seen)), len(seen)))
                told = day
        over = max([*seen.values(), -1 if told is None else told, 0]) + days + 1
        if not pending and over * DAY_MS <= passed:
            state.remove()
        else:
            state.update((list(pending), [sorted(x) for x in pending.values()], list(seen), list(seen.values()), told))
            state.setTimeoutTimestamp(max(((min(pending) if pending else over) + 1) * DAY_MS - 1, passed + 1))
        yield pd.DataFrame(out, columns=["key", "n_day", "kinds", "n_kinds"])

    kept = "days array<long>, waiting array<array<string>>, names array<string>, last array<long>, told long"
    out = f"key {stream.schema[by].dataType.simpleString()}, n_day int, kinds string, n_kinds long"
    told = rows.groupBy("key").applyInPandasWithState(run, out, kept, "append", "EventTimeTimeout")
    return told.select(F.col("key").alias(by), F.date_from_unix_date("n_day").alias("day"), "kinds", "n_kinds")
