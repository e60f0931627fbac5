"""A queue of jobs that several workers claim from, each job by one of them.

The queue is a table of a Store. A claim reads a state, chooses, and commits the next
one; if another worker has committed meanwhile, the store refuses and the claim is
made again from the new state, TRIES times at most. A job that runs for longer than
the lease counts as left by a worker that died, and is claimed again.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import Conflict, Store

SCHEMA = "job bigint, status string, enqueued timestamp_ntz, started timestamp_ntz, finished timestamp_ntz, attempts int, worker string, note string"
TRIES, LEASE_MINUTES = 5, 30


class JobQueue:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, lease_minutes: int = LEASE_MINUTES):
        self.spark, self.lease = spark, lease_minutes
        self.store = Store(spark, path, {"jobs": (SCHEMA, ["job"])}, buckets)

    def _again(self, change):
        """change(transaction) and its commit, from a new state after each conflict. None after TRIES."""
        for _ in range(TRIES):
            transaction = self.store.transaction()
            out = change(transaction)
            if out is None:
                return None
            try:
                transaction.commit()
                return out
            except Conflict:
                continue
        return None

    def enqueue(self, jobs: DataFrame) -> None:
        """Jobs (job, enqueued) that the queue does not have become pending; those that it has stay as they are."""
        new = jobs.select(F.col("job").cast("bigint"), F.col("enqueued").cast("timestamp_ntz"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
        whole = new.select(*(F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.store.read("jobs", {}).schema))
        if self._again(lambda t: t.insert_absent("jobs", whole, [F.col("enqueued")])) is None:
            raise Conflict(f"jobs were not enqueued in {TRIES} tries")

    def _free(self, jobs: DataFrame, now: datetime.datetime) -> DataFrame:
        stale = (F.col("status") == "running") & (F.col("started") < F.lit(now - datetime.timedelta(minutes=self.lease)).cast("timestamp_ntz"))
        return jobs.where((F.col("status") == "pending") | stale)

    def claim(self, worker: str, now: datetime.datetime, n: int = 1) -> list[int]:
        """The n oldest jobs that are pending or stale (ties by number) run under this worker now. An empty list: there is none, or others were faster TRIES times."""

        def choose(transaction):
            jobs = self.store.read("jobs", transaction.old)
            chosen = self._free(jobs, now).orderBy("enqueued", "job").limit(n).select("job").collect()  # n are asked for
            if not chosen:
                return None
            numbers = [r.job for r in chosen]
            buckets = self.store.buckets_of("jobs", self.spark.createDataFrame(chosen, "job bigint"))
            mine = self.store.read("jobs", transaction.old, buckets).where(F.col("job").isin(numbers))
            transaction.upsert("jobs", mine.withColumns({"status": F.lit("running"), "started": F.lit(now).cast("timestamp_ntz"), "attempts": F.col("attempts") + 1, "worker": F.lit(worker)}), [F.col("job")])
            return numbers

        return self._again(choose) or []

    def _move(self, worker: str, jobs: list[int], columns: dict[str, Column]) -> int:
        """Of these jobs, those that run under this worker (still: a lease may have passed to another) change; how many did."""

        def change(transaction):
            keys = self.spark.createDataFrame([(j,) for j in jobs], "job bigint")
            held = self.store.read("jobs", transaction.old, self.store.buckets_of("jobs", keys))
            mine = held.where(F.col("job").isin(jobs) & (F.col("status") == "running") & (F.col("worker") == worker))
            n = mine.count()
            if not n:
                return None
            transaction.upsert("jobs", mine.withColumns(columns), [F.col("job")])
            return n

        return self._again(change) or 0

    def complete(self, worker: str, jobs: list[int], now: datetime.datetime, note: str | None = None) -> int:
        return self._move(worker, jobs, {"status": F.lit("done"), "finished": F.lit(now).cast("timestamp_ntz"), "note": F.lit(note).cast("string")})

    def fail(self, worker: str, jobs: list[int], now: datetime.datetime, error: str, most_attempts: int | None = None) -> int:
        """A job that failed ends so, or, with fewer attempts than most_attempts, waits again."""
        again = F.lit(False) if most_attempts is None else F.col("attempts") < most_attempts
        return self._move(worker, jobs, {"status": F.when(again, "pending").otherwise("failed"), "finished": F.when(~again, F.lit(now).cast("timestamp_ntz")), "note": F.lit(error)})

    def requeue(self, worker: str, jobs: list[int]) -> int:
        return self._move(worker, jobs, {"status": F.lit("pending"), "started": F.lit(None).cast("timestamp_ntz")})

    def read(self) -> DataFrame:
        return self.store.read("jobs")
