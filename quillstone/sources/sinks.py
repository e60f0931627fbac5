"""Idempotent writes on plain Parquet tables: what a second run of the same input leaves unchanged.

A Store holds tables. Its state is a manifest, a small JSON file with a running
number, that names the data folders of every bucket of every table. Data folders
are never changed. A transaction writes new ones and then the next manifest, which
is created only if no one else has: of two writers that started from one state the
second fails with Conflict and leaves nothing behind that a reader sees. Readers
take the manifest with the highest number, so they see whole states only, of all
tables together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import surface_new
from ..operators.state import replace_children, union_last_wins, upsert_keep_old

BUCKETS = 16


class Conflict(RuntimeError):
    """Someone else has written the state that this write would have made."""


class _Files:
    """The few file operations that a store needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._Path, self._io = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        conf, gateway = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self._Path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self._Path(self.path)).toUri(), conf)
        self._never_over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _at(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._Path(self.path)):
            return []
        return sorted(n for s in self.fs.listStatus(self._Path(self.path)) if (n := s.getPath().getName()).startswith(prefix))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole under a name that no file has; False if one has it (a rename that never replaces; the file system makes it atomic)."""
        draft = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            self._io.write(text, stream, self._utf8)
        finally:
            stream.close()
        try:
            self._context.rename(draft, self._at(name), self._never_over)
        except Py4JJavaError:
            self.fs.delete(draft, False)
            if self.fs.exists(self._at(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Store:
    """Tables under one path that change together. tables: name to (schema, key columns)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], buckets: int = BUCKETS):
        self.spark, self.tables, self.buckets, self.files = spark, tables, buckets, _Files(spark, path)

    def state(self) -> tuple[int, dict[str, dict[str, list[str]]]]:
        names = self.files.names("manifest-")
        return (int(names[-1][9:19]), json.loads(self.files.read(names[-1]))) if names else (-1, {})

    def read(self, table: str, state: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """A table as it is, or as it was in a state; of some buckets only, if they are given."""
        held = (self.state()[1] if state is None else state).get(table, {})
        return self._folders(table, [f for b, fs in held.items() if buckets is None or b in buckets for f in fs])

    def buckets_of(self, table: str, keys: DataFrame) -> set[str]:
        """The buckets that keys (a stated few, or bounded by the number of buckets) are in."""
        return {r[0] for r in keys.select(self._bucket(table).alias("b")).distinct().collect()}

    def _folders(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.tables[table][0]
        paths = [f"{self.files.path}/{f}" for f in sorted(set(folders))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in self.tables[table][1])), F.lit(self.buckets)).cast("string")

    def transaction(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 2) -> None:
        """Remove what the last `keep` states do not name."""
        names = self.files.names("manifest-")
        named = {f.split("/")[0] for n in names[-keep:] for t in json.loads(self.files.read(n)).values() for fs in t.values() for f in fs}
        for n in names[:-keep]:
            self.files.delete(n)
        for n in self.files.names("data-"):
            if n not in named:
                self.files.delete(n)


class Transaction:
    """Changes to tables of a store that take effect together at commit(). Each method may be used once for a table."""

    def __init__(self, store: Store):
        self.store, (self.number, self.old) = store, store.state()
        self.new = {t: dict(b) for t, b in self.old.items()}

    def _write(self, table: str, df: DataFrame, files: int = 1, order: tuple[str, ...] = ()) -> dict[str, str]:
        """df in a new folder, cut by bucket: the buckets that have rows, and their folders. files: of each bucket, at most (0: a file for each task and bucket, nothing is shuffled); order: of rows in a file."""
        store = self.store
        folder = f"data-{table}-{uuid.uuid4().hex}"
        cut = df.withColumn("__bucket", store._bucket(table))
        dealt = cut if not files else cut.repartition("__bucket") if files == 1 else cut.repartition("__bucket", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
        (dealt.sortWithinPartitions("__bucket", *order) if order else dealt).write.partitionBy("__bucket").parquet(f"{store.files.path}/{folder}")
        got = [s.getPath().getName() for s in store.files.fs.listStatus(store.files._at(folder)) if s.isDirectory() and s.getPath().getName().startswith("__bucket=")]
        return {g.split("=", 1)[1]: f"{folder}/{g}" for g in got}

    def _rewrite(self, table: str, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], files: int = 1) -> None:
        """change(old, new) on the buckets that new touches; the others keep their folders."""
        store = self.store
        staged = self._write(table, new.select(*store._folders(table, []).columns), files)  # new is computed once, and tells the buckets
        before = self.old.get(table, {})
        old = store._folders(table, [f for b in staged for f in before.get(b, [])])
        done = self._write(table, change(old, store._folders(table, list(staged.values()))), files)
        self.new.setdefault(table, {}).update({b: [done[b]] if b in done else [] for b in staged})

    def append(self, table: str, rows: DataFrame, files: int = 1, order: tuple[str, ...] = ()) -> None:
        """Rows that are known to be new go in; nothing that is there is read or written again."""
        for b, f in self._write(table, rows.select(*self.store._folders(table, []).columns), files, order).items():
            of_table = self.new.setdefault(table, {})
            of_table[b] = [*of_table.get(b, []), f]

    def delete(self, table: str, keys: DataFrame) -> None:
        """The rows of these keys go."""
        key = self.store.tables[table][1]
        padded = keys.select(*key).distinct().select(*(F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.store._folders(table, []).schema))
        self._rewrite(table, padded, lambda old, gone: old.join(gone.select(*key), key, "left_anti"))

    def rewrite_all(self, table: str, rows: DataFrame, files: int = 1, order: tuple[str, ...] = ()) -> None:
        """The table is these rows from now on."""
        self.new[table] = {b: [f] for b, f in self._write(table, rows.select(*self.store._folders(table, []).columns), files, order).items()}

    def insert_absent(self, table: str, batch: DataFrame, order: list) -> DataFrame:
        """Rows whose key is new go in once; they are returned. Nothing that is there is written again."""
        store = self.store
        old = store._folders(table, [f for fs in self.old.get(table, {}).values() for f in fs])
        added = self._write(table, surface_new(batch, old, store.tables[table][1], order).select(*old.columns))
        for b, f in added.items():
            self.new.setdefault(table, {}).setdefault(b, [])
            self.new[table][b] = [*self.new[table][b], f]
        return store._folders(table, list(added.values()))

    def upsert(self, table: str, new: DataFrame, order: list) -> None:
        """The new row replaces that of its key; of new rows of one key the first in order."""
        key = self.store.tables[table][1]
        self._rewrite(table, new, lambda old, fresh: union_last_wins(old, fresh, key, order))

    def upsert_keep_old(self, table: str, new: DataFrame) -> None:
        """As upsert (one new row a key), but a null keeps the old value."""
        (key,) = self.store.tables[table][1]
        self._rewrite(table, new, lambda old, fresh: upsert_keep_old(old, fresh, key, [c for c in old.columns if c != key]).select(*old.columns))

    def replace(self, table: str, new: DataFrame, by: list[str] | None = None, files: int = 1) -> None:
        """Delete, then insert, for the keys of new (or other columns that fix the key's bucket: a prefix of what the store cuts by)."""
        key = by or self.store.tables[table][1]
        if not set(self.store.tables[table][1]) <= set(key):
            raise ValueError(f"{table} is cut by {self.store.tables[table][1]}; replacing by {key} would miss rows")
        self._rewrite(table, new, lambda old, fresh: replace_children(old, fresh, key), files)

    def commit(self) -> None:
        if not self.store.files.create(f"manifest-{self.number + 1:010d}.json", json.dumps(self.new)):
            raise Conflict(f"state {self.number + 1} of {self.store.files.path} exists")


class Table:
    """One table that is a store of its own; each call is a transaction."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.store = Store(spark, path, {"rows": (schema, key)}, buckets)

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def insert_absent(self, batch: DataFrame, order: list) -> DataFrame:
        t = self.store.transaction()
        new = t.insert_absent("rows", batch, order)
        t.commit()
        return new

    def _do(self, name: str, *args) -> None:
        t = self.store.transaction()
        getattr(t, name)("rows", *args)
        t.commit()

    def upsert(self, new: DataFrame, order: list) -> None:
        self._do("upsert", new, order)

    def upsert_keep_old(self, new: DataFrame) -> None:
        self._do("upsert_keep_old", new)

    def replace(self, new: DataFrame) -> None:
        self._do("replace", new)


class RunLock:
    """One writer at a time: a lease with an end. A lease that has run out may be taken over; giving back frees it."""

    def __init__(self, spark: SparkSession, path: str, seconds: float, clock: Callable[[], float] = time.time):
        self.files, self.seconds, self.clock, self.held = _Files(spark, path), seconds, clock, None

    def acquire(self, owner: str) -> bool:
        leases = self.files.names("lease-")
        if leases:
            last = json.loads(self.files.read(leases[-1]))
            if last["until"] > self.clock() and f"free-{leases[-1]}" not in self.files.names("free-"):
                return False
        name = f"lease-{len(leases):010d}"
        if not self.files.create(name, json.dumps({"owner": owner, "until": self.clock() + self.seconds})):
            return False  # another run was faster
        self.held = name
        return True

    def release(self) -> None:
        if self.held:
            self.files.create(f"free-{self.held}", "")
            self.held = None


def append_monthly(df: DataFrame, path: str, date: str) -> None:
    """JSON lines by month."""
    df.withColumn("month", F.date_format(date, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def cache_key(namespace: Column, key: Column, most: int = 180) -> Column:
    """A file name for a key: whatever is no letter, digit, dot, dash or underscore becomes an underscore; one of more than `most` characters is its hash."""
    plain = F.regexp_replace(key, "[^A-Za-z0-9._-]", "_")
    name = F.when(F.length(plain) > most, F.sha1(key)).otherwise(plain)
    return F.concat(namespace, F.lit("/"), name, F.lit(".json"))


def transition(jobs: DataFrame, moves: DataFrame, key: str, status: str, frm: str, to: str) -> DataFrame:
    """Guarded state change: only jobs in state `frm` that moves names go on."""
    hit = moves.select(key, F.lit(True).alias("__hit")).distinct()
    j = jobs.join(hit, key, "left")
    return j.withColumn(status, F.when(F.col("__hit") & (F.col(status) == frm), to).otherwise(F.col(status))).drop("__hit")
