"""What the operators of this subpackage share: flat text buffers, hashes, and
intermediate tables in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy step works on at once (a longer text goes alone).
SLICE_BYTES = 2 << 20
_NO_WORD = np.zeros(256, bool)
_NO_WORD[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tuned(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches, by rows and by bytes: some texts are a thousand times the usual length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; one of its own only where that is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back: the lineage
    ends there, and a lost executor costs no more than the tasks it ran. The
    shuffle files that the write needed go when it has ended."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def superseded(df: DataFrame) -> None:
    """Remove a table of materialise() that nothing will read again."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _written if any(f.endswith(e[1].split(":", 1)[-1]) for f in folders)]:
        _delete(*entry)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Values of a summary that is sent to all tasks (8 bytes each), at most; a larger one is shuffled.
SENT_VALUES = 1 << 20
#: Slices of each key of a summary that is shuffled: a key that a third of the rows have is met by so many tasks.
SLICES = 32


def meet(rows: DataFrame, summary: DataFrame, keys: list[tuple[str, str]], spread: Column, values: Column | None = None) -> DataFrame:
    """rows, each with the row of the written summary that has its key (nulls equal, nulls where there is none).

    keys: pairs of column names, those of summary go. values: how many 8-byte values
    a row of the summary holds (its columns by default). A summary of up to
    SENT_VALUES values in all is broadcast; of a larger one each row is repeated
    SLICES times, once for each slice that spread deals the rows into, and joined.
    """
    size = summary.agg(F.sum(values if values is not None else F.lit(len(summary.columns)))).first()[0] or 0
    gone = [b for _, b in keys]
    on = F.lit(True)
    if size <= SENT_VALUES:
        for a, b in keys:
            on = on & rows[a].eqNullSafe(summary[b])
        return rows.join(F.broadcast(summary), on, "left").drop(*gone)
    left = rows.withColumn("__slice", F.pmod(spread, F.lit(SLICES)).cast("int"))
    right = summary.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    for a, b in keys:
        on = on & left[a].eqNullSafe(right[b])
    return left.join(right, on & (left["__slice"] == right["__of"]), "left").drop("__slice", "__of", *gone)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before: its folder goes with it
            return


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """fn on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> pa.Array:
    """The column's texts as bytes, a null as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text each."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, as arrays.

    buf: the bytes (A-Z lower-cased if asked); starts, ends: of each word in buf;
    first: for each text the number of its first word, and the total at the end.
    """

    def __init__(self, column: pa.Array, start: int, end: int, lower: bool = False, no_word: np.ndarray = _NO_WORD):
        offsets = np.frombuffer(column.buffers()[1], np.int64, end - start + 1, (column.offset + start) * 8)
        size = int(offsets[-1] - offsets[0])
        raw = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        self.raw, self.offsets = raw, offsets - offsets[0]
        self.buf = _LOWER[raw] if lower else raw
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = ~no_word[raw]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.inside = inside[1:-1]
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, family: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, family)


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(family: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if family not in _powers or len(_powers[family][0]) < size:
        n = max(size, SLICE_BYTES + (1 << 18))
        base = _BASES[family]
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[family] = np.cumprod(up), np.cumprod(down)
        if size > SLICE_BYTES + (1 << 18):
            return _powers.pop(family)  # an odd long text: not kept
    return _powers[family]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each span buf[start:end] (in order, not overlapping); the same bytes hash alike anywhere.

    The span's polynomial modulo 2**64 (from prefix sums), then mixed. Long buffers
    are worked on SLICE_BYTES at a time.
    """
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        first, last = int(starts[a]), int(ends[b - 1])
        up, down = _power_tables(family, last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((buf[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def in_chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches dealt anew into batches of about limit bytes of text (the column of that number; a longer text goes alone)."""
    held, size = [], 0
    for batch in batches:
        column = text_bytes(batch.column(text))
        for a, b in slices(column, min(limit, SLICE_BYTES)):
            held.append(batch.slice(a, b - a))
            size += int(np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)[[a, b]])[0])
            if size >= limit:
                yield _one_batch(held)
                held, size = [], 0
    if held:
        yield _one_batch(held)


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.schema.names)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """A hash of each run of size consecutive word hashes (of all texts on end)."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    base = _BASES[family]
    if size <= 8:
        out = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            out += words[i : i + len(out)] * np.uint64(pow(base, i, 1 << 64))
        return mix(out)
    up, down = _power_tables(family, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def inside_text(first: np.ndarray, size: int) -> np.ndarray:
    """Of each run of size words of all texts on end: whether one text has it whole."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    has = counts >= size
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, (first[1:] - size + 1)[has], -1)
    return np.cumsum(ok)[: n - size + 1] > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])


def held_out(doc_id: str, modulus: int, rest: int):
    """crc32 of doc_id as text has that remainder; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == rest
