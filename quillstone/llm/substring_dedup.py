"""Substring dedup by recompression.

Each text is parsed bottom-up: rounds join runs of one symbol, and pairs whose
left symbol falls in the left half of the alphabet and whose right symbol falls
in the right half. A symbol's name is a hash of what it stands for, so names are
global without a table of names; the halves are drawn from the names too. Equal
substrings therefore get equal symbols, except where a decision looked past
their ends. For every symbol the parse keeps the words that its decisions looked
at (its reach): any other occurrence of those words has the same symbol.

So a window of 50 words that two documents have has all its symbols (those whose
reach it covers) in both. One aggregation over the symbols of all documents
(about a sixth of the words) tells which are shared; a window with a symbol that
is not is settled, as are documents without any other window. The windows that
are left are verified by 96-bit hashes of all their words in a second
aggregation, which finds the least document of each. Texts go in chunks; a chunk
first joins its own copies of a symbol or window, so what a third of all documents
share reaches an aggregation once for each chunk, not for each document. Both
aggregations are exchange.py's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_chunks, materialise, mix, text_bytes, window_hashes
from .exchange import FAN_BITS, ROWS, answered, ask, reduce_keys

WINDOW = 50
#: Words of a symbol, at most; and the rounds: r joins runs, p pairs.
LONGEST = 16
ROUNDS = "rpppppp"
CHUNK_BYTES = 4 << 20
_NEVER = np.iinfo(np.int64).max


class Parse:
    """The symbols of some texts after all rounds: name, and reach [low, high) in words of all texts on end."""

    def __init__(self, words: np.ndarray, first: np.ndarray, rounds: str = ROUNDS, longest: int = LONGEST):
        n = len(words)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.arange(n)
        self.name, self.start, self.end, self.low, self.high, self.doc = words, at, at + 1, at.copy(), at + 1, doc
        self.bounds = first
        for k, kind in enumerate(rounds):
            if len(self.name):
                (self._runs if kind == "r" else self._pairs)(np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1), longest)

    def _beside(self) -> tuple[np.ndarray, ...]:
        """The reach of the neighbours to the left and right; a text's edge is past its first or last word."""
        same = self.doc[1:] == self.doc[:-1]
        lo, hi = self.bounds[self.doc] - 1, self.bounds[self.doc + 1] + 1
        left_low, left_high, right_low, right_high = lo.copy(), self.high.copy(), self.low.copy(), hi.copy()
        left_low[1:][same], left_high[1:][same] = self.low[:-1][same], self.high[:-1][same]
        right_low[:-1][same], right_high[:-1][same] = self.low[1:][same], self.high[1:][same]
        return left_low, left_high, right_low, right_high

    def _take(self, keep: np.ndarray, **new: np.ndarray) -> None:
        for x in ("name", "start", "end", "low", "high", "doc"):
            setattr(self, x, new[x] if x in new else getattr(self, x)[keep])

    def _runs(self, salt: np.uint64, longest: int) -> None:
        left_low, left_high, right_low, right_high = self._beside()
        low = np.minimum(np.minimum(self.low, left_low), right_low)
        high = np.maximum(np.maximum(self.high, left_high), right_high)
        new = np.append(True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(self.name)))
        name = self.name[first]
        self._take(first, name=np.where(count > 1, mix(name + salt * count.astype(np.uint64)), name), end=self.end[first + count - 1], low=np.minimum.reduceat(low, first), high=np.maximum.reduceat(high, first))

    def _pairs(self, salt: np.uint64, longest: int) -> None:
        right = (mix(self.name ^ salt) >> np.uint64(63)).astype(bool)
        joins = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]) & (self.end[1:] - self.start[:-1] <= longest)
        head, tail = np.append(joins, False), np.append(False, joins)
        alone = ~(head | tail)
        left_low, left_high, right_low, right_high = self._beside()
        low, high = self.low.copy(), self.high.copy()
        for which, l, h in ((alone & ~right, right_low, right_high), (alone & right, left_low, left_high)):
            low[which], high[which] = np.minimum(low, l)[which], np.maximum(high, h)[which]
        at = np.flatnonzero(head)
        name, end = self.name.copy(), self.end.copy()
        name[at] = mix(mix(name[at] + salt) + name[at + 1] * np.uint64(0xD6E8FEB86659FD93))
        end[at] = end[at + 1]
        low[at], high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        keep = ~tail
        self._take(keep, name=name[keep], end=end[keep], low=low[keep], high=high[keep])

    def usable(self, window: int = WINDOW) -> np.ndarray:
        """Of each symbol: whether its text has a window that covers its reach."""
        return (self.high - self.low <= window) & (self.low >= self.bounds[self.doc]) & (self.high <= self.bounds[self.doc + 1])


def _marks(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of n positions lies in one of the ranges [start, end)."""
    d = np.zeros(n + 1, np.int64)
    ok = end > start
    np.add.at(d, start[ok], 1)
    np.add.at(d, end[ok], -1)
    return np.cumsum(d)[:n] > 0


def _window_starts(first: np.ndarray, window: int) -> np.ndarray:
    return _marks(int(first[-1]), first[:-1], first[1:] - window + 1)


def _settled(n: int, low: np.ndarray, high: np.ndarray, first: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Windows that cover one of these reaches."""
    return _marks(n, np.maximum(high - window, first[doc]), np.minimum(low, first[doc + 1] - window) + 1)


def _distinct(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: where the (first) one with the least doc is, in the order of the rows; and for each row the number of its key."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = order[new]
    by_row = np.argsort(least)
    place = np.empty(len(least), np.int64)
    place[by_row] = np.arange(len(least))
    return least[by_row], place[number]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)


_SYMBOLS = "chunk bigint, size int, low binary, span binary, index binary, doc binary, n int, names binary, held binary, docs array<struct<id: bigint, mark: bigint, n_words: bigint, sha: string>>"


def _first_pass(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """docs has (id, mark, text). A row for each chunk: its documents, its symbols (size of them) and their n distinct names, each with how many documents here have it (2 for more)."""
    document = pa.struct([("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for chunk, batch in enumerate(in_chunks(batches, 2, chunk_bytes), first):
            w = Words(text_bytes(batch.column(2)), 0, batch.num_rows)
            ids = _ids(batch.column(0))
            whole = bytes(w.raw)
            starts, ends = w.starts.tolist(), w.ends.tolist()
            sha = [hashlib.sha256(b" ".join([whole[s:e] for s, e in zip(starts[i:j], ends[i:j], strict=True)])).hexdigest() for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            own = pa.StructArray.from_arrays([batch.column(0), batch.column(1), pa.array(w.counts()), pa.array(sha, pa.string())], fields=list(document))
            p = Parse(w.hashes(), w.first)
            at = np.flatnonzero(p.usable(window))
            name, doc = p.name[at], p.doc[at]
            least, index = _distinct((name,), ids[doc])
            held = np.ones(len(least), np.uint8)
            held[index[doc != doc[least][index]]] = 2
            blobs = (p.low[at].astype(np.int32), (p.high[at] - p.low[at]).astype(np.uint8), index.astype(np.int32), doc.astype(np.int32))
            columns = [pa.array([chunk], pa.int64()), pa.array([len(at)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([len(least)], pa.int32()), pa.array([name[least].tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["chunk", "size", "low", "span", "index", "doc", "n", "names", "held", "docs"])

    return docs.mapInArrow(run, _SYMBOLS)


def _read(batch: pa.RecordBatch, i: int, name: str, dtype) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), dtype)


def _ask_symbols(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield ask(batch.column("chunk")[i].as_py(), _read(batch, i, "names", np.uint64), _read(batch, i, "held", np.uint8).astype(np.int64), bits)

    return chunks.select("chunk", "names", "held").mapInArrow(run, ROWS)


def _candidates(chunks: DataFrame, window: int) -> DataFrame:
    """Each document with the windows (starts and lengths of ranges) that are not settled by its symbols: a window with one that no other document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, span = _read(batch, i, "low", np.int32).astype(np.int64), _read(batch, i, "span", np.uint8)
                index, doc = _read(batch, i, "index", np.int32), _read(batch, i, "doc", np.int32)
                alone = (answered(batch.column("hits")[i].as_py(), _read(batch, i, "names", np.uint64)) < 2)[index]
                docs = batch.column("docs")[i].as_py()
                first = np.append(0, np.cumsum(np.array([d["n_words"] for d in docs], np.int64)))
                open_ = _window_starts(first, window)
                open_ &= ~_settled(len(open_), low[alone], low[alone] + span[alone], first, doc[alone], window)
                edge = np.diff(open_.astype(np.int8), prepend=0, append=0)
                edge = _split_at(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), first)
                of = np.searchsorted(first, edge[0], "right") - 1
                where = np.searchsorted(of, np.arange(len(docs) + 1))
                ranges = [np.stack([edge[0][a:b] - first[k], edge[1][a:b] - edge[0][a:b]]).astype(np.int32).tobytes() if b > a else None for k, (a, b) in enumerate(zip(where[:-1], where[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in docs], t) for c, t in (("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()))] + [pa.array(ranges, pa.binary())], names=["id", "mark", "n_words", "sha", "ranges"])

    return chunks.mapInArrow(run, "id bigint, mark bigint, n_words bigint, sha string, ranges binary")


def _split_at(start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges cut where texts begin (windows of two texts never touch for window > 1, but ranges may for window = 1)."""
    inner = first[np.searchsorted(start, first, "right") > 0]
    k = np.searchsorted(start, inner, "right") - 1
    cut = inner[(inner > start[k]) & (inner < end[k])] if len(start) else inner[:0]
    return np.sort(np.append(start, cut)), np.sort(np.append(end, cut))


def _open_windows(ranges: list[bytes | None], first: np.ndarray) -> np.ndarray:
    at = []
    for k, r in enumerate(ranges):
        start, size = np.frombuffer(r, np.int32).reshape(2, -1).astype(np.int64)
        at.append(np.repeat(start - np.cumsum(np.append(0, size[:-1])), size) + np.arange(size.sum()) + first[k])
    return np.concatenate(at) if at else np.zeros(0, np.int64)


def _windows(w: Words, ranges: list[bytes], ids: np.ndarray, window: int):
    """The distinct open windows of a chunk: their keys and least document; for each open one: place, key number, whether a smaller document here has it."""
    at = _open_windows(ranges, w.first)
    key = window_hashes(w.hashes(0), window, 0)[at]
    more = (window_hashes(w.hashes(1), window, 1)[at] >> np.uint64(32)).astype(np.uint32)
    doc = ids[np.searchsorted(w.first, at, "right") - 1]
    least, index = _distinct((more, key), doc)
    return at, index, doc > doc[least][index], key[least], more[least], doc[least]


_TEXTS = "chunk bigint, docs array<struct<id: bigint, text: string, n_words: bigint, ranges: binary>>"


def _gather(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents that have open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(in_chunks(batches, 1, chunk_bytes), first):
            own = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["chunk", "docs"])

    return docs.mapInArrow(run, _TEXTS)


def _of_chunk(docs: pa.StructArray) -> tuple[Words, list[bytes], np.ndarray]:
    return Words(text_bytes(docs.field("text")), 0, len(docs)), docs.field("ranges").to_pylist(), _ids(docs.field("id"))


def _one(batch: pa.RecordBatch, i: int) -> pa.StructArray:
    return batch.column("docs").slice(i, 1).flatten()


def _ask_windows(chunks: DataFrame, window: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, key, more, doc = _windows(*_of_chunk(_one(batch, i)), window)
                yield ask(batch.column("chunk")[i].as_py(), key, doc, bits, more)

    return chunks.mapInArrow(run, ROWS)


def _last_pass(chunks: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = _one(batch, i)
                w, ranges, ids = _of_chunk(docs)
                at, index, here, key, more, doc = _windows(w, ranges, ids, window)
                hit = at[here | (answered(batch.column("hits")[i].as_py(), key, more) < doc)[index]]
                gone = _marks(len(w), hit, hit + window)
                whole = w.raw.tobytes()
                removed, kept = [], []
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    stay = ~gone[a:b]
                    removed.append(int(gone[a:b].sum()))
                    kept.append(b" ".join([whole[s:e] for s, e in zip(w.starts[a:b][stay].tolist(), w.ends[a:b][stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([docs.field("id"), docs.field("n_words"), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return chunks.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, one space between; null: all of them) for each row.

    Words covered by a window (that many consecutive words of one document) whose
    word sequence also starts in a document with a smaller doc_id are removed.
    A null text has no words. A null doc_id is larger than any other; one that is
    no whole number is an error. Rows that repeat (the same doc_id) take nothing
    from each other. Other columns are left out.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    parsed = materialise(_first_pass(rows, window, chunk_bytes), "symbols")
    shared = reduce_keys(_ask_symbols(parsed, fan_bits), "sum", parsed.select("chunk").count(), fan_bits)
    judged = materialise(_candidates(parsed.join(shared, "chunk", "left"), window), "candidates")
    open_ = judged.where(F.col("ranges").isNotNull()).dropDuplicates(["id", "mark"]).select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "n_words", "ranges")
    texts = rows.join(open_, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))).select("id", "text", "n_words", "ranges")
    gathered = materialise(_gather(texts, chunk_bytes), "texts")
    least = reduce_keys(_ask_windows(gathered, window, fan_bits), "min", gathered.select("chunk").count(), fan_bits)
    cut = _last_pass(gathered.join(least, "chunk", "left"), window)
    rest = judged.where(F.col("ranges").isNull()).select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return cut.unionByName(rest)
