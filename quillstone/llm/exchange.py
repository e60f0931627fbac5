"""Sums or least values by key over all chunks, given back to every chunk that holds the key.

A key has 64 bits, or 96 in two arrays (the second with 32 bits), and is a hash.
A chunk sorts its distinct keys and cuts them by their top bits into FAN rows of
packed arrays. Chunks are dealt into groups of about FAN; a group's rows with the
same bits meet in one task, which joins equal keys. If there is more than one group,
what a task holds is a chunk of the next level and cut by the next bits, until one
group has all that is left of its bits. The answers go back down the same way. So a
chunk makes FAN rows on a level and a level has about as many chunks as the one
below it at most, however many there are; no task holds more keys than FAN rows of a
chunk's FAN-th part, no row spans all chunks, and as keys are hashes no key is hot: a
chunk asks once, whatever it holds of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits of a key that one level takes: FAN = 2 ** FAN_BITS rows of each chunk.
FAN_BITS = 8
ROWS = "node bigint, part int, n int, keys binary, more binary, vals binary"
_ANSWER = "node bigint, part int, n int, vals binary"
_REDUCE = {"sum": np.add, "min": np.minimum}


def pack(x: np.ndarray) -> bytes:
    """int64 numbers: sign folded into the lowest bit, then byte plane by byte plane, without the planes at either end that are all 0."""
    return _planes(((x << 1) ^ (x >> 63)).view(np.uint64))


def unpack(data: bytes, n: int) -> np.ndarray:
    x = _numbers(data, n)
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """A byte that says where the planes start, then those from the first to the last that has a bit."""
    bits = int(np.bitwise_or.reduce(x)) if len(x) else 0
    low, high = ((bits & -bits).bit_length() - 1) // 8 if bits else 0, (bits.bit_length() + 7) // 8
    return bytes([low]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, low:high].T).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if len(data) > 1:
        low, planes = data[0], np.frombuffer(data, np.uint8, offset=1).reshape(-1, n)
        out[:, low : low + len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in the order of sort_order(): the first, then differences modulo 2 ** 64."""
    return keys[:1].tobytes() + _planes(np.diff(keys))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), _numbers(data[8:], n - 1)]), dtype=np.uint64)


def sort_order(keys: np.ndarray) -> np.ndarray:
    """An order by the keys' leading bits, then by place: as many bits as a place leaves of 64 (numbers sort faster than places do)."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(code, return_inverse=True) of int64 numbers from 0."""
    bits = max(1, (len(code) - 1).bit_length())
    if not len(code) or int(code.max()).bit_length() + bits > 63:
        return np.unique(code, return_inverse=True)
    both = np.sort((code << bits) | np.arange(len(code)))
    ordered, at = both >> bits, both & ((1 << bits) - 1)
    new = np.append(True, ordered[1:] != ordered[:-1])
    inverse = np.empty(len(code), np.int32)
    inverse[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], inverse


def in_order(keys: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    return sort_order(keys) if more is None else np.lexsort((more, keys))


def cut(keys: np.ndarray, more: np.ndarray | None, vals: np.ndarray, level: int, bits: int = FAN_BITS) -> list[tuple[int, int, bytes, bytes | None, bytes]]:
    """(part, n, keys, more, vals) of keys in_order(), cut by the level's bits (from 1); parts without a key are left out."""
    part = (keys << np.uint64((level - 1) * bits)) >> np.uint64(64 - bits)
    edges = np.append(np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)), len(part)).tolist()
    return [(int(part[a]), b - a, pack_keys(keys[a:b]), None if more is None else more[a:b].astype(np.uint32).tobytes(), pack(vals[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def ask(chunk: int, keys: np.ndarray, vals: np.ndarray, bits: int = FAN_BITS, more: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of one chunk: its distinct keys (in any order) with their values (int64)."""
    order = in_order(keys, more)
    rows = cut(keys[order], None if more is None else more[order], vals[order], 1, bits)
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), *columns], names=["node", "part", "n", "keys", "more", "vals"])


def zipped(data: bytes) -> bytes:
    """Compressed here, as a shuffle's own codec leaves more; after its size."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(pa.py_buffer(data).slice(8), size, "zstd", asbytes=True) if size else b""


def answered(hits: bytes | None, keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """What reduce_keys() gave a chunk, in the order of its keys."""
    out = np.zeros(len(keys), np.int64)
    if hits:
        out[in_order(keys, more)] = unpack(unzipped(hits), len(keys))
    return out


def _merge(table: pa.Table, how: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, list[np.ndarray]]:
    """Distinct keys, the rest of them, their reduced values, and for each row where its keys are among them."""
    sizes = table.column("n").to_numpy()
    keys = np.concatenate([unpack_keys(k.as_py(), n) for k, n in zip(table.column("keys"), sizes, strict=True)])
    vals = np.concatenate([unpack(v.as_py(), n) for v, n in zip(table.column("vals"), sizes, strict=True)])
    more = None if table.column("more").null_count else np.concatenate([np.frombuffer(m.as_py(), np.uint32) for m in table.column("more")])
    order = in_order(keys, more)
    if more is None and (keys[order][1:] < keys[order][:-1]).any():  # two keys that differ in their last bits alone
        order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    total = _REDUCE[how].reduceat(vals[order], np.flatnonzero(new))
    return ordered[new], None if more is None else more[order][new], total, np.split(at, np.cumsum(sizes)[:-1])


def _top(rows: DataFrame, how: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        _, _, total, at = _merge(table, how)
        return pa.table({"node": table.column("node"), "part": table.column("part"), "n": table.column("n"), "vals": pa.array([pack(total[i]) for i in at], pa.binary())})

    return rows.groupBy("g", "path", "part").applyInArrow(run, _ANSWER)


_LEVEL = "node bigint, g bigint, path bigint, inputs array<struct<node: bigint, part: int, n: int, at: binary>>, up array<struct<part: int, n: int, keys: binary, more: binary, vals: binary>>"


def _level(rows: DataFrame, how: str, level: int, bits: int) -> DataFrame:
    fan = 1 << bits
    inputs = pa.struct([("node", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("at", pa.binary())])
    up = pa.struct([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("vals", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        keys, more, total, at = _merge(table, how)
        g, part = table.column("g")[0].as_py(), table.column("part")[0].as_py()
        path = table.column("path")[0].as_py() * fan + part
        below = pa.StructArray.from_arrays([*(table.column(c).combine_chunks() for c in ("node", "part", "n")), pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary())], fields=list(inputs))
        rows = cut(keys, more, total, level + 1, bits)
        above = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], up.field(k).type) for k in range(5)], fields=list(up))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (below, above)]
        return pa.table({"node": pa.array([g * fan**level + path], pa.int64()), "g": pa.array([g // fan], pa.int64()), "path": pa.array([path], pa.int64()), "inputs": lists[0], "up": lists[1]})

    return rows.groupBy("g", "path", "part").applyInArrow(run, _LEVEL)


def _down(level: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers to a level's nodes, as answers to their inputs."""
    joined = level.select("node", "inputs").join(by_chunk(answers, "node"), "node").select("inputs", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total = np.concatenate([unpack(h["vals"], h["n"]) for h in batch.column("hits")[i].as_py()])
                rows = [(x["node"], x["part"], x["n"], pack(total[np.frombuffer(x["at"], np.int32)])) for x in batch.column("inputs")[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["node", "part", "n", "vals"])

    return joined.mapInArrow(run, _ANSWER)


def _of_chunk(answers: DataFrame) -> DataFrame:
    """A chunk's answers in the order of its parts, as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total = np.concatenate([unpack(h["vals"], h["n"]) for h in batch.column("hits")[i].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([zipped(pack(total))], pa.binary())], names=["chunk", "hits"])

    return by_chunk(answers).mapInArrow(run, "chunk bigint, hits binary")


def by_chunk(answers: DataFrame, name: str = "chunk") -> DataFrame:
    return answers.groupBy(F.col("node").alias(name)).agg(F.array_sort(F.collect_list(F.struct("part", "n", "vals"))).alias("hits"))


def reduce_keys(rows: DataFrame, how: str, chunks: int, bits: int = FAN_BITS) -> DataFrame:
    """rows: ask() of all chunks (their node numbers are distinct). chunk, hits: what answered() takes.

    how: "sum" or "min" of the values of a key over all chunks. A chunk without a key gets no row.
    """
    fan = 1 << bits
    groups = -(-max(chunks, 1) // fan)
    rows = rows.withColumns({"g": F.pmod(F.xxhash64("node"), F.lit(groups)), "path": F.lit(0).cast("bigint")})
    stored = []
    while groups > 1:
        level, groups = len(stored) + 1, -(-groups // fan)
        done = materialise(_level(rows, how, level, bits), "exchange")
        stored.append(done)
        rows = done.select("node", "g", "path", F.explode("up").alias("up")).select("node", "g", "path", "up.*")
    answers = _top(rows, how)
    for level in reversed(stored):
        answers = _down(level, answers)
    return _of_chunk(answers)
