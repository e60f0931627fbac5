"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are parted by the number of their distinct shingles (powers of two). An
item of q shingles is in a document if at least c = ceil(0.8 * q) of them are;
then any q - c + 1 of its shingles have one in the document. So an item's sketch
is that many of its least hash values (bottom-k MinHash, k set by the largest
size of its part), and no contained item is missed, however long the document.
Every shingle of every whole document is looked up in the sketches (numpy, on
flat arrays); what is met is verified on the exact shingles.

A benchmark up to BLOCK_BYTES goes to the executors whole. A larger one stays where
it is: documents are read once, their shingles that a bitmap of the benchmark's
passes (a fixed size) meet its sketches in a join, and the pairs that have enough
hashes in common are verified on the words of all their shingles, as in the first
way. Both ways have the same result, whatever hashes are equal by chance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialise, slices, text_bytes, window_hashes

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of item texts that are sent to the executors, at most.
BLOCK_BYTES = 8 << 20
#: Bits of the hash that the bitmap of a larger benchmark goes by: 2 ** 26 bits, 8 MB.
MAP_BITS = 26
#: What is no part of a word here: ASCII other than letters and digits.
_BREAK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str | bytes | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased (all beyond ASCII counts as letters)."""
    data = text.encode() if isinstance(text, str) else text or b""
    return _words(data.lower())


def shingles_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(n)), strict=False)) if words else []


def length_for(words: list[bytes], n: int = SHINGLE) -> int:
    """Shingle length of an item: n, or all its words if it has fewer."""
    return min(n, len(words))


class Index:
    """The sketches of one block of items, and their shingles for the exact check."""

    def __init__(self, items: list[tuple[object, str | None]], containment: float = CONTAINMENT, shingle: int = SHINGLE):
        self.containment = containment
        self.sets: list[tuple[object, int, frozenset]] = []
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = words_of(text)
            n = length_for(words, shingle)
            if not n:
                continue
            data = b" ".join(words)
            w = Words(text_bytes(pa.array([data.decode()])), 0, 1)
            hashes = np.unique(window_hashes(w.hashes(), n))
            number, q = len(self.sets), len(hashes)
            self.sets.append((item, n, frozenset(shingles_of(words, n))))
            part = 1 << (q - 1).bit_length()  # the largest size in its part
            size = part - self.least(part) + 1
            for h in hashes[: max(size, q - self.least(q) + 1)].tolist():
                found[n][h].append(number)
        self.tables = {n: (keys := np.array(sorted(t), np.uint64), [t[h] for h in sorted(t)], _filter(keys)) for n, t in found.items()}

    def least(self, q: int) -> int:
        """Shingles of q that must be found."""
        return max(1, int(np.ceil(self.containment * q - 1e-9)))

    def find(self, column: pa.Array, start: int, end: int) -> Iterator[tuple[int, object, float]]:
        """(text, item, containment) of texts column[start:end], for each item that is in a text."""
        w = Words(column, start, end, lower=True, no_word=_BREAK)
        if not len(w):
            return
        hashes = w.hashes()
        pairs: set[tuple[int, int]] = set()
        for n, (keys, items, some) in self.tables.items():
            h = window_hashes(hashes, n)
            if not len(h):
                continue
            at = np.flatnonzero(some[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[slot] == h[at]
            at, slot = at[hit], slot[hit]
            text = np.searchsorted(w.first, at, "right") - 1
            inside = at + n <= w.first[text + 1]
            for t, s in set(zip(text[inside].tolist(), slot[inside].tolist(), strict=True)):
                pairs.update((t, i) for i in items[s])
        by_text: dict[int, list[int]] = defaultdict(list)
        for t, i in pairs:
            by_text[t].append(i)
        for t, numbers in sorted(by_text.items()):
            words = words_of(column[start + t].as_py())
            sets = {n: set(shingles_of(words, n)) for n in {self.sets[i][1] for i in numbers}}
            for i in sorted(numbers):
                item, n, own = self.sets[i]
                share = len(own & sets[n]) / len(own)
                if share >= self.containment - 1e-9:
                    yield t, item, share


def _filter(keys: np.ndarray) -> np.ndarray:
    """Which top 20 bits occur: most shingles end here."""
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def _items(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    return benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()


def _small(items: DataFrame, block_bytes: int) -> list[tuple[object, str]] | None:
    """All items if they are small enough to be sent, else None."""
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > block_bytes:
        return None
    return [(r.i, r.t) for r in items.orderBy("i", "t").collect()]


def contained(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_text: str = "text", item_id: str = "item_id", containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """The keep columns, item_id and containment (share of the item's distinct shingles that the document has), where that is 0.8 or more.

    Shingles have five words (an item of fewer: all of them; of none: it is in no
    document). hash_bits: of the shingles' hashes in joins (fewer only cost time).
    Null texts have no words. A row of docs that repeats gives its rows
    again; items that repeat whole count once. Other columns are left out.
    """
    kept = docs.select(*keep, docs[text].alias("__text"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    items = _items(benchmark, item_text, item_id)
    small = _small(items, block_bytes)
    if small is None:
        rows = docs.select(F.struct(*keep).alias("__keep"), docs[text].alias("__text")).withColumn("__row", F.monotonically_increasing_id())
        found, each = _joined(rows, items, containment, hash_bits)
        return each.join(found, "__row").select("__keep.*", F.col("i").alias("item_id"), "containment")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    index = docs.sparkSession.sparkContext.broadcast(Index(small, containment))
    return kept.mapInArrow(_run(index), ", ".join([*types, f"item_id {kind}", "containment double"]))


def _run(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_bytes(batch.column(batch.num_columns - 1))
            rows = [(a + t, i, c) for a, b in slices(column) for t, i, c in index.value.find(column, a, b)]
            if rows:
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [c.take(at) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.float64())], names=[*batch.schema.names[:-1], "item_id", "containment"])

    return run


_ITEM = "number bigint, n int, h bigint, sketch boolean, least int"


def _least(containment: float, k: int) -> int:
    return max(1, int(np.ceil(containment * k - 1e-9)))


def _cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of each hash."""
    return hashes & np.uint64(((1 << bits) - 1) << (64 - bits))


def _hashed_items(items: DataFrame, containment: float, hash_bits: int) -> DataFrame:
    """items has (number, t). A row for each distinct hash of each item's shingles: their length and the hash, whether it is in the item's sketch, and how many must be found.

    Shingles that share a hash by chance are one here, and count as found together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = length_for(words)
                if not n:
                    continue
                hashes = np.unique(_cut(window_hashes(Words(text_bytes(pa.array([b" ".join(words).decode()])), 0, 1).hashes(), n), hash_bits))
                q, exact = len(hashes), len(set(shingles_of(words, n)))
                part = 1 << (exact - 1).bit_length()
                must = max(1, _least(containment, exact) - (exact - q))
                size = max(part - _least(containment, part) + 1, q - must + 1)
                ones = np.ones(q, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number * ones), pa.array(n * ones, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(np.arange(q) < size), pa.array(must * ones, pa.int32())], names=["number", "n", "h", "sketch", "least"])

    return items.select("number", "t").mapInArrow(run, _ITEM)


def _bitmap(hashed: DataFrame) -> np.ndarray:
    """A bit for the leading bits of each hash; one bitmap of a task at a time comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            out[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in hashed.select("h").coalesce(64).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    return total


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (__row, i, item's text, document's text, and no more) to (__row, i, share of the item's distinct shingles, by their words, in the document)."""
    held: tuple[int, int, set] = (-1, 0, set())  # rows come sorted by document: its shingles serve all its items
    for batch in batches:
        numbers, item, text = (batch.column(k).to_pylist() for k in (0, 2, 3))
        shares = []
        for row, a, b in zip(numbers, item, text, strict=True):
            words = words_of(a)
            n = length_for(words)
            if held[:2] != (row, n):
                held = row, n, set(shingles_of(words_of(b), n))
            of_item = set(shingles_of(words, n))
            shares.append(len(of_item & held[2]) / len(of_item))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["__row", "i", "containment"])


def _joined(rows: DataFrame, items: DataFrame, containment: float, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """rows has (__text, __row, ...). (__row, i, containment) of what is found, and the rows as they were written (their numbers hold)."""
    items = materialise(items.withColumn("number", F.monotonically_increasing_id()), "items")
    hashed = materialise(_hashed_items(items, containment, hash_bits), "shingles")
    lengths = [r.n for r in hashed.select("n").distinct().collect()]  # five at most
    each = materialise(rows, "texts")
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            column, ids = text_bytes(batch.column(0)), batch.column(1).to_numpy()
            for a, b in slices(column):
                w = Words(column, a, b, lower=True, no_word=_BREAK)
                words = w.hashes()
                for n in lengths:
                    h = _cut(window_hashes(words, n), hash_bits)
                    at = np.flatnonzero(some[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
                    text = np.searchsorted(w.first, at, "right") - 1
                    inside = at + n <= w.first[text + 1] if len(at) else np.zeros(0, bool)
                    both = np.unique(np.stack([ids[a + text[inside]].view(np.uint64), h[at[inside]]], 1), axis=0) if inside.any() else np.zeros((0, 2), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(np.full(len(both), n), pa.int32()), pa.array(both[:, 1].view(np.int64))], names=["__row", "n", "h"])

    hits = materialise(each.select("__text", "__row").mapInArrow(run, "__row bigint, n int, h bigint").join(hashed.select("n", "h").distinct(), ["n", "h"], "left_semi"), "hits")
    pairs = hits.join(hashed.where("sketch").select("n", "h", "number"), ["n", "h"]).select("__row", "number").distinct()
    counted = pairs.join(hashed.select("number", "n", "h", "least"), "number").join(hits, ["__row", "n", "h"]).groupBy("__row", "number").agg(F.count(F.lit(1)).alias("c"), F.max("least").alias("least"))
    likely = counted.where("c >= least").join(items, "number").select("__row", "i", "t")
    both = likely.join(each.select("__row", "__text"), "__row").sortWithinPartitions("__row").select("__row", "i", "t", "__text")
    found = both.mapInArrow(_verified, f"__row bigint, i {items.schema['i'].dataType.simpleString()}, containment double").where(F.col("containment") >= containment - 1e-9)
    return found, each


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (all columns, whatever their names) without the rows that contain an item."""
    names = docs.columns
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), F.col(f"`{text}`").alias("__text"))
    items = _items(benchmark, item_text, item_id)
    small = _small(items, block_bytes)
    if small is None:
        found, each = _joined(out.withColumn("__row", F.monotonically_increasing_id()), items, containment)
        return each.join(found.select("__row").distinct(), "__row", "left_anti").select("__doc.*")
    index = docs.sparkSession.sparkContext.broadcast(Index(small, containment))
    return out.mapInArrow(_clean(index), out.schema).select("__doc.*")


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_bytes(batch.column(1))
            hit = np.zeros(batch.num_rows, bool)
            for a, b in slices(column):
                hit[[a + t for t, _, _ in index.value.find(column, a, b)]] = True
            yield batch.filter(pa.array(~hit))

    return run
