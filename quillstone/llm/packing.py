"""Best-fit packing into bins of several permitted lengths.

Only the histogram of lengths matters to the packer, and it has at most as many
rows as the longest permitted length, whatever the number of documents. On it the
driver runs best-fit decreasing with counts: bins that have been filled alike are
one range of bin numbers. An item goes into the fullest bin that holds it; where
none does, the bin size is opened that costs least for each token it can expect
to hold. All sets of permitted lengths that may be opened are tried, every bin is
at last downsized to the least permitted length that holds its contents, and the
set with the least total cost wins.

The plan (ranges of items of one length to ranges of bins) goes to the executors,
where each item finds its bin by its rank among the items of its length. Ranks
come from counts by (length, salt), so no length is ranked in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_map, materialise, slices, text_bytes

SIZES = (512, 1024, 2048, 4096, 8192)
#: What a bin costs beside its tokens, and what the square of its size adds (attention).
BIN_COST, SQUARE_COST = 16.0, 1 / 65536


def cost_of(size: int) -> float:
    return BIN_COST + size + SQUARE_COST * size * size


@dataclass(frozen=True)
class Plan:
    """segments: length, first rank, number of items, first bin, place in the bin. bins: first bin, number of bins, tokens used, size."""

    segments: np.ndarray
    bins: np.ndarray
    cost: float


def _pack(lengths: list[tuple[int, int]], opens: tuple[int, ...], sizes: tuple[int, ...]) -> Plan:
    """Best-fit decreasing of (length, count), longest first; only sizes in opens are opened (or the least permitted that holds an item)."""
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first bin, bins, used)
    rooms: list[int] = []
    segments, n_bins = [], 0
    tokens_left = np.zeros(sizes[-1] + 2)
    for length, count in lengths:
        tokens_left[length] += length * count
    below = np.cumsum(tokens_left)  # tokens of items of at most a length: none of them is placed before the longer ones

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(group)

    for length, count in lengths:
        rank = 0
        while rank < count:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins, used = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
                n = min(bins, count - rank)
                segments.append((length, rank, n, first, used))
                put(room - length, (first, n, used + length))
                if n < bins:
                    put(room, (first + n, bins - n, used))
                rank += n
            else:
                fits = [s for s in opens if s >= length] or [next(s for s in sizes if s >= length)]
                rest = max(0.0, below[length] - length)
                size = min(fits, key=lambda s: (cost_of(s) / (length + min(s - length, rest)), s))  # noqa: B023
                each = size // length
                bins = max(1, (count - rank) // each)
                each = min(each, count - rank)
                for j in range(each):
                    segments.append((length, rank, bins, n_bins, j * length))
                    rank += bins
                put(size - each * length, (n_bins, bins, each * length))
                n_bins += bins
    table = sorted((first, bins, used, next(s for s in sizes if s >= used)) for room in groups.values() for first, bins, used in room)
    total = sum(bins * cost_of(size) for _, bins, _, size in table)
    return Plan(np.array(segments, np.int64).reshape(-1, 5), np.array(table, np.int64).reshape(-1, 4), total)


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """The cheapest packing over all sets of sizes that may be opened."""
    sizes = tuple(sorted(sizes))
    lengths = sorted(((n, c) for n, c in histogram.items() if n > 0 and c > 0), reverse=True)
    sets = [s for k in range(1, len(sizes) + 1) for s in combinations(sizes, k)]
    best = min((_pack(lengths, s, sizes) for s in sets), key=lambda p: p.cost)
    order = np.lexsort((best.segments[:, 1], best.segments[:, 0]))
    return Plan(best.segments[order], best.bins, best.cost)


def word_lengths(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns and n_tokens: words, and one end for a text that has any."""
    kept = docs.select(*keep, F.col(f"`{text}`").alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = text_bytes(batch.column(batch.num_columns - 1))
        n = np.concatenate([Words(column, a, b).counts() for a, b in slices(column)])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n + (n > 0), pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return arrow_map(kept, run, f"{types}, n_tokens bigint")


def pack(lengths: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """For each chunk of each row: doc_id, chunk, start, n_tokens, bin_id, bin_offset, bin_used, bin_size.

    A row longer than the longest size is cut into chunks of that size and a
    rest. A row of null or no tokens has one chunk of 0 tokens in no bin (nulls).
    Rows that repeat are packed each for itself. Every bin's chunks lie end to end
    from 0, and bin_size is the least permitted size that holds them.
    """
    sizes = tuple(sorted(sizes))
    longest = sizes[-1]
    rows = materialise(lengths.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(n_tokens).cast("bigint"), F.lit(0).cast("bigint")).alias("n")), "lengths")
    chunk = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / longest).cast("int") - 1, F.lit(0))))
    chunks = rows.select("doc_id", "n", chunk.alias("chunk")).select("doc_id", "chunk", (F.col("chunk").cast("bigint") * longest).alias("start"), F.least(F.lit(longest).cast("bigint"), F.col("n") - F.col("chunk").cast("bigint") * longest).alias("n_tokens"))
    salts = max(1, isqrt(rows.count()))  # so neither the ranks of a salt nor the offsets of a length are many in one task
    salted = chunks.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).toLocalIterator()}  # at most longest rows
    made = lengths.sparkSession.sparkContext.broadcast(plan(histogram, sizes))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "chunk"))
    ranked = salted.withColumn("here", here).join(offsets, ["n_tokens", "salt"]).select("doc_id", "chunk", "start", "n_tokens", (F.col("offset") + F.col("here") - 1).alias("rank"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = ranked.mapInArrow(_place(made), f"doc_id {kind}, chunk int, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_used bigint, bin_size bigint")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_offset", "bin_used", "bin_size")]
    return packed.unionByName(chunks.where("n_tokens <= 0").select("doc_id", "chunk", "start", F.lit(0).cast("bigint").alias("n_tokens"), *none))


def _place(made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, bins = made.value.segments, made.value.bins
        key = (seg[:, 0] << 46) + seg[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            s = seg[np.searchsorted(key, (n << 46) + rank, "right") - 1]
            number = s[:, 3] + rank - s[:, 1]
            b = bins[np.searchsorted(bins[:, 0], number, "right") - 1]
            new = [pa.array(x) for x in (number, s[:, 4], b[:, 2], b[:, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names=[*batch.schema.names[:4], "bin_id", "bin_offset", "bin_used", "bin_size"])

    return run


def pack_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sizes: tuple[int, ...] = SIZES, length: Column | None = None) -> DataFrame:
    """pack() of whole texts; length: tokens of a row, or None for its words and one end."""
    if length is not None:
        return pack(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), length.alias("n_tokens")), sizes=sizes)
    return pack(word_lengths(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__t")), "__t"), sizes=sizes)
