"""Hard-negative mining by a full sort of each anchor's scores.

Rows and anchors are held as blocks of bounded size, and every pair of an anchor
block and a row block is one unit of work: integer scores by a matrix product, each
anchor's scores sorted (higher first, ties by smaller id), and from the sorted
scores the first ones that are wanted. What a pair yields is a few rows an anchor;
Spark merges those over the row blocks. First the positives (the best rows of the
anchor's label), then, for each positive, a binary search of its upper limit and the
first rows of another label from there down to its lower limit. The pairs grow with
anchors times rows, as the stated query set asks; no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, superseded
from .vectors import integers, of_one_length, whole

#: Rows and anchors of a block, at most (the former below 2**16).
ROWS, ANCHORS = 1 << 15, 1 << 13
#: Row blocks are dealt into this many for each task slot where the table is small.
BLOCKS_A_SLOT = 4
#: Scores that are sorted at once.
TILE = 1 << 21
_BLOCK = "block bigint, ids binary, labels binary, vectors binary, positives binary, scores binary"


def _packed(width: int, limit: int, positives: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, label, vector, and with positives also their ids and scores) to blocks of up to limit rows, sorted by label and id."""

    def block(held: list[tuple[np.ndarray, ...]], number: int) -> pa.RecordBatch:
        ids, labels, vectors, best, scores = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, labels))
        cells = [ids[order], labels[order], vectors[order].astype(np.int32), best[order], scores[order]]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["block", "ids", "labels", "vectors", "positives", "scores"])

    def lists(column: pa.Array, fill: int) -> np.ndarray:
        out = np.full((len(column), positives), fill, np.int64)
        sizes = np.diff(column.offsets.to_numpy())
        out[np.arange(positives) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                b = batch.slice(at, limit)
                none = np.zeros((b.num_rows, 0), np.int64)
                more = (lists(b.column(3), 0), lists(b.column(4), _NO_SCORE)) if positives else (none, none)
                if n + b.num_rows > limit:
                    yield block(held, number)
                    number, held, n = number + 1, [], 0
                held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), integers(b.column(2), width), *more))
                n += b.num_rows
        if held:
            yield block(held, number)

    return run


_NO_SCORE = np.iinfo(np.int64).min


class Block:
    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, positives: bytes, scores: bytes, width: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(-1, width).astype(np.int64)
        n = len(self.ids)
        self.positives, self.scores = (np.frombuffer(x, np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64) for x in (positives, scores))
        self.starts = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1]]) if n else np.zeros(0, np.int64)
        self.ends = np.r_[self.starts[1:], n]

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; by float64 where no partial sum can leave 53 bits, so that no rounding occurs in any order."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return np.matmul(a.astype(np.float64), b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Sorted:
    """The rows of each line of scores, higher scores first, ties by smaller id. scores: lines x rows; ids: of the rows, distinct; out: cells that take no part."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray, out: np.ndarray | None = None):
        self.at = np.argsort(ids, kind="stable")  # column of each rank
        lines, n = scores.shape
        self.n = np.full(lines, n) if out is None else n - np.count_nonzero(out, axis=1)
        self.bits = max(n - 1, 1).bit_length()
        if int(np.abs(scores).max(initial=0)) < 1 << (62 - self.bits):
            # score and rank in one number: sorting it is the sort by score and id
            rank = np.empty(n, np.int64)
            rank[self.at] = np.arange(n)
            keys = (scores << self.bits) + (((1 << self.bits) - 1) - rank)
            if out is not None:
                keys[out] = np.iinfo(np.int64).min
            keys.sort(axis=1)
            keys = keys[:, ::-1]
            self.scores = keys >> self.bits
            self.columns = self.at[np.minimum(((1 << self.bits) - 1) - (keys & ((1 << self.bits) - 1)), n - 1)]
        else:
            order = np.empty(scores.shape, np.int64)
            gone = np.zeros(n, bool)
            for i in range(lines):
                order[i] = np.lexsort((ids, -scores[i], gone if out is None else out[i]))
            self.columns = order
            self.scores = np.take_along_axis(scores, order, 1)

    def first_at_most(self, line: int, limits: np.ndarray) -> np.ndarray:
        """Places of the first scores that are no higher than the limits, by binary search."""
        n = self.n[line]
        return n - np.searchsorted(self.scores[line, :n][::-1], limits, "right")


def _tiles(anchors: Block, rows: Block) -> Iterator[tuple[int, int, int]]:
    """Anchors of one label, as many as make a tile of scores."""
    step = max(1, TILE // max(len(rows.ids), 1))
    for s, e in zip(anchors.starts.tolist(), anchors.ends.tolist(), strict=True):
        for at in range(s, e, step):
            yield int(anchors.labels[s]), at, min(at + step, e)


def best_of_label(anchors: Block, rows: Block, k: int) -> list[tuple]:
    """(anchor, id, score) of the first k rows of each anchor's label without itself."""
    found = []
    for label, a, b in _tiles(anchors, rows):
        own = rows.of_label(label)
        if own.start == own.stop:
            continue
        ids = rows.ids[own]
        line = Sorted(inner_products(anchors.vectors[a:b], rows.vectors[own]), ids, anchors.ids[a:b, None] == ids[None, :])
        take = np.arange(min(k, len(ids)))
        ok = take < line.n[:, None]
        found.append((np.broadcast_to(anchors.ids[a:b, None], ok.shape)[ok], ids[line.columns[:, : len(take)]][ok], line.scores[:, : len(take)][ok]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def limits(scores: np.ndarray, lower: int, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest n with lower * score <= 100 * n <= upper * score, without leaving 64 bits."""
    whole_, rest = np.divmod(scores, 100)
    return lower * whole_ - (-lower * rest) // 100, upper * whole_ + (upper * rest) // 100


def hard_ones(anchors: Block, rows: Block, k: int, lower: int, upper: int) -> list[tuple]:
    """(anchor, place of the positive, positive's id and score, id, score) of the first k rows of other labels within each positive's limits."""
    found = []
    least, most = limits(anchors.scores, lower, upper)
    for label, a, b in _tiles(anchors, rows):
        own = rows.of_label(label)
        other = np.r_[0 : own.start, own.stop : len(rows.ids)]
        if not len(other):
            continue
        ids = rows.ids[other]
        line = Sorted(inner_products(anchors.vectors[a:b], rows.vectors[other]), ids)
        start = np.stack([line.first_at_most(i, most[a + i]) for i in range(b - a)])
        place = start[:, :, None] + np.arange(k)
        inside = np.minimum(place, len(ids) - 1).reshape(b - a, -1)
        score = np.take_along_axis(line.scores, inside, 1).reshape(place.shape)
        got = ids[np.take_along_axis(line.columns, inside, 1)].reshape(place.shape)
        ok = (place < len(ids)) & (score >= least[a:b, :, None]) & (anchors.scores[a:b, :, None] != _NO_SCORE)
        i, j, _ = np.nonzero(ok)
        found.append((anchors.ids[a:b][i], j, anchors.positives[a:b][i, j], anchors.scores[a:b][i, j], got[ok], score[ok]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 6


def _pairs(blocks: DataFrame, anchors: DataFrame, work: Callable[[Block, Block], list], names: list[str], width: int) -> DataFrame:
    """work(anchor block, row block) for every pair of blocks.

    Each side is repeated for the other's block numbers and both are dealt by the
    pair, so that a pair is met in one task and pairs spread evenly.
    """
    of_rows, of_anchors = ([r[0] for r in x.select("block").collect()] for x in (blocks, anchors))  # numbers of blocks: one for ROWS and for ANCHORS rows
    n = max(1, min(len(of_rows) * len(of_anchors), 2 * blocks.sparkSession.sparkContext.defaultParallelism * max(1, len(of_anchors))))
    cells = ["ids", "labels", "vectors", "positives", "scores"]

    def dealt(side: DataFrame, mine: str, other: str, numbers: list[int]) -> DataFrame:
        named = side.select(F.col("block").alias(mine), *(F.col(c).alias(f"{mine}_{c}") for c in cells))
        return named.select("*", F.explode(F.lit(numbers)).alias(other)).repartition(n, "rb", "ab")

    pairs = dealt(blocks, "rb", "ab", of_anchors).join(dealt(anchors, "ab", "rb", of_rows), ["rb", "ab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                got = work(Block(*row[5:], width), Block(*row[:5], width))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=names)

    chosen = pairs.select(*(f"rb_{c}" for c in cells), *(f"ab_{c}" for c in cells))
    return chosen.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the first rows of other labels within the limits.

    anchor: a condition on rows. Scores are inner products of floor(256 * x); higher
    come first, ties by smaller id. A positive of score p allows negatives n with
    lower * p <= 100 * n <= upper * p (none for p < 0).
    Rows with a null id, label or vector, or with a component that is null or not
    finite, take no part, nor do vectors whose length is not that of the least id's.
    Of rows that share an id the least by label and vector takes part; ids and
    labels are whole numbers. No rows, no anchors or one label give no result.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    kept, width = of_one_length(own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("v"))), "id", "v")
    once = materialise(kept.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*"), "vectors")
    n, n_anchors = once.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], out)
    slots = spark.sparkContext.defaultParallelism
    n_blocks = max(math.ceil(n / ROWS), min(BLOCKS_A_SLOT * slots, math.ceil(n / 256)))
    blocks = materialise(once.select("id", "label", "v").repartition(n_blocks).mapInArrow(_packed(width, ROWS, 0), _BLOCK), "row-blocks")
    asked = once.where("anchor").select("id", "label", "v").repartition(math.ceil(n_anchors / ANCHORS))
    asked = materialise(asked.mapInArrow(_packed(width, ANCHORS, 0), _BLOCK), "anchor-blocks")
    near = _pairs(blocks, asked, lambda a, r: best_of_label(a, r, positives), ["anchor_id", "positive_id", "score"], width)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    first = materialise(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    superseded(asked)
    # sorted by place: a list of positives a row at most
    lists = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))
    asked = once.where("anchor").join(lists, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "p.positive_id", "p.score").repartition(math.ceil(n_anchors / ANCHORS))
    asked = materialise(asked.mapInArrow(_packed(width, ANCHORS, positives), _BLOCK), "anchor-blocks")
    hard = _pairs(blocks, asked, lambda a, r: hard_ones(a, r, negatives, lower, upper), ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"], width)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
