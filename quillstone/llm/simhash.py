"""SimHash near-duplicates by pigeonring filtering.

Fingerprints have 64 bits; two link at 3 or fewer differing bits. The bits lie on
a ring of 5 segments. If the segments' differences sum to 3 or less, then from
some segment on every chain of l consecutive ones differs in at most 3 * l / 5
bits: the first not at all, the first three in one bit at most. So a linked pair
shares a start segment and one of the next two (26 bits); these are the keys of
the candidate buckets, and a pair must pass the whole chain test from that start
before its Hamming distance is taken.

Equal fingerprints are one node from the start. A bucket gives the edges of a
spanning forest, not its pairs; a bucket beyond BLOCK nodes is cut into blocks,
and every two blocks are compared in a task of their own. Components come from
alternating large-star and small-star steps, a written table after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, superseded

BITS, DISTANCE = 64, 3
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 2048
_SMALL = 12
_ALLOWED = [(k + 1) * DISTANCE // len(SEGMENTS) for k in range(len(SEGMENTS))]
_MASKS = np.array([((1 << w) - 1) << at for at, w in SEGMENTS], np.uint64)


def fingerprint(text: bytes) -> int:
    """A-Z lower-cased, words at ASCII white space, XXH64 (seed 42) of 3-word shingles; a bit is set if it is in over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns and fp (as a signed long) of each row; a null text has no words, so 0."""
    kept = docs.select(*keep, docs[text].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_string()).cast(pa.large_binary())
        fp = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return arrow_map(kept, run, f"{types}, fp bigint")


def _keys(fp: Column) -> Column:
    """For each start segment and each of the next two: both segments' bits, and which they are."""
    n, part = len(SEGMENTS), lambda i: F.shiftright(fp, SEGMENTS[i][0]).bitwiseAND(F.lit((1 << SEGMENTS[i][1]) - 1))
    keys = [F.shiftleft(F.lit(2 * i + d - 1).cast("bigint"), 32).bitwiseOR(F.shiftleft(part(i), 13)).bitwiseOR(part((i + d) % n)) for i in range(n) for d in (1, 2)]
    return F.array(*keys)


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether pairs pass the chain from their start segment, and then the full Hamming check."""
    differ = a ^ b
    ok = np.ones(differ.shape, bool)
    seen = np.zeros(differ.shape, np.int16)
    for k, allowed in enumerate(_ALLOWED[:-1]):
        seen += np.bitwise_count(differ & _MASKS[(start + k) % len(SEGMENTS)])
        ok &= seen <= allowed
    return ok & (np.bitwise_count(differ) <= DISTANCE)


def _forest(fp: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A star for each component of one bucket's nodes, by breadth-first search."""
    out, rest = [], np.unique(fp)
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for x in np.array_split(front, len(front) // 256 + 1):
                hit |= _linked(x[:, None], rest[None, :], np.array(start)).any(0)
            front, rest = rest[hit], rest[~hit]
            out.append((np.full(len(front), root), front))
    return out


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, low, high, fp) in the order of the first three; a bucket may go on over batches."""

    def edges(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = (key >> 33).astype(np.int64)
        new = np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        out = []
        small = size[group] <= _SMALL
        at = np.flatnonzero(small)
        for d in range(1, _SMALL):
            at = at[at + d < len(key)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            hit = at[(fp[at] != fp[at + d]) & _linked(fp[at], fp[at + d], start[at])]
            out.append((fp[hit], fp[hit + d]))
        first = np.flatnonzero(new)
        for g in np.flatnonzero(size > _SMALL):
            out += _forest(fp[first[g] : first[g] + size[g]], int(start[first[g]]))
        u, v = (np.concatenate([x[i] for x in out] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        key, low, high, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        now = [key, low * (1 << 31) + high, fp.view(np.uint64)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield edges(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield edges(*held)


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u > v) that connect just what the links between the nodes' fingerprints (column fp, distinct) connect."""
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = cut.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").cast("bigint").alias("low"), F.greatest("own", "other").cast("bigint").alias("high"), "fp")
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return dealt.mapInArrow(_bucket_edges, "u bigint, v bigint")


def _least(pairs: DataFrame, edges: int) -> DataFrame:
    """(u, v, least v of u) of each pair. Nodes with a great many pairs (at most 1000 can have that many) go by a broadcast, the others by a join."""
    by_node = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    most = max(20_000, edges // 500)
    hot = F.broadcast(by_node.where(F.col("n") > most).select("u", "m"))
    return pairs.join(hot, "u", "left_anti").join(by_node.select("u", "m"), "u").unionByName(pairs.join(hot, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node of its component; roots have no row."""
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select("v", "u"))
        large = _least(both, state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialise(large, "edges")
        superseded(now)
        least = _least(large, state[0])
        small = least.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges")
        superseded(large)
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp, root (the component's least fingerprint), component_id (the least doc_id that links reach, itself included) and the columns of more, for each row.

    Null and empty texts have fingerprint 0 and link as any other. Rows may repeat;
    each gets its own. A null doc_id is passed over in the choice of the least; a
    component with no other gets a null.
    """
    extra = [c.alias(f"__more{i}") for i, c in enumerate(more)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__t"), *extra)
    prints = materialise(fingerprints(rows, "__t", ("doc_id", *(f"__more{i}" for i in range(len(extra))))), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    of_node = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialise(of_node.join(of_root, "root").select("fp", "root", "component_id"), "groups")
    return prints.join(by_print, "fp")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates, with all columns: that with the least doc_id (nulls last; then by a hash of the text).

    Rows that repeat whole stay once.
    """
    names = docs.columns
    mark = F.xxhash64(F.col(f"`{text}`"))
    rows = grouped(docs, text, doc_id, (mark,))
    # of each group one (doc_id, mark), found by partial aggregates
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__more0").alias("mark"))
    kept = rows.groupBy("root").agg(F.min(order).alias("k"))
    copies = rows.groupBy("doc_id", "__more0").agg(F.count(F.lit(1)).alias("__copies"))
    kept = kept.select(F.when(~F.col("k.none"), F.col("k.id")).alias("doc_id"), F.col("k.mark").alias("__more0"))
    keys = kept.join(copies, kept["doc_id"].eqNullSafe(copies["doc_id"]) & (kept["__more0"] == copies["__more0"])).select(kept["doc_id"].alias("__id"), kept["__more0"].alias("__mark"), "__copies").distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), F.col(f"`{doc_id}`").alias("__i"), mark.alias("__m"))
    got = whole.join(keys, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")))
    once = got.where("__copies = 1").unionByName(got.where("__copies > 1").dropDuplicates(["__i", "__m"]))
    return once.select("__doc.*")
