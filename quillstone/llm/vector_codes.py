"""Vector code compression: product codes by exact integer distances, screened in float32.

Each vector is cut into equal parts and each part is replaced by the number of its
nearest codebook entry. A float32 matrix product gives every entry's score with a
bound on its rounding error; entries whose interval overlaps the best one's are
measured again in int64, and ties go to the lower index. So the codes are those of
exact arithmetic, at the speed of float32.

Codebooks (parts x entries integers vectors, a fixed size whatever the data) are
learnt in rounds: tasks sum the parts of each entry, Spark adds the sums. Rows are
never shuffled but for the error by label, which is pre-aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialise, meet
from .vectors import integers, of_one_length, whole

_UNIT = 2.0**-24


class Codebooks:
    """entries: integers of shape (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = (entries * entries).sum(2)
        self._turned = np.ascontiguousarray(entries.transpose(0, 2, 1)).astype(np.float32)
        self._norms = self.norms.astype(np.float32)[:, None, :]
        self._largest = np.abs(entries).max(1).astype(np.float64)  # of each part's component
        self._top = self.norms.max(1).astype(np.float64)

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as (parts, rows, width)."""
        parts, _, width = self.entries.shape
        return np.ascontiguousarray(vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2))

    def screened(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Float32 scores |c|**2 - 2 v.c, and for each part and row a bound on the error of every one of its scores.

        In float32 each input is off by one rounding, a sum of width products in any
        order by width of them, the doubling by none and the difference by one:
        at most gamma(width + 4) times the sum of the absolute terms, which is at
        most |c|**2 + 2 sum |v||c| with the largest |c| of each component.
        """
        scores = self._norms - np.float32(2) * np.matmul(cut.astype(np.float32), self._turned)
        k = (cut.shape[2] + 4) * _UNIT
        terms = self._top[:, None] + 2 * np.einsum("prw,pw->pr", np.abs(cut).astype(np.float64), self._largest)
        return scores, terms * (k / (1 - k)) * 1.000001  # the last factor: this line's own rounding

    def nearest(self, cut: np.ndarray) -> np.ndarray:
        """Of each part and row the nearest entry by exact distance, ties to the lower index."""
        scores, radius = self.screened(cut)
        best = scores.argmin(2)
        low = np.take_along_axis(scores, best[:, :, None], 2)
        open_ = scores.astype(np.float64) <= low.astype(np.float64) + 2 * radius[:, :, None]
        several = np.count_nonzero(open_, axis=2) > 1
        if several.any():
            part, row = np.nonzero(several)
            pair, entry = np.nonzero(open_[part, row])
            gap = cut[part, row][pair] - self.entries[part[pair], entry]
            exact = (gap * gap).sum(1)
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            least = np.minimum.reduceat(exact, starts)
            hits = np.flatnonzero(exact == least[pair])
            _, first = np.unique(pair[hits], return_index=True)  # of equal ones the lowest index comes first
            best[part, row] = entry[hits[first]]
        return best

    def errors(self, cut: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances to the coded entries, summed over parts."""
        gap = cut - np.take_along_axis(self.entries, codes[:, :, None], 1)
        return (gap * gap).sum((0, 2))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def learn(rows: DataFrame, width: int, vec_id: str, vector: str, parts: int, entries: int, rounds: int) -> Codebooks:
    """The codebooks start as the parts of the rows of least vec_id (then of the lesser vector); each round moves an entry to the floor of its parts' mean, and leaves one that has none."""
    first = rows.select(F.col(vec_id), F.col(vector)).orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    start = integers(pa.array([r[1] for r in first], pa.list_(pa.float64())), width)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)))
    each = width // parts
    sums = ", ".join(f"s{i} bigint" for i in range(each))
    for _ in range(rounds):
        added = rows.select(vector).mapInArrow(_summing(books, width), f"part int, entry int, n bigint, {sums}")
        new = books.entries.copy()
        for r in added.groupBy("part", "entry").agg(F.sum("n"), *(F.sum(f"s{i}") for i in range(each))).collect():  # parts x entries rows at most
            new[r[0], r[1]] = [s // r[2] for s in r[3:]]
        books = Codebooks(new)
    return books


def _summing(books: Codebooks, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, each = books.entries.shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, each), np.int64)
        for batch in batches:
            cut = books.cut(integers(batch.column(0), width))
            codes = books.nearest(cut)
            for p in range(parts):
                n[p] += np.bincount(codes[p], minlength=entries)
                np.add.at(sums[p], codes[p], cut[p])
        part, entry = np.nonzero(n)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry])]
            columns += [pa.array(np.ascontiguousarray(sums[part, entry, i])) for i in range(each)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(each))])

    return run


def _coding(books: Codebooks, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = 2 * books.entries.shape[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = books.cut(integers(batch.column(2), width))
            codes = books.nearest(cut)
            text = np.ascontiguousarray(codes.T).astype(np.uint8).tobytes().hex()
            code = pa.array([text[i : i + digits] for i in range(0, len(text), digits)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(books.errors(cut, codes))], names=names)

    return run


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (two hex digits a part), error and label_error (the errors of all rows of that label, nulls together) of each whole vector; and the codebooks.

    A null vector, one that holds a null, a NaN or an infinity, an empty one, and
    one whose length is not that of the least vec_id's or no multiple of parts
    drop out. Ids may repeat or be null (nulls come last); each row gets its code.
    Fewer rows than entries give as many entries as rows; no rows give no codebooks.
    Components beyond the limit of vectors.limit() count as the limit. entries: 256 at most.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    own = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    kept, width = of_one_length(own.where(whole(F.col("v")) & (F.size("v") % parts == 0)), "vec_id", "v")
    fields = [*own.select("vec_id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())]
    if not width:
        return rows.sparkSession.createDataFrame([], StructType([*fields, StructField("label_error", LongType())])), None
    books = learn(kept, width, "vec_id", "v", parts, entries, rounds)
    coded = materialise(kept.select("vec_id", "label", "v").mapInArrow(_coding(books, width, [f.name for f in fields]), StructType(fields)), "codes")
    totals = materialise(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return meet(coded, totals, [("label", "__label")], F.xxhash64("vec_id", "code")), books

