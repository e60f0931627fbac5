"""Arrow batches row by row, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters of strings and rows that an output batch holds, about.
OUT_CHARS, OUT_ROWS = 4 << 20, 10_000


def row_by_row(batch: pa.RecordBatch, rows: Callable[..., Iterator[tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows that rows(last column, *other columns) makes of each row, after its other columns.

    One row of the batch is in Python at a time, and what it makes leaves once it is a
    few MB, however many rows the batch has: a task needs its batch and little more.
    """
    keys, last = batch.columns[:-1], batch.column(batch.num_columns - 1)
    names = [*batch.schema.names[:-1], *kinds]

    def out(at: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = [c.take(pa.array(at, pa.int64())) for c in keys]
        columns += [pa.array([r[k] for r in made], t) for k, t in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    at, made, size = [], [], 0
    for i in range(batch.num_rows):
        for r in rows(last[i].as_py(), *(c[i].as_py() for c in keys)):
            at.append(i)
            made.append(r)
            size += sum(len(x) for x in r if isinstance(x, str))
            if size >= OUT_CHARS or len(made) >= OUT_ROWS:
                yield out(at, made)
                at, made, size = [], [], 0
    if made:
        yield out(at, made)
