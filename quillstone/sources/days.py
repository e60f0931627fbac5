"""A Data Source of index lines by day, for batches and streams; and sources that fail alone."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import written

SCHEMA = "date date, line string, error string"
_DAY = datetime.timedelta(days=1)


class _Day(InputPartition):
    def __init__(self, date: datetime.date):
        self.date = date


def weekdays(first: datetime.date, last: datetime.date) -> list[datetime.date]:
    days = (first + _DAY * i for i in range((last - first).days + 1))
    return [d for d in days if d.weekday() < 5]


def _rows(fetch: Callable, date: datetime.date) -> Iterator[tuple]:
    try:
        lines = fetch(date)
    except Exception as e:  # a refused day is a row, the others go on
        yield date, None, f"{type(e).__name__}: {e}"
        return
    for line in lines or ():  # a day that has no index (a holiday) has no rows
        yield date, line, None


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable, first: datetime.date, last: datetime.date):
        self.fetch, self.first, self.last = fetch, first, last

    def pushFilters(self, filters):
        """Bounds of the date decide which days are asked for at all; Spark checks the rest."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, datetime.date):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value + _DAY if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, f.value - _DAY if isinstance(f, LessThan) else f.value)
            yield f

    def partitions(self):
        return [_Day(d) for d in weekdays(self.first, self.last)]

    def read(self, partition):
        if partition is not None:  # no day is left
            yield from _rows(self.fetch, partition.date)


class _Stream(DataSourceStreamReader):
    """The offset is the last day that was asked for."""

    def __init__(self, fetch: Callable, first: datetime.date, last: Callable[[], datetime.date]):
        self.fetch, self.first, self.last = fetch, first, last

    def initialOffset(self) -> dict:
        return {"day": (self.first - _DAY).isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max(self.first - _DAY, self.last()).isoformat()}

    def partitions(self, start: dict, end: dict):
        return [_Day(d) for d in weekdays(datetime.date.fromisoformat(start["day"]) + _DAY, datetime.date.fromisoformat(end["day"]))]

    def read(self, partition):
        yield from _rows(self.fetch, partition.date)


def day_index(fetch: Callable[[datetime.date], list[str] | None], name: str = "day_index") -> type[DataSource]:
    """A Data Source to register: date, line and error, a partition a weekday, fetched on the executors.

    fetch: the lines of a day; None or none where it has no index; an exception where
    it is refused, which becomes a row with an error. Options since and until (days,
    both included; until is today where it is not given, for a stream at each trigger).
    """

    class DayIndex(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _first(self) -> datetime.date:
            return datetime.date.fromisoformat(self.options["since"])

        def _last(self) -> datetime.date:
            until = self.options.get("until")
            return datetime.date.fromisoformat(until) if until else datetime.date.today()

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, self._first(), self._last())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(fetch, self._first(), self._last)

    return DayIndex


def gather(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all sources that can be read, with a column source (others that one lacks are null), and source and error of those that cannot.

    Each source is read whole under its own guard and written, so that what fails
    while it is read (a corrupt file, a value that breaks a cast) takes no other along.
    """
    out, issues = None, []
    for name, read in sources.items():
        try:
            rows = written(read().withColumn("source", F.lit(name)), "source")
        except Exception as e:  # one source's failure is a row
            issues.append((name, (getattr(e, "getCondition", lambda: None)() or type(e).__name__)))
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame(issues, "source string, error string")
