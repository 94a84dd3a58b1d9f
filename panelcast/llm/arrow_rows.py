"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 1024


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``df.mapInArrow`` where ``make()`` builds the batch function once per task.

    The function gets at most ROWS rows at a time, so what it returns for them stays small.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from each(batch.slice(at, ROWS))
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of a column one by one, a null as the empty string."""
    for value in column:
        yield value.as_py() or ""


class Memo(dict):
    """A dict that fills itself by ``make`` and holds two generations of ``limit`` entries at most.

    When the young generation is full it becomes the old one; what is still in use moves back by look-up.
    """

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by integer ``keys`` into tables of whole groups.

    Only the last group of what was read waits for the next batch, so memory is bounded by a batch and one group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            if waiting:
                before = waiting[-1].column(batch.schema.names.index(k))[waiting[-1].num_rows - 1].as_py()
                new[0] |= v[0] != before
        starts = np.flatnonzero(new)
        if not len(starts):
            waiting.append(batch)
            continue
        first, last = int(starts[0]), int(starts[-1])
        if first:
            waiting.append(batch.slice(0, first))
        if last > first:
            if waiting:
                yield pa.Table.from_batches(waiting)
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        elif waiting:
            yield pa.Table.from_batches(waiting)
        waiting = [batch.slice(last)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def map_whole_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[pa.Table], Iterable[pa.RecordBatch]]],
                     schema: str) -> DataFrame:
    """Deals rows to tasks by ``keys`` (integers), sorts them, and maps tables of whole groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for table in whole_groups(batches, keys):
            yield from each(table)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of a table sorted by integer ``keys``, and the number of rows at the end."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
