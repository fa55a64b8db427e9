"""Groups of rows worked on in Arrow, many at once.

Rows are dealt by key to tasks of about `ROWS` rows, however many the session shuffles to, and come to the function in order, some whole groups at a time. So a task's
memory does not grow with the table, and no call is made for a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame

#: Rows of a task, about.
ROWS = 1_000_000
#: Rows that a function is given at once, about, and the largest group beyond them.
AT_ONCE = 16_384


def starts(table, keys: list[str]) -> np.ndarray:
    """Where the groups of an ordered Arrow table begin; nulls are equal."""
    import pyarrow as pa
    import pyarrow.compute as pc

    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole(keys: list[str], fn: Callable):
    def run(batches):
        import pyarrow as pa

        held, n, wait = [], 0, AT_ONCE
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= wait:
                t = pa.Table.from_batches(held).combine_chunks()
                last = int(starts(t, keys)[-1])
                if last:
                    yield from fn(t.slice(0, last).combine_chunks()).to_batches()
                held, n = t.slice(last).to_batches(), t.num_rows - last
                wait = max(AT_ONCE, 2 * n)
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()
    return run


def by_groups(df: DataFrame, keys: list[str], order: list[Column | str], fn: Callable, schema: str, size: int | None = None) -> DataFrame:
    """What `fn` (Arrow table to Arrow table) gives for the groups of `keys`, which it gets in order of the keys and `order`. size: rows of `df`, if that is dear to count."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, -(-(df.count() if size is None else size) // ROWS))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(_whole(keys, fn), schema)


def numbers(table, name: str) -> np.ndarray:
    """A column as float64, null as NaN."""
    return table.column(name).cast("double").to_numpy().astype(float)


def flags(table, name: str) -> np.ndarray:
    """A boolean column, null as false."""
    import pyarrow.compute as pc

    return pc.fill_null(table.column(name), False).to_numpy().astype(bool)
