"""Many small groups in one task: Arrow tables of whole groups, and patches of one shape as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a table of whole groups has at least, and cells that a stack has at most (or one patch).
ROWS, CELLS = 1 << 16, 1 << 21


def group_numbers(table: pa.Table, keys) -> np.ndarray:
    """0, 1, 2, ... by runs of rows with equal keys."""
    new = np.zeros(table.num_rows, np.int64)
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(batches, keys, least: int = ROWS) -> Iterator[pa.Table]:
    """The rows of batches sorted by ``keys``, cut between groups only."""
    held, n, wanted = [], 0, least
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= wanted:
            table = pa.Table.from_batches(held)
            last = int(np.searchsorted(numbers := group_numbers(table, keys), numbers[-1]))
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            n = table.num_rows - last
            wanted = max(least, 2 * n)  # a group larger than ``least`` is gathered in steps that double
    if n:
        yield pa.Table.from_batches(held)


def per_table(rows: DataFrame, keys, make: Callable[[pa.Table], pa.Table], schema, *order: str) -> DataFrame:
    """What ``make`` makes of tables that hold groups of ``keys`` whole, rows of a group in ``order``."""
    def run(batches):
        for table in whole_groups(batches, keys):
            yield from make(table).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def stacks(group: np.ndarray, r: np.ndarray, c: np.ndarray, height: np.ndarray, width: np.ndarray, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int, int]]]:
    """(rows, places, shape) of stacks: groups of one height and width, as many as ``cells`` allows.

    ``height`` and ``width`` are by group; ``places`` index the flat stack of ``shape``.
    """
    sizes, of_group = np.unique(np.stack([height, width], axis=1), axis=0, return_inverse=True)
    of_group = of_group.ravel()
    order = np.argsort(of_group[group], kind="stable")
    ends = np.searchsorted(of_group[group][order], np.arange(len(sizes) + 1))
    for k, (h, w) in enumerate(sizes):
        rows = order[ends[k] : ends[k + 1]]
        number = np.unique(group[rows], return_inverse=True)[1]  # sorted already: rows keep the order of groups
        most = max(1, cells // int(h * w))
        for low in range(0, int(number[-1]) + 1, most):
            a, b = np.searchsorted(number, (low, low + most))
            some = rows[a:b]
            n = int(number[b - 1]) - low + 1
            yield some, ((number[a:b] - low) * h + r[some]) * w + c[some], (n, int(h), int(w))


def ends(group: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """One more than the largest of each group's values, by group."""
    first = np.flatnonzero(np.r_[True, np.diff(group) > 0])
    return [np.maximum.reduceat(x, first) + 1 for x in values]


def below(x: np.ndarray, y: np.ndarray, weights: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, open_x: bool, open_y: bool) -> np.ndarray:
    """Sums of the rows of ``weights`` whose (x, y) lies at or below (at_x, at_y) on both axes; on an open axis, below it.

    Rows in order of x are dealt by the bits of their rank in y, high bits first;
    a point's rows stay one range, so each bit costs two looks at running sums.
    """
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    high = np.searchsorted(x[by_x], at_x, "left" if open_x else "right")
    most = np.searchsorted(y[by_y], at_y, "left" if open_y else "right")
    rank = np.empty(len(y), np.int64)
    rank[by_y] = np.arange(len(y))
    rank, weights, low = rank[by_x], weights[by_x], np.zeros(len(high), np.int64)
    out = np.zeros((len(at_x), weights.shape[1]), weights.dtype)
    for bit in reversed(range(len(y).bit_length())):
        zero = (rank >> bit) & 1 == 0
        before = np.r_[0, np.cumsum(zero)]
        sums = np.concatenate([np.zeros((1, weights.shape[1]), weights.dtype), np.cumsum(weights[zero], axis=0)])
        up = (most >> bit) & 1 == 1
        out[up] += sums[before[high[up]]] - sums[before[low[up]]]
        low, high = (np.where(up, before[-1] + k - before[k], before[k]) for k in (low, high))
        order = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
        rank, weights = rank[order], weights[order]
    return out
