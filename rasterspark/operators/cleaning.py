"""Cleaning of class masks.

A patch is a bounded group of cells (patch_id, r, c, class_id), dealt by its id;
each step is a function from one patch's array to another, and ``per_patch``
runs a chain of them.  A step that is marked ``stacked`` also takes patches of
one shape along a first axis, all at once; the others get one patch at a time.
Cells that are missing or have no class count as no class and stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import masks, stacks

#: No class; and no cell at all, which is as outside of the patch.
MISSING, ABSENT = -1, -2


def per_patch(cells: DataFrame, *steps, patch: str = "patch_id", value: str = "class_id", skip_failing: bool = False) -> DataFrame:
    """``cells`` with the classes that the steps, one after another, give each patch.

    With ``skip_failing`` a step that raises an error leaves its patch as it is.
    """

    def run(table: pa.Table) -> pa.Table:
        group = stacks.group_numbers(table, [patch])
        r, c = (table[x].to_numpy().astype(np.int64) for x in ("r", "c"))
        return with_classes(table, value, steps, group, r, c, *stacks.ends(group, r, c), skip_failing)

    return stacks.per_table(cells.where("r IS NOT NULL AND c IS NOT NULL"), [patch], run, cells.schema)


def with_classes(table: pa.Table, value: str, steps, group, r, c, height, width, skip_failing: bool = False) -> pa.Table:
    """``table`` with the classes that the steps give its groups; cells are at (r, c) of grids of each group's height and width."""
    known, field = table[value].is_valid().to_numpy(), table.schema.field(value)
    old = table[value].fill_null(MISSING).to_numpy().astype(np.int64)
    new = np.empty_like(old)
    for rows, places, shape in stacks.stacks(group, r, c, height, width):
        grid = np.full(shape, ABSENT, np.int64)
        grid.reshape(-1)[places] = old[rows]
        for step in steps:
            grid = _stepped(step, grid, skip_failing)
        new[rows] = grid.reshape(-1)[places]
    return table.set_column(table.schema.get_field_index(value), field, pa.array(new, mask=~known).cast(field.type))


def _stepped(step, grids: np.ndarray, skip_failing: bool) -> np.ndarray:
    if getattr(step, "stacked", False):
        try:
            return step(grids)
        except Exception:
            if not skip_failing:
                raise
    out = grids.copy()
    for k, grid in enumerate(grids):
        try:
            out[k] = step(grid.copy())
        except Exception:
            if not skip_failing:
                raise
    return out


@dataclass(frozen=True)
class Cleaning:
    """Sizes of each class's steps; ``overrides`` maps a class to its own."""

    opening: int = 1
    closing: int = 2
    least_object: int = 0
    least_hole: int = 0
    overrides: dict[int, Cleaning] = field(default_factory=dict)
    stacked: ClassVar[bool] = True

    def __call__(self, grid: np.ndarray) -> np.ndarray:
        """Opening, closing, small objects, small holes; later classes overwrite, cleared cells become 0."""
        grid, absent = grid.copy(), grid == ABSENT
        for k in np.unique(grid[grid >= 0]):
            own, mask = self.overrides.get(int(k), self), grid == k
            if own.opening:
                kernel = masks.ellipse(own.opening)
                mask = masks.dilate(masks.erode(mask | absent, kernel) & ~absent, kernel) & ~absent
            if own.closing:
                kernel = masks.ellipse(own.closing)
                mask = masks.erode(masks.dilate(mask, kernel) | absent, kernel) & ~absent
            mask = mask & ~masks.smaller_than(masks.components(mask), own.least_object)
            mask = mask | masks.smaller_than(masks.holes(mask), own.least_hole)
            grid[grid == k] = 0
            grid[mask] = k
        return grid


def majority(size: int = 3):
    """The commonest class of the size x size cells around each; borders mirror, ties take the least class.

    Cells without a class have no vote; where no cell has one, all stays as it is.
    """

    def step(grid):
        wide = np.pad(grid, [(0, 0)] * (grid.ndim - 2) + [(size // 2, (size - 1) // 2)] * 2, mode="symmetric")
        around = np.lib.stride_tricks.sliding_window_view(wide, (size, size), (-2, -1))
        best, most = grid.copy(), np.zeros(grid.shape, np.int64)
        for k in np.unique(grid[grid >= 0]):
            votes = np.count_nonzero(around == k, axis=(-2, -1))
            best[votes > most] = k
            most = np.maximum(votes, most)
        return best

    step.reach, step.stacked = size // 2, True
    return step


def fill_holes(grid: np.ndarray) -> np.ndarray:
    """Every enclosed hole takes the class around it; judged on the input, later classes overwrite."""
    out = grid.copy()
    for k in np.unique(grid[grid >= 0]):
        out[masks.holes(grid == k) > 0] = k
    return out


fill_holes.stacked = True


def replace_small(least: int = 64):
    """Components of fewer than ``least`` cells take the commonest other class within two steps; ties take the least class."""

    def step(grid):
        out, flat = grid.copy(), np.arange(grid.size).reshape(grid.shape)
        classes = np.unique(grid[grid >= 0])
        for k in classes:
            labels = masks.components(grid == k)
            small = np.where(masks.smaller_than(labels, least), labels, 0)
            if not small.any():
                continue
            # each pair of a small component and a cell of another class near it, once
            pairs = []
            for i, j in masks.diamond(2):
                one = masks.shift(small, i, j, 0)
                near = (one > 0) & (grid != k) & (grid >= 0)
                pairs.append(one[near] * grid.size + flat[near])
            own, cell = np.divmod(np.unique(np.concatenate(pairs)), grid.size)
            named, at = np.unique(own, return_inverse=True)
            if not len(named):
                continue
            votes = np.bincount(at * len(classes) + np.searchsorted(classes, grid.reshape(-1)[cell]), minlength=len(named) * len(classes))
            best = np.full(labels.max() + 1, MISSING)
            best[named] = classes[votes.reshape(-1, len(classes)).argmax(axis=1)]
            taken = (small > 0) & (best[small] != MISSING)
            out[taken] = best[small[taken]]
        return out

    step.reach, step.stacked = least + 2, True
    return step


def square_pass(kind: str, size: int = 3):
    """Opening or closing by a square per class.  Cells are only added, so opening changes nothing."""
    if kind not in ("open", "close"):
        raise ValueError("kind is open or close")
    kernel = masks.square(size)

    def step(grid):
        out = grid.copy()
        for k in np.unique(grid[grid >= 0]):
            mask = grid == k
            out[masks.dilate(masks.erode(mask, kernel, False), kernel) if kind == "open" else masks.erode(masks.dilate(mask, kernel), kernel, False)] = k
        return out

    step.reach, step.stacked = size, True
    return step
