"""Small array helpers for one patch, or a stack of patches along leading axes: shifts, erosion, dilation, components."""

from __future__ import annotations

import numpy as np


def square(size: int) -> list[tuple[int, int]]:
    span = range(-(size // 2), size - size // 2)
    return [(i, j) for i in span for j in span]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical kernel 2 * radius + 1 wide."""
    reach = {i: int(np.rint(np.sqrt(radius * radius - i * i))) for i in range(-radius, radius + 1)}
    return [(i, j) for i, far in reach.items() for j in range(-far, far + 1)]


def diamond(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i, j in square(2 * radius + 1) if abs(i) + abs(j) <= radius]


def shift(mask: np.ndarray, i: int, j: int, outside) -> np.ndarray:
    """The value ``i`` rows down and ``j`` columns right of each cell."""
    far = max(abs(i), abs(j))
    wide = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(far, far)] * 2, constant_values=outside)
    return wide[..., far + i : far + i + mask.shape[-2], far + j : far + j + mask.shape[-1]]


def erode(mask: np.ndarray, offsets, outside: bool = True) -> np.ndarray:
    return np.logical_and.reduce([shift(mask, i, j, outside) for i, j in offsets])


def dilate(mask: np.ndarray, offsets) -> np.ndarray:
    return np.logical_or.reduce([shift(mask, -i, -j, False) for i, j in offsets])


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """0 outside; 1, 2, ... for components in the order of their first cells, on through a stack."""
    at = np.arange(mask.size).reshape(mask.shape)
    ends = [(at[..., :-1], at[..., 1:]), (at[..., :-1, :], at[..., 1:, :])]
    if eight:
        ends += [(at[..., :-1, :-1], at[..., 1:, 1:]), (at[..., :-1, 1:], at[..., 1:, :-1])]
    inside = mask.ravel()
    a, b = (np.concatenate([e[k].ravel() for e in ends]) for k in (0, 1))
    a, b = a[inside[a] & inside[b]], b[inside[a] & inside[b]]
    label = np.arange(mask.size)
    while (label[a] != label[b]).any():
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        label = new[new]
    while (label != label[label]).any():
        label = label[label]
    out = np.zeros(mask.size, np.int64)
    out[inside] = np.unique(label[inside], return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def holes(mask: np.ndarray) -> np.ndarray:
    """Components (numbered) of the rest that do not touch the border."""
    rest = components(~mask)
    open_ = np.zeros(rest.max(initial=0) + 1, bool)
    for border in (rest[..., 0, :], rest[..., -1, :], rest[..., 0], rest[..., -1]):
        open_[border.ravel()] = True
    return np.where(open_[rest], 0, rest)


def smaller_than(labels: np.ndarray, size: int) -> np.ndarray:
    """Cells of numbered components of fewer than ``size`` cells."""
    return (labels > 0) & (np.bincount(labels.ravel())[labels] < size)
