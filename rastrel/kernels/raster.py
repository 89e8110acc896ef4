"""Masks as arrays: components, specks, holes, borders with their tree, blurs and resizing."""

from __future__ import annotations

import numpy as np

#: Neighbour steps (dy, dx), clockwise on the screen from the west.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels from 1 in scan order of the components' first cells; 0 where mask is unset.

    Works on runs of set cells: two runs of adjacent rows join if they touch (8: also at corners)."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    rows, opens = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    at = np.searchsorted(rows, np.arange(height + 1))
    reach = 1 if eight else 0
    for y in range(1, height):
        a, b = at[y - 1], at[y]
        while a < at[y] and b < at[y + 1]:
            if opens[a] < ends[b] + reach and opens[b] < ends[a] + reach:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
            if ends[a] < ends[b]:
                a += 1
            else:
                b += 1
    roots = np.array([find(k) for k in range(len(rows))], np.int64)
    _, names = np.unique(roots, return_inverse=True)
    out = np.zeros((height, width), np.int64)
    for y, a, b, name in zip(rows, opens, ends, names, strict=True):
        out[y, a:b] = name + 1
    return out


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Without 4-connected components of fewer than `least` cells."""
    if least <= 1:
        return mask
    labels = components(mask)
    return mask & (np.bincount(labels.ravel())[labels] >= least)


def fill_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """With 4-connected gaps of at most `most` cells filled, unless they touch the edge."""
    if most <= 0 or not mask.size:
        return mask
    labels = components(~mask)
    size = np.bincount(labels.ravel())
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    small = size <= most
    small[edge] = False
    small[0] = False
    return mask | small[labels]


def follow(mask: np.ndarray, y: int, x: int, back: int) -> list[tuple[int, int]]:
    """The border cells (x, y) from a cell of a mask with an unset margin; back: index of the unset neighbour to begin from."""
    def turn(cy: int, cx: int, first: int, way: int) -> int:
        for k in range(8):
            d = (first + way * k) % 8
            if mask[cy + _AROUND[d][0], cx + _AROUND[d][1]]:
                return d
        return -1

    out_dir = turn(y, x, back, 1)
    if out_dir < 0:
        return [(x, y)]
    last = (y + _AROUND[out_dir][0], x + _AROUND[out_dir][1])
    cy, cx, came = y, x, out_dir
    cells = []
    while True:
        cells.append((cx, cy))
        d = turn(cy, cx, came - 1, -1)
        ny, nx = cy + _AROUND[d][0], cx + _AROUND[d][1]
        if (ny, nx) == (y, x) and (cy, cx) == last:
            return cells
        cy, cx, came = ny, nx, (d + 4) % 8


def borders(mask: np.ndarray) -> list[dict]:
    """Borders of every 8-connected component and of every 4-connected hole, as a tree.

    Each: id, parent (id or None), hole, depth, cells [(x, y)]. Outers come in scan order, holes after theirs."""
    inner = np.pad(mask.astype(bool), 1)
    solid, empty = components(inner, eight=True), components(~inner)
    outside = empty[0, 0]
    found: dict[tuple[bool, int], dict] = {}
    first = lambda labels: {int(n): divmod(int(k), labels.shape[1]) for n, k in zip(*np.unique(labels, return_index=True), strict=True) if n}
    for name, (y, x) in first(solid).items():
        ground = int(empty[y, x - 1])
        found[False, name] = {"hole": False, "cells": follow(inner, y, x, 0), "up": None if ground == outside else (True, ground)}
    for name, (y, x) in first(empty).items():
        if name != outside:
            found[True, name] = {"hole": True, "cells": follow(inner, y, x - 1, 4), "up": (False, int(solid[y, x - 1]))}
    ids = {k: n for n, k in enumerate(sorted(found, key=lambda k: (found[k]["cells"][0][1], found[k]["cells"][0][0], k[0])))}

    def depth(k: tuple[bool, int]) -> int:
        n = 0
        while found[k]["up"] is not None:
            k, n = found[k]["up"], n + 1
        return n

    return [
        {"id": ids[k], "parent": None if b["up"] is None else ids[b["up"]], "hole": b["hole"], "depth": depth(k), "cells": [(x - 1, y - 1) for x, y in b["cells"]]}
        for k, b in sorted(found.items(), key=lambda kb: ids[kb[0]])
    ]


def gaussian(grey: np.ndarray, radius: float) -> np.ndarray:
    """Separable blur of standard deviation `radius` with replicated edges, back to 8 bits."""
    if radius <= 0:
        return grey
    reach = max(1, int(np.ceil(3 * radius)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    weights /= weights.sum()
    out = grey.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(w * np.take(padded, np.arange(k, k + out.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def bilateral(grey: np.ndarray, diameter: int = 5, sigma_colour: float = 22.0, sigma_space: float = 2.2) -> np.ndarray:
    """Edge-preserving blur over an odd diameter with replicated edges, truncated to 8 bits."""
    if diameter <= 1 or sigma_colour <= 0 or sigma_space <= 0:
        return grey
    reach = diameter // 2
    values = grey.astype(np.float32)
    padded = np.pad(values, reach, mode="edge")
    total, weight = np.zeros_like(values), np.zeros_like(values)
    height, width = grey.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = padded[reach + dy : reach + dy + height, reach + dx : reach + dx + width]
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2) - (other - values) ** 2 / (2 * sigma_colour**2)).astype(np.float32)
            total += w * other
            weight += w
    return (total / weight).clip(0, 255).astype(np.uint8)


def otsu(grey: np.ndarray) -> int:
    """The first level that maximises the variance between both sides; 127 for one level."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0.0)
    return int(np.argmax(spread)) if spread.max() > 0 else 127


def field(grey: np.ndarray, alpha: np.ndarray | None = None, invert: bool = False) -> np.ndarray:
    """Foreground strength in 32-bit numbers: tone, or the larger of tone and alpha where the image is partly transparent."""
    tone = grey.astype(np.float32) / np.float32(255)
    tone = tone if invert else np.float32(1) - tone
    if alpha is None or not alpha.size or alpha.max() == 0 or alpha.min() / 255.0 >= 0.999:
        return tone
    return np.maximum(tone, alpha.astype(np.float32) / np.float32(255))


def level(threshold: int, invert: bool = False) -> np.float32:
    """A grey threshold as a level of field()."""
    return np.float32(threshold / 255.0 if invert else 1.0 - threshold / 255.0)


def foreground(grey: np.ndarray, threshold: int | None = None, invert: bool = False, alpha: np.ndarray | None = None, bias: int = 0) -> np.ndarray:
    """The mask of field >= level in 32-bit numbers, as pixels.mask has it; bias moves the threshold, Otsu's or the given one."""
    chosen = min(255, max(0, (otsu(grey) if threshold is None else threshold) + bias))
    return field(grey, alpha, invert) >= level(chosen, invert)


def erode(mask: np.ndarray) -> np.ndarray:
    """Set where the whole 3x3 neighbourhood is; cells outside count as unset."""
    return _stencil(mask, np.logical_and)


def dilate(mask: np.ndarray) -> np.ndarray:
    """Set where any cell of the 3x3 neighbourhood is."""
    return _stencil(mask, np.logical_or)


def _stencil(mask: np.ndarray, join: np.ufunc) -> np.ndarray:
    p = np.pad(mask.astype(bool), 1)
    rows = join(join(p[:-2], p[1:-1]), p[2:])
    return join(join(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def morphology(mask: np.ndarray, steps: str) -> np.ndarray:
    """steps, a letter each: e(rode), d(ilate), o(pen: both), c(lose: both the other way)."""
    for way in steps.replace("o", "ed").replace("c", "de"):
        mask = erode(mask) if way == "e" else dilate(mask)
    return mask


def resize_longest(grey: np.ndarray, target: int) -> np.ndarray:
    """Scaled to a longest side: area means when shrinking, bilinear when growing."""
    height, width = grey.shape
    scale = target / max(height, width)
    size = max(1, round(height * scale)), max(1, round(width * scale))
    out = grey.astype(np.float64)
    for axis, n in enumerate(size):
        m = out.shape[axis]
        if n < m:
            total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
            edge = np.linspace(0, m, n + 1)
            low = np.minimum(edge.astype(int), m - 1)
            part = np.take(total, low, axis) + np.take(out, low, axis) * (edge - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
            out = np.diff(part, axis=axis) * n / m
        elif n > m:
            at = ((np.arange(n) + 0.5) * m / n - 0.5).clip(0, m - 1)
            low = np.minimum(at.astype(int), m - 1)
            f = (at - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
            out = np.take(out, low, axis) * (1 - f) + np.take(out, np.minimum(low + 1, m - 1), axis) * f
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def median_cut(rgb: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, palette): boxes split at the median of their widest channel, the most crowded wide box first."""
    colours, inverse, counts = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    boxes = [np.arange(len(colours))]
    while len(boxes) < most:
        spread = [(counts[b].sum() * np.ptp(colours[b].astype(int), axis=0).max(), -k) for k, b in enumerate(boxes) if len(b) > 1]
        if not spread:
            break
        box = boxes.pop(-max(spread)[1])
        axis = int(np.argmax(np.ptp(colours[box].astype(int), axis=0)))
        box = box[np.argsort(colours[box, axis], kind="stable")]
        run = np.cumsum(counts[box])
        cut = min(max(1, int(np.searchsorted(run, run[-1] / 2)) + 1), len(box) - 1)
        boxes += [box[:cut], box[cut:]]
    names = np.empty(len(colours), np.int64)
    palette = np.empty((len(boxes), 3), np.int64)
    for k, b in enumerate(boxes):
        names[b] = k
        palette[k] = np.rint((colours[b] * counts[b, None]).sum(0) / counts[b].sum())
    return names[inverse.ravel()].reshape(rgb.shape[:2]), palette
