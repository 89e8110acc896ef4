"""Colour mode on arrays: quantizing to a few colours, merging near ones, background and layer masks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from rastrel.kernels.raster import median_cut

# Least share of the border that a background holds, and that of an image with hardly a transparent pixel.
BACKGROUND_SHARE, OPAQUE_BACKGROUND_SHARE, OPAQUE = 0.35, 0.22, 0.98
METHODS = ("median_cut", "max_coverage", "fast_octree")


class PaletteColour(NamedTuple):
    ix: int
    rgb: tuple[int, int, int]
    hex: str
    n: int
    background: bool


class Layer(NamedTuple):
    layer_id: str
    z: int
    colour: PaletteColour
    mask: np.ndarray


class Segmentation(NamedTuple):
    labels: np.ndarray  # by pixel, an index of palette
    palette: list[PaletteColour]
    background: int | None
    layers: list[Layer]


def max_coverage(rgb: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, palette): the commonest colour, then again and again the one farthest from all chosen."""
    colours, inverse, counts = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    values = colours.astype(np.int64)
    chosen = [int(np.argmax(counts))]
    near = ((values - values[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(most, len(values)):
        k = int(np.lexsort((-counts, -near))[0])
        if not near[k]:
            break
        chosen.append(k)
        near = np.minimum(near, ((values - values[k]) ** 2).sum(1))
    return _assigned(rgb, values, inverse, counts, values[chosen])


def fast_octree(rgb: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, palette): cubes of colours, the least populated level of an octree merged until few are left."""
    colours, inverse, counts = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    values = colours.astype(np.int64)
    for bits in range(8, -1, -1):
        cube = values >> (8 - bits)
        _, name = np.unique(cube, axis=0, return_inverse=True)
        if name.max() < most or not bits:
            break
    # Of the next finer cubes, the fullest stand by themselves as far as there is room.
    name = name.ravel()
    if bits < 8 and name.max() + 1 < most:
        _, finer = np.unique(values >> (7 - bits), axis=0, return_inverse=True)
        finer = finer.ravel()
        size = np.bincount(finer, counts)
        for k in np.argsort(-size, kind="stable"):
            own = finer == k
            if name.max() + 1 >= most:
                break
            if (name == name[own][0]).sum() > own.sum():
                name = np.where(own, name.max() + 1, name)
    means = np.stack([np.rint(np.bincount(name, counts * values[:, c]) / np.bincount(name, counts)) for c in range(3)], 1).astype(np.int64)
    return name[inverse.ravel()].reshape(rgb.shape[:2]), means


def _assigned(rgb: np.ndarray, values: np.ndarray, inverse: np.ndarray, counts: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colours go to their nearest palette entry, whose value becomes the mean of them."""
    name = np.argmin(((values[:, None] - palette[None]) ** 2).sum(2), axis=1)
    used, name = np.unique(name, return_inverse=True)
    means = np.stack([np.rint(np.bincount(name, counts * values[:, c]) / np.bincount(name, counts)) for c in range(3)], 1).astype(np.int64)
    return name[inverse.ravel()].reshape(rgb.shape[:2]), means


def quantize(rgb: np.ndarray, most: int = 8, method: str = "median_cut") -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, palette) of `most` colours at most; a method that isn't known is median cut."""
    most = max(1, most)
    if method == "max_coverage":
        return max_coverage(rgb, most)
    return fast_octree(rgb, most) if method == "fast_octree" else median_cut(rgb, most)


def merge_similar(labels: np.ndarray, palette: np.ndarray, valid: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries that reach each other over pairs within `distance` become one of their mean colour, weighted by valid
    pixels and rounded half to even; the new entries come by descending count. Entries without a valid pixel go."""
    n = len(palette)
    counts = np.bincount(labels[valid], minlength=n)
    low = np.arange(n)
    square = ((palette[:, None].astype(np.int64) - palette[None]) ** 2).sum(2)
    near = (square <= distance * distance) & (counts > 0)[:, None] & (counts > 0)[None]
    while True:
        new = np.minimum(low, np.where(near, low[None], n).min(1))
        if (new == low).all():
            break
        low = new
    held = np.flatnonzero(np.bincount(low, counts, minlength=n))
    size = np.bincount(low, counts, minlength=n)
    held = held[np.lexsort((held, -size[held]))]
    place = np.full(n, 0)
    place[held] = np.arange(len(held))
    means = np.stack([np.rint(np.bincount(low, counts * palette[:, c], minlength=n)[held] / size[held]) for c in range(3)], 1).astype(np.int64)
    # A pixel that isn't valid keeps the nearest entry.
    to = np.where(size[low] > 0, place[low], [int(np.argmin(((means - c) ** 2).sum(1))) if len(means) else 0 for c in palette])
    return to[labels], means


def parse_hex(text: str | None) -> tuple[int, int, int] | None:
    digits = (text or "").strip().removeprefix("#")
    digits = "".join(2 * d for d in digits) if len(digits) == 3 else digits
    try:
        return tuple(int(digits[k : k + 2], 16) for k in (0, 2, 4)) if len(digits) == 6 else None
    except ValueError:
        return None


def background_of(labels: np.ndarray, palette: np.ndarray, valid: np.ndarray, mode: str = "auto", colour: str | None = None) -> int | None:
    """none: no background. manual: the entry nearest to `colour`, none if that isn't one. auto: the commonest entry of the
    four edges, corners twice, the lower of equals, if it holds enough of them."""
    if mode == "none" or not len(palette):
        return None
    if mode == "manual":
        want = parse_hex(colour)
        return None if want is None else int(np.argmin(((palette - np.array(want)) ** 2).sum(1)))
    edge = np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]])
    seen = np.concatenate([valid[0], valid[-1], valid[:, 0], valid[:, -1]])
    votes = np.bincount(edge[seen], minlength=len(palette))
    if not votes.sum():
        return None
    best = int(np.argmax(votes))
    least = OPAQUE_BACKGROUND_SHARE if valid.mean() >= OPAQUE else BACKGROUND_SHARE
    return best if votes[best] / votes.sum() >= least else None


def segment(
    rgb: np.ndarray, valid: np.ndarray | None = None, most: int = 8, method: str = "median_cut", distance: float = 28.0, merge: bool = True, mode: str = "auto", colour: str | None = None
) -> Segmentation:
    """Palette, background and a mask for each other colour, by descending count of pixels."""
    valid = np.ones(rgb.shape[:2], bool) if valid is None else valid
    if not valid.any():
        return Segmentation(np.zeros(rgb.shape[:2], np.int64), [], None, [])
    labels, palette = quantize(rgb, most, method)
    labels, palette = merge_similar(labels, palette, valid, distance if merge else -1.0)
    ground = background_of(labels, palette, valid, mode, colour)
    counts = np.bincount(labels[valid], minlength=len(palette))
    entries = [PaletteColour(k, tuple(map(int, c)), "#%02x%02x%02x" % tuple(c), int(counts[k]), k == ground) for k, c in enumerate(palette)]
    rest = [e for e in entries if not e.background and e.n]
    layers = [Layer(f"layer_{z:02d}_{e.hex[1:]}", z, e, (labels == e.ix) & valid) for z, e in enumerate(rest)]
    return Segmentation(labels, entries, ground, layers)


def membership(rgb: np.ndarray, palette: np.ndarray, ix: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Soft membership of each pixel in a palette entry: nearest other distance over own plus nearest other."""
    far = np.sqrt(((rgb[..., None, :].astype(float) - palette) ** 2).sum(-1))
    own = far[..., ix]
    if len(palette) == 1:
        out = np.ones(own.shape)
    else:
        other = np.delete(far, ix, -1).min(-1)
        out = np.divide(other, own + other, out=np.zeros_like(own), where=own + other > 0)
    return out if valid is None else np.where(valid, out, 0.0)
