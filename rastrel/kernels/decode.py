"""From decoded colours to masks on arrays: alpha, size, grey, denoising, threshold and morphology by settings."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from rastrel.config import ClassifyFirst, Common, PrimitiveFirst
from rastrel.kernels import raster


class Preprocessed(NamedTuple):
    """The planes of one image; sizes are (width, height)."""

    original: tuple[int, int]
    rgb: np.ndarray
    alpha: np.ndarray
    grey: np.ndarray
    field: np.ndarray
    mask: np.ndarray
    threshold: int

    @property
    def working(self) -> tuple[int, int]:
        return self.mask.shape[1], self.mask.shape[0]

    @property
    def scale(self) -> tuple[float, float]:
        return tuple(coordinate_scale(a, b) for a, b in zip(self.original, self.working, strict=True))

    @property
    def offset(self) -> tuple[float, float]:
        return 0.0, 0.0

    @property
    def view_box(self) -> tuple[float, float, float, float]:
        return (*self.offset, float(self.original[0]), float(self.original[1]))

    @property
    def aspect(self) -> float:
        return self.original[0] / max(1, self.original[1])

    def row(self) -> dict:
        (w, h), (sx, sy) = self.working, self.scale
        return {
            "width": w, "height": h, "data": self.mask.astype(np.uint8).tobytes(), "threshold": self.threshold, "original_width": self.original[0], "original_height": self.original[1],
            "scale_x": sx, "scale_y": sy, "grey": self.grey.tobytes(), "rgb": self.rgb.astype(np.uint8).tobytes(),
        }


def coordinate_scale(original: int, working: int) -> float:
    return original / max(1.0, float(working))


def from_bgr(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """RGBA of a row of Spark's image source."""
    bgr = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    alpha = bgr[..., 3:] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([bgr[..., 2::-1] if channels > 1 else np.repeat(bgr, 3, 2), alpha], 2)


def over_white(rgba: np.ndarray) -> np.ndarray:
    """RGB over opaque white, with the usual integer rounding."""
    alpha = rgba[..., 3:].astype(np.int64)
    flat = rgba[..., :3].astype(np.int64) * alpha + 255 * (255 - alpha) + 128
    return ((flat + (flat >> 8)) >> 8).astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int64) * np.array([19595, 38470, 7471])).sum(-1) + 0x8000 >> 16).astype(np.uint8)


def denoise(grey: np.ndarray, s: Common) -> np.ndarray:
    """Bilateral, then Gaussian, each where the settings ask for it; the primitive-first order takes the other's bilateral."""
    base = s.as_classify_first() if isinstance(s, PrimitiveFirst) else s
    if isinstance(base, ClassifyFirst):
        grey = raster.bilateral(grey, base.bilateral_filter_diameter, base.bilateral_sigma_color, base.bilateral_sigma_space)
    return raster.gaussian(grey, s.preblur_radius)


def preprocess(rgba: np.ndarray, s: Common) -> Preprocessed:
    """All planes of an RGBA image. Otsu's level, or the given threshold, is moved by the bias and kept within a byte."""
    size = rgba.shape[1], rgba.shape[0]
    rgb, alpha = over_white(rgba), rgba[..., 3]
    if s.target_size:
        rgb = np.stack([raster.resize_longest(rgb[..., k], s.target_size) for k in range(3)], -1)
        alpha = raster.resize_longest(alpha, s.target_size)
    grey = denoise(luma(rgb), s)
    chosen = min(255, max(0, (raster.otsu(grey) if s.threshold is None else s.threshold) + s.threshold_bias))
    field = raster.field(grey, alpha if s.use_alpha_foreground else None, s.invert)
    colours = rgb
    if isinstance(s, ClassifyFirst) and s.color_preblur_radius > 0:
        colours = np.stack([raster.gaussian(rgb[..., k], s.color_preblur_radius) for k in range(3)], -1)
    return Preprocessed(size, colours, alpha, grey, field, field >= raster.level(chosen, s.invert), chosen)
