"""Image files to RGBA arrays: PNG, PPM and PGM, BMP here; whatever else Pillow reads, where it is installed."""

from __future__ import annotations

import re
import struct

import numpy as np

from rastrel.kernels import png


def _netpbm(data: bytes) -> np.ndarray:
    """Binary or plain PGM and PPM of 8 bits."""
    head = re.match(rb"P([2356])\s+(?:#.*\s+)*(\d+)\s+(?:#.*\s+)*(\d+)\s+(?:#.*\s+)*(\d+)\s", data)
    if not head:
        raise ValueError("damaged netpbm file")
    kind, width, height, most = (int(g) for g in head.groups())
    n = 3 if kind in (3, 6) else 1
    body = data[head.end() :]
    if not 0 < most < 256:
        raise ValueError("unsupported netpbm depth")
    try:
        values = np.array(body.split(), np.int64) if kind < 4 else np.frombuffer(body, np.uint8).astype(np.int64)
        pixels = values[: width * height * n].reshape(height, width, n) * 255 // most
    except ValueError as e:
        raise ValueError("truncated netpbm file") from e
    return np.concatenate([np.repeat(pixels, 3 // n, 2), np.full((height, width, 1), 255)], 2).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 24 or 32 bits."""
    try:
        start, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
        n = depth // 8
        if n not in (3, 4) or packing not in (0, 3):
            raise ValueError("unsupported BMP layout")
        step = -(-width * n // 4) * 4
        rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * n].reshape(abs(height), width, n)
    except (struct.error, ValueError) as e:
        raise ValueError(f"damaged BMP file: {e}") from e
    rows = rows[::-1] if height > 0 else rows
    alpha = rows[..., 3:] if n == 4 and rows[..., 3].any() else np.full((*rows.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rows[..., 2::-1], alpha], 2)


def decode(data: bytes | None) -> np.ndarray:
    """(height, width, 4) RGBA; ValueError for empty, damaged or other files."""
    if not data:
        raise ValueError("empty image")
    if data[:1] == b"P" and data[1:2] in (b"2", b"3", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    try:
        return png.decode(data)
    except ValueError as own:
        try:
            import io

            from PIL import Image
        except ImportError:
            raise own from None
        try:
            return np.asarray(Image.open(io.BytesIO(data)).convert("RGBA"))
        except Exception as e:
            raise ValueError(str(own)) from e


def as_png(data: bytes | None) -> bytes:
    """An upload as an RGBA PNG file; ValueError for what isn't an image."""
    return png.encode(decode(data))
