"""PNG files to arrays and back with zlib alone: 8-bit grey, grey-alpha, RGB, RGBA and palette, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes | None) -> np.ndarray:
    """(height, width, 4) RGBA; ValueError for empty, damaged or other files."""
    if not data:
        raise ValueError("empty image")
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG file")
    at, body, palette, alpha, head = 8, b"", None, None, None
    try:
        while at < len(data):
            (size,) = struct.unpack(">I", data[at : at + 4])
            kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            if len(chunk) < size:
                raise ValueError("truncated PNG file")
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"PLTE":
                palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alpha = np.frombuffer(chunk, np.uint8)
            elif kind == b"IDAT":
                body += chunk
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        if depth != 8 or interlaced or colour not in _CHANNELS:
            raise ValueError("unsupported PNG layout")
        n = _CHANNELS[colour]
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    except (struct.error, zlib.error, TypeError) as e:
        raise ValueError(f"damaged PNG file: {e}") from e
    out = np.zeros((height + 1, (width + 1) * n), np.int64)
    for y in range(height):
        line, up, way = rows[y, 1:].astype(np.int64), out[y], rows[y, 0]
        if way in (0, 2):
            out[y + 1, n:] = (line + (up[n:] if way == 2 else 0)) & 255
        elif way == 1:
            out[y + 1, n:] = (np.cumsum(line.reshape(-1, n), axis=0) & 255).ravel()
        else:
            now = out[y + 1]
            for x in range(n, len(now)):
                a, b, c = now[x - n], up[x], up[x - n]
                if way == 3:
                    guess = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                now[x] = (line[x - n] + guess) & 255
    pixels = out[1:, n:].astype(np.uint8).reshape(height, width, n)
    full = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        index = pixels[..., 0]
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        if alpha is not None:
            table[: len(alpha), 3] = alpha
        return table[index]
    if n <= 2:
        return np.concatenate([np.repeat(pixels[..., :1], 3, axis=2), pixels[..., 1:] if n == 2 else full], axis=2)
    return pixels if n == 4 else np.concatenate([pixels, full], axis=2)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width) grey or (height, width, 3 or 4) colours."""
    height, width = pixels.shape[:2]
    n = 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.zeros((height, 1 + width * n), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
