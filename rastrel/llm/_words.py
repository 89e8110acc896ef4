"""Vectorised word kernels over the buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: [^\x20\x09-\x0D]+ is a word
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RADIX = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_RADIX), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = _RADIX) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, U64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 23:  # longer ones are not kept
            _powers[int(base)] = got
    return got[:n]


_BYTE = mix(np.arange(1, 257, dtype=U64))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), offs - (offs[0] if len(offs) else 0)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def spans(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text); words never cross from one text to the next."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word: equal for equal bytes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=total[1:])
    value = (total[ends] - total[starts]) * powers(len(raw) + 1, _INVERSE)[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(names: np.ndarray, firsts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """A 64-bit name for each run names[first : first + length]."""
    if not len(firsts):
        return np.zeros(0, U64)
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(names * powers(len(names)), out=total[1:])
    value = (total[firsts + lengths] - total[firsts]) * powers(len(names) + 1, _INVERSE)[firsts]
    return mix(value + U64(0xA0761D6478BD642F) * np.asarray(lengths).astype(U64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every whole window."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
