"""Word positions and word hashes of whole UTF-8 buffers, by numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes are hashed in pieces of about this many.
PIECE = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_UP, _DOWN = _powers(BASE, PIECE + 1), _powers(INVERSE, PIECE + 1)


def spans(buf: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~blank[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        a = starts[i]
        j = int(np.searchsorted(ends, a + PIECE, "right"))
        if j <= i:  # one span longer than a piece
            j = i + 1
            size = int(ends[i] - a)
            up = _powers(BASE, size + 1)
            out[i] = (_BYTE[buf[a : ends[i]]] * up[:size]).sum(dtype=np.uint64)
        else:
            part = buf[a : ends[j - 1]]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
        out[i:j] += (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return mix64(out)


@lru_cache(maxsize=8)
def _window_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


def window_hashes(word_hashes: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; empty if there are fewer.

    A polynomial in an odd base of the words' hashes, as a difference of running
    sums, brought back by the base's inverse: the same for equal words anywhere.
    """
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _window_powers((BASE * (2 * salt + 1)) & MASK, PIECE + width)
    out = np.empty(n, np.uint64)
    for a in range(0, n, PIECE):
        part = word_hashes[a : a + PIECE + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - width + 1
        out[a : a + k] = (sums[width:] - sums[:k]) * down[:k]
    return mix64(out)


def varint(gaps: np.ndarray) -> bytes:
    """Unsigned integers as one byte plane after another, only as many planes as the largest needs."""
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    raw = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + np.ascontiguousarray(raw.T).tobytes()


def unvarint(data: bytes) -> np.ndarray:
    planes = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u8").ravel()
