"""Words of a UTF-8 text as 64-bit hashes, by numpy alone.

A word is a run of bytes other than space and 0x09 to 0x0D. Its hash comes from running sums of a
polynomial over the whole text, so no Python object is made per word. Very long texts go piece by
piece, cut at white space: memory is a piece plus eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20260101)
SYMBOLS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(2**40, 2**62)) * 8 + 5
_POWERS: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``count``."""
    if "up" not in _POWERS or len(_POWERS["up"]) < count:
        size = max(count, 1 << 12)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, np.uint64(base % 2**64), np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:count], _POWERS["down"][:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut only between a word and the white space behind it."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and (WHITE[text[end - 1]] or not WHITE[text[end]]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for the bytes of each span of ``codes``, the same wherever they stand."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(SYMBOLS[codes] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _word_hashes(piece: bytes) -> np.ndarray:
    codes = np.frombuffer(piece, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~WHITE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_hashes(codes, starts, ends)


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word, in order."""
    parts = [_word_hashes(p) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = (out + hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def code_points(text: bytes) -> int:
    """Characters of UTF-8 bytes."""
    codes = np.frombuffer(text, np.uint8)
    return int(len(codes) - np.count_nonzero((codes & 0xC0) == 0x80))
