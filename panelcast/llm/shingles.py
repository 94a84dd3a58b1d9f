"""Word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
BLOCK = 1 << 20

_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n (rounded up to a power of two, kept per process)."""
    size = 1 << max(BLOCK, n).bit_length()
    if size not in _powers:
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word (run of non-space bytes)."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~IS_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), starts


def batches_of(texts: list[str], limit: int = BLOCK):
    """(first index, encoded texts) in groups of about ``limit`` bytes."""
    at, group, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode()
        if group and size + len(data) > limit:
            yield at, group
            at, group, size = i, [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield at, group


def shingle_sets(texts: list[str], width: int = WIDTH):
    """For each text the sorted distinct hashes of its word shingles.

    A text of fewer than ``width`` words (but at least one) has one shingle, all its words; a text without words none.
    """
    for _, group in batches_of(texts):
        hashes, starts = word_hashes(b"\n".join(group))
        sizes = np.array([len(d) + 1 for d in group])
        bounds = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        bounds = np.append(bounds, len(hashes))
        n = max(0, len(hashes) - width + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(width):
            joined += hashes[k:k + n] * PLACE[k]
        joined = mix64(joined)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(joined[a:b - width + 1])
            elif b > a:
                short = (hashes[a:b] * PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    a, b = mix64(tokens ^ BYTE[1]).sum(dtype=np.uint64), mix64(tokens + BYTE[2]).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(tokens))], ">u8").tobytes()
