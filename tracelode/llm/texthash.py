"""Hashes of the words of Arrow text columns, computed on the bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
SLICE = 1 << 20
_R = 0x9E3779B97F4A7C55
_R_INVERSE = pow(_R, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = constants(256, 7)[_LOWER]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE + 65536)
        for key, base in (("up", _R), ("down", _R_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offsets; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one text: runs of other than white space, A-Z lower-cased."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        part = data[at:end]
        edge = np.diff(np.concatenate(([True], SPACE[part], [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64, out=total[1:])
        hashes.append(mixed((total[last] - total[first]) * down[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


_ORDER = constants(64, 99)


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence where there are fewer; none without words."""
    if len(hashes) < n:
        return mixed((hashes * _ORDER[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))) if len(hashes) else hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(out) + i] * _ORDER[i]
    return mixed(out + np.uint64(n))
