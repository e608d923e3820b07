"""Vectorised word and shingle hashing of whole texts inside tasks.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a shingle is five words, or all words of a shorter
text.  Hashes have 64 bits: a polynomial over random byte values, then a mixing step.  Polynomials modulo a power of two have
constructed collisions from about 2,000 bytes on, so longer words (LONG_WORD) take a cryptographic digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes hashed at a time
LONG_WORD = 512  # bytes
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_COEFF = _rng.integers(2**62, 2**63, 6, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for x in (_BASE, _INVERSE):
            p = np.full(max(n, SLICE + 1), x, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slice_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one slice."""
    gap = _SPACE[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power[: len(buf)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    for k in np.flatnonzero(end - start > LONG_WORD):
        word = buf[start[k] : end[k]].tobytes().lower()  # bytes.lower() changes A-Z only
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return start, h


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words, slice by slice, cut between words."""
    at, starts, hashes = 0, [], []
    while at < len(buf):
        to = min(at + SLICE, len(buf))
        while to < len(buf) and not _SPACE[buf[to]]:  # a word longer than the rest of the slice
            more = np.flatnonzero(_SPACE[buf[to : to + SLICE]])
            to = to + int(more[0]) if len(more) else min(to + SLICE, len(buf))
        s, h = _slice_words(buf[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle(w: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one word sequence, in order, with repeats."""
    n = min(len(w), 5)
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64) * _COEFF[5]
    for k in range(n):
        h = h + w[k : len(w) - n + 1 + k] * _COEFF[k]
    return mix(h)


def shingle_lists(texts: list[str | None]) -> Iterator[np.ndarray]:
    """One array of shingle hashes per text, with repeats; texts are hashed in bounded groups."""
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k < len(texts) and (not group or size < SLICE):
            group.append((texts[k] or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            k += 1
        bounds = np.cumsum([0, *(len(b) + 1 for b in group)])
        start, hashes = words(np.frombuffer(b"\n".join(group), np.uint8))
        cutoff = np.searchsorted(start, bounds)
        for i in range(len(group)):
            yield shingle(hashes[cutoff[i] : cutoff[i + 1]])


def fingerprint(distinct: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Name of a sorted set of shingles: 128 bits as two signed integers."""
    data = hashlib.blake2b(distinct.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)
