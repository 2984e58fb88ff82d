"""Sets of word shingles as sorted 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: bytes) -> np.ndarray:
    global _UP, _DOWN
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edge):
        return np.empty(0, np.uint64)
    starts, ends = edge[::2], edge[1::2]
    term = _BYTE[raw] * _UP[: len(raw)]
    term[~inside] = 0
    return mix(np.add.reduceat(term, starts) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word between ASCII white space, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= _CHUNK:
        return _hash_chunk(data)
    out, at = [], 0
    while at < len(data):  # cut a very long text at white space
        end = at + _CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_chunk(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(size, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + words[i : len(words) - k + 1 + i]) * np.uint64(2 * i + 3)
    return np.unique(mix(total + np.uint64(k)))
