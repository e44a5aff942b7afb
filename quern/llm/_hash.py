"""Words of whole texts as 64-bit hashes, computed on the bytes of a batch at once.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Its hash is a
polynomial in an odd base modulo 2^64 with a random number for each byte value, taken
as a difference of prefix sums, and mixed.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 19
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xCA5A826395121157)
    h ^= h >> np.uint64(29)
    return h


def _chunk(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in buf."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _powers(_INVERSE, len(buf))[start])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + CHUNK)
        while end < len(buf) and not _SPACE[buf[end - 1]]:  # a chunk ends behind white space
            back = np.flatnonzero(_SPACE[buf[at:end]])
            end = at + int(back[-1]) + 1 if len(back) else min(len(buf), end + CHUNK)
        s, h = _chunk(buf[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n successive words; of all words where there are fewer; none of no words."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * np.uint64(pow(_INVERSE, i + 1 + 8 * (n - k), 1 << 64))
    return np.unique(mix(total))


def text_key(words: np.ndarray) -> int:
    """A signed 64-bit key of a sequence of words."""
    h = (words * _powers(0xA0761D6478BD642F, len(words))).sum(dtype=np.uint64) + np.uint64(len(words))
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])
