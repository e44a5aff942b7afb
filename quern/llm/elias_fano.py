"""Elias-Fano coding of monotone 64-bit sequences, with vectorised search, over memory maps."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLOCK = 8  # words of 64 bits for each entry of a directory


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word."""
    at = np.zeros(len(words), np.int64)
    w, k = words.copy(), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = w & U((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        right = k >= n
        k -= n * right
        at += width * right
        w = np.where(right, w >> U(width), low)
    return at


class EliasFano:
    """n values below 2^64: low bits packed, high bits in unary, directories of ones and zeros."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.n, self.l = (int(x) for x in arrays["head"])

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(U)
        low_bits = min(57, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> U(low_bits)).astype(np.int64)
        low = values & U((1 << low_bits) - 1)
        bits = n + (universe - 1 >> low_bits) + 2
        flags = np.zeros(-(-bits // 512) * 512, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view(U)
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, _BLOCK).sum(1)
        ones = np.concatenate([[0], np.cumsum(ones)])[:-1]
        packed = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits and n:
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(U)
            for k, part in ((word, low << shift), (word + 1, np.where(shift > 0, low >> ((U(64) - shift) & U(63)), U(0)))):
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                packed[k[first]] |= np.bitwise_or.reduceat(part, first)
        zeros = np.arange(len(ones), dtype=np.int64) * 64 * _BLOCK - ones
        return cls({"head": np.array([n, low_bits], np.int64), "words": words, "ones": ones, "zeros": zeros, "low": packed})

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(U)
        p = self.a["low"]
        got = (p[word] >> shift) | np.where(shift > 0, p[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return got & U((1 << self.l) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Bit position of the k-th one or zero (from 0)."""
        directory = self.a["ones" if ones else "zeros"]
        block = np.searchsorted(directory, k, side="right") - 1
        left = k - directory[block]
        words = self.a["words"].reshape(-1, _BLOCK)[block]
        if not ones:
            words = ~words
        total = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        inside = (total <= left[:, None]).sum(1)
        row = np.arange(len(k))
        before = np.where(inside > 0, total[row, inside - 1], 0)
        return block * 64 * _BLOCK + inside * 64 + _select_in_word(words[row, inside], left - before)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self._select(i, True) - i).astype(U)
        return (high << U(self.l)) | self._low(i)

    def all(self) -> np.ndarray:
        """All values, in order."""
        i = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.a["words"].view(np.uint8), bitorder="little"))[: self.n] - i
        return (high.astype(U) << U(self.l)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below x, whether it equals x); of the places from `first` up to `last`, where given."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> U(self.l)).astype(np.int64)
        low = x & U((1 << self.l) - 1)
        if 16 * len(x) > self.n:  # many: all bucket ends at once cost less than a selection for each
            zeros = np.flatnonzero(np.unpackbits(self.a["words"].view(np.uint8), bitorder="little") == 0)
            hi, lo = zeros[h] - h, np.where(h > 0, zeros[np.maximum(h - 1, 0)] - h + 1, 0)
        else:
            hi = self._select(h, False) - h  # ones before the zero that ends bucket h
            lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)
        if first is not None:
            hi = np.minimum(hi, last)
            lo = np.minimum(np.maximum(lo, first), hi)
        end = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        same = lo < end
        same[same] = self._low(lo[same]) == low[same]
        return lo, same


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """One block of bytes: a table of names, types and places, then the arrays, aligned to 8 bytes."""
    import json

    table, at, parts = [], 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        table.append((name, a.dtype.str, at, len(a)))
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(table).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def load(buffer) -> dict[str, np.ndarray]:
    """The arrays of dump(), as views of the buffer."""
    import json

    size = int.from_bytes(bytes(buffer[:8]), "little")
    table = json.loads(bytes(buffer[8 : 8 + size]))
    return {name: np.frombuffer(buffer, kind, n, 8 + size + at) for name, kind, at, n in table}


def nested(prefix: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in ef.a.items()}


def unnested(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")})
