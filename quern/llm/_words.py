"""Encoding of whole texts through the distinct space-separated segments of a batch.

Byte-level and piece BPE never merge across a lone space, so the ids of a text are the
ids of its segments put together. Texts are split and their segments numbered as Arrow
arrays; only segments that a task has not met yet reach the tokenizer. What it said of
them is kept, bounded in bytes, and the ids of a batch are gathered as one array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Segments:
    """Ids, and further figures, of segments by number. `encode` gives (flat ids, lengths, further columns...) of new ones.

    Beyond about `size` bytes all are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, ...]], size: int = 64 << 20):
        self.encode, self.size = encode, size
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.columns, self.end, self.bytes = np.empty(0, np.uint32), [], 0, 0

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The numbers of distinct segments; they hold until the next call."""
        if self.bytes > self.size:
            self._clear()
        at = np.fromiter(map(self.number.get, segments, [-1] * len(segments)), np.int64, len(segments))
        new = np.flatnonzero(at < 0)
        if len(new):
            names = [segments[i] for i in new.tolist()]
            flat, *columns = self.encode(names)
            at[new] = len(self.number) + np.arange(len(names))
            self._put(names, flat, columns)
        return at

    def _put(self, names: list[str], flat: np.ndarray, columns: list[np.ndarray]) -> None:
        first = len(self.number)
        self.number.update(zip(names, range(first, first + len(names)), strict=True))
        if self.end + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.end], np.empty(max(len(flat), self.end), np.uint32)])
        self.flat[self.end : self.end + len(flat)] = flat
        columns = [self.end + np.cumsum(columns[0]) - columns[0], *columns]
        mine = self.columns if first else [np.empty(0, c.dtype) for c in columns]
        if first + len(names) > len(mine[0]):
            mine = [np.concatenate([c[:first], np.empty(max(len(names), first), c.dtype)]) for c in mine]
        for to, c in zip(mine, columns, strict=True):
            to[first : first + len(c)] = c
        self.columns = mine
        self.end += len(flat)
        self.bytes += 120 * len(names) + 2 * sum(map(len, names)) + flat.nbytes

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Ids of the numbered segments, put together."""
        if not len(at):
            return np.empty(0, np.uint32)
        start, n = self.columns[0][at], self.columns[1][at]
        return self.flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def split(texts: pa.Array, odd: str, cut: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets of the texts, number of each segment, the distinct segments).

    A text is split at its spaces; one in which `odd` (in the syntax of RE2) is found, where `cut` matches.
    """
    parts = pc.split_pattern(texts, " ")
    rows = np.flatnonzero(pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False))
    if len(rows):
        some = texts.take(pa.array(rows)).to_pylist()
        gap = next(g for k in count() if not any((g := f"\0{k}\0") in t for t in some))
        other = pc.split_pattern(pa.array([cut.sub(gap, t) for t in some], pa.string()), gap)
        take = np.arange(len(texts))
        take[rows] = len(texts) + np.arange(len(rows))
        parts = pa.concat_arrays([parts, other]).take(pa.array(take))
    coded = parts.flatten().dictionary_encode()
    ends = parts.offsets.to_numpy()
    return ends - ends[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def slices(column: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about `size` bytes of a column of texts; null is empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, column.slice(a, b - a)
        a = b


def batches(texts: list[str], chars: int = 2_000_000):
    """(first, last) places of runs of texts with about `chars` characters each."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(flat, lengths) of lists of ids."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
    return flat, n


def by_lead(tok, lead: np.ndarray, space: str, at_once: int = 500) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes segments that each follow a space, `at_once` of them as one text.

    In segments without white space at their ends, spaces inside or the mark of a space,
    only the space in front makes a token that begins with its mark (`lead` by id), so
    those tokens say where each segment begins. Other segments, and texts whose marks do
    not add up, go one by one.
    """

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i, s in enumerate(segments) if s and " " not in s and space not in s and s.strip() == s]
        parts = [plain[a : a + at_once] for a in range(0, len(plain), at_once)]
        texts = [" " + " ".join([segments[i] for i in part]) for part in parts]
        rows, flats, sizes = [], [], []
        for part, e in zip(parts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            starts = np.flatnonzero(lead[ids])
            if len(starts) == len(part) and starts[0] == 0:
                rows.append(part)
                flats.append(ids)
                sizes.append(np.diff(np.append(starts, len(ids))))
        known = np.zeros(len(segments), bool)
        for part in rows:
            known[part] = True
        rest = np.flatnonzero(~known).tolist()
        flat, n = joined([e.ids for e in tok.encode_batch_fast([" " + segments[i] for i in rest], add_special_tokens=False)])
        order = np.concatenate([*map(np.asarray, rows), np.array(rest, np.int64)]).astype(np.int64)
        flat, n = np.concatenate([*flats, flat]), np.concatenate([*sizes, n]).astype(np.int64)
        start, back = np.cumsum(n) - n, np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        start, n = start[back], n[back]
        return flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    return encode
