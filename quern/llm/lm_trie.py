"""Language-model scoring with an Elias-Fano n-gram trie.

The trie. Its first level holds the words of the training texts with their counts. Below
a word are its successors, below a pair the successors of the pair, to the order of the
model. A level is a monotone Elias-Fano sequence of (parent, hash of the successor), so a
successor is coded relative to its context; monotone pointers say where the successors of
a context begin and end, and a successor search within these bounds finds the quantised,
smoothed probability. The shards of a trie are memory maps.

Smoothing is interpolated absolute discounting: (c - D) / C for a successor seen c times
in a context seen C times, plus b times its probability in the context that is one word
shorter, where b is D times the number of distinct successors by C. A word alone has
(c - D) / N; words never seen have D V / N together. A text is scored from a start mark
to an end token; every n-gram of the training texts counts, however rare.

The run. Texts are taken in blocks. A block is reduced to its distinct n-grams with their
counts in training texts, dealt to shards; a shard merges what all blocks sent, builds
its part of the trie and answers every block's n-grams from it, a byte each. A block's
texts then meet the answers and are scored. Nothing of the model reaches a machine that
does not ask for it, and the driver sees N and V only. A word and all below it lie in one
shard, unless the word (or a pair) is so common that its successors would burden a
shard: these contexts are found in a sample and their successors dealt to several
shards, each with its share of the context's mass. Only the balance depends on the
sample, not the result.

Blocks are found again by partition and place, so rows must come in the same partitions
and order twice, as from files; other inputs are written first (`stable`). A block whose
n-grams are not the ones that were answered is never scored: all is run again on a written copy.

Edge cases: null and empty texts are the end token alone. Rows for which `learn` is null
or false are scored and not learned from. Without training texts every score is that of an
empty vocabulary (log10 of 1 for each token). Texts are read whole; repeated rows count
and score as rows of their own. Only the id and text columns, and what `learn` needs, are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import drop, fold, stage, unit_hash

U = np.uint64
ORDER = 3
DISCOUNT_1, DISCOUNTS = 0.5, (0.6, 0.7)  # of words; of pairs, triples and longer ones
END, START = U(0x1D8AF066E1C2B3A5), U(0x2545F4914F6CDD1D)
STEP = 1 / 24  # of the quantised log10 probabilities, one byte each
NONE = 255  # the code of an n-gram that is not there
OTHER_BLOCKS = "a block of texts is not the one that was answered: rows must come in the same partitions and order twice"
POWERS = 10.0 ** (np.arange(256) * -STEP)
NODE = U((1 << 32) - 1)  # rows of a block are shard << 32 | node
BLOCK_TOKENS = 750_000
SHARD_TOKENS = 750_000
MOST_TASKS = 20_000
SAMPLE_ROWS = 4000


def quantise(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logp / STEP), 0, NONE - 1).astype(np.uint8)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with an END behind each text, offsets of the texts)."""
    from quern.llm._hash import word_hashes

    words, at = word_hashes(texts)
    n = np.diff(at) + 1
    out = np.full(len(words) + len(n), END)
    ends = np.cumsum(n) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words
    return out, np.concatenate([[0], ends + 1])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, number of each key's own value among them)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return k[new], order[new], inverse


def merged(keys: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of all."""
    k = np.sort(np.concatenate(keys))
    return k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k


def small(a: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def pack(v: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bytes of each value."""
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel()


def unpack(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").ravel()


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


@dataclass(frozen=True)
class Deal:
    """How n-grams go to shards."""

    shards: int = 1
    order: int = ORDER
    widths: tuple[int, ...] = (5, 5)  # bytes of a successor's hash, by level from pairs on
    hot: tuple[np.ndarray, ...] = field(default_factory=lambda: (np.zeros(0, U),) * (ORDER - 1))  # common contexts, by level, sorted
    parts: tuple[np.ndarray, ...] = field(default_factory=lambda: (np.zeros(0, U),) * (ORDER - 1))  # into how many their successors go

    def shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U(32)) * U(self.shards) >> U(32)).astype(np.int32)

    def among(self, level: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it hot?, parts) of context hashes of a level (0: words)."""
        hot = self.hot[level]
        if not len(hot):
            return np.zeros(len(h), bool), np.ones(len(h), U)
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        same = hot[at] == h
        return same, np.where(same, self.parts[level][at], U(1))


class Block:
    """The distinct n-grams of a block of texts, and how they go to shards.

    Level 0 are the words, START among them; node i of level k is (parent in level k - 1, word).
    rows[k] are the (shard, node) that shards hear of, in order of both: each node in
    its own shard, and contexts wherever successors of theirs are.
    """

    def __init__(self, tok: np.ndarray, at: np.ndarray, deal: Deal):
        from quern.llm._hash import mix

        self.deal, self.at = deal, at
        n = len(tok)
        self.words, _, rank = distinct(np.append(tok, START))
        start, self.rank = int(rank[-1]), rank[:-1]
        bits = U(int(len(self.words)).bit_length())
        place = np.arange(n, dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), np.diff(at))  # of a token in its text
        ctx = np.empty(n, np.int32)
        ctx[1:] = self.rank[:-1]
        ctx[at[:-1]] = start
        here, route = np.arange(n), self.words
        self.hashes = hashes = [self.words]
        self.node, self.parent, self.last, self.first, self.routes = [self.rank], [None], [None], [None], [deal.shard(self.words)]
        for level in range(1, deal.order):
            key, one, inverse = distinct(ctx.astype(U) << bits | self.rank[here].astype(U))
            parent, last = (key >> bits).astype(np.int32), (key & ((U(1) << bits) - U(1))).astype(np.int32)
            hot, parts = deal.among(level - 1, hashes[-1])
            succ = self.words[last]
            route = route[parent]
            if (spread := np.flatnonzero(hot[parent])).size:
                p = parent[spread]
                route[spread] = mix(hashes[-1][p] + U(1) + succ[spread] % parts[p])
            hashes.append(mix(hashes[-1][parent] * U(3) + succ) if level < deal.order - 1 else None)
            self.parent.append(parent)
            self.last.append(last)
            self.first.append(here[one].astype(np.int32))
            self.routes.append(deal.shard(route))
            if level == 1:
                node = inverse
            else:
                node = np.full(n, -1, np.int32)
                node[here] = inverse
            self.node.append(node)
            if level < deal.order - 1:
                here = np.flatnonzero(place >= level)
                ctx = node[here - 1]
        # which shards hear of which nodes
        self.hot = [deal.among(k, hashes[k])[0] for k in range(deal.order - 1)]
        self.rows: list = [None] * deal.order
        need = np.zeros(0, U)
        for level in range(deal.order - 1, -1, -1):
            pairs = [need, self.routes[level].astype(U) << U(32) | np.arange(len(self.routes[level]), dtype=U)]
            if level < deal.order - 1 and self.hot[level].any():  # all parts of a common context tell their share of it
                k = np.flatnonzero(self.hot[level])
                parts = deal.among(level, hashes[level][k])[1].astype(np.int64)
                each = spans(np.zeros(len(k), np.int64), parts).astype(U)
                to = deal.shard(mix(np.repeat(hashes[level][k], parts) + U(1) + each))
                pairs.append(to.astype(U) << U(32) | np.repeat(k, parts).astype(U))
            self.rows[level] = merged(pairs)
            need = self._up(level) if level else need

    def _up(self, level: int) -> np.ndarray:
        """(shard, parent) of the rows of a level."""
        rows = self.rows[level]
        return rows & ~NODE | self.parent[level][self._node(level)].astype(U)

    def _node(self, level: int) -> np.ndarray:
        return (self.rows[level] & NODE).astype(np.int64)

    def _own(self, level: int) -> np.ndarray:
        """Is the row that of the node's own shard?"""
        return self.routes[level][self._node(level)] == (self.rows[level] >> U(32)).astype(np.int32)

    def check(self) -> int:
        """A number that tells blocks of other n-grams apart."""
        n = int(self.words.sum(dtype=U)) + len(self.rank) * 0x9E3779B97F4A7C15 + len(self.rows[-1])
        return int(np.uint64(n & (1 << 64) - 1).view(np.int64))

    def requests(self, learn: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """(shard, arrays) of all shards that hear of this block."""
        deal = self.deal
        seen = np.repeat(learn, np.diff(self.at))
        counts, runs = [], []
        for level, node in enumerate(self.node):
            n = np.bincount(node[seen & (node >= 0)], minlength=len(self.routes[level]))
            counts.append(np.where(self._own(level), n[self._node(level)], 0))
            if level:
                runs.append(np.bincount(self._above(level), minlength=len(self.rows[level - 1])))
        edges = [np.searchsorted(r, np.arange(deal.shards + 1, dtype=U) << U(32)) for r in self.rows]
        nodes = [self._node(level) for level in range(deal.order)]
        for s in range(deal.shards):
            a, b = edges[0][s], edges[0][s + 1]
            if a == b:
                continue
            out = {"word": self.words[nodes[0][a:b]], "n0": small(counts[0][a:b]), "hot0": small(np.flatnonzero(self.hot[0][nodes[0][a:b]]))}
            for level in range(1, deal.order):
                c = slice(edges[level][s], edges[level][s + 1])
                if level < deal.order - 1:
                    out[f"hot{level}"] = small(np.flatnonzero(self.hot[level][nodes[level][c]]))
                succ = self.words[self.last[level][nodes[level][c]]] >> U(64 - 8 * deal.widths[level - 1])
                out |= {f"run{level}": small(runs[level - 1][edges[level - 1][s] : edges[level - 1][s + 1]]), f"succ{level}": pack(succ, deal.widths[level - 1]), f"n{level}": small(counts[level][c])}
            yield s, out

    def _above(self, level: int) -> np.ndarray:
        """The row above each row of a level."""
        up = self._up(level)
        new = np.r_[True, up[1:] != up[:-1]] if len(up) else np.zeros(0, bool)
        return np.searchsorted(self.rows[level - 1], up[new])[np.cumsum(new) - 1]

    def scores(self, answers: dict[int, dict[str, np.ndarray]], total: int, vocabulary: int) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        deal, at = self.deal, self.at[:-1]
        told = [answers[s] for s in sorted(answers)]
        word, own = np.zeros(len(self.words), np.int64), self._own(0)
        word[self._node(0)[own]] = np.concatenate([x["seen0"] for x in told])[own]
        p = np.where(word > 0, word - DISCOUNT_1, max(DISCOUNT_1 * vocabulary, 0.5)) / max(total, 1) if total else np.ones(len(word))
        lower = p[self.rank]
        share, back = self._contexts(0, told)
        for level in range(1, deal.order):
            own = self._own(level)
            code = np.concatenate([x[f"code{level}"] for x in told])
            lead = np.where(code == NONE, 0.0, POWERS[code])
            if share is not None:
                lead *= share[self._above(level)]
            mine = np.empty(len(self.last[level]))
            mine[self._node(level)[own]] = lead[own]
            q = mine + back[self.parent[level]] * lower[self.first[level]]  # by node; lower by token
            here = self.node[level] >= 0
            lower[here] = q[self.node[level][here]]
            if level < deal.order - 1:
                share, back = self._contexts(level, told)
        log = np.log10(lower)
        base = np.log10((word + 1) / (total + 1 * (vocabulary + 1)))[self.rank]
        known = (word > 0)[self.rank].astype(np.int64)
        return np.diff(self.at), *(np.add.reduceat(x, at) if len(at) else x for x in (known, base, log))

    def _contexts(self, level: int, told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(share of a context's mass by row, None if all have all of it; what its discounts leave by node)."""
        node, hot = self._node(level), self.hot[level]
        back, share = np.ones(len(hot)), None
        back[node] = POWERS[np.concatenate([x[f"back{level}"] for x in told] or [np.zeros(0, np.uint8)])]
        if hot.any():
            share = np.ones(len(node))
            rows = np.flatnonzero(hot[node])
            raw = np.concatenate([x[f"mass{level}"] for x in told]).reshape(-1, 2)
            mass, kinds = np.bincount(node[rows], raw[:, 0], len(hot)), np.bincount(node[rows], raw[:, 1], len(hot))
            share[rows] = raw[:, 0] / np.maximum(mass[node[rows]], 1)
            back[hot] = np.where(mass[hot] > 0, DISCOUNTS[level] * kinds[hot] / np.maximum(mass[hot], 1), 1.0)
        return share, back


def _cut(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of runs of equal shards in a sorted array."""
    if len(shard):
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b in zip(edge, [*edge[1:], len(shard)], strict=True):
            yield int(shard[a]), slice(int(a), int(b))


class Trie:
    """Levels of a shard, over a memory map."""

    def __init__(self, arrays: dict[str, np.ndarray], deal: Deal):
        from quern.llm.elias_fano import unnested

        self.a, self.deal = arrays, deal
        self.words = unnested("word", arrays)
        self.succ = [unnested(f"succ{k}", arrays) for k in range(1, deal.order)]
        self.pointer = [unnested(f"pointer{k}", arrays) for k in range(1, deal.order)]

    @classmethod
    def build(cls, n_grams: Rows, deal: Deal) -> Trie:
        """From the n-grams of all blocks, of which those never learned are left out."""
        import mmap

        from quern.llm.elias_fano import EliasFano, dump, load, nested

        names, levels, hot = n_grams.names, n_grams.levels, n_grams.common
        # bottom up: what was learned itself stays, and what is a context of something that was
        size = [len(names), *(len(x[0]) for x in levels)]
        keep, mass, kinds = [np.zeros(n, bool) for n in size], [], []
        for level in range(deal.order - 1, 0, -1):
            parent, _, n = levels[level - 1]
            got = n > 0
            keep[level] |= got
            keep[level - 1][parent[keep[level]]] = True
            mass.insert(0, np.bincount(parent[got], n[got], size[level - 1]))
            kinds.insert(0, np.bincount(parent[got], minlength=size[level - 1]))
        keep[0] |= n_grams.seen > 0
        arrays = nested("word", EliasFano.build(names[keep[0]], 1 << 64)) | {"count": small(n_grams.seen[keep[0]])}
        for level in range(1, deal.order):
            wide, up = 8 * deal.widths[level - 1], keep[level - 1]
            parent, tail, n = (x[keep[level]] for x in levels[level - 1])
            parent = (np.cumsum(up) - 1)[parent]
            k = int(up.sum())
            arrays |= nested(f"pointer{level}", EliasFano.build(np.append(np.searchsorted(parent, np.arange(k)), len(parent)).astype(U), len(parent) + 1))
            arrays |= nested(f"succ{level}", EliasFano.build(parent.astype(U) << U(wide) | tail, max(k, 1) << wide))
            of, many = mass[level - 1][up], kinds[level - 1][up]
            lead = quantise(np.log10(np.maximum(n - DISCOUNTS[level - 1], 1e-9) / np.maximum(of[parent], 1)))
            arrays[f"prob{level}"] = np.where(n > 0, lead, NONE).astype(np.uint8)
            arrays[f"back{level - 1}"] = np.where(of > 0, quantise(np.log10(np.maximum(DISCOUNTS[level - 1] * many, 1e-9) / np.maximum(of, 1))), 0).astype(np.uint8)
            # of contexts that several shards share, the mass itself
            some = np.flatnonzero(hot[level - 1][up])
            arrays |= {f"hot{level - 1}": some, f"mass{level - 1}": np.stack([of[some], many[some]], 1).astype(np.float64).ravel()}
        raw = dump(arrays)
        place = mmap.mmap(-1, len(raw))
        place.write(raw)
        return cls(load(place), deal)

    def answer(self, n_grams: Rows) -> dict[str, np.ndarray]:
        """Codes of the n-grams and what their contexts leave; every level is searched within the bounds of its contexts."""
        out: dict[str, np.ndarray] = {}
        at, ok = self.words.find(n_grams.names)
        out["seen0"] = np.zeros(len(at), np.int64)
        out["seen0"][ok] = self.a["count"][at[ok]]
        for level in range(1, self.deal.order):
            self._context(level - 1, at, ok, n_grams.common[level - 1], out)
            parent, tail, _ = n_grams.levels[level - 1]
            bounds = self.pointer[level - 1].all().astype(np.int64)
            at, ok = np.where(ok, at, 0)[parent], ok[parent]
            lo, hi = bounds[at], np.where(ok, bounds[np.minimum(at + 1, len(bounds) - 1)], bounds[at])
            at, ok = self.succ[level - 1].find(at.astype(U) << U(8 * self.deal.widths[level - 1]) | tail, lo, hi)
            out[f"code{level}"] = _at(self.a[f"prob{level}"], at, ok, NONE)
        return out

    def _context(self, level: int, at: np.ndarray, ok: np.ndarray, hot: np.ndarray, out: dict) -> None:
        out[f"back{level}"] = _at(self.a[f"back{level}"], at, ok, 0)
        which, mine = at[hot], self.a[f"hot{level}"]
        place = np.searchsorted(mine, which)
        there = ok[hot] & (place < len(mine))
        there[there] = mine[place[there]] == which[there]
        mass = np.zeros((len(which), 2))
        mass[there] = self.a[f"mass{level}"].reshape(-1, 2)[place[there]]
        out[f"mass{level}"] = mass


def _at(a: np.ndarray, at: np.ndarray, ok: np.ndarray, other: int) -> np.ndarray:
    out = np.full(len(at), other, np.uint8)
    out[ok] = a[at[ok]]
    return out


class Rows:
    """N-grams of one shard as blocks sent them, one block behind the other."""

    def __init__(self, sent: list[dict[str, np.ndarray]], deal: Deal):
        put = lambda name: np.concatenate([x[name] for x in sent])
        levels = range(1, deal.order)
        self.sizes = [[len(x[f"n{k}"]) for x in sent] for k in range(deal.order)]
        self.hot = [np.zeros(sum(n), bool) for n in self.sizes[:-1]]
        for k, flags in enumerate(self.hot):
            flags[np.concatenate([x[f"hot{k}"].astype(np.int64) + a for x, a in zip(sent, np.cumsum([0, *self.sizes[k]]), strict=False)])] = True
        # the distinct ones: words; by level parent, hash of the successor and count; which contexts are common
        self.names, _, node = distinct(put("word"))
        self.seen = np.bincount(node, put("n0").astype(np.float64), len(self.names)).astype(np.int64)
        self.node, self.levels, self.common = [node], [], [np.bincount(node, self.hot[0], len(self.names)) > 0]
        for k in levels:
            wide = U(8 * deal.widths[k - 1])
            key, _, inverse = distinct(np.repeat(node, put(f"run{k}").astype(np.int64)).astype(U) << wide | unpack(put(f"succ{k}"), deal.widths[k - 1]))
            self.levels.append(((key >> wide).astype(np.int32), key & ((U(1) << wide) - U(1)), np.bincount(inverse, put(f"n{k}").astype(np.float64), len(key))))
            node = inverse
            self.node.append(node)
            if k < deal.order - 1:
                self.common.append(np.bincount(node, self.hot[k], len(key)) > 0)

    def split(self, answer: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        """The answer to each block, from that on the distinct n-grams."""
        out: list[dict] = [{} for _ in self.sizes[0]]
        for name, a in answer.items():
            kind, k = name[:4], int(name[4:])
            if kind == "mass":
                some = np.cumsum(self.common[k]) - 1
                a, sizes = a[some[self.node[k][self.hot[k]]]], np.diff(np.append(0, np.cumsum(self.hot[k]))[np.cumsum([0, *self.sizes[k]])])
            else:
                a, sizes = a[self.node[k]], self.sizes[k]
            for to, part in zip(out, np.split(a, np.cumsum(sizes)[:-1]), strict=True):
                to[name] = small(part) if kind == "seen" else part.ravel()
        return out


_SENT = "shard int, block long, check long, data binary, n long, v long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "block", "check", "data", "n", "v"])


def _blocks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """(block, its rows) of a partition of (id, text, learn): the block of a row follows from the bytes before it alone."""
    import pyarrow.compute as pc

    before, held, now, part = 0, [], None, TaskContext.get().partitionId()
    for batch in it:
        n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = before + np.cumsum(n)
        for k, c in _cut((ends - n) // size):
            if held and k != now:
                yield part << 40 | now, pa.Table.from_batches(held)
                held = []
            now = k
            held.append(batch.slice(c.start, c.stop - c.start))
        before = int(ends[-1]) if len(ends) else before
    if held:
        yield part << 40 | now, pa.Table.from_batches(held)


def _tokens_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return tokens([t or "" for t in column.to_pylist()])


def _requests_fn(deal: Deal, size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm.elias_fano import dump

        for number, rows in _blocks(it, size):
            block = Block(*_tokens_of(rows.column(1)), deal)
            learn = np.array([bool(x) for x in rows.column(2).to_pylist()], bool)
            check, out = block.check(), []
            for shard, arrays in block.requests(learn):
                out.append((shard, number, check, dump(arrays), None, None))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _answers_fn(deal: Deal):
    """Of rows in order of their shards, those of one shard at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm.elias_fano import dump, load

        def work(shard: int, held: list) -> pa.RecordBatch:
            n_grams = Rows([load(data) for _, _, data in held], deal)
            got = n_grams.split(Trie.build(n_grams, deal).answer(n_grams))
            rows = [(shard, -1, 0, b"", int(n_grams.seen.sum()), int((n_grams.seen > 0).sum()))]
            return _batch(rows + [(shard, block, check, dump(x), None, None) for (block, check, _), x in zip(held, got, strict=True)])

        held, now = [], None
        for batch in it:
            for shard, block, check, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and shard != now:
                    yield work(now, held)
                    held = []
                now = shard
                held.append((block, check, data))
        if held:
            yield work(now, held)

    return run


def _deal_fn(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(it, size):
            for batch in rows.to_batches(max_chunksize=2000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number)), batch.column(0), batch.column(1)], ["block", "id", "text"])

    return run


def _score_fn(deal: Deal, total: int, vocabulary: int):
    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        from quern.llm.elias_fano import load

        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        block = Block(*_tokens_of(texts.column("text")), deal)
        if set(sent.column("check").to_pylist()) != {block.check()}:
            raise RuntimeError(OTHER_BLOCKS)
        answers = {s.as_py(): load(x.as_buffer()) for s, x in zip(sent.column("shard"), sent.column("data"), strict=True)}
        return pa.table([texts.column("id"), *map(pa.array, block.scores(answers, total, vocabulary))], names=names)

    return run


def _common_fn(least: float):
    """(level, hash, count) of contexts with at least this share of a task's tokens; level -1 counts the tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(it, 12 << 20):
            block = Block(*_tokens_of(rows.column(1)), Deal())
            n, out = len(block.rank), [(-1, 0, len(block.rank))]
            for level, node in enumerate(block.node[:-1]):
                count = np.bincount(node[node >= 0], minlength=len(block.hashes[level]))
                if not level:
                    count[block.words == START] = len(rows)
                    count[block.words == END] = 0
                k = np.flatnonzero(count >= max(2, least * n))
                out += [(level, h, c) for h, c in zip(block.hashes[level][k].view(np.int64).tolist(), count[k].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["level", "hash", "n"])

    return run


def common(rows: DataFrame, texts: int, deal: Deal) -> Deal:
    """The deal with the contexts whose successors a sample says would fill a quarter of a shard: at most 4 a shard and level."""
    least = 1 / (4 * deal.shards)
    if deal.shards < 8:
        return deal
    sample = rows.where(unit_hash(F.col("id")) < F.lit(SAMPLE_ROWS / max(texts, 1)))
    got = sample.mapInArrow(_common_fn(least / 2), "level int, hash long, n long").groupBy("level", "hash").agg(F.sum("n").alias("n"))
    total = got.where("level < 0").select("n").first()
    if total is None:
        return deal
    found = got.where((F.col("level") >= 0) & (F.col("n") >= F.lit(least * total[0]))).toPandas()
    hot, parts = [], []
    for level in range(deal.order - 1):
        mine = found[found["level"] == level]
        h, n = mine["hash"].to_numpy(np.int64).view(U), mine["n"].to_numpy(float)
        by = np.argsort(h)
        hot.append(h[by])
        parts.append((2 ** np.ceil(np.log2(np.maximum(n[by] / total[0] / least, 1)) + 1)).astype(U))
    return Deal(deal.shards, deal.order, deal.widths, tuple(hot), tuple(parts))


def score(df: DataFrame, learn: Column, id_col="doc_id", text_col="text", order: int = ORDER, stable: bool = False, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int, int]:
    """(id, n_tokens, n_known, base_score and score of every row; tokens and words learned from the rows where `learn` holds).

    stable: rows of df come in the same partitions and order whenever they are read, as those of files do.
    """
    if not 2 <= order <= 1 + len(DISCOUNTS):
        raise ValueError(f"the order must be from 2 to {1 + len(DISCOUNTS)}")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    if stable:
        try:
            out, *counts = _scored(rows, order, block_tokens, shard_tokens)
            return out.withColumnRenamed("id", id_col), *counts
        except Exception as e:
            if OTHER_BLOCKS not in str(e):  # as when a cluster that has lost or gained machines cuts files otherwise
                raise
    written = stage(rows)
    out, *counts = _scored(written, order, block_tokens, shard_tokens)
    drop(written)
    return out.withColumnRenamed("id", id_col), *counts


def _scored(rows: DataFrame, order: int, block_tokens: int, shard_tokens: int) -> tuple[DataFrame, int, int]:
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    chars, texts = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    about = (chars or 0) // 6 + texts
    # the hash of a successor is as wide as the corpus asks for, wider where a context can have more successors
    wide = lambda spare: min(5, max(3, -(-(int(about).bit_length() + spare) // 8)))
    none = (np.zeros(0, U),) * (order - 1)
    deal = common(rows, texts, Deal(max(1, about // shard_tokens), order, (wide(5), *(wide(-3) for _ in range(order - 2))), none, none))
    size = 6 * block_tokens
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(deal.shards, MOST_TASKS))
    sent = rows.mapInArrow(_requests_fn(deal, size), _SENT).repartitionById(tasks, "shard").sortWithinPartitions("shard")
    answers = stage(sent.mapInArrow(_answers_fn(deal), _SENT))
    total, vocabulary = (int(x or 0) for x in answers.where("block = -1").agg(F.sum("n"), F.sum("v")).first())
    dealt = rows.mapInArrow(_deal_fn(size), f"block long, id {kind}, text string")
    dealt = dealt.repartition(tasks, "block")
    told = answers.where("block >= 0").select("block", "shard", "check", "data").repartition(tasks, "block")
    out = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score_fn(deal, total, vocabulary), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    out = stage(out)
    drop(answers)
    return out, total, vocabulary


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(True))
    out, total, _ = score(docs, ~held, stable=True)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
