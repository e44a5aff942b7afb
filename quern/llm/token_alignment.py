"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE of the tokenizers library, B a SentencePiece model. Both write the
bytes of a space and the text. Packed bitsets mark the bytes at which a token of A, and
of B, ends. Their AND holds the cuts that both share: between two of them lies a group,
and popcount rank maps its cuts to the ranges of tokens of A and B. Their OR has one bit
for each link, a pair of tokens whose bytes overlap: up to that byte one token of each
covers the text, and rank says which. Nothing is compared pair by pair.

Neither tokenizer merges across a lone space between two other characters, so a text is
aligned through its segments at those spaces: each distinct one that a task meets is
encoded and aligned once, and kept in bounded memory. A model of which this is not true
(pieces that hold an inner space, a normaliser) takes texts whole.

A pair's count, how many texts hold it linked, is taken over the whole corpus, combined
in each task before the shuffle. The most frequent pairs, at most TOP of them, go to all
tasks as three arrays; links of other pairs meet their counts in a join, so the result
is the same for any TOP.

Edge cases: null and empty texts, and texts that one of the tokenizers does not give
back byte by byte (B writes U+2581 as a space), have no tokens: zeros, and '' for the
digest. Strings of special tokens inside texts are plain text. Repeated rows are rows of
their own, and each counts as a text. An empty table gives an empty result. Only the id
and the text column are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import drop, stage
from quern.llm._words import Segments, by_lead, joined, slices, split

TOP = 1 << 20  # pairs that go to all tasks, 17 bytes each
HELD = 1 << 21  # counted pairs that a task holds before it passes them on
MARK = "▁"
# a text is cut at spaces between two characters that are no white space; texts with other spaces are cut one by one
_WHITE = r"[\s\v\x{1c}-\x{1f}\x{85}\pZ]"
_ODD = rf"(?:\A|{_WHITE}) | (?:{_WHITE}|\z)"
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Bits:
    """A packed bitset with popcount rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def at(places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 1) // 64) * 64, bool)
        flags[places] = True
        return Bits(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Segments aligned: token ids of both, their numbers in each segment, ends of groups as numbers of tokens, and links as places of tokens."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ok: np.ndarray
    cuts: np.ndarray  # byte behind each group
    cut_a: np.ndarray  # tokens of A up to there
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


class Aligner:
    """Encodes with both tokenizers and aligns what they say."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core belongs to each task already
        import sentencepiece
        from tokenizers import Tokenizer

        from quern.llm.sentencepiece_tokenizers import BYTE, NORMAL, USER_DEFINED, parse_model

        self.tok = Tokenizer.from_file(path_a)
        self.tok.encode_special_tokens = True
        with open(path_b, "rb") as f:
            data = f.read()
        self.spm, m = sentencepiece.SentencePieceProcessor(model_proto=data), parse_model(data)
        decode, vocabulary = byte_level(), self.tok.get_vocab()
        self.size_a, self.size_b = max(vocabulary.values(), default=0) + 1, len(m.pieces)
        self.bytes_a = [b""] * self.size_a
        lead = np.zeros(self.size_a, bool)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
            lead[i] = token.startswith("Ġ")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        numbers = range(max(self.size_a, self.size_b))
        self.signed = np.array([[f"{i}{c}" for i in numbers] for c in ",|;"], object)
        self.digits = np.array([len(str(i)) + 1 for i in numbers], np.int64)
        inner = any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED))
        self.by_word = not (inner or m.whitespace_as_suffix or m.remove_extra_whitespaces or m.charsmap) and m.add_dummy_prefix
        spaced = SimpleNamespace(encode_batch_fast=lambda texts, add_special_tokens: [SimpleNamespace(ids=x) for x in self.spm.encode([t[1:] for t in texts], num_threads=1)])
        self.many_a = by_lead(self.tok, lead, " ")
        self.many_b = by_lead(spaced, np.array([p.startswith(MARK) and k == NORMAL for p, _, k in m.pieces]), MARK)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(ids, lengths) of both for segments that each follow a space."""
        if self.by_word:
            return *self.many_a(segments), *self.many_b(segments)
        a = [e.ids for e in self.tok.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        return *joined(a), *joined(self.spm.encode(segments, num_threads=1))

    def align(self, segments: list[str]) -> Aligned:
        """Segments that one of the two does not give back keep no tokens."""
        a, n_a, b, n_b = self.encode(segments)
        raw = [f" {s}".encode() for s in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        owner_a, owner_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
        ok = np.ones(len(raw), bool)
        for ids, n, owner, names, lengths in ((a, n_a, owner_a, self.bytes_a, self.len_a), (b, n_b, owner_b, self.bytes_b, self.len_b)):
            same = np.bincount(owner, lengths[ids], len(raw)).astype(np.int64) == size
            if not same.all() or b"".join([names[i] for i in ids.tolist()]) != b"".join(raw):
                ends = np.append(0, np.cumsum(n)).tolist()
                same &= np.array([b"".join([names[j] for j in ids[x:y].tolist()]) == r for x, y, r in zip(ends, ends[1:], raw, strict=False)], bool)
            ok &= same
        a, b = a[ok[owner_a]], b[ok[owner_b]]
        n_a, n_b, size = n_a * ok, n_b * ok, size * ok
        total = int(size.sum())
        in_a, in_b = Bits.at(np.cumsum(self.len_a[a]) - 1, total), Bits.at(np.cumsum(self.len_b[b]) - 1, total)
        shared, links = in_a & in_b, (in_a | in_b).select()
        cuts, stop = shared.select() + 1, np.cumsum(size)
        link_a, link_b = in_a.rank(links), in_b.rank(links)
        return Aligned(
            a, b, n_a, n_b, ok, cuts, in_a.rank(cuts), in_b.rank(cuts), link_a, link_b,
            np.diff(shared.rank(stop), prepend=0), np.diff(np.searchsorted(links, stop), prepend=0),
        )

    def groups(self, x: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2` of each segment."""
        per_a, per_b = np.diff(x.cut_a, prepend=0), np.diff(x.cut_b, prepend=0)
        # tokens in the order in which they are written, each with the sign behind it: A's of a group, then B's
        at_a = np.arange(len(x.a)) + np.repeat(x.cut_b - per_b, per_a)
        at_b = np.arange(len(x.b)) + np.repeat(x.cut_a, per_b)
        sign_a, sign_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        sign_a[x.cut_a - 1], sign_b[x.cut_b - 1] = 1, 2
        written = np.empty(len(x.a) + len(x.b), object)
        written[at_a], written[at_b] = self.signed[sign_a, x.a], self.signed[sign_b, x.b]
        text = "".join(written.tolist())
        n = np.zeros(len(written) + 1, np.int64)
        n[1:][at_a], n[1:][at_b] = self.digits[x.a], self.digits[x.b]
        ends = np.cumsum(n)[np.append(0, np.cumsum(x.n_a + x.n_b))].tolist()
        return [text[i : max(i, j - 1)] for i, j in zip(ends, ends[1:], strict=False)]


class Table(Segments):
    """Segments with their links and figures; `counts` (codes, numbers, best), if given, are summed over a segment's links.

    columns: start, 2 x links, n_a, n_b, n_groups, ok, sum of known counts, links of best pairs, links of pairs not in counts
    """

    def __init__(self, aligner: Aligner, counts: tuple[np.ndarray, ...] | None = None, size: int = 48 << 20):
        self.aligner, self.counts = aligner, counts
        super().__init__(self._aligned, size)

    def _clear(self) -> None:
        super()._clear()
        self.groups: list[str] = []

    def _aligned(self, names: list[str]):
        x = self.aligner.align(names)
        a, b = x.a[x.link_a].astype(np.int64), x.b[x.link_b].astype(np.int64)
        owner = np.repeat(np.arange(len(names)), x.n_links)
        sums = []
        if self.counts is not None:
            self.groups += (new := self.aligner.groups(x))
            self.bytes += 60 * len(new) + sum(map(len, new))
            codes, number, best = self.counts
            code = a * self.aligner.size_b + b
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            at = at[known]
            add = lambda w, who: np.bincount(who, w, len(names)).astype(np.int64) if len(w) else np.zeros(len(names), np.int64)
            count = np.zeros(len(names), np.int64)
            np.add.at(count, owner[known], number[at])  # in integers: a sum of counts may pass 2^53
            sums = [count, add(best[at].astype(float), owner[known]), add((~known).astype(float), owner)]
        flat = np.stack([a, b], 1).astype(np.uint32).ravel()
        return flat, 2 * x.n_links, x.n_a, x.n_b, x.n_groups, x.ok, *sums

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of the texts, numbers of their segments, has each text tokens?)."""
        if self.aligner.by_word:
            at, words, names = split(texts, _ODD, _CUT)
        else:
            coded = texts.dictionary_encode()
            at, words, names = np.arange(len(texts) + 1), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        number = self.numbers(names)[words]
        ok = np.logical_and.reduceat(self.columns[5][number], at[:-1]) if len(texts) else np.zeros(0, bool)
        return at, number, ok & np.array([bool(len(t)) for t in texts.to_pylist()], bool)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of two files, loaded once by a worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _pairs_of(table: Table, at: np.ndarray, number: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, links) of the distinct pairs of each text that is taken."""
    row = np.repeat(np.arange(len(take)), np.diff(at))
    keep = take[row]
    span = int(number.max(initial=0)) + 1
    key, times = np.unique(row[keep] * span + number[keep], return_counts=True)
    row, number = key // span, key % span
    n = table.columns[1][number] // 2
    ids = table.ids(number).reshape(-1, 2).astype(np.int64)
    span = table.aligner.size_a * table.aligner.size_b
    key = np.repeat(row, n) * span + ids[:, 0] * table.aligner.size_b + ids[:, 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    key, times = key[first], np.add.reduceat(np.repeat(times, n)[order], first) if len(first) else np.zeros(0, np.int64)
    return key // span, key % span, times


def _count_fn(path_a: str, path_b: str, held: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        table = Table(aligner)
        codes, counts, parts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal codes, counts, waiting
            every, n = np.concatenate([codes, *parts]), np.concatenate([counts, *(np.ones(len(p), np.int64) for p in parts)])
            codes, back = np.unique(every, return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, back, n)
            parts.clear()
            waiting = 0

        def out():
            for lo in range(0, len(codes), 50_000):
                c = codes[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array((c // aligner.size_b).astype(np.int32)), pa.array((c % aligner.size_b).astype(np.int32)), pa.array(counts[lo : lo + 50_000])], ["a", "b", "n"])

        for batch in it:
            for _, texts in slices(batch.column(0)):
                at, number, ok = table.of(texts)
                _, code, _ = _pairs_of(table, at, number, ok)
                parts.append(code)
                waiting += len(code)
                if waiting > held:
                    merge()
                    if len(codes) > held:
                        yield from out()
                        codes, counts = codes[:0], counts[:0]
        merge()
        yield from out()

    return run


def pair_counts(df: DataFrame, path_a: str, path_b: str, text_col="text", held: int = HELD) -> DataFrame:
    """a, b, n (texts that hold the pair linked) and best (is n the highest of its A id?) of every pair of ids, staged."""
    parts = df.select(text_col).mapInArrow(_count_fn(path_a, path_b, held), "a int, b int, n long")
    counts = stage(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each entry of A's vocabulary at most
    out = stage(counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    drop(counts)
    return out


def _top(counts: DataFrame, size_b: int, top: int) -> tuple[tuple[np.ndarray, ...], bool]:
    """The most frequent pairs as sorted arrays, at most `top` of them, and whether these are all."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 rows at most
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > top:
            break
        least, held = k, held + sizes[k]
    t = counts.where(F.floor(F.log2("n")) >= least).select("a", "b", "n", "best").toArrow()
    code = t.column("a").to_numpy().astype(np.int64) * size_b + t.column("b").to_numpy()
    order = np.argsort(code)
    best = t.column("best").to_numpy(zero_copy_only=False).astype(bool)
    return (code[order], t.column("n").to_numpy().astype(np.int64)[order], best[order]), held == sum(sizes.values())


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _digest_fn(path_a: str, path_b: str, shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        table, part, seen = Table(aligner, shared.value), TaskContext.get().partitionId(), 0
        for batch in it:
            for a, texts in slices(batch.column(1)):
                at, number, ok = table.of(texts)
                _, length, n_a, n_b, n_groups, _, count, best, other = table.columns
                total = lambda x: np.add.reduceat(x[number], at[:-1]) * ok  # noqa: E731, B023
                rare = total(other) > 0
                row, code, times = _pairs_of(table, at, number, rare) if rare.any() else (np.zeros(0, np.int64),) * 3
                if len(row):
                    codes = shared.value[0]
                    place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                    new = codes[place] != code if len(codes) else np.ones(len(code), bool)
                    row, code, times = row[new], code[new], times[new]
                sha = []
                for i, good in enumerate(ok.tolist()):
                    h = hashlib.sha256()
                    for lo in range(at[i], at[i + 1] if good else at[i], 100_000):
                        h.update(((";" if lo > at[i] else "") + ";".join([table.groups[k] for k in number[lo : min(lo + 100_000, at[i + 1])].tolist()])).encode())
                    sha.append(h.hexdigest() if good else "")
                links = total(length) // 2
                ends = pa.array(np.searchsorted(row, np.arange(len(ok) + 1)).astype(np.int32))
                pair = pa.StructArray.from_arrays([pa.array((code // aligner.size_b).astype(np.int32)), pa.array((code % aligner.size_b).astype(np.int32)), pa.array(times)], ["a", "b", "times"])
                cols = [batch.column(0).slice(a, len(texts)), pa.array((part << 40) + seen + np.arange(len(ok)))]
                cols += [pa.array(c) for c in (total(n_a), total(n_b), total(n_groups), links, total(best), total(count))]
                cols += [pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, pair)]
                seen += len(ok)
                yield pa.RecordBatch.from_arrays(cols, ["id", "row", *_FIGURES, "groups_sha256", "rare"])

    return run


def digests(df: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text", top: int = TOP) -> DataFrame:
    """A row per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    counts = pair_counts(df, path_a, path_b, text_col)
    arrays, all_there = _top(counts, _aligner(path_a, path_b).size_b, top)
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, {', '.join(f'{c} long' for c in _FIGURES)}, groups_sha256 string, rare array<struct<a: int, b: int, times: long>>"
    rows = df.select(id_col, text_col).mapInArrow(_digest_fn(path_a, path_b, shared), schema)
    named = [F.col("id").alias(id_col), *_FIGURES, "groups_sha256"]
    if all_there:
        return rows.select(*named)
    rows = stage(rows)
    r = rows.select("row", F.inline("rare")).join(counts.hint("merge"), ["a", "b"])
    more = r.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = rows.drop("rare").join(more.hint("merge"), "row", "left")
    out = out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return out.select(*named)


def alignments(df: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text") -> DataFrame:
    """A row per text: ids of both tokenizers, the byte behind each group (the leading space counted), and the tokens of both up to there."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        aligner = _aligner(path_a, path_b)
        for batch in it:
            for i, text in enumerate(batch.column(1).to_pylist()):
                x = aligner.align([text] if text else [])
                lists = [pa.array([c.tolist()], pa.list_(pa.int64())) for c in (x.a, x.b, x.cuts, x.cut_a, x.cut_b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *lists], ["id", "a", "b", "cuts", "a_upto", "b_upto"])

    lists = ", ".join(f"{c} array<long>" for c in ("a", "b", "cuts", "a_upto", "b_upto"))
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, {lists}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *_FIGURES, "groups_sha256")
