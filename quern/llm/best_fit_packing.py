"""Best-fit packing of token sequences under several capacities at once.

A bin (training sequence) has a token, a document-count and an attention-cost
capacity; an item of n tokens takes (n, 1, n^2) of them. Items are placed by falling
length into the open bin that fits best: by the smallest weighted norm of what would
remain, or by the largest weighted dot product of item and residual, and only where
every capacity suffices. All three demands follow from the length, so the plan is
made on the histogram of lengths: bins in the same state are one class, and a whole
run of equal items goes to a class at once. That plan has at most a few runs per
length and class, whatever the number of documents; the driver makes it, and tasks
turn (length, rank among equal lengths) into (sequence, offset) by binary search.

Edge cases: null and empty texts are the end id alone (length 1). Texts longer than a
sequence are cut into full pieces with the short piece first. Ties go to the class
opened first. Repeated rows are packed each. An empty table gives an empty result.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import stage

CAPACITY = 2048
END_ID = 0


def plan(hist: dict[int, int], tokens: int = CAPACITY, docs: int | None = None, attention: int | None = None, rule: str = "norm", weights=(1.0, 0.05, 0.05)) -> np.ndarray:
    """Runs (length, first rank, items, first sequence, offset, items per sequence), sorted by length and rank.

    Item r of a run lies in sequence first + r // per at offset + (r % per) * length.
    Where docs and attention are not given, no sequence of that many tokens can exceed them.
    """
    cap = np.array([tokens, docs or tokens, attention or tokens**2], float)
    w = np.array(weights, float)
    state = np.empty((0, 3))  # residual tokens, documents, attention of each class
    spans: list[tuple[int, int]] = []  # its sequences: first, number
    runs, opened = [], 0
    for n in sorted((int(k) for k, v in hist.items() if v), reverse=True):
        item, left, rank = np.array([n, 1, n * n], float), int(hist[n]), 0
        if (item > cap).any():
            raise ValueError(f"an item of {n} tokens does not fit an empty sequence")
        while left:
            fits = (state >= item).all(1)
            if fits.any():
                if rule == "norm":
                    score = (w * ((state - item) / cap) ** 2).sum(1)
                else:
                    score = -(w * (state / cap) * (item / cap)).sum(1)
                k = int(np.where(fits, score, np.inf).argmin())
                (first, count), room = spans[k], state[k].copy()
                per = int((room // item).min())
                take = min(left, per * count)
                keep = np.ones(len(spans), bool)
                keep[k] = False
                state, spans = state[keep], [s for i, s in enumerate(spans) if i != k]
            else:
                room, per = cap.copy(), int((cap // item).min())
                take, first, count = left, opened, -(-left // per)
                opened += count
            runs.append((n, rank, take, first, int(tokens - room[0]), per))
            full, rest = divmod(take, per)
            for a, c, used in ((first, full, per), (first + full, 1 if rest else 0, rest), (first + full + bool(rest), count - full - bool(rest), 0)):
                if c:
                    state = np.vstack([state, room - used * item])
                    spans.append((a, c))
            left -= take
            rank += take
        if len(spans) > 64:  # classes without room for one more token take no part any more
            keep = state.min(1) >= 1
            state, spans = state[keep], [s for s, ok in zip(spans, keep, strict=True) if ok]
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def locate(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the items with these lengths and ranks."""
    key = (runs[:, 0] << 44) | runs[:, 1]
    r = runs[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
    i = rank - r[:, 1]
    return r[:, 3] + i // r[:, 5], r[:, 4] + i % r[:, 5] * length


HEAD = "\ud800"  # in front of the first segment of a text, which follows no space; no text holds this character
# byte-level BPE never merges across a space unless white space (or an end of the text) is on both sides of it
_ODD = r"(?:\A|[\s\v\x{1c}-\x{1f}\x{85}\pZ]) (?:[\s\v\x{1c}-\x{1f}\x{85}\pZ]|\z)"
_CUT = re.compile(r"(?<=\S) | (?=\S)")
_ENCODERS: dict[str, Callable] = {}


def _encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """What encodes segments by a tokenizer file, kept by the worker process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core belongs to each task already
        from tokenizers import Tokenizer

        from quern.llm._words import by_lead, joined

        tok = Tokenizer.from_file(path)
        vocabulary = tok.get_vocab()
        lead = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        # in a byte-level vocabulary only a space makes a token that begins with its mark
        lead[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        spaced = by_lead(tok, lead, " ")

        def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
            k = len(segments)  # the heads come last
            while k and segments[k - 1].startswith(HEAD):
                k -= 1
            flat, n = spaced(segments[:k])
            head, m = joined([e.ids for e in tok.encode_batch_fast([s[1:] for s in segments[k:]], add_special_tokens=False)])
            return np.concatenate([flat, head]), np.concatenate([n, m])

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def _pieces_fn(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm._words import Segments, slices, split

        known = Segments(_encoder(path))
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in it:
            for a, texts in slices(batch.column(1)):
                at, words, names = split(texts, _ODD, _CUT)
                first = at[:-1]
                inner = np.ones(len(words), bool)
                inner[first] = False
                used = np.flatnonzero(np.bincount(words[inner], minlength=len(names)))
                heads = np.unique(words[first])
                got = known.numbers([names[i] for i in used.tolist()] + [HEAD + names[i] for i in heads.tolist()])
                number, head = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                number[used], head[heads] = got[: len(used)], got[len(used) :]
                number = number[words]
                number[first] = head[words[first]]
                flat = known.ids(number)
                n = np.add.reduceat(known.columns[1][number], first)
                flat = np.insert(flat, np.cumsum(n), np.uint32(end_id))
                n += 1
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = (n - 1) % capacity + 1
                start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[row])
                lo = (np.cumsum(n) - n)[row] + start
                raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                begin = np.flatnonzero(np.r_[True, length[by][1:] != length[by][:-1]])
                times = np.diff(np.append(begin, len(by)))
                idx = np.empty(len(by), np.int64)
                idx[by] = np.arange(len(by)) - np.repeat(begin, times) + seen[length[by]]
                seen[length[by][begin]] += times
                out = [batch.column(0).take(pa.array(a + row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(idx), pa.array(np.full(len(row), part, np.int32))]
                names = ["id", "piece", "start", "length", "ids_crc32", "idx", "part"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(df: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokens of every text and an end id, cut to the capacity: one row for each piece.

    Columns: the id, piece, start, length, ids_crc32, idx and part (the place among
    equal lengths of its partition, once the table is staged), and with keep_ids the ids.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, idx long, part int" + (", ids array<int>" if keep_ids else "")
    return df.select(id_col, text_col).mapInArrow(_pieces_fn(tokenizer_path, capacity, end_id, keep_ids), schema).withColumnRenamed("id", id_col)


def pack(staged: DataFrame, **limits) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces (with length, part and idx)."""
    # the window sees one row for each partition and length, however many pieces have that length
    counts = stage(staged.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = plan(hist, **limits)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        s, o = locate(runs, length.to_numpy(np.int64), rank.to_numpy(np.int64)) if len(length) else ([], [])
        return pd.DataFrame({"sequence_id": s, "offset": o}, dtype="int64")

    # joined by a shuffle at every size: the table of offsets grows with partitions x lengths
    placed = staged.join(offsets.hint("merge"), ["part", "length"]).withColumn("__at", place(F.col("length"), F.col("idx") + F.col("before")))
    return placed.withColumns({"sequence_id": F.col("__at.sequence_id"), "offset": F.col("__at.offset")}).drop("__at", "before")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, **limits) -> DataFrame:
    """Tokenize, cut and pack: a row per piece with its sequence and offset, and its ids if wanted."""
    staged = stage(pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids))
    return pack(staged, tokens=capacity, **limits).drop("part", "idx")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
