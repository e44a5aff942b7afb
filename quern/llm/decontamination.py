"""Benchmark decontamination by a prefix-filtered set join.

Words are lower-cased; a window is ten consecutive words of a benchmark item, or a shorter
item whole. A window is the set of its shingles of five words (a window of fewer words is
one shingle), put in order of rarity: how often each occurs in all documents. A document
holds the window only if it holds every shingle, so the necessary prefix is the rarest one
alone, and a window with a shingle that no document has is out at once. Documents give up
the places of prefix shingles with the words around them; these are joined with the windows
on the shingle, bounded by position (the window must begin within the text) and by length
(and end within it), and the words are compared one by one: what counts is an exact
occurrence, whatever the hashes say.

Scale: documents are read twice and never shuffled. Both times a bitmap of the shingles
sought goes to all tasks; it has 32 bits a shingle and at most MOST_BITS, and where more
shingles than that bound allows are sought, only more places pass it that the join turns
away. Counts of shingles are combined in each task. What is shuffled are places of prefix
shingles: joins on a passage that many documents share can be split, as one side has but a
few windows for a shingle.

Edge cases: null texts have no words, and documents without words are not contaminated;
items without words are never found. Repeated documents are rows of their own, repeated
items count once, an item without an id marks words but is not listed. Without hits
items_sha256 is that of the empty string. A text is held whole in a task. Empty tables of
documents give an empty result; with an empty benchmark nothing is contaminated. Only the
id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import drop, stage
from quern.llm._hash import _BASE, _INVERSE, _VALUE, CHUNK, _powers, mix
from quern.llm._words import slices

WINDOW, SHINGLE = 10, 5
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29
HELD = 1 << 21  # counted shingles that a task holds before it passes them on
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_ODD = np.random.default_rng(20250611).integers(1, 1 << 63, (SHINGLE + 1, SHINGLE), dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of some texts: hashes, places in the lower-cased bytes, and how many words precede each text."""

    def __init__(self, texts: list[str]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.buffer = b"\n".join(raw).lower() + b"\n"
        buf = np.frombuffer(self.buffer, np.uint8)
        starts, ends, hashes, at = [], [], [], 0
        while at < len(buf):
            end = min(len(buf), at + CHUNK)
            while end < len(buf) and not _GAP[buf[end - 1]]:  # a chunk ends behind a gap
                back = np.flatnonzero(_GAP[buf[at:end]])
                end = at + int(back[-1]) + 1 if len(back) else min(len(buf), end + CHUNK)
            part = buf[at:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[part], [True]]).view(np.int8)))
            s, e = edge[::2], edge[1::2]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * _powers(_BASE, len(part)), out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _powers(_INVERSE, len(part))[s]))
            starts.append((s + at).astype(np.int32))
            ends.append((e + at).astype(np.int32))
            at = end
        self.start, self.end, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.bounds = np.searchsorted(self.start, np.cumsum([0] + [len(r) + 1 for r in raw]))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all runs of k words that lie in one text."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(len(self.hash) - k + 1, np.uint64)
        for i in range(k):
            total += self.hash[i : len(self.hash) - k + 1 + i] * _ODD[k, i]
        inside = np.ones(len(total) + k, bool)
        for i in range(1, k):  # runs that begin in the last words of a text
            last = self.bounds[1:] - i
            inside[last[last >= 0]] = False
        first = np.flatnonzero(inside[: len(total)])
        return first, mix(total[first]).view(np.int64)

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.buffer[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def _windows_fn(window: int, shingle: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ident, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                w = Words([text])
                n = len(w.hash)
                size = min(window, n)
                k = min(shingle, n)
                if not n:
                    continue
                names, (_, hashes) = [x.decode() for x in w.words(0, n)], w.shingles(k)
                for lo in range(0, n - size + 1, 5000):
                    at = range(lo, min(lo + 5000, n - size + 1))
                    cols = [pa.array([ident.as_py()] * len(at), ident.type), pa.array([" ".join(names[i : i + size]) for i in at], pa.string()), pa.array([size] * len(at), pa.int32())]
                    lists = pa.array([hashes[i : i + size - k + 1].tolist() for i in at], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([k] * len(at), pa.int32()), lists], ["item", "window", "n", "k", "shingles"])

    return run


def windows_of(items: DataFrame, id_col="item_id", text_col="text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, window (its words, joined by spaces), n (words), k (words of a shingle) and its shingles' hashes."""
    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(_windows_fn(window, shingle), f"item {kind}, window string, n int, k int, shingles array<long>")


def _bitmap(hashes: DataFrame, most: int) -> np.ndarray:
    """One bit for each value of `hash`, by its last bits; at most `most` bits, gathered as blocks of 4 kB."""
    bits, n = LEAST_BITS, hashes.count()
    while bits < 32 * n and bits < most:
        bits *= 2
    place = F.pmod(F.col("hash"), F.lit(bits))
    blocks = hashes.groupBy(F.floor(place / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        out[4096 * r["block"] : 4096 * (r["block"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passing(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _count_fn(lengths: list[int], shared, held: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, parts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal hashes, counts, waiting
            hashes, back = np.unique(np.concatenate([hashes, *(p[0] for p in parts)]), return_inverse=True)
            summed = np.zeros(len(hashes), np.int64)
            np.add.at(summed, back, np.concatenate([counts, *(p[1] for p in parts)]))
            counts = summed
            parts.clear()
            waiting = 0

        def out():
            for lo in range(0, len(hashes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[lo : lo + 50_000]), pa.array(counts[lo : lo + 50_000])], ["hash", "times"])

        for batch in it:
            for _, texts in slices(batch.column(0)):
                w = Words(texts.to_pylist())
                for k in lengths:
                    _, h = w.shingles(k)
                    parts.append(np.unique(h[_passing(shared.value, h)], return_counts=True))
                    waiting += len(parts[-1][0])
                if waiting > held:
                    merge()
                    if len(hashes) > held:
                        yield from out()
                        hashes, counts = hashes[:0], counts[:0]
        merge()
        yield from out()

    return run


def _places_fn(lengths: list[int], shared, window: int):
    """A row for each text (id, row, n_words) and one for each place of a prefix shingle (row, first word, hash, words before, words around)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 40, 0
        empty = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        names = ["id", "row", "n_words", "first", "hash", "before", "around"]
        for batch in it:
            for a, texts in slices(batch.column(1)):
                w = Words(texts.to_pylist())
                rows, n = part + seen + np.arange(len(texts)), np.diff(w.bounds)
                seen += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(rows), pa.array(n.astype(np.int64)), *(pa.nulls(len(texts), t) for t in empty)], names)
                for k in lengths:
                    first, h = w.shingles(k)
                    ok = _passing(shared.value, h)
                    first, h = first[ok], h[ok]
                    doc = np.searchsorted(w.bounds, first, side="right") - 1
                    lo, hi = np.maximum(first - (window - k), w.bounds[doc]), np.minimum(first + window, w.bounds[doc + 1])
                    for at in range(0, len(first), 5000):
                        s = slice(at, at + 5000)
                        around = [[x.decode("utf-8", "replace") for x in w.words(p, q)] for p, q in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
                        cols = [pa.array(rows[doc[s]]), pa.nulls(len(around), pa.int64()), pa.array(first[s] - w.bounds[doc[s]]), pa.array(h[s]), pa.array((first[s] - lo[s]).astype(np.int32)), pa.array(around, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(around), batch.column(0).type), *cols], names)

    return run


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The distinct windows that may occur, each with its rarest shingle (ties by hash, then place) and where in the window it begins."""
    one = windows.select("window", "n", "k", "shingles").dropDuplicates(["window"])
    each = one.select("window", "n", "k", F.posexplode("shingles").alias("place", "hash")).join(counts, "hash")
    best = each.groupBy("window", "n", "k").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("times", "hash", "place")).alias("least"))
    return best.where("found = n - k + 1").select("window", "n", "least.hash", "least.place")


def find(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = WINDOW, shingle: int = SHINGLE, most_bits: int = MOST_BITS, held: int = HELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, row, n_words of every document; occurrences: row, first word, n, window; owners: window, item), all from staged tables.

    `row` numbers the rows of docs, whose ids need not be unique.
    """
    if not 0 < shingle <= SHINGLE or window < shingle:
        raise ValueError(f"a shingle has 1 to {SHINGLE} words, and a window no fewer")
    spark, text = docs.sparkSession, docs.select(text_col)
    windows = stage(windows_of(items, item_id, item_text, window, shingle))
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # 5 at most
    sought = stage(windows.select(F.explode("shingles").alias("hash")).distinct())
    seen = spark.sparkContext.broadcast(_bitmap(sought, most_bits))
    counts = text.mapInArrow(_count_fn(lengths, seen, held), "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))
    prefixes = stage(_prefixes(windows, counts))
    drop(sought)
    wanted = spark.sparkContext.broadcast(_bitmap(prefixes.select("hash").distinct(), most_bits))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, n_words long, first long, hash long, before int, around array<string>"
    places = stage(docs.select(id_col, text_col).mapInArrow(_places_fn(lengths, wanted, window), schema))
    texts = places.where("n_words IS NOT NULL").select("id", "row", "n_words")
    c = places.where("hash IS NOT NULL").select("row", "first", "hash", "before", "around").join(prefixes, "hash")
    begins = F.col("before") - F.col("place") + 1
    bounds = (begins >= 1) & (begins + F.col("n") - 1 <= F.size("around"))
    exact = F.when(bounds, F.array_join(F.slice("around", begins, F.col("n")), " ") == F.col("window"))
    found = c.where(exact).select("row", (F.col("first") - F.col("place")).alias("first"), "n", "window")
    return texts, found, windows.select("window", "item").distinct()


def _sha(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    texts, found, owners = find(docs, items, **options)
    found = stage(found)
    behind = F.col("first") + F.col("n")
    earlier = F.max(behind).over(Window.partitionBy("row").orderBy("first", "n", "window").rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.select("row", F.greatest(F.lit(0), behind - F.greatest(F.col("first"), F.coalesce(earlier, F.lit(0)))).alias("fresh"))
    words = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    listed = found.select("row", "window").distinct().join(owners, "window").select("row", F.col("item").cast("string").alias("item")).distinct()
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    hit = words.join(listed, "row", "left")
    out = texts.join(hit, "row", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("id", "n_words", n(F.col("n_hit")).alias("n_hit"), n(F.size(ids)).alias("n_items"), _sha(ids).alias("items_sha256"), (n(F.col("n_hit")) > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, items).withColumnRenamed("id", "doc_id")
