"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles. Texts with the same words are one set with
a weight. Every set gets SKETCH min-wise values, each a token of the set sampled alike
for all sets: two sets share a value with the probability of their similarity. A run
splits all sets on one sampled value into buckets; a bucket above LIMIT is split again
on another value, each split sampling 1 / threshold values on average, so a pair at the
threshold stays together about once a level however deep the recursion. Small buckets,
and whatever is still large at the last level, are compared by brute force: first the
sketches, to leave out sets without a likely partner, then the full sets of shingles.
Runs are repeated until the target recall.

Result: one row per document: id, class_id (smallest id that links reach), n_links
(documents linked directly, copies included), kept (id = class_id).

Edge cases: null and blank texts have no shingle and link with nothing. A text of fewer
than five words is one shingle. Words are split at ASCII white space, A-Z in lower case.
A null id takes no part (class_id null, kept). Rows that repeat an id and text count as
documents of their own but are one class. Texts are read whole. Only the id and text
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import drop, stage
from quern.llm._links import BLOCK, classes, compare

SKETCH = 32
LIMIT = 128
LEAST_LEVELS = 3
TARGET_RECALL = 0.999
_A = np.random.default_rng(99).integers(1, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(98).integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def levels_for(sets: int) -> int:
    """Levels that split what a tenth of their tokens holds together, a tenth a level, until buckets are small."""
    return max(LEAST_LEVELS, math.ceil(math.log10(max(sets, 1))) - 3)


def runs_needed(threshold: float, levels: int = LEAST_LEVELS, target: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold has met with the target probability.

    A level samples one value, and a second one with probability 1 / threshold - 1.
    """
    p, extra = 1.0, 1 / threshold - 1
    for _ in range(levels):
        q = threshold * p  # one sampled value keeps the pair together to the end
        p = 1 - (1 - q) * (1 - extra * q)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - p)))


def _sketch_fn(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm._hash import shingles, text_key, word_hashes
        from quern.llm._words import batches

        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts := [t or "" for t in texts]):
                words, at = word_hashes(texts[a:b])
                sets = [shingles(words[i:j], n) for i, j in zip(at, at[1:], strict=False)]
                some = np.array([len(s) > 0 for s in sets])
                keys = [text_key(words[i:j]) if j > i else None for i, j in zip(at, at[1:], strict=False)]
                flat = np.concatenate([s for s in sets if len(s)] or [np.zeros(0, np.uint64)])
                out = np.zeros((len(sets), SKETCH), np.int32)
                if len(flat):
                    starts = np.cumsum([0] + [len(s) for s in sets if len(s)])[:-1]
                    for k in range(SKETCH):
                        v = (flat ^ _B[k]) * _A[k]
                        v >>= np.uint64(32)
                        out[some, k] = np.minimum.reduceat(v.astype(np.uint32), starts).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SKETCH, pa.int32()), pa.array(out.ravel()))
                size = pa.array([8 * len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), lists, size], ["id", "key", "sketch", "bytes"])

    return run


def _sets_fn(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm._hash import shingles, text_key, word_hashes
        from quern.llm._words import batches

        for batch in it:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in batches(texts, 1_000_000):
                words, at = word_hashes(texts[a:b])
                spans = [(i, j) for i, j in zip(at, at[1:], strict=False) if j > i]
                sets = [shingles(words[i:j], n) for i, j in spans]
                flat = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0] + [len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([text_key(words[i:j]) for i, j in spans], pa.int64()), lists], ["key", "payload"])

    return run


def likely(threshold: float):
    """Pairs whose sketches agree as often as a pair at the threshold does, less 4.3 standard deviations."""
    least = math.floor(SKETCH * threshold - 4.3 * math.sqrt(SKETCH * threshold * (1 - threshold)))

    def similar(sketches, split):
        X = np.ascontiguousarray(sketches.flatten().to_numpy().reshape(-1, SKETCH).T)
        a, b = (slice(None),) * 2 if split is None else (slice(0, split), slice(split, None))
        n = np.zeros((X[0, a].size, X[0, b].size), np.uint8)
        for row in X:
            n += row[a][:, None] == row[b][None, :]
        return n >= least

    return similar


def jaccard(threshold: float, columns: int = 4096):
    """Pairs of sets whose exact Jaccard similarity reaches the threshold."""

    def similar(sets, split):
        flat, ends = sets.flatten().to_numpy(), sets.offsets.to_numpy()
        size = np.diff(ends).astype(np.float64)
        n = len(size)
        a, b = (slice(None),) * 2 if split is None else (slice(0, split), slice(split, None))
        names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), np.diff(ends))
        shared = times > 1  # an element of one set alone adds to no intersection
        at, owner = (np.cumsum(shared) - 1)[at][shared[at]], owner[shared[at]]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both = np.zeros((size[a].size, size[b].size), np.float32)
        for lo in range(0, int(shared.sum()), columns):
            i, j = np.searchsorted(at, (lo, lo + columns))
            M = np.zeros((n, min(columns, int(shared.sum()) - lo)), np.float32)
            M[owner[i:j], at[i:j] - lo] = 1
            both += M[a] @ M[b].T
        return both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9

    return similar


def buckets(reps: DataFrame, threshold: float, limit: int = LIMIT, levels: int = LEAST_LEVELS, target: float = TARGET_RECALL) -> DataFrame:
    """Staged (leaf, key): the buckets in which the chosen paths of all runs end; reps is (key, sketch)."""
    runs = runs_needed(threshold, levels, target)
    extra = 1 / threshold - 1
    root = [(r, r % SKETCH) for r in range(runs)]
    root += [(r, (runs + r) % SKETCH) for r in range(runs) if int((r + 1) * extra) > int(r * extra)]
    at = [F.struct(F.xxhash64(F.lit(r), F.lit(p), F.col("sketch")[p]).alias("leaf"), F.lit(p).alias("pos")) for r, p in root]
    rows = stage(reps.select("key", F.explode(F.array(*at)).alias("x")).select("x.leaf", "key", "x.pos"))
    ends = []
    for level in range(levels):
        sizes = stage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        large = stage(rows.join(sizes.where(F.col("n") > limit).select("leaf"), "leaf")) if level < levels - 1 else None
        if large is None or large.isEmpty():
            ends.append(rows.join(sizes.select("leaf"), "leaf").select("leaf", "key"))
            break
        ends.append(rows.join(sizes.where(F.col("n") <= limit).select("leaf"), "leaf").select("leaf", "key"))
        other = lambda seed: F.pmod(F.col("pos") + 1 + F.pmod(F.xxhash64("leaf", F.lit(seed)), F.lit(SKETCH - 1)), F.lit(SKETCH)).cast("int")
        step = lambda p, seed: F.struct(F.xxhash64("leaf", F.lit(seed), p, F.element_at("sketch", p + 1)).alias("leaf"), p.alias("pos"))
        second = F.pmod(F.xxhash64("leaf", F.lit(2)), F.lit(1000)) < F.lit(int(1000 * extra))
        both = F.when(second & (other(3) != other(1)), F.array(step(other(1), 1), step(other(3), 3))).otherwise(F.array(step(other(1), 1)))
        rows = stage(large.join(reps.select("key", "sketch"), "key").select("key", F.explode(both).alias("x")).select("x.leaf", "key", "x.pos"))
    out = ends[0]
    for e in ends[1:]:
        out = out.unionAll(e)
    return stage(out)


def _classified(df: DataFrame, id_col="doc_id", text_col="text", threshold: float = 0.8, words: int = 5, limit: int = LIMIT, levels: int | None = None, target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = docs.mapInArrow(_sketch_fn(words), f"id {kind}, key long, sketch array<int>, bytes long")
    base = stage(base.withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))))
    reps = base.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"), F.first("sketch").alias("sketch"), F.first("bytes").alias("bytes"))
    reps = stage(reps)
    ends = buckets(reps, threshold, limit, levels or levels_for(reps.count()), target)
    close = compare(ends, reps.select("key", "weight", F.col("sketch").alias("payload")), likely(threshold), count=False, block=block)
    drop(ends)
    members = stage(close.select("leaf", "key").distinct())  # each pair of blocks of a large bucket names its keys anew
    wanted = reps.join(members.select("key").distinct(), "key", "left_semi").select(F.col("first").alias("id"))
    # texts are dealt by id at every size: a plan that broadcasts small id lists would change with the input
    sets = docs.join(wanted.distinct().hint("merge"), "id", "left_semi").select("text").mapInArrow(_sets_fn(words), "key long, payload array<long>")
    sets = sets.groupBy("key").agg(F.first("payload").alias("payload"))
    found = compare(members, sets.join(reps.select("key", "weight", "bytes"), "key"), jaccard(threshold), block=block)
    drop(close, members)
    return classes(base.select("id", "key"), reps.select("key", "weight"), found)


def join(df: DataFrame, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """Classes of documents whose shingle sets reach the Jaccard threshold (settings: threshold, words, limit, levels, target, block)."""
    return _classified(df, id_col, text_col, **settings).select(F.col("id").alias(id_col), "n_links", F.col("label").alias("class_id"), "kept")


def _keys_fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, key) of (row, id, text)."""
    from quern.llm._hash import text_key, word_hashes
    from quern.llm._words import batches

    for batch in it:
        texts, keys = [t or "" for t in batch.column(2).to_pylist()], []
        for a, b in batches(texts):
            words, at = word_hashes(texts[a:b])
            keys += [text_key(words[i:j]) if j > i else None for i, j in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["row", "id", "key"])


def keep_one(df: DataFrame, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """The rows of df without the near copies: of each class the document with the smallest id stays.

    Rows with null ids or without words stay. Of rows that repeat an id, each is judged by
    its own text: another text is another document, and of equal ones the smallest row stays.
    """
    all_rows = stage(_classified(df, id_col, text_col, **settings))
    named = all_rows.where("id is not null")
    again = stage(named.groupBy("id").count().where("count > 1").select("id"))
    kept = named.where("kept and stands").select("id").distinct()
    here_id = F.col(f"`{id_col}`")
    here = lambda ids: here_id == ids["id"]
    out = df.join(kept.hint("merge"), here(kept), "left_semi")
    if again.isEmpty():
        return out.unionByName(df.where(here_id.isNull()))
    out = out.join(again.hint("merge"), here(again), "left_anti")
    rest = df.join(again.hint("merge"), here(again), "left_semi")
    whole = rest.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), here_id.alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = T.StructType([*whole.drop("text").schema.fields, T.StructField("key", T.LongType())])
    rest = whole.mapInArrow(_keys_fn, kinds)
    stays = named.where("kept and stands and key is not null").select("id", "key").distinct()
    alone = rest.where("key is null")
    # map-side, as one text may be most of the rows
    first = rest.where("key is not null").join(stays.hint("merge"), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(alone.select("row.*")).unionByName(first.select("row.*")).unionByName(df.where(here_id.isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
