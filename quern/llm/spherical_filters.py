"""Embedding near-duplicates by spherical-cap filters.

Filters are directions of a structured random product code: the space is rotated at
random and cut into two halves, each half has a codebook of random unit vectors, and a
filter is a pair of codewords; there are CODES such codes. A vector is in every filter whose inner product with it
exceeds a threshold; list decoding finds all of them from the two short lists of
codeword products, sorted, without visiting the others. Codebooks and threshold follow from the number of vectors: a filter
holds about BUCKET of them and a vector is in about FILTERS filters of a code, so work grows with the vectors.
Vectors that share a filter are joined on it: first their sign codes, of BITS random
directions, leave out the sets without a likely pair; what is left is verified in double precision.

Results: one row per vector: id, n_links, component_id, kept. Equal vectors are
compared once, by weight, so groups of copies cost nothing.

Edge cases: null vectors, zero vectors and vectors with null or non-finite components
link with nothing (n_links 0, own component). Vectors are compared with those of their
own length. A null id takes no part (component_id null, kept). Rows that repeat an id
count as rows of their own. An empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import drop, stage
from quern.llm._links import BLOCK, classes, compare

CODES = 6  # many codes of few filters each: the filters of one code overlap more than those of several
FILTERS, BUCKET = 4, 128
BITS = 128


def codebook(vectors: int, dims: int, filters: int = FILTERS, bucket: int = BUCKET) -> tuple[int, float]:
    """(codewords of a half, threshold): a random unit vector exceeds about `filters` of the pairs, and a pair has `bucket` vectors."""
    share = min(0.05, bucket / max(vectors, 1))
    x = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - x * x) ** ((max(dims, 2) - 3) / 2)  # of a coordinate of a random unit vector
    tail = np.cumsum(density[::-1])[::-1]
    return math.ceil(math.sqrt(filters / share)), float(x[np.searchsorted(-tail / tail[0], -share)])


class ProductCode:
    def __init__(self, dims: int, words: int, cap: float, seed: int = 3):
        r = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(r.standard_normal((dims, dims)))[0]
        half = dims // 2
        books = [r.standard_normal((words, d)) for d in (half, dims - half)]
        # with one half empty (a single dimension) its codebook is a zero, and the other decides
        self.books = [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) * np.sqrt(0.5) for b in books]
        self.half, self.words, self.cap = half, words, cap

    def decode(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all filters that unit vectors exceed, by vector; the best one of each at least."""
        Y, rows = X @ self.rotation, np.arange(len(X))[:, None]
        A, B = Y[:, : self.half] @ self.books[0].T, Y[:, self.half :] @ self.books[1].T
        oa, ob = np.argsort(-A, axis=1), np.argsort(-B, axis=1)
        a, b = np.take_along_axis(A, oa, 1), np.take_along_axis(B, ob, 1)
        # of the second list, those that reach the cap with each of the first; vectors lie 4 apart, so one search does for all
        n = np.searchsorted((4 * rows - b).ravel(), (4 * rows + np.clip(a - self.cap, -1.5, 1.5)).ravel(), side="left").reshape(a.shape) - rows * self.words
        n = np.clip(n, 0, self.words)
        n[:, 0] = np.maximum(n[:, 0], 1)
        one, first = np.nonzero(n)
        times = n[one, first]
        second = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        one, first = np.repeat(one, times), np.repeat(first, times)
        return one, oa[one, first] * self.words + ob[one, second]


def signs(dims: int, bits: int = BITS, seed: int = 17) -> np.ndarray:
    """Random directions, orthogonal as far as there are dimensions."""
    r = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(r.standard_normal((dims, dims)))[0] for _ in range(-(-bits // dims))], axis=1)[:, :bits]


def likely(threshold: float, bits: int = BITS):
    """Pairs whose sign codes differ no more than those of a pair at the threshold, by 4.5 standard deviations."""
    f = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    most = math.floor(bits * f + 4.5 * math.sqrt(bits * f * (1 - f)))

    def similar(codes, split):
        X = np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(len(codes), -1)
        a, b = (slice(None),) * 2 if split is None else (slice(0, split), slice(split, None))
        n = np.zeros((len(X[a]), len(X[b])), np.uint16)
        for k in range(X.shape[1]):
            n += np.bitwise_count(X[a, k][:, None] ^ X[b, k][None, :])
        return n <= most

    return similar


def _unit(X: np.ndarray) -> np.ndarray:
    X = X / np.abs(X).max(1, keepdims=True)  # no overflow in the norm
    return X / np.linalg.norm(X, axis=1, keepdims=True)


def valid_vector(col: str) -> Column:
    """True for a vector without null or non-finite components that is not zero."""
    x = F.col(col).cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _marks_fn(books: dict[int, tuple[int, float]]):
    """(key, filters, sign code) of (key, vector)."""

    def run(it):
        codes: dict[int, tuple] = {}
        for batch in (b.slice(i, 2048) for b in it for i in range(0, b.num_rows, 2048)):
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                if dims not in codes:
                    words, cap = books[dims]
                    codes[dims] = [ProductCode(dims, words, cap, seed) for seed in range(CODES)], signs(dims)
                book, R = codes[dims]
                at = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(at)) if len(at) < len(sizes) else batch
                X = _unit(part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dims))
                # filters of other lengths and codes are others
                each = [(one, f + (dims << 44 | k << 40)) for k, (one, f) in enumerate(c.decode(X) for c in book)]
                one, flat = (np.concatenate(x) for x in zip(*each, strict=True))
                order = np.argsort(one, kind="stable")
                ends = np.searchsorted(one[order], np.arange(len(X) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order], pa.int64()))
                sign = np.packbits(X @ R > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([x.tobytes() for x in sign], pa.binary())], ["key", "leaves", "sign"])

    return run


def near_duplicates(df: DataFrame, id_col="vec_id", vec_col="embedding", threshold: float = 0.95, filters: int = FILTERS, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Components of the vectors whose cosine reaches the threshold."""
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    base = base.withColumn("key", F.when(valid_vector("v") & F.col("id").isNotNull(), F.xxhash64(F.col("v").cast("array<double>"))))
    rows = stage(base.select("id", "key"))
    good = base.where("key is not null")
    reps = stage(good.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    lengths = {r[0]: r[1] for r in reps.groupBy(F.size("v").alias("d")).count().collect()}
    books = {d: codebook(n, d, filters, bucket) for d, n in lengths.items()}
    marks = stage(reps.select("key", "v").mapInArrow(_marks_fn(books), "key long, leaves array<long>, sign binary"))
    every = marks.select(F.explode("leaves").alias("leaf"), "key")
    close = compare(every, marks.select("key", F.col("sign").alias("payload")), likely(threshold), count=False, first=False, block=block)
    members = stage(close.select("leaf", "key").distinct())
    drop(marks, close)

    def similar(vectors, split):
        dims = len(vectors[0])  # those of a filter are of one length
        X = vectors.flatten().to_numpy().astype(np.float64).reshape(-1, dims)
        X = X / np.abs(X).max(1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", X, X))
        a, b = (slice(None),) * 2 if split is None else (slice(0, split), slice(split, None))
        return (X[a] @ X[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold

    found = compare(members, reps.select("key", F.col("v").alias("payload"), "weight"), similar, block=block)
    drop(members)
    out = classes(rows, reps.select("key", "weight"), found)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("label").alias("component_id"), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
