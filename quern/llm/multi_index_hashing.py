"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred and rotated; the rotation is learned by alternating between
the signs and the best rotation onto them (iterative quantisation), once for every 64
bits, on a bounded sample. A code of BITS bits is cut into substrings of 16 bits, and
each substring has a table from its values to the rows of an index shard. For a radius
r = m s + a over m substrings, any code within r agrees with the query to within s bits
on one of the first a + 1 substrings or to within s - 1 on another; probing all those
values therefore retrieves every code within the radius. These are reranked by exact
Euclidean distance in double precision. The radius is the one within which `target` of
the true neighbours of PROBES drawn vectors lie, found among all rows.

Every row is indexed once, in shards of at most about SHARD rows that one task each
holds; the stated queries pass by every shard. Queries with fewer than k codes within
the radius are ranked against all rows, so a query gets k neighbours wherever there are
k candidates.

Edge cases: vectors that are null, zero or with null or non-finite components take no
part, as query or candidate; neither do null ids. Vectors are searched among those of
their own length. A query's own row is no candidate, other rows with its id are. Ties
go to the smaller id. Fewer candidates than k: all are given. An empty table gives an
empty result. Only id and vector are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import stage, unit_hash
from quern.llm.spherical_filters import valid_vector

BITS, SUB = 128, 16
SHARD, LEAST_SHARD = 262_144, 4096
SAMPLE, PROBES = 6000, 256
TARGET = 0.975


class BinaryCode:
    def __init__(self, X: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 5):
        r, d = np.random.default_rng(seed), X.shape[1]
        self.mean, self.rotations = X.mean(0), []
        Y = X - self.mean
        for lo in range(0, bits, d):
            n = min(d, bits - lo)
            R = np.linalg.qr(r.standard_normal((d, d)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(Y @ R).T @ Y)
                R = (u @ vt).T
            self.rotations.append(R[:, :n])
        self.R = np.concatenate(self.rotations, axis=1)

    def encode(self, X: np.ndarray) -> np.ndarray:
        """(rows, bits / 16) of unsigned 16-bit substrings."""
        return np.packbits((X - self.mean) @ self.R > 0, axis=1, bitorder="little").view("<u2")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _masks() -> list[np.ndarray]:
    """All 16-bit masks with at most s bits, for s = 0, 1, ..."""
    out, level = [], [0]
    for s in range(SUB + 1):
        if s:
            level = level + [sum(1 << b for b in c) for c in combinations(range(SUB), s)]
        out.append(np.array(level, np.uint16))
    return out


MASKS = _masks()


class Index:
    """Substring tables of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for sub in codes.T:
            order = np.argsort(sub, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(sub, minlength=1 << SUB))])))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of the query's, all of them, by probing."""
        m = len(self.tables)
        s, a = divmod(min(radius, m * SUB), m)
        hit = np.zeros(len(self.codes), bool)
        for i, (order, start) in enumerate(self.tables):
            reach = s if i <= a else s - 1
            if reach < 0:
                continue
            probe = MASKS[min(reach, SUB)] ^ query[i]
            lo = start[probe]
            n = start[probe.astype(np.int64) + 1] - lo
            some = n > 0
            lo, n = lo[some], n[some]
            hit[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], query) <= radius]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dims)


def _probes_fn(code: BinaryCode, P: np.ndarray, own: np.ndarray, k: int):
    """(probe, distance, Hamming distance) of the k nearest of each batch of (row, vector)."""
    asked = code.encode(P)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            rows, X = batch.column(0).to_numpy(), _matrix(batch.column(1), P.shape[1])
            codes, out = code.encode(X), []
            for i, p in enumerate(P):
                d = ((X - p) ** 2).sum(1)
                d[rows == own[i]] = np.inf
                near = np.argpartition(d, min(k, len(d) - 1))[:k]
                near = near[np.isfinite(d[near])]
                out.append((np.full(len(near), i), d[near], hamming(codes[near], asked[i])))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int32())], ["probe", "d", "bits"])

    return run


def radius_of(rows: DataFrame, code: BinaryCode, P: np.ndarray, own: np.ndarray, k: int, target: float) -> int:
    """The Hamming radius that holds `target` of the k nearest rows of the probes P."""
    near = rows.select("row", "v").mapInArrow(_probes_fn(code, P, own, k), "probe int, d double, bits int")
    w = Window.partitionBy("probe").orderBy("d")
    bits = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("bits").toPandas()["bits"]  # PROBES x k rows at most
    return int(np.ceil(np.quantile(bits, target))) if len(bits) else BITS


def _nearest_fn(code: BinaryCode, radius: int | None, k: int, dims: int):
    """The k nearest rows of each query in a shard: its rows come first, then the queries."""

    def run(it):
        now, held, index = None, [], None
        for batch in it:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])]) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    now, held, index = shards[a], [], None
                if not asks[a]:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(-1, dims)))
                elif held:
                    if index is None:
                        rows, ids, V = (np.concatenate(x) for x in zip(*held, strict=True))
                        codes = np.concatenate([code.encode(V[i : i + 8192].astype(np.float64)) for i in range(0, len(V), 8192)])
                        index = Index(codes)
                    yield answer(part, rows, ids, V, index)

    def answer(part, rows, ids, V, index):
        cols: list[list] = [[], [], [], [], []]
        Q = _matrix(part.column(4), dims)
        for q, c, row, name in zip(Q, code.encode(Q), part.column(2).to_numpy(), part.column(3).to_numpy(), strict=True):
            at = np.arange(len(rows)) if radius is None else index.within(c, radius)
            at = at[rows[at] != row]
            d = np.concatenate([((V[i].astype(np.float64) - q) ** 2).sum(1) for i in np.array_split(at, len(at) // 8192 + 1)])
            d = np.sqrt(d)
            best = np.lexsort((rows[at], ids[at], d))[:k]
            for col, x in zip(cols, (np.full(len(best), row), np.full(len(best), name), rows[at[best]], ids[at[best]], d[best]), strict=True):
                col.append(x)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, kinds, strict=True)], ["asked", "query_id", "row", "vec_id", "score"])

    return run


def _search(base: DataFrame, count: int, dims: int, is_query, k: int, sample: int, target: float, bits: int) -> DataFrame:
    """(asked, query_id, row, vec_id, score) among vectors of one length."""
    rows = base.where(F.size("v") == dims)
    drawn = rows.where(unit_hash(F.col("row")) < F.lit(1.1 * sample / count)).select("row", "v").limit(sample).toPandas()
    if not len(drawn):
        drawn = rows.select("row", "v").limit(sample).toPandas()
    X = np.stack(drawn["v"]).astype(np.float64)
    code = BinaryCode(X, bits)
    radius = radius_of(rows, code, X[:PROBES], drawn["row"].to_numpy()[:PROBES], k, target)
    cores = base.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-count // SHARD), min(cores, -(-count // LEAST_SHARD)))
    here = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    index = rows.select(here.alias("shard"), F.lit(False).alias("ask"), "row", "id", "v")

    def pass_by(asked: DataFrame, radius: int | None) -> DataFrame:
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "row", "id", "v")
        dealt = index.unionAll(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "ask")
        return stage(dealt.mapInArrow(_nearest_fn(code, radius, k, dims), "asked long, query_id long, row long, vec_id long, score double"))

    queries = rows.where(is_query(F.col("id")))
    found = pass_by(queries, radius)
    enough = found.groupBy("asked").count().where(F.col("count") >= k).select(F.col("asked").alias("row"))
    short = stage(queries.join(enough.hint("merge"), "row", "left_anti"))
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("row").alias("asked")).hint("merge"), "asked", "left_anti").unionByName(pass_by(short, None))


def search(df: DataFrame, is_query, k: int = 10, id_col="vec_id", vec_col="embedding", sample: int = SAMPLE, target: float = TARGET, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where is_query holds."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    base = stage(base.where(F.col("id").isNotNull() & valid_vector("v")).withColumn("row", F.monotonically_increasing_id()))
    found = None
    for r in base.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # a search for each length of vectors
        part = _search(base, r["count"], r["d"], is_query, k, sample, target, bits)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("asked").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
