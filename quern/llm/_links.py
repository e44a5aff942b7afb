"""Counting links inside overlapping buckets, and components of the links.

Rows (bucket, key) say which buckets a key is in. Two keys are compared in every
bucket that both are in, but a link counts only in the first of these (the smallest
bucket number), so no pair is counted twice and none has to be written down. A bucket
larger than BLOCK, or whose payloads exceed BLOCK_BYTES, is cut into blocks, and each pair of blocks is a unit of its own:
any bucket is compared in whole, and no unit holds more than two blocks. Up to SPREAD blocks are
of BLOCK keys, so that a middling bucket spreads; in larger ones, where every key goes to as many units as there
are blocks, they grow to four times that. A unit gives
at most one row per key: the number of links, and one neighbour in a tree that joins
all keys its links connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import drop, stage

BLOCK, SPREAD, BLOCK_BYTES = 256, 16, 16 << 20


def forest(linked: np.ndarray) -> np.ndarray:
    """Component numbers (its smallest member) of a symmetric boolean matrix."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            label[i] = i
            while front.any():
                near = linked[front].any(0) & (label < 0)
                label[near] = i
                front = near
    return label


def _units_fn(similar: Callable, count: bool):
    def work(t: pa.Table):
        keys = t.column("key").to_numpy()
        side = t.column("side").to_numpy()
        leaf = t.column("leaf")[0].as_py()
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        order = np.argsort(side, kind="stable") if two else np.arange(len(keys))
        na = int((side == 0).sum()) if two else len(keys)
        if two and na in (0, len(keys)) or len(keys) < 2:
            return None
        t, keys = t.take(pa.array(order)), keys[order]
        rows, cols = (slice(0, na), slice(na, None)) if two else (slice(None), slice(None))
        ok = similar(t.column("payload").combine_chunks(), na if two else None)  # boolean, rows x columns
        if not two:
            np.fill_diagonal(ok, False)
        if not ok.any():
            return None
        new = ok
        if "leaves" in t.column_names:  # pairs that share a smaller bucket were compared there
            lists = t.column("leaves").combine_chunks()
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
            earlier = flat < leaf
            names, at, n = np.unique(flat[earlier], return_inverse=True, return_counts=True)
            if (n > 1).any():
                M = np.zeros((len(keys), len(names)), np.float32)
                M[owner[earlier], at] = 1
                M = M[:, n > 1]
                new = ok & ((M[rows] @ M[cols].T) == 0)
        if not new.any():
            return None
        if not count:
            got = np.concatenate([new.any(1), new.any(0)]) if two else new.any(1)
            return keys[got], np.zeros(int(got.sum()), np.int64), keys[got]
        w = t.column("weight").to_numpy().astype(float)
        n = np.concatenate([new @ w[cols], new.T @ w[rows]]) if two else new @ w
        if two:
            full = np.zeros((len(keys), len(keys)), bool)
            full[rows, cols] = new
            full[cols, rows] = new.T
        else:
            full = new
        label = forest(full)
        peer = keys.copy()
        by = np.argsort(label, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(label[by])) + 1]
        first = np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        place = np.arange(len(by)) - first
        peer[by] = keys[by[first + np.maximum(place - 1, 0) // 2]]  # a binary tree: no key gets more than three edges from a unit
        got = np.rint(n).astype(np.int64)
        some = (got > 0) | (peer != keys)
        return keys[some], got[some], peer[some]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        out: list[tuple] = []

        def flush(t: pa.Table):
            if (r := work(t)) is not None:
                leaf = np.full(len(r[0]), t.column("leaf")[0].as_py())
                out.append((leaf, *r))

        def emit():
            cols = [pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["leaf", "key", "links", "peer"])

        for batch in it:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            unit = np.stack([t.column(c).to_numpy() for c in ("leaf", "i", "j")])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = t.slice(a, b - a)
                if held and tuple(held[-1].column(c)[0].as_py() for c in ("leaf", "i", "j")) != tuple(unit[:, a].tolist()):
                    flush(pa.concat_tables(held).combine_chunks())
                    held.clear()
                held.append(part)
            if len(out) > 500:
                yield emit()
        if held:
            flush(pa.concat_tables(held).combine_chunks())
        if out:
            yield emit()

    return run


def compare(members: DataFrame, payloads: DataFrame, similar: Callable, count: bool = True, first: bool = True, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(leaf, key, links, peer) from members (leaf, key; distinct) and payloads (key, payload, weight, and bytes if they differ).

    members must be staged. similar(payloads, split), with an Arrow array of payloads, gives the boolean matrix of the
    first `split` payloads against the others, or of all against all. With count the
    links are summed by weight; without, it only says which (leaf, key) have a link, and unless `first` holds
    in every bucket of the pair: lists of buckets, which may outweigh the payloads, do not travel then.
    """
    size = [F.count(F.lit(1)).alias("n")]
    with_size = members
    if "bytes" in payloads.columns:
        with_size = members.join(payloads.select("key", "bytes").hint("merge"), "key")
        size.append(F.sum("bytes").alias("bytes"))
    sizes = with_size.groupBy("leaf").agg(*size).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / F.lit(4.0 * block)), F.least(F.ceil(F.col("n") / F.lit(float(block))), F.lit(SPREAD)))
    if "bytes" in payloads.columns:
        parts = F.greatest(parts, F.ceil(F.col("bytes") / F.lit(float(block_bytes))))
    sizes = stage(sizes.select("leaf", F.least(parts, F.col("n")).cast("int").alias("nb")))
    placed = stage(members.join(sizes, "leaf"))
    own = payloads.select("key", "payload", "weight") if count else payloads.select("key", "payload")
    if count or first:
        lists = placed.groupBy("key").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # as many as a key has buckets, a constant
        own = own.join(lists, "key")
    mine = F.pmod(F.xxhash64("key", "leaf"), F.col("nb")).cast("int")
    units = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j"), (F.col("b") > o).cast("byte").alias("side")),
    )
    # the units of a bucket go to one partition after another, so those of a large one do not meet
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.pmod(F.xxhash64("leaf") % F.lit(1 << 40) + F.col("u.i").cast("long") * F.col("nb") + F.col("u.j"), F.lit(tasks)).cast("int")
    rows = placed.withColumn("b", mine).select("leaf", "key", "nb", F.explode(units).alias("u")).select("leaf", "key", "u.i", "u.j", "u.side", to.alias("to"))
    rows = rows.join(own, "key").repartitionById(tasks, "to").drop("to").sortWithinPartitions("leaf", "i", "j")
    out = stage(rows.mapInArrow(_units_fn(similar, count), "leaf long, key long, links long, peer long"))
    drop(sizes, placed)
    return out


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, label): for every key of the edges (key, peer) the smallest key it reaches.

    Each round hooks every key to its smallest neighbour, shortens the chains by
    pointer jumping and contracts the edges; the number of keys left falls at least by
    half. Nothing is collected but the number of edges.
    """
    live = stage(edges.where("key <> peer").select("key", "peer").distinct())
    labels = None
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.select("key", "peer").unionAll(live.select(F.col("peer").alias("key"), F.col("key").alias("peer")))
        up = stage(both.groupBy("key").agg(F.min("peer").alias("m")).select("key", F.least("key", "m").alias("up")))
        for _ in range(3):
            higher = stage(up.join(up.select(F.col("key").alias("up"), F.col("up").alias("top")), "up").select("key", F.col("top").alias("up")))
            drop(up)
            up = higher
        if labels is None:
            labels, before = up.select("key", F.col("up").alias("label")), None
        else:
            before = labels
            labels = stage(before.join(up.select(F.col("key").alias("label"), "up"), "label", "left").select("key", F.coalesce("up", "label").alias("label")))
        a = live.join(up, "key").select(F.col("up").alias("key"), "peer")
        b = stage(a).join(up.select(F.col("key").alias("peer"), "up"), "peer").select("key", F.col("up").alias("peer"))
        nxt = stage(b.where("key <> peer").distinct())
        drop(live)
        live = nxt
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select("key", F.col("peer").alias("label")).where(F.lit(False))
    # a label is the smallest key of its component: hooks and jumps only ever go down, and the last round leaves one root
    return labels


def classes(rows: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of `rows` (id, key): id, key, n_links, the smallest id of its component, kept, and whether its key stands for the component.

    A component is stood for by the smallest key among those that its smallest id has.
    """
    sums = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(found.select("key", "peer"))
    first = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    rep = reps.join(sums, "key", "left").join(comp, "key", "left").join(first, "key")
    rep = stage(rep.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "key").alias("label"), "first"))
    least = stage(rep.groupBy("label").agg(F.min(F.struct("first", "key")).alias("least")))
    rep = stage(rep.join(least, "label").select("key", "n_links", F.col("least.first").alias("least"), (F.col("key") == F.col("least.key")).alias("stands")))
    to = F.coalesce("least", "id")
    return rows.join(rep, "key", "left").select(
        "id", "key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), to.alias("label"), F.coalesce(F.col("id") == to, F.lit(True)).alias("kept"), F.coalesce("stands", F.lit(True)).alias("stands")
    )
