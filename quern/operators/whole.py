"""Operators over a whole table that Spark would do in one task, or not at all: global numbering and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import written

_ROW = (1 << 33) - 1  # monotonically_increasing_id keeps the partition above, the row within it below


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """row_number() over the whole table, from 1, without a window in one task.

    The table is dealt by ranges of the order and sorted in each partition, which is written
    with the row's place in it; a row's number is that and the rows of all partitions
    before. Only a count for each partition reaches the driver. Rows that tie in all of
    `order` stay together, so the order should end in a key. Null placement is the order's own.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__id": F.col("__id").bitwiseAND(F.lit(_ROW))}))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    out = placed.join(F.broadcast(offsets), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__before") + F.col("__id") + 1).drop("__part", "__id", "__before")


def reach(edges: DataFrame, starts: DataFrame, source: str, target: str, node: str, rounds: int | None = None) -> DataFrame:
    """node and hops (the fewest edges from any start) of all that the starts reach, themselves included.

    Each round follows the edges of the nodes found last and keeps the new ones, so a node is
    expanded once and cycles end. Rounds are as many as the longest shortest path, each in written tables; nothing is collected
    but whether there is more. Null nodes reach nothing.
    """
    edges = written(edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from IS NOT NULL AND __to IS NOT NULL AND __from <> __to").distinct())
    front = written(starts.select(F.col(node).alias("__node")).where("__node IS NOT NULL").distinct().withColumn("hops", F.lit(0).cast("long")))
    seen, hops = [front], 0
    while not front.isEmpty() and (rounds is None or hops < rounds):
        hops += 1
        found = front.join(edges, F.col("__node") == F.col("__from")).select(F.col("__to").alias("__node")).distinct()
        for old in _folded(seen):
            found = found.join(old.select("__node"), "__node", "left_anti")
        front = written(found.withColumn("hops", F.lit(hops).cast("long")))
        seen.append(front)
    out = seen[0]
    for more in seen[1:]:
        out = out.unionAll(more)
    return out.select(F.col("__node").alias(node), "hops")


def _folded(seen: list[DataFrame]) -> list[DataFrame]:
    """The tables of all rounds as one, written anew every eighth round so that plans and files stay few."""
    if len(seen) >= 8:
        whole = seen[0]
        for more in seen[1:]:
            whole = whole.unionAll(more)
        seen[:] = [written(whole)]
    if len(seen) == 1:
        return seen
    whole = seen[0]
    for more in seen[1:]:
        whole = whole.unionAll(more)
    return [whole]
