"""Connected components of a large graph by alternating stars, all rows on the executors.

Edges are contracted inside each task first (a union-find forest has fewer edges than nodes), then
rounds of large-star and small-star link every node to the smallest node it can reach. Each round
is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Edges of a task that are contracted at once.
FOREST_EDGES = 500_000
MAX_ROUNDS = 60


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for every node that is not itself the smallest."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches):
    hold, size = [], 0

    def flush():
        t = pa.Table.from_batches(hold)
        c, r = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(r, pa.int64())], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            hold.append(b)
            size += b.num_rows
        if size >= FOREST_EDGES:
            yield flush()
            hold, size = [], 0
    if hold:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``root`` (longs), for each node of ``edges`` (columns u, v) that is not its component's smallest.

    Loops, repeated and null edges change nothing; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "u long, v long")
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_contract, empty.schema)
    e = materialise(e, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # what hung on u hangs on its smallest neighbour now, and so does u
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        new = materialise(small, "edges")
        release(e)
        e = new
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if now[0] == now[2] and now[:2] == mark:
            return e.select("u", F.col("v").alias("root"))
        mark = now[:2]
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
