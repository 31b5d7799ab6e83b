"""Embedding near-duplicates (operator 6): collision counting over one-dimensional projections.

Vectors are made unit length and projected on ``PROJECTIONS`` random directions. Two unit vectors of
cosine c differ by a normal variable of variance 2 - 2c in each projection, so around a query a
window of one such deviation for the threshold cosine catches a linked vector with probability 0.68,
and an unrelated one with 0.21. Each projection is sorted; what lies in a query's window there collides with
it, and collisions are counted per pair over all projections. The count asked for is the highest that keeps
``RECALL`` of pairs at the threshold (binomial), and closer pairs meet more often. Survivors are verified by
their cosine in double precision, so no reported pair is below it.

The work is dealt out along the first projection: vectors of a label are put in strips as wide as
the window that loses one pair in two thousand, and meet their own strip and the next. A strip
of many vectors is dealt in hashed blocks of at most ``BLOCK_ROWS``; a task sorts the projections of one pair of
blocks and counts, and it returns link counts and a spanning forest, never the pairs. Equal vectors of a
label are one node with a weight, so thousands of copies cost nothing.

Defined cases: null labels, and vectors that are null, empty, zero or hold a null or non-finite
component, link with nothing; vectors of different lengths don't link; a row with a null id links with
nothing and is in no component; different vectors that share an id are nodes of their own; an empty table
gives an empty result; other columns are ignored.
"""

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, schema, table
from .components import components, forest

COSINE = 0.93
PROJECTIONS = 48
RECALL = 0.999
BLOCK_ROWS = 1024
STRIP_DEVIATIONS = 3.5


def windows(cosine: float = COSINE, projections: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int, float]:
    """Half width of a window, collisions asked for, and width of a strip."""
    s = sqrt(max(2 - 2 * cosine, 1e-12))
    p = erf(1 / sqrt(2))
    tail, least = 0.0, 0
    for k in range(projections, -1, -1):
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            least = k
            break
    return s, least, STRIP_DEVIATIONS * s


@lru_cache(maxsize=8)
def directions(size: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, projections))


def prepared(df: DataFrame, *, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, raw): raw is the vector as doubles, null where it can link with nothing."""

    def run(batches):
        for b in batches:
            raw = []
            for known, i, v in zip(b.column(1).is_valid().to_pylist(), b.column(0).is_valid().to_pylist(), b.column(2), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if known and i and v.is_valid and not v.values.null_count else np.zeros(0)
                raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["id", "label", "raw"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec_col).mapInArrow(run, schema("id long, label string, raw binary"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled by the largest component first, so that squares of large or small ones stay finite."""
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _classes(rows: DataFrame, strip: float) -> DataFrame:
    """Distinct vectors of a label: node, least id, weight, raw, projections and strip."""
    by = rows.where("raw is not null").groupBy("label", "node", "h1").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))

    def run(batches):
        for b in batches:
            x = [unit(np.frombuffer(r, np.float64)) for r in b.column(4).to_pylist()]
            p = [(v @ directions(len(v))).astype(np.float32) for v in x]
            made = [pa.array([q.tobytes() for q in p], pa.binary()), pa.array([len(v) for v in x], pa.int32()), pa.array([int(np.floor(q[0] / strip)) for q in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=["label", "node", "least", "weight", "raw", "proj", "size", "strip"])

    return by.select("label", "node", "least", "weight", "raw").mapInArrow(run, schema("label string, node long, least long, weight long, raw binary, proj binary, size int, strip int"))


def _collisions(queries: np.ndarray, order: np.ndarray, ranked: np.ndarray, half: float) -> np.ndarray:
    """How often each of the sorted vectors lies in each query's window: queries x vectors.

    ``queries`` holds a row of values for each projection; ``order`` and ``ranked`` the vectors as each projection sorts them.
    """
    n = ranked.shape[1]
    met = np.zeros(queries.shape[1] * n, np.int32)
    base = np.arange(queries.shape[1]) * n
    for q, at, p in zip(queries, order, ranked, strict=True):
        lo, hi = np.searchsorted(p, q - half), np.searchsorted(p, q + half, side="right")
        size = hi - lo
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        met[np.repeat(base, size) + at[place]] += 1  # a vector is in a window once
    return met.reshape(-1, n)


def _meet(t: pa.Table, cosine: float, half: float, least: int):
    """(node, links) and forest edges among the two blocks of a task, or of one block with itself."""
    side = t["side"].to_numpy()
    node, weight = t["node"].to_numpy(), t["weight"].to_numpy()
    x = unit(np.frombuffer(b"".join(t["raw"].to_pylist()), np.float64).reshape(len(node), -1))
    p = np.frombuffer(b"".join(t["proj"].to_pylist()), np.float32).reshape(len(node), -1).T
    alone = bool((side == 0).all())
    a = np.flatnonzero(side < 2) if alone else np.flatnonzero(side == 1)
    b = a if alone else np.flatnonzero(side == 2)
    links = np.zeros(len(node), np.int64)
    us, vs = [], []
    order = np.argsort(p[:, b], axis=1, kind="stable")
    ranked = np.take_along_axis(p[:, b], order, axis=1)
    for at in range(0, len(a) if len(b) else 0, 128):
        q = a[at : at + 128]
        i, j = np.nonzero(_collisions(p[:, q], order, ranked, half) >= least)
        i, j = q[i], b[j]
        keep = i < j if alone else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 14):
            u, v = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            near = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[near], v[near]
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            us.append(node[u])
            vs.append(node[v])
    some = np.flatnonzero(links)
    u, v = np.concatenate(us or [node[:0]]), np.concatenate(vs or [node[:0]])
    u, v = forest(u[u != v], v[u != v])
    return pa.table({"u": pa.array(np.concatenate([node[some], u]), pa.int64()), "v": pa.array([None] * len(some) + v.tolist(), pa.int64()), "links": pa.array(links[some].tolist() + [None] * len(u), pa.int64())})


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``df``, by links between vectors of one label."""
    half, least, strip = windows(cosine)
    hashes = {"h1": F.xxhash64("raw"), "node": F.xxhash64("label", F.lit("second"), "raw")}
    rows = materialise(prepared(df, id_col=id_col, vec_col=vec_col, label_col=label_col).withColumns(hashes), "vectors")
    classes = materialise(_classes(rows, strip), "vector-classes")
    at = ["label", "size", "strip"]
    blocks = classes.groupBy(*at).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    after = blocks.select("label", "size", (F.col("strip") - 1).alias("strip"), F.col("blocks").alias("after"))
    before = blocks.select("label", "size", (F.col("strip") + 1).alias("strip"), F.col("blocks").alias("before"))
    sizes = blocks.join(after, at, "left").join(before, at, "left")
    x = classes.join(sizes, at).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, strip, p, q, side: F.struct(F.lit(kind).alias("kind"), strip.alias("at"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))
    own = F.col("own")
    within = F.transform(until(F.col("blocks")), lambda q: task(0, F.col("strip"), F.least(q, own), F.greatest(q, own), F.when(q == own, 0).when(own < q, 1).otherwise(2)))
    to_next = F.transform(until(F.coalesce("after", F.lit(0))), lambda q: task(1, F.col("strip"), own, q, F.lit(1)))
    to_last = F.transform(until(F.coalesce("before", F.lit(0))), lambda q: task(1, F.col("strip") - 1, q, own, F.lit(2)))
    dealt = x.select("label", "size", "node", "weight", "raw", "proj", F.explode(F.concat(within, to_next, to_last)).alias("t")).select("label", "size", "t.*", "node", "weight", "raw", "proj")
    met = dealt.groupBy("label", "size", "kind", "at", "p", "q").applyInArrow(lambda t: _meet(t, cosine, half, least), schema("u long, v long, links long"))
    met = materialise(met, "meetings")
    root = components(met.where("v is not null").select("u", "v")).withColumnRenamed("u", "node")
    counts = met.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select("node", "least", "weight").join(counts, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(smallest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    # rows that link with nothing have a node of their own, which spreads them
    out = rows.select("id", F.col("raw").isNotNull().alias("ok"), F.when(F.col("raw").isNotNull(), F.col("node")).otherwise(F.xxhash64("id")).alias("node"))
    out = out.join(known, "node", "left")
    n = F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0))
    comp = F.when(F.col("ok"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), n.cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def op6_collision_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Exact cosines of all pairs of a label, and what they reach.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS s, b.vec_id AS d
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS s, vec_id AS d FROM v UNION SELECT r.s, l.d FROM r JOIN l ON r.d = l.s),
n AS (SELECT s, count(*) AS n_links FROM l GROUP BY s),
c AS (SELECT s, min(d) AS component_id FROM r GROUP BY s)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.s = v.vec_id LEFT JOIN n ON n.s = v.vec_id
"""
