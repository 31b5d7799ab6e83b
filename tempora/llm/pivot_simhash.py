"""SimHash near-duplicates (operator 5): pivot distance tables over fingerprints.

Each text gets a 64-bit fingerprint. Distances to many reference fingerprints are computed once per
distinct fingerprint; by the triangle inequality two fingerprints within ``radius`` bits differ by
at most ``radius`` in every coordinate of that table, so a pair with a larger difference anywhere is
discarded and only survivors are verified.

Which pairs are looked at at all is an exit from that method: candidate groups are pigeonhole bit blocks. Of ``BLOCKS``
blocks of bits at least ``BLOCKS - radius`` are equal in a linked pair, so fingerprints are grouped by each choice of that
many blocks, and no linked pair is missed. Distances to pivots only filter pairs within a group before the exact
distance, and change no row. A group larger than ``GROUP_ROWS`` is dealt out as pairs of hashed parts,
each a task's work of bounded size, and a task returns a spanning forest of its links, never all
pairs. Equal fingerprints are one node throughout, so thousands of copies cost one row.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows get equal results; a null id keeps its row and is
never a component id (a component of null ids alone has id null); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialise, schema, table
from .components import components, forest

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Blocks of bits: with 6 and a radius of 4, two blocks at least are equal in a linked pair.
BLOCKS = 6
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Rows of a group that one task takes as a whole.
GROUP_ROWS = 2048
#: Shingles counted at a time.
STEP = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    sizes = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(w) - words + 1].tolist()
    ends = (ends - 1)[words - 1 :].tolist()
    h, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        got = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)], np.uint64)
        ones += np.unpackbits(got.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if x else "0" for x in (2 * ones > n)), 2)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id_col`` and fp (the fingerprint as a signed long). One narrow pass."""

    def make():
        def run(texts):
            return [[(x ^ (1 << 63)) - (1 << 63) for x in (fingerprint(t, words) for t in texts)]]

        return run

    return map_texts(df, [id_col], text_col, schema("fp long"), make)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def _blocks(n: int) -> list[np.uint64]:
    edges = [64 * i // n for i in range(n + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _linked(fp_a, tab_a, fp_b, tab_b, radius):
    """Index pairs within ``radius``: every pivot coordinate first, then the true distance."""
    i, j = np.nonzero(np.abs(tab_a[:, :1].astype(np.int16) - tab_b[:, 0].astype(np.int16)) <= radius)
    for c in range(1, tab_a.shape[1]):
        near = np.abs(tab_a[i, c].astype(np.int16) - tab_b[j, c]) <= radius
        i, j = i[near], j[near]
    true = np.bitwise_count(fp_a[i] ^ fp_b[j]) <= radius
    return i[true], j[true]


def _distances(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)


def _coordinates(distinct: DataFrame) -> DataFrame:
    """fp and tab (its distances to the pivots, a byte each)."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            tab = _distances(fp)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in tab], pa.binary())], names=["fp", "tab"])

    return distinct.select("fp").mapInArrow(run, schema("fp long, tab binary"))


def _keys(radius: int, blocks: int):
    masks = _blocks(blocks)
    return [np.bitwise_or.reduce(np.array(c, np.uint64)) for c in combinations(masks, blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u, v) that span the same components as all pairs of ``fp`` within ``radius`` bits."""
    masks = _keys(radius, blocks)
    # candidate groups: equal bits on the chosen blocks
    keyed = distinct.select("fp", "tab", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(int(m.astype(np.int64)))) for m in masks])).alias("choice", "bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    keyed = keyed.join(sizes, ["choice", "bits"])
    parts = F.ceil(F.col("rows") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # part p of a group meets every part q: p <= q. A group of one part is its own and only task unit.
    every = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(q, F.col("own")).alias("p"), F.greatest(q, F.col("own")).alias("q")))
    dealt = keyed.withColumn("own", own).select("choice", "bits", "own", "fp", "tab", F.explode(every).alias("pq")).select("choice", "bits", F.col("pq.p"), F.col("pq.q"), "own", "fp", "tab")
    dealt = dealt.repartition("choice", "bits", "p", "q").sortWithinPartitions("choice", "bits", "p", "q")

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = _last_group(t)
            held = t.slice(last)
            yield from _group_links(t.slice(0, last), radius)
        if held is not None:
            yield from _group_links(held, radius)

    return dealt.mapInArrow(run, schema("u long, v long"))


def _group_bounds(t: pa.Table) -> np.ndarray:
    k = [t.column(c).to_numpy() for c in ("choice", "bits", "p", "q")]
    new = np.zeros(len(k[0]), bool)
    new[:1] = True
    for c in k:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _last_group(t: pa.Table) -> int:
    bounds = _group_bounds(t)
    return int(bounds[-1]) if len(bounds) else 0


def _group_links(t: pa.Table, radius: int):
    n = t.num_rows
    if not n:
        return
    fp = t.column("fp").to_numpy().view(np.uint64)
    tab = np.frombuffer(b"".join(t.column("tab").to_pylist()), np.int8).reshape(n, -1)
    own, p, q = (t.column(c).to_numpy() for c in ("own", "p", "q"))
    start = _group_bounds(t)
    size = np.diff(np.append(start, n))
    group = np.repeat(np.arange(len(start)), size)
    us, vs = [], []
    small = size[group] <= 32
    for s in range(1, 32):  # rows of small groups meet by shifts, all groups at once
        i = np.flatnonzero(small[:-s] & (group[:-s] == group[s:])) if n > s else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + s
        near = np.ones(len(i), bool)
        for c in range(tab.shape[1]):
            near &= np.abs(tab[i, c].astype(np.int16) - tab[j, c]) <= radius
        i, j = i[near], j[near]
        true = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        us.append(fp[i[true]])
        vs.append(fp[j[true]])
    for g in np.flatnonzero(size > 32):
        at = np.arange(start[g], start[g] + size[g])
        if p[at[0]] == q[at[0]]:
            a = b = at
        else:
            a, b = at[own[at] == p[at[0]]], at[own[at] == q[at[0]]]
        for lo in range(0, len(a), 512):
            rows = a[lo : lo + 512]
            i, j = _linked(fp[rows], tab[rows], fp[b], tab[b], radius)
            u, v = fp[rows[i]], fp[b[j]]
            keep = u != v
            if keep.any():
                u, v = forest(u[keep].view(np.int64), v[keep].view(np.int64))
                us.append(u.view(np.uint64))
                vs.append(v.view(np.uint64))
    if us:
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        keep = u != v
        u, v = forest(u[keep], v[keep])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``id_col``, fp (signed long) and component_id, the smallest id reachable through links, for each row."""
    prints = materialise(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    distinct = materialise(_coordinates(least), "pivot-table")
    root = components(links(distinct, radius, blocks)).withColumnRenamed("u", "fp")
    named = least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
