"""Packing (operator 3): documents in the order of a space-filling curve, packed into fixed sequences.

Each document's tokens are hashed into a vector, projected to a few dimensions, quantised and turned
into a Hilbert key, so documents with like words get near keys. Documents are range-sorted by key
and laid end to end; every ``seq_len`` tokens a new sequence begins, so only the last one is padded.

Scale: one pass tokenizes and writes (key, ids) to the shared folder; a range sort puts documents in order and
numbers tokens within each range as rows stream by; ranges' token sums (a row per range) then give
each its first place, and pieces are cut in one narrow pass. No range is held in memory. The key ends in bits of
the document's hash, so a third of all documents being equal spreads over ranges like any others.

Defined cases: null or empty text is one closing token; repeated rows are packed again; documents
with null ids are packed too; ties of a key go by document id; an empty table gives an empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, map_texts, materialise, release, schema, slices, table, trim

SEQ_LEN = 1024
#: Token that closes a document.
CLOSE = 0
FEATURES, DIMS, LEVEL_BITS, TIE_BITS = 512, 4, 8, 20
#: Tokens of a range, about; and tokens whose pieces are cut at a time.
RANGE_TOKENS, PIECE_TOKENS = 4_000_000, 1 << 18


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (rows x dims), by bitwise rotation."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Sketch:
    """Hashed vectors of token ids, projected to ``DIMS`` dimensions and quantised by the normal quantile of each."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.mix = rng.permutation(1 << 16).astype(np.uint16) & (FEATURES - 1)
        self.plane = rng.standard_normal((FEATURES, DIMS)).astype(np.float32)

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.sqrt(np.bincount(self.mix[ids & 0xFFFF], minlength=FEATURES).astype(np.float32))
        return v / max(float(np.sqrt(v @ v)), 1e-9)

    def key(self, vectors: np.ndarray) -> np.ndarray:
        centred = vectors - vectors.mean(axis=1, keepdims=True)
        p = (centred @ self.plane) / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
        cells = np.clip((np.tanh(0.8 * p) + 1) / 2 * (1 << LEVEL_BITS), 0, (1 << LEVEL_BITS) - 1)
        return hilbert_key(cells.astype(np.int64), LEVEL_BITS)


def tokenized(df: DataFrame, vocabulary: str, *, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, key long, n long, ids binary (16-bit where the vocabulary allows, deflated) of each row."""
    from .bpe import pieces

    narrow = "<u2" if len(pieces(vocabulary)) <= 1 << 16 else "<u4"

    def make():
        from .bpe import whole_text_encoder

        encode, sketch = whole_text_encoder(vocabulary), Sketch()

        def run(texts):
            ids = [np.array([*encode(t or ""), CLOSE], dtype=narrow) for t in texts]
            if not ids:
                return [[], [], []]
            key = sketch.key(np.stack([sketch.vector(x) for x in ids]))
            tie = np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)
            return [key << TIE_BITS, [len(x) for x in ids], [zlib.compress(x.tobytes(), 1) for x in ids], tie]

        return run

    out = map_texts(df, [id_col], text_col, schema("key long, n long, ids binary, tie long"), make)
    tie = F.pmod(F.xxhash64(id_col, "tie"), F.lit(1 << TIE_BITS))
    return out.select(id_col, (F.col("key") + tie).alias("key"), "n", "ids")


def pack(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Pieces of all rows: ``id_col``, start, length, ids binary, doc_tokens, sequence_id, offset.

    Every id lies in one piece and pieces leave no gap in a sequence; all sequences but the last are full.
    """
    from .bpe import pieces

    narrow = "<u2" if len(pieces(vocabulary)) <= 1 << 16 else "<u4"
    tok = materialise(tokenized(df, vocabulary, id_col=id_col, text_col=text_col), "tokens")
    n_ranges = max(1, -(-(tok.agg(F.sum("n")).first()[0] or 0) // range_tokens))
    ordered = materialise(in_order(tok, n_ranges), "curve")
    release(tok)
    first, at = [], 0
    for r in ordered.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # a row for each range
        first.append((r["range"], at))
        at += r["n"]
    out = T.StructType([df.schema[id_col], *schema("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").fields])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])
    begin = df.sparkSession.sparkContext.broadcast(dict(first))

    def cut(batches):
        for b in batches:
            for lo, hi in slices(b.column(2).to_pylist(), PIECE_TOKENS):
                rows = []
                for doc, r, n, within, raw in zip(*[c.slice(lo, hi - lo).to_pylist() for c in b.columns], strict=True):
                    ids, at, start = np.frombuffer(zlib.decompress(raw), narrow).astype("<u4"), begin.value[r] + within, 0
                    while start < n:
                        seq, off = divmod(at, seq_len)
                        size = min(n - start, seq_len - off)
                        rows.append((doc, start, size, ids[start : start + size].tobytes(), n, seq, off))
                        start, at = start + size, at + size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        trim()

    return ordered.select(ordered.columns[0], "range", "n", "within", "ids").mapInArrow(cut, out)


def in_order(tok: DataFrame, n_ranges: int) -> DataFrame:
    """``tok`` (an id first, then key, n, ids) in order of the curve: each row with its range and the tokens before it there."""
    by = ["key", tok.columns[0]]

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy()
            total = np.cumsum(n)
            cols = [*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(at + total - n)]
            at += int(total[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "range", "within"])

    out = T.StructType([*tok.schema.fields, *schema("range int, within long").fields])
    return tok.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by).mapInArrow(number, out)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
