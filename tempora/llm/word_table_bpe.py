"""BPE encoding and decoding (operator 7): a table of distinct words, joined back by position.

Texts are split into words by the vocabulary's rule. A chunk of documents (some MB of text) is kept
as its distinct words, each with a place, and the documents as sequences of places. The words of all
chunks are dealt out by hash, so the occurrences of a distinct word meet in one part of the word
table and it is encoded once; its ids go back to the chunks by (chunk, place), and a document's ids
are those at its places, in order. Decoding joins ids to the id-to-piece table (as many rows as the
vocabulary has) and joins the pieces' bytes.

Scale: what is shuffled is each distinct word of a chunk, sorted and compressed, not each word of the
corpus; a frequent word is in a chunk once at most, so no word is hot. The word table has as many
parts as the session has shuffle partitions. The places are written once, bucketed by chunk, and
are not shuffled. Chunks survive retries: they are read from that table.

Defined cases: null and empty texts have no ids; strings of special tokens inside a text get their
id, as the library does by default; a text longer than a chunk is a chunk of its own; repeated rows
are encoded again; null ids are kept; an empty table gives an empty result.
"""

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import arrow_type, forget_at_end, materialise, schema, scratch_dir, slices, small_batches, table, trim

CHUNK_CHARS = 16 << 20
SLICE_CHARS = 1 << 20
#: Distinct words handed to the encoder at a time.
ENCODE_WORDS = 1 << 12
#: Distinct words of a part that are held at a time.
TABLE_WORDS = 1 << 20


class _Places(dict):
    """Place of each distinct word, given out in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def splitter(vocabulary: str):
    """``f(text) -> words``; strings of special tokens are words of their own."""
    usual, rule = regex.compile(bpe.SPLIT).findall, bpe.library(vocabulary).pre_tokenizer

    def find(text):
        return [text[a:b] for _, (a, b) in rule.pre_tokenize_str(text)] if bpe.UNUSUAL(text) else usual(text)

    marks = bpe.special(vocabulary)
    if not marks:
        return find
    cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")").split

    def words(text):
        if not any(m in text for m in marks):
            return find(text)
        out = []
        for i, part in enumerate(cut(text)):
            out += [part] if i % 2 else find(part)
        return out

    return words


def _pack(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> tuple[bytes, np.ndarray]:
    return zstandard.ZstdCompressor(level=6).compress("".join(words).encode("utf-8", "surrogatepass")), np.fromiter(map(len, words), np.uint32, len(words))


def _unpack_words(raw: bytes, lengths: np.ndarray) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(raw).decode("utf-8", "surrogatepass")
    ends = np.cumsum(lengths, dtype=np.int64)
    return [text[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def split_words(df: DataFrame, vocabulary: str, parts: int, *, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: (chunk, part, words, numbers: their lengths and places), and (chunk, docs, counts, numbers: the places of the docs' words)."""
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("docs", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType())])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches):
        words = splitter(vocabulary)
        base, number = TaskContext.get().partitionId() << 24, 0
        places, chars = _Places(), 0

        def close():
            by: list[list] = [[] for _ in range(parts)]
            for w, i in places.items():
                by[zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts].append((w, i))
            for part, rows in enumerate(by):
                if rows:
                    rows.sort()
                    raw, lengths = _pack_words([w for w, _ in rows])
                    numbers = _pack(np.concatenate([lengths, np.fromiter((i for _, i in rows), np.uint32, len(rows))]))
                    yield pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([part], pa.int32()), pa.array([raw], pa.binary()), pa.nulls(1, arrow.types[3]), pa.nulls(1, arrow.types[4]), pa.array([numbers], pa.binary())], schema=arrow)

        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_CHARS):
                if chars and chars + sum(sizes[lo:hi]) > CHUNK_CHARS:
                    yield from close()
                    places.clear()
                    number, chars = number + 1, 0
                codes, counts = [], []
                for t in b.column(1).slice(lo, hi - lo).to_pylist():
                    got = list(map(places.__getitem__, words(t))) if t else []
                    codes.append(np.array(got, np.uint32))
                    counts.append(len(got))
                chars += sum(sizes[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([b.column(0).slice(lo, hi - lo).to_pylist()], arrow.types[3]), pa.array([counts], arrow.types[4]), pa.array([_pack(np.concatenate(codes))], pa.binary())], schema=arrow)
        yield from close()
        places.clear()
        trim()

    return df.select(id_col, text_col).mapInArrow(run, out)


def encode_words(rows: DataFrame, vocabulary: str, parts: int) -> DataFrame:
    """(chunk, n, ids) from (chunk, part, words, numbers): a part of the word table at a time, each of its distinct words encoded once.

    Rows of a part stream by, so what is held is the part's distinct words. Beyond ``TABLE_WORDS`` of them the
    table is begun anew, which costs encodings and changes no result; more parts avoid it.
    """

    def run(batches):
        library = bpe.library(vocabulary)
        now, known = None, {}
        for b in batches:
            for chunk, part, raw, numbers in zip(*b.columns, strict=True):
                if part.as_py() != now or len(known) > TABLE_WORDS:
                    now, known = part.as_py(), {}
                x = _unpack(numbers.as_py())
                n = len(x) // 2
                words = _unpack_words(raw.as_py(), x[:n])
                new = [w for w in words if w not in known]  # a chunk holds a word once
                for at in range(0, len(new), ENCODE_WORDS):
                    some = new[at : at + ENCODE_WORDS]
                    for w, e in zip(some, library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                size = np.fromiter(map(len, ids), np.uint32, n) // 4
                packed = _pack(np.concatenate([x[n:], size, np.frombuffer(b"".join(ids), "<u4")]))
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "n", "ids"])
        known.clear()
        trim()

    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "chunk")
    return rows.select("chunk", "part", "words", "numbers").mapInArrow(run, schema("chunk long, n int, ids binary"))


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the runs start[i] .. start[i] + n[i] - 1, one after another."""
    total = int(n.sum())
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", finish=None, finish_schema: str = "ids array<long>") -> DataFrame:
    """``id_col`` and the ids of each text; or what ``finish(ids as uint32 array) -> tuple`` makes of them."""
    spark = df.sparkSession
    small_batches(spark)
    finish = finish or (lambda ids: (ids.tolist(),))
    name = f"word_places_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split_words(df, vocabulary, buckets, id_col=id_col, text_col=text_col).write.bucketBy(buckets, "chunk").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    both = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay until the session ends; buckets are known to the frame
    forget_at_end(spark, f"{scratch_dir(spark)}/{name}")
    ids = encode_words(both.where("part is not null"), vocabulary, buckets)
    texts = both.where("part is null").select("chunk", "docs", "counts", "numbers")
    out = T.StructType([df.schema[id_col], *schema(finish_schema).fields])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for n, raw in zip(right["n"].to_pylist(), right["ids"].to_pylist(), strict=True):
            x = _unpack(raw)
            parts.append((x[:n], x[n : 2 * n], x[2 * n :]))
        size = sum(len(p[0]) for p in parts)
        length, begin = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        for place, n, flat in parts:
            n = n.astype(np.int64)
            length[place], begin[place] = n, at + np.cumsum(n) - n
            at += len(flat)
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
        rows = []
        for docs, counts, raw in zip(left["docs"].to_pylist(), left["counts"].to_pylist(), left["numbers"].to_pylist(), strict=True):
            places = _unpack(raw).astype(np.int64)
            n = length[places]
            ids = flat[_ragged(begin[places], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            for doc, a, z in zip(docs, ends[:-1], ends[1:], strict=True):
                rows.append((doc, *finish(ids[a:z])))
        trim()
        if not rows:
            return arrow.empty_table()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, out)


def decode_ids(ids, vocabulary: str) -> str:
    """The text of ids: their pieces' bytes, joined; what is not UTF-8 becomes U+FFFD."""
    own = bpe.pieces(vocabulary)
    return b"".join([own[i] for i in ids]).decode("utf-8", "replace")


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece): the bytes of each id."""
    own = bpe.pieces(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(own)), pa.int64()), "piece": pa.array(own, pa.binary())}))


def decode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the text of the ids in ``ids_col``: each position meets its piece by a join, and pieces are put together in order.

    Null ids give null; what is not UTF-8 becomes U+FFFD. Repeated rows are decoded each.
    """
    pieces = F.broadcast(piece_table(df.sparkSession, vocabulary))  # as many rows as the vocabulary
    rows = df.select(id_col, F.col(ids_col).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "ids")
    at = rows.select("row", F.posexplode("ids").alias("at", "id")).join(pieces, "id")
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: F.hex(x["piece"]))
    joined = at.groupBy("row").agg(F.unhex(F.array_join(hexes, "")).alias("bytes"))
    text = F.try_validate_utf8(F.col("bytes").cast("string"))
    loose = F.udf(lambda x: None if x is None else bytes(x).decode("utf-8", "replace"), "string", useArrow=True)
    valid = F.coalesce(text, F.when(text.isNull(), loose("bytes")))
    out = rows.join(joined, "row", "left")
    return out.select(id_col, F.when(F.col("ids").isNotNull(), F.coalesce(valid, F.lit(""))).alias("text"))


def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")

    def digests(ids):
        back = decode_ids(ids.tolist(), vocabulary).encode()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

    return encode(table(spark, sf_dir, "documents"), vocabulary, finish=digests, finish_schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
