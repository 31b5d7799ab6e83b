"""Best-fit packing (operator 11): documents into as few sequences as possible by linear grouping.

Lengths above a half (third, fourth, eighth: see ``TRIES``) of a sequence are large. Sorted, they are cut into groups of equal cardinality, and
each length is rounded up to the largest of its group. Over these few sizes a linear programme over
configurations (what fits into a sequence) is solved by column generation; its whole part gives sequences with
slots, which are filled with actual documents of the slot's group. What is left, large or small, is placed by
exact length, longest first, each where it fits best.

Documents of one length are interchangeable, so all of this is planned on the histogram of lengths alone: at
most ``seq_len`` counts reach the driver, whatever the corpus. The plan says, for a stretch of ranks within a
length, in which sequences they go and at what place there; it has some ten thousand rows at most, bounded by
``seq_len`` and the groups, and is what is broadcast.

Scale: texts are tokenized and cut once, and pieces are written once, bucketed by the task that wrote them. A
piece's rank within its length is its number in that task plus the pieces of that length in earlier tasks,
a window over one row for each task and length. Its sequence then follows by looking up the plan. No document is
shuffled, and none is sorted.

Defined cases: null or empty text is one closing token; repeated rows are packed again; documents with null
ids are packed too; equal lengths go in order of task and row; an empty table gives an empty result; other
columns are ignored.
"""

import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, forget_at_end, schema, scratch_dir, slices, small_batches, table, trim

SEQ_LEN = 2048
#: Token that closes a document.
CLOSE = 0
#: What is tried, as (part of a sequence beyond which a length is large, groups); the plan with the fewest sequences is taken.
#: Rounding costs most where small documents can't fill what it leaves, so few large lengths or many groups do best there.
TRIES = ((2, 48), (3, 160), (4, 48), (4, 160), (8, 48))
SLICE_CHARS = 1 << 19
#: Ranks within a length are below this.
RANKS = 1 << 51


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most worth within ``capacity``, by dynamic programming over the number of items."""
    value = np.zeros(capacity + 1)
    picks = []
    for _ in range(capacity // int(sizes.min())):
        new, pick = value.copy(), np.full(capacity + 1, -1)
        for g, (s, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
            if w > 0:
                got = value[: capacity + 1 - s] + w
                better = got > new[s:] + 1e-12
                new[s:][better], pick[s:][better] = got[better], g
        if not (pick >= 0).any():
            break
        value = new
        picks.append(pick)
    out, at = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            out[pick[at]] += 1
            at -= int(sizes[pick[at]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each size, copies): the whole part of a linear programme's solution for the fewest sequences.

    The basis has one configuration for each size; the next one to enter is the best under the dual prices.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(60 * k):
        copies = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(k))
        new = best_configuration(sizes, price, capacity)
        if price @ new <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(copies, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    copies = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.astype(object), []
    for j in np.argsort(-copies):
        need = basis[:, j].round().astype(np.int64)
        n = min([int(np.floor(copies[j] + 1e-6)), *[int(left[g]) // int(need[g]) for g in np.flatnonzero(need)]])
        if n > 0:
            left = left - need * n
            out.append((need, n))
    return out


class Plan:
    """Where the pieces of each length go: ``place`` gives sequence and offset of (length, rank)."""

    def __init__(self, counts: dict[int, int], capacity: int = SEQ_LEN, large_part: int = 4, groups: int = 48):
        self.capacity, self.large, self.sequences = capacity, capacity // large_part, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces a sequence, first sequence, offset
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, sequences) by what is free
        self.mask = 0
        rest = self._grouped({n: c for n, c in counts.items() if c}, groups)
        for length in sorted(rest, reverse=True):
            for first, n in rest[length]:
                self._best_fit(length, first, n)
        self.rows.sort()
        t = np.array(self.rows, np.int64).reshape(-1, 5)
        self.key, self.first, self.each, self.sequence, self.offset = t[:, 0] * RANKS + t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4]
        del self.rows, self.room

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length.astype(np.int64) * RANKS + rank, side="right") - 1
        n = rank - self.first[i]
        return self.sequence[i] + n // self.each[i], self.offset[i] + n % self.each[i] * length

    def _free(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.room[room].append((first, n))
            self.mask |= 1 << room

    def _grouped(self, counts: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
        """Fill configurations with large pieces; what remains, as (first rank, pieces) by length."""
        rest = {n: [(0, c)] for n, c in counts.items()}
        large = sorted((n for n in counts if self.large < n < self.capacity), reverse=True)
        total = sum(counts[n] for n in large)
        if not total:
            return rest
        each = -(-total // groups)
        runs: dict[int, list[list[int]]] = {}  # rounded size: [length, first rank, pieces]
        size, room = 0, 0
        for n in large:
            at = 0
            while at < counts[n]:
                if not room:
                    size, room = n, each
                take = min(room, counts[n] - at)
                runs.setdefault(size, []).append([n, at, take])
                at, room = at + take, room - take
        sizes = sorted(runs, reverse=True)
        demand = np.array([sum(r[2] for r in runs[s]) for s in sizes])
        for need, n in configurations(np.array(sizes), demand, self.capacity):
            slots = [self._take(runs[sizes[g]], n) for g in np.flatnonzero(need) for _ in range(int(need[g]))]
            self._fill(slots, n)
        for n in large:
            rest[n] = []
        for left in runs.values():
            for n, at, c in left:
                rest[n].append((at, c))
        return rest

    @staticmethod
    def _take(runs: list[list[int]], n: int) -> list[tuple[int, int, int]]:
        """The next ``n`` pieces of a group as (length, first rank, pieces)."""
        out = []
        while n:
            length, at, c = runs[0]
            got = min(n, c)
            out.append((length, at, got))
            n -= got
            if got == c:
                runs.pop(0)
            else:
                runs[0] = [length, at + got, c - got]
        return out

    def _fill(self, slots: list[list[tuple[int, int, int]]], n: int) -> None:
        """``n`` sequences with these slots, cut into stretches in which each slot has one length."""
        ends = [np.cumsum([r[2] for r in s]).tolist() for s in slots]
        at = 0
        for end in sorted({e for es in ends for e in es}):
            used = 0
            for slot, es in zip(slots, ends, strict=True):
                i = bisect_right(es, at)
                length, first, c = slot[i]
                self.rows.append((length, first + at - (es[i] - c), 1, self.sequences + at, used))
                used += length
            self._free(self.capacity - used, self.sequences + at, end - at)
            at = end
        self.sequences += n

    def _best_fit(self, length: int, first: int, n: int) -> None:
        """Place ``n`` pieces in the sequences with the least sufficient room, one sequence after another; then in new ones."""
        while n:
            fits = self.mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                begin, have = self.room[room].pop()
                if not self.room[room]:
                    self.mask &= ~(1 << room)
            else:
                room, begin = self.capacity, self.sequences
                have = -(-n // (room // length))
                self.sequences += have
            each = room // length
            put = min(n, each * have)
            self.rows.append((length, first, each, begin, self.capacity - room))
            whole, part = divmod(put, each)
            self._free(room - each * length, begin, whole)
            if part:
                self._free(room - part * length, begin + whole, 1)
            self._free(room, begin + whole + bool(part), have - whole - bool(part))
            first, n = first + put, n - put


def best_plan(counts: dict[int, int], capacity: int = SEQ_LEN, tries=TRIES) -> Plan:
    return min((Plan(counts, capacity, *t) for t in tries), key=lambda p: p.sequences)


def cuts(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``seq_len``."""
    head = n % seq_len or min(n, seq_len)
    return [(0, head), *[(at, seq_len) for at in range(head, n, seq_len)]]


def pieces(df: DataFrame, vocabulary: str, *, id_col: str, text_col: str, seq_len: int) -> DataFrame:
    """``id_col``, piece, start, length, ids (deflated), part and nth (among the part's pieces of that length)."""
    from . import bpe

    narrow = "<u2" if len(bpe.pieces(vocabulary)) <= 1 << 16 else "<u4"
    out = T.StructType([df.schema[id_col], *schema("piece int, start long, length int, ids binary, part int, nth long").fields])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches):
        encode, part, seen = bpe.whole_text_encoder(vocabulary), TaskContext.get().partitionId(), [0] * (seq_len + 1)
        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_CHARS):
                rows = []
                for doc, text in zip(*[c.slice(lo, hi - lo).to_pylist() for c in b.columns], strict=True):
                    ids = np.array([*encode(text or ""), CLOSE], dtype=narrow)
                    for i, (start, n) in enumerate(cuts(len(ids), seq_len)):
                        rows.append((doc, i, start, n, zlib.compress(ids[start : start + n].tobytes(), 1), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        trim()

    return df.select(id_col, text_col).mapInArrow(run, out)


def pack(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, tries=TRIES) -> DataFrame:
    """Pieces of all rows: ``id_col``, piece, start, length, ids binary (32-bit), sequence_id, offset."""
    from . import bpe

    spark = df.sparkSession
    small_batches(spark)
    narrow = "<u2" if len(bpe.pieces(vocabulary)) <= 1 << 16 else "<u4"
    name = f"packing_pieces_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = pieces(df, vocabulary, id_col=id_col, text_col=text_col, seq_len=seq_len)
    made.write.bucketBy(buckets, "part").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    cut = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay until the session ends; buckets are known to the frame
    forget_at_end(spark, f"{scratch_dir(spark)}/{name}")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    plan = spark.sparkContext.broadcast(best_plan(histogram, seq_len, tries))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each part, with at most seq_len entries; read by the join itself, and never sent to Python
    earlier = by_part.select("part", F.struct("length", before.alias("before")).alias("e")).groupBy("part").agg(F.map_from_entries(F.collect_list("e")).alias("before"))
    ranked = cut.join(earlier.hint("shuffle_hash"), "part").select(id_col, "piece", "start", "length", "ids", (F.element_at("before", F.col("length")) + F.col("nth")).alias("rank"))
    out = T.StructType([df.schema[id_col], *schema("piece int, start long, length long, ids binary, sequence_id long, offset long").fields])
    names = [f.name for f in out.fields]

    def look_up(batches):
        for b in batches:
            length = b.column(3).to_numpy().astype(np.int64)
            sequence, offset = plan.value.place(length, b.column(5).to_numpy())
            for lo, hi in slices(length.tolist(), SLICE_CHARS):
                ids = [np.frombuffer(zlib.decompress(x), narrow).astype("<u4").tobytes() for x in b.column(4).slice(lo, hi - lo).to_pylist()]
                own = [b.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(length[lo:hi]), pa.array(ids, pa.binary()), pa.array(sequence[lo:hi]), pa.array(offset[lo:hi])], names=names)
        trim()

    return ranked.mapInArrow(look_up, out)


def op11_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
