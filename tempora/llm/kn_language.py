"""Language ID (operator 4): interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, letters and their marks kept and everything else made one space. Letters of the first 1,280
code points are one unit of 12 bits, all others two, so none share a code. For each language the
counts of its 5-grams of units, over all training rows, give an interpolated Kneser-Ney model:
the highest order from counts, lower orders from the number of distinct characters to the left.
The language of lowest cross-entropy per unit wins; a text whose cross-entropy is above
what that language's own texts reach, with room, is rejected.

Scale: counts are summed inside each task, then by key on the executors; lower orders are aggregates
of distinct grams, and probabilities are worked out there too, a whole context in one task, from the
counts of all grams. Every gram is stored. An order's grams and contexts are hash arrays in parts of
``PART_BYTES``, which pass through the driver one at a time and are broadcast; a worker holds
``RESIDENT_BYTES`` of them and reads the others again for each stretch of text, so a model larger
than a worker's memory is slower and not smaller.

Defined cases: null text or a text without letters is ``und``, with score 0, and rejected; without a
training row everything is ``und``; null or empty languages are not learned from; rows with a null id
are training rows; ties go to the
language first in order; repeated rows count and are judged again; other columns are ignored.
"""

import sys
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialise, release, schema, table, trim

ORDER = 5
CODE_BITS = 12
CODES = 1 << CODE_BITS
#: Of the model: bytes of a part, and of the parts that a worker holds between stretches of text.
PART_BYTES, RESIDENT_BYTES = 64 << 20, 256 << 20
#: Grams counted at a time in a task; four times as many distinct ones are held before they are passed on.
HOLD_GRAMS = 1 << 17
#: Grams of a batch handed back to Spark, which holds batches outside its heap and keeps what it once took there.
OUT_GRAMS = 1 << 14
#: Room above the highest cross-entropy of own texts: nats, and nats times the root of the length.
ROOM, SHORT_ROOM = 1.0, 8.0
SPACE = 32


#: Code points below this are a unit of their own; any other is two units: which 512 it is of, and which of those it is.
ONE_UNIT, LOW_BITS = 0x500, 9
TRAIL = ONE_UNIT + (sys.maxunicode >> LOW_BITS) + 1
LETTER, MARK = 1, 2


def _kinds() -> np.ndarray:
    """Of each code point, whether it is a letter, or a mark that belongs to one (vowel signs, accents)."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        of = unicodedata.category(chr(c))[0]
        kind[c] = LETTER if of == "L" else MARK if of == "M" else 0
    return kind


_TABLE: list[np.ndarray] = []


def codes_of(text: str | None) -> np.ndarray:
    """Letters and single spaces of a text as units, with a space at either end; empty if it has no letter. No two letters share their units."""
    if not text:
        return np.zeros(0, np.uint16)
    if not _TABLE:
        _TABLE.append(_kinds())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _TABLE[0][points]
    if not (kind == LETTER).any():
        return np.zeros(0, np.uint16)
    c = np.where(kind > 0, points, SPACE)
    wide = c >= ONE_UNIT
    if wide.any():
        at = np.cumsum(1 + wide) - 1 - wide
        units = np.repeat(c, 1 + wide)
        units[at[wide]] = ONE_UNIT + (c[wide] >> LOW_BITS)
        units[at[wide] + 1] = TRAIL + (c[wide] & (1 << LOW_BITS) - 1)
        c = units
    gap = c == SPACE
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[:1] |= gap[:1]
    c = c[keep]
    return np.concatenate([[SPACE] * int(c[0] != SPACE), c, [SPACE] * int(c[-1] != SPACE)]).astype(np.uint16)


def grams_of(c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each character but the first; at the start a gram is filled up with spaces."""
    c = np.concatenate([np.full(order - 2, SPACE, np.uint16), c]).astype(np.int64)
    g = np.zeros(len(c) - order + 1, np.int64)
    for i in range(order):
        g = g << CODE_BITS | c[i : i + len(g)]
    return g


def hashed(gram: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def count_grams(train: DataFrame, *, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows of ``train``."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                at = np.argsort(g, kind="stable")
                g, n = g[at], n[at]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                g, n = g[first], np.add.reduceat(n, first)
                for lo in range(0, len(g), OUT_GRAMS):
                    part = slice(lo, lo + OUT_GRAMS)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(g[part])), pa.array(g[part]), pa.array(n[part])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            by: dict[str, list] = {}
            chars = 0
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                c = codes_of(text.as_py())
                if len(c):
                    by.setdefault(lang.as_py(), []).append(grams_of(c, order))
                    chars += len(c)
                if chars > HOLD_GRAMS:
                    size += _fold(by, held)
                    chars = 0
                if size > 4 * HOLD_GRAMS:
                    yield from flush()
                    size = 0
            size += _fold(by, held)
        yield from flush()
        trim()

    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and lang <> '' and text is not null")
    return rows.mapInArrow(run, schema("lang string, gram long, n long")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _fold(by: dict, held: dict) -> int:
    size = 0
    for lang, parts in by.items():
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        held.setdefault(lang, []).append((g, n))
        size += len(g)
    by.clear()
    return size


@dataclass
class Part:
    """Keys in order of their hash, a row for each, and where each hash begins."""

    keys: np.ndarray
    rows: np.ndarray  # a column for each language
    starts: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> "Part":
        bits = max(1, int(len(keys)).bit_length())
        h = hashed(keys, bits)
        by = np.argsort(h, kind="stable")
        return cls(keys[by], rows[by], np.searchsorted(h[by], np.arange((1 << bits) + 1)).astype(np.int32), bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        h = hashed(keys, self.bits)
        at, end, todo = self.starts[h].astype(np.int64), self.starts[h + 1], np.arange(len(keys))
        while len(todo):
            left = at < end
            at, end, todo = at[left], end[left], todo[left]
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = at[hit]
            at, end, todo = at[~hit] + 1, end[~hit], todo[~hit]
        return out

    @property
    def size(self) -> int:
        return self.keys.nbytes + self.rows.nbytes + self.starts.nbytes


@dataclass
class Model:
    languages: list[str]
    #: For each order, the parts of its grams' log probabilities and of its contexts' log back-offs: (bytes, broadcast).
    grams: list[list] = field(default_factory=list)
    contexts: list[list] = field(default_factory=list)
    limits: dict[str, float] = field(default_factory=dict)
    resident_bytes: int = RESIDENT_BYTES

    def _lookup(self, parts: list, keys: np.ndarray, add_to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Add the row of each stored key to ``add_to[at]``; returns which keys are stored."""
        found = np.zeros(len(keys), bool)
        for place, size, shared in parts:
            todo = np.flatnonzero(~found)
            if not len(todo):
                break
            part = shared.value
            got = part.find(keys[todo])
            hit = got >= 0
            add_to[at[todo[hit]]] += part.rows[got[hit]]
            found[todo[hit]] = True
            if place + size > self.resident_bytes and getattr(shared, "_path", None):
                shared.__dict__.pop("_value", None)
        return found

    def log_probability(self, gram: np.ndarray, k: int | None = None) -> np.ndarray:
        """Rows of log p(last character | those before) for grams of ``k`` characters, a column for each language."""
        k = len(self.grams) if k is None else k
        out, todo = np.zeros((len(gram), len(self.languages)), np.float32), np.arange(len(gram))
        for j in range(k, 0, -1):
            g = gram[todo] & ((1 << CODE_BITS * j) - 1)
            miss = ~self._lookup(self.grams[j - 1], g, out, todo)
            todo, g = todo[miss], g[miss]
            if not len(todo):
                return out
            self._lookup(self.contexts[j - 1], g >> CODE_BITS, out, todo)
        out[todo] -= np.log(CODES)
        return out

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text, which has letters."""
        total = np.zeros((len(texts), len(self.languages)))
        grams = [grams_of(c, len(self.grams)) for c in texts]
        sizes = np.array([len(g) for g in grams])
        g, of = np.concatenate(grams), np.repeat(np.arange(len(texts)), sizes)
        step = max(1 << 12, (1 << 20) // len(self.languages))
        for at in range(0, len(g), step):
            h, row = self.log_probability(g[at : at + step]), of[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[first]] -= np.add.reduceat(h, first, axis=0, dtype=np.float64)
        return total / sizes[:, None]

    def predict(self, texts) -> list[list]:
        """Language, score, cross-entropy and whether it is accepted, for each text."""
        codes = [codes_of(t) for t in texts]
        rows = [("und", 0.0, None, False)] * len(codes)
        some = [i for i, c in enumerate(codes) if len(c)] if self.languages else []
        # a language without a text of its own to set a limit by has that of the others
        other = max(self.limits.values(), default=np.inf)
        for i, h in zip(some, self.cross_entropies([codes[i] for i in some]) if some else (), strict=True):
            n = len(codes[i])
            best = int(np.argmin(h))
            score = 1 / np.exp(-(h - h[best]) * min(n, 50)).sum()
            lang = self.languages[best]
            limit = self.limits.get(lang, other) + SHORT_ROOM / np.sqrt(n)
            rows[i] = (lang, float(score), float(h[best]), bool(h[best] <= limit))
        return [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 4


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, part_bytes: int = PART_BYTES, resident_bytes: int = RESIDENT_BYTES) -> Model:
    """A model of every language in ``rows``, from all their texts."""
    raw = materialise(count_grams(rows, text_col=text_col, lang_col=lang_col, order=order), "grams")
    languages = sorted(r[0] for r in raw.select("lang").distinct().collect())
    model = Model(languages, resident_bytes=resident_bytes)
    if not languages:
        release(raw)
        return model
    code = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    counts = {order: raw.select(code.cast("int").alias("lang"), "gram", "n")}
    for k in range(order - 1, 0, -1):
        counts[k] = materialise(_continued(counts[k + 1], k), f"grams-{k}")
    few = reduce(DataFrame.union, [c.where("n <= 2").groupBy("lang", "n").count().select(F.lit(k).alias("k"), "lang", "n", "count") for k, c in counts.items()]).collect()
    few = {(r["k"], r["lang"], r["n"]): r["count"] for r in few}
    shorter, made = None, []
    for k in range(1, order + 1):
        once, twice = (np.array([few.get((k, i, n), 0) for i in range(len(languages))]) for n in (1, 2))
        discount = np.clip(np.where(once + 2 * twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)
        shorter = materialise(_order(counts[k], shorter, k, discount), f"order-{k}")
        made.append(shorter)
    sizes = reduce(DataFrame.union, [t.groupBy("is_context").count().select(F.lit(k).alias("k"), "is_context", "count") for k, t in enumerate(made)]).collect()
    sizes = {(r["k"], r["is_context"]): r["count"] for r in sizes}
    place = 0
    for k, t in enumerate(made):
        for kind, into in ((False, model.grams), (True, model.contexts)):
            n = -(-sizes[k, kind] * (4 * len(languages) + 16) // part_bytes)
            parts = []
            for i in range(n):
                got = t.where(F.col("is_context") == kind).where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).select("key", "row").toArrow()
                if got.num_rows:
                    part = Part.of(got.column("key").to_numpy(), _rows(got.column("row"), len(languages)))
                    parts.append((place, part.size, rows.sparkSession.sparkContext.broadcast(part)))
                    place += part.size
            into.append(parts)
    release(raw, *counts.values(), *made)
    return model


def _rows(column, n_lang: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, n_lang)


def _continued(counts: DataFrame, k: int) -> DataFrame:
    """Grams of ``k`` characters with the number of distinct characters seen to their left, from the grams one longer."""
    return counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << CODE_BITS * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))


def _order(counts: DataFrame, shorter: DataFrame | None, k: int, discount: np.ndarray) -> DataFrame:
    """(is_context, key, row): log probabilities of the grams of ``k`` characters and log back-offs of their contexts.

    A row has a float for each language. A context's grams meet in one task; there are at most as
    many as there are characters, times languages.
    """
    n_lang, lowest = len(discount), shorter is None
    logs = lambda x: np.log(np.maximum(x, 1e-12)).astype(np.float32)

    def packed(x):
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n_lang), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

    def work(t: pa.Table):
        if not t.num_rows:
            return
        lang, gram, c = (t.column(x).to_numpy() for x in ("lang", "gram", "n"))
        grams, first, at = np.unique(gram, return_index=True, return_inverse=True)
        contexts, of = np.unique(grams >> CODE_BITS, return_inverse=True)
        n = np.zeros((len(grams), n_lang))
        np.add.at(n, (at, lang), c)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        back = np.where(total > 0, np.minimum(discount * kinds / np.maximum(total, 1), 1), 1)
        low = np.exp(_rows(t.column("low").take(pa.array(first)), n_lang).astype(np.float64)) if not lowest else 1 / CODES
        p = np.maximum(n - discount, 0) / np.maximum(total[of], 1) + back[of] * low
        for kind, keys, x in ((False, grams, p), (True, contexts, back)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind)), pa.array(keys), packed(logs(x))], names=["is_context", "key", "row"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            context = t.column("gram").to_numpy() >> CODE_BITS
            last = int(np.searchsorted(context, context[-1])) if len(context) else 0
            held = t.slice(last)
            yield from work(t.slice(0, last))
        if held is not None:
            yield from work(held)
        trim()

    c = counts.select("lang", "gram", "n", F.shiftright("gram", CODE_BITS).alias("context"))
    if not lowest:
        low = shorter.where(~F.col("is_context")).select(F.col("key").alias("suffix"), F.col("row").alias("low"))
        c = c.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << CODE_BITS * (k - 1)) - 1))).join(low, "suffix").drop("suffix")
    c = c.repartition("context").sortWithinPartitions("context", "gram").drop("context")
    return c.mapInArrow(run, schema("is_context boolean, key long, row binary"))


PREDICTION = "lang_pred string, score double, cross_entropy double, accepted boolean"


def predict(df: DataFrame, model: Model, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score, cross_entropy and accepted for each row. No shuffle."""

    def make():
        return model.predict  # its arrays are broadcasts

    return map_texts(df, keep, text_col, schema(PREDICTION), make)


def calibrate(model: Model, rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Set each language's limit from the cross-entropies of all its own training rows: one narrow pass and a maximum."""
    if model.languages:
        own = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        got = predict(own, model, keep=["lang"]).where("lang = lang_pred").groupBy("lang").agg(F.max("cross_entropy").alias("h")).collect()
        model.limits = {r["lang"]: r["h"] + ROOM for r in got}
    return model


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame) -> Model:
    rows = docs.where(F.coalesce(~held_out(), F.lit(True)))
    return calibrate(train(rows), rows)


def op4_kn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, trained(docs), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
