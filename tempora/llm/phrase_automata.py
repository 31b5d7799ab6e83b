"""Phrase collocation mining (operator 13): suffix automata of shards, counts reduced over all of them.

A shard is some hundred thousand running words of one language. Its generalised suffix automaton, bounded in
depth, holds a state for each set of end positions: the phrases of a state are suffixes of its longest one and
have one count, its suffix link leads to the next shorter phrase with more ends, and counts are numbers of ends.
The link tree of a suffix automaton is the suffix tree of the reversed text, and that is how it is built here: by
sorting, level by level, the contexts that end at each position. Transitions are not kept, as nothing walks them.

A phrase of 100 occurrences has only parts of 100, so rounds over words, pairs and triples of words come first:
each counts hashes, pruned by the round before, and leaves a bitmap of fixed size. A bit may stand for a rare
phrase too, which costs a row and no result: the last round emits the phrases themselves, and their exact sums
decide. Scores are joins of candidates with their parts. Subsumption follows suffix links: a candidate points to
itself without its first word (its link, unless that has more ends) and, in the mirrored automaton, without its
last; what is pointed to with enough occurrences goes. One step suffices, as counts only fall from a phrase to a
longer one.

Scale: texts are cut once and written as shards with dictionaries, and once more without rare words. A round
shuffles a shard's distinct phrases (hashes of about four bytes; in the last round the phrases), packed by range of
hash, and no phrase is hot, as a shard sends it once. A task adds up one range at a time, and ranges follow the input. Bitmaps are 2^``FILTER_BITS`` bits: when a
corpus fills them they prune less, and results stay. The top of a language is taken in salted parts first.

Defined cases: null text is empty; null lang is ``und``; a piece shorter than a phrase has none of it; repeated
rows count again; ties go by count, then by the phrase's bytes; null ids do not matter, and neither do other
columns; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, schema, small_batches, table, trim

MIN_COUNT, MAX_WORDS, TOP, SUBSUME_PERCENT = 100, 5, 2000, 100
#: Running words of a stored row, of all rows a writing task holds, and of an automaton.
ROW_WORDS, HELD_WORDS, SHARD_WORDS = 1 << 18, 1 << 20, 1 << 20
#: Bytes of a long text that are cut into words at a time.
CUT_BYTES = 1 << 20
FILTER_BITS = 26
#: Running words for each range of hashes, of which there are some at least; a task holds the counts of one range at a time.
RANGE_WORDS, LEAST_RANGES = 1 << 22, 8
#: Longest phrases that are counted by hash before phrases are emitted.
HASHED_WORDS = 3
#: Parts of a language whose best phrases are taken first.
SALTS = 64
UNKNOWN = "und"
#: Stands between pieces; no UTF-8 text holds it.
BREAK = b"\xff"


def _letters() -> bytes:
    """Bytes as the cut sees them: A-Z lowered, tabs as blanks, separators of pieces as line ends."""
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    for b in b".,;:!?\n\x0b\x0c\r":
        out[b] = 10
    out[9] = 32
    return bytes(out)


def words_of(raw: bytes, table: bytes = _letters()) -> list[bytes]:
    """Words of a text's bytes, with ``BREAK`` where a piece ends."""
    return raw.translate(table).replace(b"\n", b" " + BREAK + b" ").split()


def _spans(raw: bytes):
    """Stretches of a text that end between words."""
    at = 0
    while at < len(raw):
        end = at + CUT_BYTES
        if end < len(raw):
            end = min((i for i in (raw.find(b" ", end), raw.find(b"\n", end)) if i >= 0), default=len(raw))
        yield raw[at:end]
        at = end


class _Codes(dict):
    """Code of each distinct word, in order of first sight; a break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_pack = zstandard.ZstdCompressor


def shards(df: DataFrame, *, lang_col: str, text_col: str, row_words: int = ROW_WORDS, lead_words: int = MAX_WORDS - 1) -> DataFrame:
    """(lang, n, lead, words, codes): running words of a language as places in the row's own dictionary.

    A row that begins inside a piece repeats the words before it, ``lead`` of them, which are not counted again.
    """

    def run(batches):
        held: dict[str, tuple[_Codes, list[np.ndarray], int]] = {}
        size: dict[str, int] = {}
        z = _pack(level=3)

        def close(lang):
            codes, runs, lead = held.pop(lang)
            del size[lang]
            flat, words = np.concatenate(runs), list(codes)
            inside = flat[np.flatnonzero(flat == 0)[-1] + 1 :] if (flat == 0).any() else flat
            if len(inside):  # a row ends within a piece
                again = _Codes()
                held[lang] = (again, [np.array([again[words[c]] for c in inside[-lead_words:]], np.uint32)], len(inside[-lead_words:]))
                size[lang] = len(held[lang][1][0])
            n = int((flat > 0).sum()) - lead
            cols = [pa.array([lang]), pa.array([n], pa.int64()), pa.array([lead], pa.int32()), pa.array([z.compress(b" ".join(words[1:]))], pa.binary()), pa.array([z.compress(flat.tobytes())], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "n", "lead", "words", "codes"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for span in _spans(text.as_py()):
                    codes, runs, _ = held.setdefault(lang, (_Codes(), [], 0))
                    got = list(map(codes.__getitem__, words_of(span)))
                    runs.append(np.array(got, np.uint32))
                    size[lang] = size.get(lang, 0) + len(got)
                    if size[lang] >= row_words:
                        yield close(lang)
                if lang in held:
                    held[lang][1].append(np.zeros(1, np.uint32))
                    size[lang] += 1
                if sum(size.values()) >= HELD_WORDS:
                    yield close(max(size, key=size.get))
        for lang in list(held):
            yield close(lang)
        held.clear()
        trim()

    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema("lang string, n long, lead int, words binary, codes binary"))


class SuffixAutomaton:
    """States of the generalised suffix automaton of ``ids`` (0 parts texts), for phrases of up to ``depth`` words.

    ``counted`` marks the ends that count; ``allowed(d)`` marks the ends where a phrase of d words may be a node.
    Nodes of level d are the phrases of d words; a node's link is its phrase without the first word.
    """

    def __init__(self, ids: np.ndarray, depth: int, counted: np.ndarray | None = None, allowed=None):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # one end of each node, its ends, its link
        at = np.flatnonzero(ids > 0)
        node = np.zeros(len(ids), np.int64)
        for d in range(1, depth + 1):
            if d > 1:
                at = at[at >= d - 1]
                at = at[ids[at - d + 1] > 0]
            if allowed is not None and len(at):
                at = at[allowed(d)[at]]
            if not len(at):
                break
            _, first, inverse = np.unique(node[at] << 32 | ids[at - d + 1], return_index=True, return_inverse=True)
            weight = inverse if counted is None else inverse[counted[at]]
            self.levels.append((at[first], np.bincount(weight, minlength=len(first)), node[at[first]]))
            node[at] = inverse

    def states(self) -> dict[str, np.ndarray]:
        """For each state: ``end`` (one of them), ``longest`` and ``shortest`` (words), ``count`` and ``link`` (a state, or -1)."""
        out: dict[str, list] = {"end": [], "longest": [], "shortest": [], "count": [], "link": []}
        below, total = None, 0
        made: list[np.ndarray] = []
        for d in range(len(self.levels), 0, -1):
            end, count, _ = self.levels[d - 1]
            state = np.full(len(end), -1)
            if below is not None:
                _, child_count, link = self.levels[d]
                same = child_count == count[link]  # its only extension to the left has the same ends
                state[link[same]] = below[same]
            new = np.flatnonzero(state < 0)
            state[new] = total + np.arange(len(new))
            total += len(new)
            out["end"].append(end[new])
            out["longest"].append(np.full(len(new), d))
            out["count"].append(count[new])
            made.append(state)
            below = state
        flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items() if k in ("end", "longest", "count")}
        shortest, link = np.zeros(total, np.int64), np.full(total, -1)
        for d in range(len(self.levels), 0, -1):  # shallower levels overwrite deeper ones
            state = made[len(self.levels) - d]
            shortest[state] = d
            link[state] = made[len(self.levels) - d + 1][self.levels[d - 1][2]] if d > 1 else -1
        return flat | {"shortest": shortest, "link": link}

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One end, the words and the count of every phrase: each state's, from its shortest to its longest."""
        s = self.states()
        n = s["longest"] - s["shortest"] + 1
        length = np.repeat(s["shortest"], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(s["end"], n), length, np.repeat(s["count"], n)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(29)


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)


def without_rare(rows: DataFrame, frequent) -> DataFrame:
    """Shards with a break in place of each word that is not frequent."""

    def run(batches):
        z, back = _pack(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for lang, lead, words, codes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words, codes = back.decompress(words).split(b" "), np.frombuffer(back.decompress(codes), np.uint32)
                ok = has_bit(frequent.value, word_hashes(words, lang)) if words != [b""] else np.zeros(1, bool)
                new = np.concatenate([[0], np.where(ok, np.cumsum(ok), 0)]).astype(np.uint32)[codes]
                kept = (new > 0) | np.concatenate([[True], new[:-1] > 0])  # of breaks in a row one is enough
                kept[: min(1, len(new))] = True
                cols = [pa.array([lang]), pa.array([int(kept[:lead].sum())], pa.int32()), pa.array([z.compress(b" ".join(w for w, k in zip(words, ok, strict=True) if k))], pa.binary()), pa.array([z.compress(new[kept].tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "lead", "words", "codes"])
        trim()

    return rows.select("lang", "lead", "words", "codes").mapInArrow(run, schema("lang string, lead int, words binary, codes binary"))


def _loaded(batches, shard_words: int):
    """(lang, words, hashes, ids, counted) of each shard: rows of a language put together."""
    held: dict[str, list] = {}

    def take(lang):
        place, hashes, ids, counted = held.pop(lang)
        return lang, list(place), np.concatenate([np.zeros(1, np.uint64), *hashes]), np.concatenate(ids), np.concatenate(counted)

    for b in batches:
        for lang, lead, words, codes in zip(*[c.to_pylist() for c in b.columns], strict=True):
            z = zstandard.ZstdDecompressor()
            words, codes = z.decompress(words).split(b" "), np.frombuffer(z.decompress(codes), np.uint32)
            if words == [b""]:
                continue
            place, hashes, ids, counted = held.setdefault(lang, [{b"": 0}, [], [], []])
            known = len(place)
            to = np.array([0, *[place.setdefault(w, len(place)) for w in words]], np.int64)
            hashes.append(word_hashes([w for w, i in zip(words, to[1:].tolist(), strict=True) if i >= known], lang))
            count = np.ones(len(codes) + 1, bool)
            count[: lead + 1] = False
            ids.append(np.concatenate([[0], to[codes]]))
            counted.append(count)
            if sum(map(len, ids)) >= shard_words:
                yield take(lang)
            elif sum(len(x) for v in held.values() for x in v[2]) >= 2 * shard_words:
                yield take(max(held, key=lambda k: sum(map(len, held[k][2]))))
    for lang in list(held):
        yield take(lang)


class _Hashes:
    """Hashes of the phrases that end at each place of a shard, by length, and whether earlier rounds found them frequent."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, bitmaps: list[np.ndarray]):
        self.ids, self.bitmaps, self.by, self.ok = ids, bitmaps, [words[ids]], []

    def of(self, d: int) -> np.ndarray:
        while len(self.by) < d:
            before = np.concatenate([np.zeros(1, np.uint64), self.by[-1][:-1]])
            self.by.append(pair_hash(before, self.by[0]))
        return self.by[d - 1]

    def frequent(self, d: int) -> np.ndarray:
        """Of phrases longer than any round has counted, whether their parts of the longest counted length are frequent."""
        while len(self.ok) < d:
            n = len(self.ok)  # words of the phrases judged last
            here = self.ids > 0 if n >= len(self.bitmaps) else has_bit(self.bitmaps[n], self.of(n + 1))
            if n:
                here = here & self.ok[-1] & np.concatenate([[False], self.ok[-1][:-1]])
            self.ok.append(here)
        return self.ok[d - 1]


def hashed(rows: DataFrame, depth: int, bitmaps: list, ranges: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(range, packed): hashes and counts in its shard of the phrases of ``depth`` words whose parts are frequent, a row for each range of hashes."""

    def run(batches):
        z = _pack(level=1)
        for _, _, words, ids, counted in _loaded(batches, shard_words):
            hashes = _Hashes(ids, words, [b.value for b in bitmaps])
            end, length, count = SuffixAutomaton(ids, depth, counted, hashes.frequent).phrases()
            on = (length == depth) & (count > 0)
            h, count = hashes.of(depth)[end[on]], count[on]
            part, low = (h >> np.uint64(32)) % np.uint64(ranges), h.astype(np.uint32)
            order = np.lexsort((low, part))
            part, low, count = part[order].astype(np.int32), low[order], count[order].astype(np.uint32)
            at = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
            made = [z.compress(b"".join((_planes(low[a:b]), _planes(count[a:b])))) for a, b in zip(at, [*at[1:], len(part)], strict=True)] if len(part) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(made, pa.binary())], names=["range", "packed"])
        trim()

    return rows.select("lang", "lead", "words", "codes").mapInArrow(run, schema("range int, packed binary"))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Entries of a range that are held before equal hashes are added up.
FOLD_ENTRIES = 1 << 21


def bitmap(packed: DataFrame, least: int, bits: int = FILTER_BITS) -> np.ndarray:
    """2^``bits`` bits, one of them set for each hash that occurs ``least`` times. What the driver sees is of that size, whatever the corpus."""

    def fold(low, count):
        low, inverse = np.unique(np.concatenate(low), return_inverse=True)
        return [low], [np.bincount(inverse, np.concatenate(count)).astype(np.int64)]

    def hot(low, count):
        (low,), (count,) = fold(low, count)
        i = np.unique(low[count >= least].astype(np.int64) & (1 << bits) - 1)
        slot, on = i >> 6, np.uint64(1) << (i & 63).astype(np.uint64)
        at = np.flatnonzero(np.diff(slot, prepend=-1)) if len(slot) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot[at]), pa.array((np.bitwise_or.reduceat(on, at) if len(at) else on).view(np.int64))], names=["slot", "on"])

    def run(batches):
        z, now, low, count, n = zstandard.ZstdDecompressor(), None, [], [], 0
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != now and low:
                    yield hot(low, count)
                    low, count, n = [], [], 0
                now, raw = part, z.decompress(raw.as_py())
                low.append(_numbers(raw[: len(raw) // 2]))
                count.append(_numbers(raw[len(raw) // 2 :]).astype(np.int64))
                n += len(low[-1])
                if n > FOLD_ENTRIES + 2 * len(low[0]):
                    low, count = fold(low, count)
                    n = len(low[0])
        if low:
            yield hot(low, count)
        trim()

    by = packed.repartition(F.col("range")).sortWithinPartitions("range").mapInArrow(run, schema("slot long, on long"))
    slots = by.groupBy("slot").agg(F.bit_or("on").alias("on")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[slots["slot"].to_numpy()] = slots["on"].to_numpy().view(np.uint64)
    return out


def phrase_counts(rows: DataFrame, bitmaps: list, max_words: int, ranges: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, range, phrases, counts): the phrases of up to ``max_words`` words that the bitmaps let by, with their counts in a shard, a row for each range of hashes."""

    def run(batches):
        z = _pack(level=3)
        for lang, names, words, ids, counted in _loaded(batches, shard_words):
            hashes = _Hashes(ids, words, [b.value for b in bitmaps])
            end, length, count = SuffixAutomaton(ids, max_words, counted, hashes.frequent).phrases()
            on = count > 0
            end, length, count = end[on], length[on], count[on]
            h = np.zeros(len(end), np.uint64)
            for d in range(1, max_words + 1):
                h[length == d] = hashes.of(d)[end[length == d]]
            part = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, end, length, count = part[order], end[order], length[order], count[order]
            at = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True) if len(part) else ():
                text = b"\n".join([b" ".join([names[i] for i in ids[e - n + 1 : e + 1].tolist()]) for e, n in zip(end[a:b].tolist(), length[a:b].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(part[a])], pa.int32()), pa.array([z.compress(text)], pa.binary()), pa.array([z.compress(_planes(count[a:b]))], pa.binary())], names=["lang", "range", "phrases", "counts"])
        trim()

    return rows.select("lang", "lead", "words", "codes").mapInArrow(run, schema("lang string, range int, phrases binary, counts binary"))


def summed(packed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, a) of the phrases that occur ``least`` times over all shards: their exact sums, a range at a time."""

    def hot(lang, sums):
        found = [(p, c) for p, c in sums.items() if c >= least]
        text = pa.array([p for p, _ in found], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), text, pa.array([p.count(b" ") + 1 for p, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int64())], names=["lang", "phrase", "size", "a"])

    def run(batches):
        z, now, sums = zstandard.ZstdDecompressor(), None, {}
        for b in batches:
            for lang, part, phrases, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (lang, part) != now:
                    if now:
                        yield hot(now[0], sums)
                    now, sums = (lang, part), {}
                for p, c in zip(z.decompress(phrases).split(b"\n"), _numbers(z.decompress(counts)).tolist(), strict=True):
                    sums[p] = sums.get(p, 0) + c
        if now:
            yield hot(now[0], sums)
        trim()

    by = packed.repartition("lang", "range").sortWithinPartitions("lang", "range")
    return by.mapInArrow(run, schema("lang string, phrase string, size int, a long"))


def frequent_phrases(df: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, max_words: int = MAX_WORDS, filter_bits: int = FILTER_BITS, row_words: int = ROW_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to ``max_words`` words that occur ``least`` times; and (lang, n), all words."""
    context = df.sparkSession.sparkContext
    rows = materialise(shards(df, lang_col=lang_col, text_col=text_col, row_words=row_words, lead_words=max_words - 1), "phrase-shards")
    ranges = max(LEAST_RANGES, -(-(rows.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS))
    bitmaps = [context.broadcast(bitmap(hashed(rows, 1, [], ranges, shard_words), least, filter_bits))]
    totals = materialise(rows.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    kept = materialise(without_rare(rows, bitmaps[0]), "phrase-shards")
    release(rows)
    for d in range(2, min(HASHED_WORDS, max_words) + 1):
        bitmaps.append(context.broadcast(bitmap(hashed(kept, d, bitmaps, ranges, shard_words), least, filter_bits)))
    found = materialise(summed(phrase_counts(kept, bitmaps, max_words, ranges, shard_words), least), "phrases")
    release(kept)
    for b in bitmaps:
        b.unpersist()
    return found, totals


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score): candidates with their worst cut, in exact arithmetic."""
    word = F.split("phrase", " ")
    cut = found.where("size > 1").select("lang", "phrase", "size", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("right"))
    cut = cut.join(found.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(found.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr("cast((cast(a as decimal(19,0)) * 1000 * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0))) as bigint)")
    cut = cut.join(totals, "lang").withColumn("score", score)
    worst = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a", "size")).alias("s"))
    return worst.select("lang", "phrase", "s.size", "s.a", "s.l", "s.r", "s.n", "s.score")


def standing(found: DataFrame, percent: int = SUBSUME_PERCENT) -> DataFrame:
    """(lang, phrase) of candidates that no longer one, with ``percent`` of their count, holds."""
    gap = F.instr("phrase", " ")
    last = F.length("phrase") - F.instr(F.reverse("phrase"), " ")
    links = F.array(F.substring("phrase", gap + 1, F.length("phrase")), F.substring("phrase", F.lit(1), last))
    longer = found.where("size > 2").select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    both = found.where("size > 1").join(longer, ["lang", "phrase"], "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).select("lang", "phrase")


def mine(df: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, percent: int = SUBSUME_PERCENT, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best collocations."""
    found, totals = frequent_phrases(df, lang_col=lang_col, text_col=text_col, least=least, max_words=max_words, **sizes)
    best = scored(found, totals).join(standing(found, percent), ["lang", "phrase"], "left_semi")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)),
c AS (SELECT lang, k AS size, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM c WHERE size > 1),
t AS (
  SELECT s.lang, s.phrase, s.size, s.a, s.k, x.a AS l, y.a AS r, n.n, CAST((CAST(1000 AS HUGEINT) * s.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM s JOIN c x ON x.lang = s.lang AND x.phrase = array_to_string(s.words[1 : s.k], ' ')
    JOIN c y ON y.lang = s.lang AND y.phrase = array_to_string(s.words[s.k + 1 : s.size], ' ') JOIN n ON n.lang = s.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM t) WHERE cut = 1),
q AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(words[2 : size], ' ') AS phrase, a FROM s WHERE size > 2 AND k = 1
    UNION ALL SELECT lang, array_to_string(words[1 : size - 1], ' '), a FROM s WHERE size > 2 AND k = 1) GROUP BY lang, phrase),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN q ON q.lang = b.lang AND q.phrase = b.phrase WHERE q.longer IS NULL OR 100 * q.longer < 100 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM r WHERE rank <= 2000
"""


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
