"""Fill-in-middle transformation (operator 12): cut points found by a parallel scan with a finite automaton.

A unit is white space with the word after it, or the white space at a text's end. Units are counted by an
automaton over UTF-8 bytes: a boundary lies before a byte where the automaton emits. A stretch of bytes is
summed up without knowing the state it is entered in: the state it ends in and the boundaries it holds, for
each state it may begin in. Such summaries compose associatively. Texts of up to ``CHUNK_BYTES`` are scanned
in place, many at a time in one stream. Longer ones are dealt out as chunks; chunk summaries are composed in
a tree of ``FAN`` children a node, and the wanted boundaries are found by descending the tree, where each
node's entry state follows from its elder siblings', down to one chunk, which is then scanned from its known
entry state.

Scale: short texts are one narrow pass. Of long ones each chunk is shuffled once as bytes, and once more if
the chunk holds a cut and Spark doesn't broadcast the cuts; a group is never more than ``FAN`` summaries. A text reaches
one task only where its output is put together, as the row it already was.

Defined cases: null text is empty: plain, 0 units; a null id hashes as the seed and colon alone; rows with
equal id and text give equal results, and each is returned; a text of white space only is one unit; texts
that hold a mark stay plain; an empty table gives an empty result; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialise, release, schema, table, trim

CHUNK_BYTES = 1 << 16
#: Children of a node of the summary tree.
FAN = 256
#: Bytes that one lane of a scan steps through; lanes run side by side.
LANE = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Automaton:
    """A deterministic automaton over bytes: ``step[state, kind]`` and ``emit[state, kind]``, kinds of bytes by ``kind``."""

    def __init__(self, kind: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.kind, self.states = kind.astype(np.uint8), len(step)
        self.step, self.emit = step.astype(np.uint8), emit.astype(np.uint8)

    def _lanes(self, data: np.ndarray) -> np.ndarray:
        """Kinds as (LANE, lanes); the last lane is padded with a kind that changes nothing."""
        n = -(-len(data) // LANE) * LANE
        k = np.full(n, self.step.shape[1], np.uint8)
        k[: len(data)] = self.kind[data]
        return np.ascontiguousarray(k.reshape(-1, LANE).T)

    def _tables(self):
        stay = np.arange(self.states, dtype=np.uint8)[:, None]
        return np.hstack([self.step, stay]), np.hstack([self.emit, np.zeros_like(stay)])

    def lanes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start state and lane: the state it ends in and the boundaries in it."""
        step, emit = self._tables()
        kinds = self._lanes(data)
        state = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], kinds.shape[1], axis=1)
        count = np.zeros(state.shape, np.int32)
        for k in kinds:
            count += emit[state, k]
            state = step[state, k]
        return state, count

    def summary(self, data: np.ndarray) -> tuple[list[int], list[int]]:
        """The stretch's transition function and its boundaries, for each start state."""
        to, n = list(range(self.states)), [0] * self.states
        ends, counts = self.lanes(data)
        for end, count in zip(ends.T.tolist(), counts.T.tolist(), strict=True):
            n = [a + count[s] for a, s in zip(n, to, strict=True)]
            to = [end[s] for s in to]
        return to, n

    def boundaries(self, data: np.ndarray, entry: int = 0) -> np.ndarray:
        """Places of bytes before which a boundary lies, if the stretch is entered in state ``entry``."""
        step, emit = self._tables()
        ends, _ = self.lanes(data)
        state = np.empty(ends.shape[1], np.uint8)
        for i, end in enumerate(ends.T.tolist()):
            state[i] = entry
            entry = end[entry]
        kinds = self._lanes(data)
        out = np.empty(kinds.shape, np.uint8)
        for i, k in enumerate(kinds):
            out[i] = emit[state, k]
            state = step[state, k]
        return np.flatnonzero(out.T.ravel()[: len(data)])


#: Kinds: white space, other bytes, and the byte between texts of a stream, which no UTF-8 text holds.
BETWEEN = 0xFF


def units() -> Automaton:
    """States: before or in white space; in a word. A unit ends where white space follows a word."""
    kind = np.ones(256, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    kind[BETWEEN] = 2
    return Automaton(kind, np.array([[0, 1, 0], [0, 1, 0]]), np.array([[0, 0, 0], [1, 0, 0]]))


def leads(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


#: Digits of the two numbers that travel in front of a text.
HEADS = 20


def _short(df: DataFrame) -> DataFrame:
    """``df`` with n, first and second (code points before the cuts) of short texts, scanned as one stream a slice."""

    def make():
        auto = units()

        def run(rows):
            raw = [r[HEADS:].encode() for r in rows]
            data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
            at = auto.boundaries(data)
            chars = np.concatenate([[0], np.cumsum(leads(data))])
            lo, hi = np.searchsorted(at, begin), np.searchsorted(at, begin + size)
            out = []
            for i, r in enumerate(rows):
                a, z = int(begin[i]), int(begin[i] + size[i])
                n = int(hi[i] - lo[i]) + (z > a)
                cuts = sorted(int(r[j : j + 10]) % (n + 1) for j in (0, 10))
                out.append((n, *[int(chars[a if c == 0 else z if c == n else at[lo[i] + c - 1]] - chars[a]) for c in cuts]))
            return [list(c) for c in zip(*out, strict=True)]

        return run

    return map_texts(df.withColumn("scan", F.concat("heads", "text")), df.columns, "scan", schema("n long, first long, second long"), make)


def _chunked(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """(key, idx, piece): the bytes of each text in chunks. ``df`` has key and text."""

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                raw = memoryview(text.as_buffer())
                for i, at in enumerate(range(0, len(raw), chunk_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([i], pa.int64()), pa.array([raw[at : at + chunk_bytes].tobytes()], pa.binary())], names=["key", "idx", "piece"])

    return df.select("key", "text").mapInArrow(run, schema("key string, idx long, piece binary"))


def summaries(chunks: DataFrame) -> DataFrame:
    """(key, idx, to, n, chars): a transition function and boundary counts for each chunk of (key, idx, piece)."""

    def run(batches):
        auto = units()
        for b in batches:
            rows = []
            for piece in b.column(2):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                rows.append((*auto.summary(data), int(leads(data).sum())))
            to, n, chars = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64())), pa.array(chars, pa.int64())], names=["key", "idx", "to", "n", "chars"])
        trim()

    return chunks.select("key", "idx", "piece").mapInArrow(run, schema("key string, idx long, to array<int>, n array<long>, chars long"))


def _children():
    return F.array_sort(F.collect_list(F.struct("idx", "to", "n", "chars"))).alias("children")


def composed(level: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level of the tree: summaries of up to ``fan`` neighbours, composed in order."""
    states = range(units().states)
    nothing = F.struct(F.array(*[F.lit(s) for s in states]).alias("to"), F.array(*[F.lit(0).cast("long") for _ in states]).alias("n"), F.lit(0).cast("long").alias("chars"))

    def then(a, x):
        return F.struct(
            F.transform(a["to"], lambda s: F.get(x["to"], s)).alias("to"),
            F.zip_with(a["n"], a["to"], lambda n, s: n + F.get(x["n"], s)).alias("n"),
            (a["chars"] + x["chars"]).alias("chars"),
        )

    up = level.groupBy("key", F.floor(F.col("idx") / fan).alias("up")).agg(_children())
    return up.select("key", F.col("up").alias("idx"), F.aggregate("children", nothing, then).alias("s")).select("key", "idx", "s.*")


def tree(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels of summaries, from chunks up to one root for each key; as many as the longest text needs."""
    levels = [leaves]
    last = leaves.agg(F.max("idx")).first()[0] or 0
    while last > 0:
        levels.append(materialise(composed(levels[-1], fan), "fim-level"))
        last //= fan
    return levels


def select(levels: list[DataFrame], targets: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, which, idx, state, nth, before): the chunk that holds boundary ``nth`` of (key, which, nth), its entry state, and the code points before it.

    ``nth`` counts from 1 and must not pass the boundaries of its text; in the result it counts within the chunk.
    """
    long0 = F.lit(0).cast("long")
    at = targets.select("key", "which", long0.alias("idx"), F.lit(0).alias("state"), "nth", long0.alias("before"))
    for level in reversed(levels[:-1]):
        nodes = level.groupBy("key", F.floor(F.col("idx") / fan).alias("idx")).agg(_children())
        start = F.struct(F.lit(None).cast("long").alias("idx"), F.col("state").alias("state"), F.col("nth").alias("nth"), F.col("before").alias("before"))

        def walk(a, x):
            here = F.get(x["n"], a["state"])
            found = F.struct(x["idx"].alias("idx"), a["state"].alias("state"), a["nth"].alias("nth"), a["before"].alias("before"))
            on = F.struct(a["idx"].alias("idx"), F.get(x["to"], a["state"]).alias("state"), (a["nth"] - here).alias("nth"), (a["before"] + x["chars"]).alias("before"))
            return F.when(a["idx"].isNotNull(), a).when(here >= a["nth"], found).otherwise(on)

        at = at.join(nodes, ["key", "idx"]).select("key", "which", F.aggregate("children", start, walk).alias("s")).select("key", "which", "s.*")
    return at


def places(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, which, place): code points before each selected boundary."""

    def run(batches):
        auto = units()
        for b in batches:
            out = []
            for state, nth, before, piece in zip(*[b.column(i) for i in range(2, 6)], strict=True):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                cut = int(auto.boundaries(data, state.as_py())[nth.as_py() - 1])
                out.append(before.as_py() + int(leads(data[:cut]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["key", "which", "place"])
        trim()

    joined = found.join(chunks, ["key", "idx"]).select("key", "which", "state", "nth", "before", "piece")
    return joined.mapInArrow(run, schema("key string, which int, place long"))


def _long(df: DataFrame, chunk_bytes: int, fan: int) -> DataFrame:
    """``df`` with n, first and second, by chunks dealt out over the executors."""
    keyed = df.withColumn("key", F.sha2(F.concat_ws("\n", "heads", "text"), 256))  # equal rows have equal cuts
    chunks = materialise(_chunked(keyed, chunk_bytes).dropDuplicates(["key", "idx"]), "fim-chunks")
    levels = tree(materialise(summaries(chunks), "fim-level"), fan)
    state0 = F.get("n", F.lit(0))
    roots = levels[-1].select("key", (state0 + 1).alias("n"), "chars")
    heads = keyed.select("key", "heads").dropDuplicates(["key"]).join(roots, "key")
    h = [F.substring("heads", i, 10).cast("long") % (F.col("n") + 1) for i in (1, 11)]
    heads = heads.select("key", "n", "chars", F.least(*h).alias("c1"), F.greatest(*h).alias("c2"))
    wanted = heads.select("key", "n", F.posexplode(F.array("c1", "c2")).alias("which", "nth")).where("nth > 0 and nth < n")
    place = places(select(levels, wanted.select("key", "which", "nth"), fan), chunks)
    cuts = place.groupBy("key").agg(*[F.max(F.when(F.col("which") == i, F.col("place"))).alias(f"p{i}") for i in (0, 1)])
    ends = [F.when(F.col(c) == 0, F.lit(0)).when(F.col(c) == F.col("n"), F.col("chars")).otherwise(F.col(p)).alias(name) for c, p, name in (("c1", "p0", "first"), ("c2", "p1", "second"))]
    cut = materialise(heads.join(cuts, "key", "left").select("key", "n", *ends), "fim-cuts")
    release(chunks, *levels)
    return keyed.join(cut, "key").select(*df.columns, "n", "first", "second")


def transform(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """``id_col``, n, form, prefix_chars, middle_chars, output for each row of ``df``.

    Forms: plain (the text), psm, spm. Numbers are taken from the hex SHA-256 of seed, colon and id.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("id", "text", F.concat(*[F.lpad(x.cast("string"), 10, "0") for x in h[:2]]).alias("heads"), h[2].alias("h3"), h[3].alias("h4"))
    size = F.octet_length("text")
    cut = _short(rows.where(size <= chunk_bytes)).unionByName(_long(rows.where(size > chunk_bytes), chunk_bytes, fan))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_percent), F.lit("plain")).when(F.col("h4") % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    cut = cut.withColumn("form", form)
    first, second = F.col("first"), F.col("second")
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    return cut.select(F.col("id").alias(id_col), "n", "form", F.when(moved, first).alias("prefix_chars"), F.when(moved, second - first).alias("middle_chars"), output.alias("output"))


def restored(output, form):
    """The text of an output, from it and its form alone. No mark can arise across a seam, as each has one ``<``, in front."""
    parts = F.split(output, "<[PSM]>", 4)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c1, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(list_slice(units, 1, c1), '') AS prefix, array_to_string(list_slice(units, c1 + 1, c2), '') AS middle,
    array_to_string(list_slice(units, c2 + 1, n), '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_fim_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
