"""Line de-duplication (operator 2): a suffix array over line ids by distributed prefix doubling.

Lines that occur once share nothing, so they and the ends of documents cut the corpus into segments of
repeated lines. Equal segments are one text with copies: later copies are later copies throughout. The
suffixes of the distinct segments are ranked by prefix doubling: their first lines are ranked by hash, then
pairs (own rank, rank ``depth`` lines on) are sorted and ranked again at 1, 2, 4, ... lines, until
every class holds one suffix or equal whole ones. Ranks in order are the suffix array. The
longest common prefix of neighbours is found by descending the same levels, and a scan of the
array merges neighbours from the longest common prefix down. What merges at length L is an LCP interval: the
occurrences of one run of L lines that goes on differently after it. ``repeated_runs`` reports the maximal
ones, those that also differ before. In a merge only one occurrence is the first in the corpus; for the
others L is the longest run that starts there and has an earlier copy.

A later copy is deleted if it has ``min_words`` words or ``min_lines`` lines.

Scale: lines travel as 128-bit hashes and only repeated ones stay. Pairs are counted with partial sums before they
are range-sorted, so a line in a third of all documents is one row of the sort; ranks are prefix sums
with one row per range on the driver. The scan handles a range at a time and leaves a list no longer than
twice the longest run; such lists are merged in groups until one is left. Texts are shuffled once, to
meet their deletions.

Defined cases: null text stays null; an empty text is one empty line; a text whose lines all go becomes
empty; rows that repeat id and text are one document and are treated alike; corpus order is id (null
first), then a hash of the text, then the line; columns of the input stay; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, release, schema, table, trim

MIN_WORDS = 8
MIN_LINES = 4
NO_ID = -(1 << 63)
DOC = ["__doc", "__hash"]
AT = [*DOC, "no"]
#: Lists of ranges that one task merges.
MERGE_LISTS = 64


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__hash": F.xxhash64(text_col)})


def line_ids(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each line: its place, its words and the 128-bit hash that is its id."""
    lines = _keyed(df, id_col, text_col).where(F.col(text_col).isNotNull()).select(*DOC, F.posexplode(F.split(text_col, "\n", -1)).alias("no", "line"))
    return lines.select(*AT, F.regexp_count("line", F.lit(r"[^\t-\r ]+")).alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def segments(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __hash, no, lines, s1, s2): maximal stretches of lines that each occur twice or more; s1, s2 hash the whole stretch."""
    lines = line_ids(df, id_col=id_col, text_col=text_col)
    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    kept = lines.join(again, ["h1", "h2"]).repartition(*DOC).dropDuplicates(AT)
    kept = kept.withColumn("stretch", F.col("no") - F.row_number().over(Window.partitionBy(*DOC).orderBy("no")))
    by = kept.groupBy(*DOC, "stretch").agg(F.array_sort(F.collect_list(F.struct("no", "h1", "h2", "words"))).alias("lines"))
    one, two = F.transform("lines", lambda x: x["h1"]), F.transform("lines", lambda x: x["h2"])
    return by.select(*DOC, F.col("lines")[0]["no"].alias("no"), "lines", F.xxhash64(one, two).alias("s1"), F.xxhash64(two, one).alias("s2"))


def _suffixes(distinct: DataFrame, min_words: int, min_lines: int) -> DataFrame:
    """(__doc, __hash, no, len, need, copies, h1, h2, before): the suffixes of segments; ``need`` is the least number of lines from here that is a run worth deleting."""
    x = F.col("lines")

    def suffix(line, i):
        words = line["words"]
        need = F.when(words >= min_words, 1)
        for k in range(1, min_lines - 1):
            words = words + F.coalesce(F.get(x, i + k)["words"], F.lit(0))
            need = need.when(words >= min_words, k + 1)
        return F.struct(line["no"].alias("no"), (F.size(x) - i).alias("len"), need.otherwise(min_lines).alias("need"), line["h1"].alias("h1"), line["h2"].alias("h2"), F.when(i > 0, F.get(x, i - 1)["h1"]).alias("before"))

    if min_lines < 2:
        raise ValueError("a run of one line is told by its words")
    return distinct.select(*DOC, "copies", F.explode(F.transform(x, suffix)).alias("s")).select(*DOC, "s.*", "copies")


# ---------------------------------------------------------------- ranks


def _ranked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, c, n, before) for counted keys: ``before`` is the sum of ``n`` of smaller keys with the same ``a``. And the table to release.

    Keys are sorted over ranges; a range's first ``a`` may have begun in an earlier one, which one row per range makes good.
    """

    def run(batches):
        part, last, carry, first = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            total = np.cumsum(n) - n
            new = np.concatenate([[True], a[1:] != a[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            before = total - total[start]
            if last is not None and a[0] == last:
                before[start == 0] += carry
            first = a[0] if first is None else first
            last, carry = a[-1], int(before[-1] + n[-1])
            cols = [*batch.columns, pa.array(before), pa.array(np.full(len(a), part, np.int32)), pa.array(a == first)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "c", "n", "before", "part", "open"])

    made = pairs.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(run, schema("a long, b long, c long, n long, before long, part int, open boolean"))
    made = materialise(made, "ranks")
    ends = made.groupBy("part").agg(F.min("a").alias("first"), F.max("a").alias("last"), F.max(F.struct("a", (F.col("before") + F.col("n")).alias("sum")))["sum"].alias("sum"))
    offset, last, carry = [], None, 0
    for r in ends.orderBy("part").collect():  # a row for each range
        add = carry if r["first"] == last else 0
        if add:
            offset.append((r["part"], add))
        last, carry = r["last"], r["sum"] + (add if r["first"] == r["last"] else 0)
    out = made
    if offset:
        add = F.broadcast(made.sparkSession.createDataFrame(offset, "part int, add long"))  # a row for each range
        out = made.join(add, "part", "left").withColumn("before", F.col("before") + F.when(F.col("open"), F.coalesce("add", F.lit(0))).otherwise(0))
    return out.select("a", "b", "c", "n", "before"), made


STATE = [*AT, "len", "need", "copies", "rank", "n", "low", "state"]


def _levels(suffixes: DataFrame) -> list[DataFrame]:
    """Suffixes by prefix doubling; table k ranks them by their first 2**k lines.

    ``n`` suffixes share a ``rank``, the number of suffixes before them. ``low`` is the power of two that bounds
    the common prefix with the class before from below and is more than half of it. State 0: to be ranked
    further; 1: ended at this level, alone or among equal whole suffixes; 2: ended before, kept for what reaches it.
    """
    counted = suffixes.groupBy(F.lit(0).cast("long").alias("a"), F.col("h1").alias("b"), F.col("h2").alias("c")).agg(F.count("*").alias("n"))
    ranks, used = _ranked(counted)
    first = suffixes.join(ranks.select(F.col("b").alias("h1"), F.col("c").alias("h2"), "n", F.col("before").alias("rank")), ["h1", "h2"])
    first = first.withColumns({"low": F.lit(0).cast("long"), "state": F.when(F.col("n") > 1, 0).otherwise(1)})
    out = [materialise(first.select(STATE), "suffixes")]
    release(used)
    depth = 1
    while out[-1].where("state = 0").limit(1).count():
        in_doc = Window.partitionBy(*DOC).orderBy("no")
        ahead = F.when(F.col("len") > depth, F.first("rank").over(in_doc.rangeBetween(depth, depth))).otherwise(-1)
        todo_here = F.min("state").over(Window.partitionBy(*DOC)) == 0
        work = materialise(out[-1].withColumns({"ahead": ahead, "todo_here": todo_here}).where("todo_here").select(*STATE, "ahead"), "pairs")
        todo = work.where("state = 0").drop("n", "state")
        ranks, used = _ranked(todo.groupBy(F.col("rank").alias("a"), F.col("ahead").alias("b"), F.lit(0).cast("long").alias("c")).agg(F.count("*").alias("n")))
        new = todo.join(ranks.select(F.col("a").alias("rank"), F.col("b").alias("ahead"), "n", "before"), ["rank", "ahead"])
        new = new.withColumns({
            "low": F.when(F.col("before") > 0, F.lit(depth).cast("long")).otherwise(F.col("low")),
            "rank": F.col("rank") + F.col("before"),
            "state": F.when((F.col("n") > 1) & (F.col("ahead") >= 0), 0).otherwise(1),
        })
        ended = work.where("state > 0").withColumn("state", F.lit(2))
        out.append(materialise(new.select(STATE).unionByName(ended.select(STATE)), "suffixes"))
        release(work, used)
        depth *= 2
    return out


def _common_prefixes(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``leaves`` with ``low`` raised to the longest common prefix with the leaf before, by descending the levels."""
    before = leaves.select((F.col("rank") + F.col("n")).alias("rank"), F.col("__doc").alias("d"), F.col("__hash").alias("h"), F.col("no").alias("at"))
    pairs = leaves.where("low >= 2").join(before, "rank").select("rank", *AT, "d", "h", "at", "low")
    exact = leaves.where("low < 2").select("rank", "low")
    used = []
    for k in range(len(levels) - 3, -1, -1):
        r = levels[k].where("state = 0")
        one = r.select(*DOC, F.col("no").alias("x"), F.col("rank").alias("rx"))
        two = r.select(F.col("__doc").alias("d"), F.col("__hash").alias("h"), F.col("no").alias("y"), F.col("rank").alias("ry"))
        # low begins as a power of two; levels below it add their own or nothing
        todo = pairs.where(F.col("low") >= 2 << k).withColumns({"x": F.col("no") + F.col("low"), "y": F.col("at") + F.col("low")})
        todo = todo.join(one, [*DOC, "x"], "left").join(two, ["d", "h", "y"], "left")
        todo = todo.withColumn("low", F.col("low") + F.when(F.col("rx") == F.col("ry"), 1 << k).otherwise(0))
        pairs = materialise(todo.select(pairs.columns).unionByName(pairs.where(F.col("low") < 2 << k)), "prefixes")
        used.append(pairs)
    out = materialise(leaves.drop("low").join(exact.unionByName(pairs.select("rank", "low")), "rank"), "suffix-array")
    release(*used)
    return out


# ---------------------------------------------------------------- LCP intervals

SCANNED = "kind int, part long, at long, low long, __doc long, __hash long, no long, need int, depth long, copies long, before long, varied boolean"
SCANNED_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in SCANNED.split(", "))])
LATER, RUN, LEFT = 0, 1, 2


class _Merge:
    """Neighbours of the suffix array, merged from the longest common prefix down.

    Items are (common prefix with the item before, first position, its need, depth, copies, line before,
    whether the lines before vary). What can't be merged yet, as a neighbour outside may share more, stays, in order.
    """

    def __init__(self):
        self.stack, self.later, self.runs = [], [], []

    def add(self, item):
        s = self.stack
        while len(s) > 1 and s[-1][0] >= item[0] and s[-1][0] >= s[-2][0]:
            self._join()
        s.append(item)

    def finish(self):
        while len(self.stack) > 1:
            self._join()
        for item in self.stack:
            self._close(item)
        self.stack = []

    def _close(self, item):
        if item[3] and item[6]:
            self.runs.append(item)

    def _join(self):
        y = self.stack.pop()
        x = self.stack[-1]
        depth = y[0]
        first, late = (x, y) if x[1] < y[1] else (y, x)
        if depth >= late[2]:
            self.later.append((late[1], depth))
        for item in (x, y):
            if item[3] != depth:
                self._close(item)
        varied = x[6] or y[6] or x[5] is None or x[5] != y[5]
        self.stack[-1] = (x[0], first[1], first[2], depth, x[4] + y[4], x[5], varied)

    def rows(self, part: int, rest: bool = False) -> list[tuple]:
        out = [(LATER, part, 0, n, *p, *[None] * 5) for p, n in self.later] + [(RUN, part, 0, i[3], *i[1], None, None, i[4], None, None) for i in self.runs]
        self.later, self.runs = [], []
        return out + [(LEFT, part, k, i[0], *i[1], *i[2:]) for k, i in enumerate(self.stack if rest else ())]


def _batch(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(SCANNED_ARROW)
    return pa.table([pa.array(c, t) for c, t in zip(columns, SCANNED_ARROW.types, strict=True)], schema=SCANNED_ARROW)


def _items(t):
    c = [t.column(x).to_pylist() for x in ("low", *AT, "need", "depth", "copies", "before", "varied")]
    for low, d, h, no, need, depth, copies, before, varied in zip(*c, strict=True):
        yield low, (d, h, no), need, depth, copies, before, varied


def _merging(last: bool):
    def merge(t: pa.Table) -> pa.Table:
        t, m = t.sort_by([("part", "ascending"), ("at", "ascending")]), _Merge()
        for item in _items(t):
            m.add(item)
        if last:
            m.finish()
        return _batch(m.rows(t["part"][0].as_py() // MERGE_LISTS, rest=True))

    return merge


def _intervals(array: DataFrame) -> DataFrame:
    """Rows of ``SCANNED`` kinds LATER (a position and the longest earlier copy of what starts there) and RUN (an interval's depth, copies and first position)."""

    def scan(batches):
        part, m = TaskContext.get().partitionId(), _Merge()
        for b in batches:
            for item in _items(b):
                m.add(item)
            yield from _batch(m.rows(part)).to_batches()
        yield from _batch(m.rows(part, rest=True)).to_batches()
        trim()

    made = array.repartitionByRange("rank").sortWithinPartitions("rank").mapInArrow(scan, schema(SCANNED))
    made = materialise(made, "intervals")
    out, left = made.where(F.col("kind") != LEFT), made.where(F.col("kind") == LEFT)
    lists = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        lists = -(-lists // MERGE_LISTS)

        grouped = materialise(left.groupBy(F.floor(F.col("part") / MERGE_LISTS)).applyInArrow(_merging(lists == 1), schema(SCANNED)), "intervals")
        out, left = out.unionByName(grouped.where(F.col("kind") != LEFT)), grouped.where(F.col("kind") == LEFT)
        if lists == 1:
            return out


def _analysed(df: DataFrame, id_col: str, text_col: str, min_words: int, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """Maximal repeated runs, and (__doc, __hash, no, lines) of all later copies of at least ``min_words`` words or ``min_lines`` lines."""
    every = materialise(segments(df, id_col=id_col, text_col=text_col), "segments")
    distinct = every.groupBy("s1", "s2").agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("copies"), F.first("lines").alias("lines"))
    distinct = materialise(distinct, "distinct-segments")
    # a later copy of a whole segment is one from its first line on
    worth = (F.size("lines") >= min_lines) | (F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"]) >= min_words)
    copied = distinct.where("copies > 1").select("s1", "s2", "first")
    copies = every.where(worth).join(copied, ["s1", "s2"]).where(F.struct(*AT) != F.col("first")).select(*AT, F.size("lines").cast("long").alias("lines"))
    number = F.transform("lines", lambda x, i: F.struct((F.col("first.no") + i).alias("no"), x["h1"].alias("h1"), x["h2"].alias("h2"), x["words"].alias("words")))
    firsts = distinct.select(F.col("first.__doc").alias("__doc"), F.col("first.__hash").alias("__hash"), "copies", number.alias("lines"))
    suffixes = _suffixes(firsts, min_words, min_lines)
    levels = _levels(suffixes)
    ended = levels[0].limit(0)
    for t in levels[1:]:
        ended = ended.unionByName(t.where("state = 1"))
    before = suffixes.select(*AT, "before")
    ended = materialise(ended.join(before, AT), "ended")
    # equal whole suffixes are one leaf, deep as they are long; all but the first are later copies
    one = F.struct(*AT, "need")
    leaves = ended.groupBy("rank").agg(F.min(one).alias("first"), F.max("n").alias("n"), F.max("low").alias("low"), F.max("len").cast("long").alias("len"), F.sum("copies").alias("copies"), F.min("before").alias("before"), F.max("before").alias("top"), F.count("before").alias("known"), F.count("*").alias("rows"))
    again = F.col("copies") > 1
    varied = again & ((F.col("known") < F.col("rows")) | F.coalesce(F.col("before") != F.col("top"), F.lit(False)))
    leaves = leaves.select("rank", "n", "low", "first.*", F.when(again, F.col("len")).otherwise(F.lit(0)).alias("depth"), "copies", "before", varied.alias("varied"))
    leaves = materialise(leaves, "leaves")
    found = _intervals(_common_prefixes(leaves, levels))
    late = ended.where("n > 1 and len >= need").join(leaves.select("rank", F.struct(*AT).alias("first")), "rank").where(F.struct(*AT) != F.col("first")).select(*AT, F.col("len").cast("long").alias("lines"))
    runs = found.where(F.col("kind") == RUN).select(*AT, F.col("low").alias("lines"), "copies")
    # a segment with copies that no other one shares its first line with
    apart = levels[0].where("state = 1 and copies > 1").join(before.where("before is null"), AT).select(*AT, F.col("len").cast("long").alias("lines"), "copies")
    return runs.unionByName(apart), copies.unionByName(late).unionByName(found.where(F.col("kind") == LATER).select(*AT, F.col("low").alias("lines")))


def repeated_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__doc, __hash, no, lines, copies): each maximal repeated run, at its first place. Its copies differ in the line after and in the line before."""
    return _analysed(df, id_col, text_col, MIN_WORDS, MIN_LINES)[0]


def later_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """(__doc, __hash, no, lines): from each place the longest run with an earlier copy, if it is worth deleting."""
    return _analysed(df, id_col, text_col, min_words, min_lines)[1]


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` with later copies of repeated runs cut from ``text_col``, and lines_deleted (long; replaces a column of that name)."""
    runs = later_copies(df, id_col=id_col, text_col=text_col, min_words=min_words, min_lines=min_lines)
    both = _keyed(df, id_col, text_col).join(_ranges(runs), DOC, "left")
    lines, gone = F.split(text_col, "\n", -1), F.col("__gone")
    # what stands between the deleted ranges, each range of lines copied once
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["end"])
    until = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i)["no"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, begin(i) + 1, until(i) - begin(i))))
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    deleted = F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["no"]), F.lit(0).cast("long"))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns if c != "lines_deleted"], deleted.alias("lines_deleted"))


def _ranges(runs: DataFrame) -> DataFrame:
    """(__doc, __hash, __gone): overlapping and touching runs of a document as ranges [no, end), in order."""
    in_doc = Window.partitionBy(*DOC).orderBy("no")
    end = F.col("no") + F.col("lines")
    reached = F.max(end).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.repartition(*DOC).withColumn("first", (reached.isNull() | (F.col("no") > reached)).cast("int"))
    numbered = marked.withColumn("range", F.sum("first").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = numbered.groupBy(*DOC, "range").agg(F.min("no").alias("no"), F.max(end).alias("end"))
    return ranges.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("no", "end"))).alias("__gone"))


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "lines_deleted", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\t-\r ]+')) AS n,
  lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(line, 3) OVER d AS l3 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
s AS (SELECT *, n + lead(n, 1) OVER d AS n2, n + lead(n, 1) OVER d + lead(n, 2) OVER d AS n3,
  row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS r1, row_number() OVER (PARTITION BY line, l1 ORDER BY doc_id, no) AS r2,
  row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, no) AS r3, row_number() OVER (PARTITION BY line, l1, l2, l3 ORDER BY doc_id, no) AS r4
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
runs AS (SELECT doc_id, no, CASE WHEN l3 IS NOT NULL AND r4 > 1 THEN 4 WHEN l2 IS NOT NULL AND r3 > 1 AND n3 >= 8 THEN 3
  WHEN l1 IS NOT NULL AND r2 > 1 AND n2 >= 8 THEN 2 WHEN r1 > 1 AND n >= 8 THEN 1 ELSE 0 END AS size FROM s),
c AS (SELECT l.doc_id, l.no, l.line, max(r.no + r.size) OVER (PARTITION BY l.doc_id ORDER BY l.no) > l.no AS gone FROM l JOIN runs r ON l.doc_id = r.doc_id AND l.no = r.no)
SELECT d.doc_id, coalesce(x.lines_deleted, 0) AS lines_deleted, CASE WHEN d.text IS NOT NULL THEN coalesce(x.kept_md5, md5('')) END AS kept_md5
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS lines_deleted, md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_md5 FROM c GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
