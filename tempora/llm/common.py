"""What the operators of this package share: tables, scratch space, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters handled at a time inside one task; bounds what Python holds of a long batch.
SLICE_CHARS = 1 << 19


#: Rows of an Arrow batch, where the session has Spark's default. Rows are whole texts here, and an
#: executor holds several batches at a time outside its heap.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back to the system: a worker's at the end of a task, as idle ones keep theirs, and the driver's between jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it, whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/tempora-scratch-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    trim()  # the driver's own, of models it made
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends."""
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            p, fs = _file_system(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)


def slices(lengths: Iterable[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to about ``limit``; each holds one item at least."""
    lo = total = hi = 0
    for n in lengths:
        if hi > lo and total + n > limit:
            yield lo, hi
            lo, total = hi, 0
        total += n
        hi += 1
    if hi > lo:
        yield lo, hi


def map_texts(df: DataFrame, keep: list[str], text: str, schema: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """Columns ``keep`` plus what a row function yields for each text, over Arrow batches.

    ``make()`` runs once in each task and returns ``f(list of texts) -> list of columns``, called
    for slices of a batch. Null texts arrive as None. Only ``keep`` and ``text`` reach Python.
    """
    out_schema = T.StructType([df.schema[c] for c in keep] + schema.fields)
    arrow = [arrow_type(f.dataType) for f in schema.fields]
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            col = b.column(len(keep))
            sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
            for lo, hi in slices(sizes):
                part = b.slice(lo, hi - lo)
                made = f(col.slice(lo, hi - lo).to_pylist())
                cols = [part.column(i) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del f
        trim()

    small_batches(df.sparkSession)
    return df.select(*keep, text).mapInArrow(run, out_schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def ascii_lower(c):
    """A-Z to a-z and nothing else, as the contracts ask."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
