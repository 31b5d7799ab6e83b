"""PCM recordings as a Spark data source: a WAV file is read as ranges of its bytes, by as many tasks as it has splits.

``spark.read.format("pcm_frames").load(folder)`` gives (path, frame, samples): mono windows scaled to [-1, 1], channels
averaged, a rest shorter than a window dropped. Options: ``sample_rate`` of the result (a file of another rate is
sampled at the nearest earlier source sample), ``window_ms``, ``split_bytes``.

The driver lists the folder and reads each header once; a record of a few numbers for each file is all it keeps, as
Spark's own file index does. Splits fall between windows, so a window's samples never depend on the split. Small files
share a task. Files are opened through Arrow's file systems (local, HDFS, S3, GCS), at a byte offset.

Streams without a length (0 or all ones in the header), and files cut short, reach to their last whole sample. A file
that is no PCM WAV, or has no data, gives no row; ``headers`` names it with the reason.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a recording that are decoded at a time.
READ_BYTES = 4 << 20
# Sample formats of a WAV header, and lengths that mean "unknown".
INTEGER, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
UNKNOWN_LENGTHS = (0, 0xFFFFFFFF)


@dataclass(frozen=True)
class Header:
    """Where a file's samples are and how they are coded; ``status`` is ok, or why there are none."""

    path: str
    status: str = "ok"
    rate: int = 0
    channels: int = 0
    bits: int = 0
    floating: bool = False
    offset: int = 0
    samples: int = 0

    @property
    def block(self) -> int:
        """Bytes of one sample of all channels."""
        return self.channels * self.bits // 8


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_header(fs: arrow_fs.FileSystem, path: str) -> Header:
    """The header of a WAV file; chunks other than format and data are passed over."""
    try:
        with fs.open_input_file(path) as f:
            size, at, form = f.size(), 12, None
            head = f.read_at(min(12, size), 0)
            if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
                return Header(path, "no wav")
            while at + 8 <= size:
                kind, length = struct.unpack("<4sI", f.read_at(8, at))
                if kind == b"fmt ":
                    raw = f.read_at(min(40, length), at + 8)
                    code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
                    form = (struct.unpack("<H", raw[24:26])[0] if code == EXTENSIBLE and len(raw) >= 26 else code, channels, rate, bits)
                if kind == b"data":
                    break
                at += 8 + length + length % 2
            else:
                return Header(path, "no data")
            if form is None or form[0] not in (INTEGER, FLOAT) or not form[1] or not form[2] or form[3] not in ((32, 64) if form[0] == FLOAT else (8, 16, 24, 32)):
                return Header(path, "unknown format")
            have = size - at - 8
            data = have if length in UNKNOWN_LENGTHS else min(length, have)
            code, channels, rate, bits = form
            samples = data // (channels * bits // 8)
            return Header(path, "ok" if samples else "no data", rate, channels, bits, code == FLOAT, at + 8, samples)
    except (OSError, struct.error) as e:
        return Header(path, f"unreadable: {type(e).__name__}")


def list_headers(folder: str, workers: int = 32) -> list[Header]:
    """Headers of the WAV files of a folder, or of one file, in order of path."""
    fs, path = file_system(folder)
    info = fs.get_file_info(path)
    files = [info] if info.is_file else fs.get_file_info(arrow_fs.FileSelector(path, recursive=False))
    names = sorted(f.path for f in files if f.is_file and f.path.lower().endswith(".wav") and not f.base_name.startswith((".", "_")))
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda n: read_header(fs, n), names))


def decode(raw: bytes, h: Header) -> np.ndarray:
    """Mono samples in [-1, 1] of whole blocks; channels are averaged."""
    if h.floating:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    elif h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif h.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128.0) / 128.0
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}") / float(1 << h.bits - 1)
    return x.reshape(-1, h.channels).mean(axis=1)


@dataclass(frozen=True)
class Window:
    """How frames are laid over a recording: ``size`` samples of ``rate`` each."""

    rate: int
    size: int

    def frames(self, h: Header) -> int:
        return (h.samples * self.rate // h.rate) // self.size

    def source(self, sample, h: Header):
        """The sample of the file that stands for a sample of the result: at its time, or the last before it."""
        return sample * h.rate // self.rate

    def read(self, fs: arrow_fs.FileSystem, h: Header, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first frame, frames x samples) of the frames [lo, hi), a few MB at a time."""
        step = max(1, READ_BYTES * self.rate // (self.size * h.block * h.rate))
        with fs.open_input_file(h.path) as f:
            for at in range(lo, hi, step):
                end = min(hi, at + step)
                index = self.source(np.arange(at * self.size, end * self.size, dtype=np.int64), h)
                first, last = int(index[0]), int(index[-1])
                mono = decode(f.read_at((last - first + 1) * h.block, h.offset + first * h.block), h)
                yield at, mono[index - first].reshape(-1, self.size)


@dataclass
class Splits(InputPartition):
    """Ranges of frames that one task reads: (header, first frame, frame after the last)."""

    ranges: list[tuple[Header, int, int]]


def plan_splits(headers: list[Header], window: Window, split_bytes: int) -> list[Splits]:
    """Ranges of about ``split_bytes``; files smaller than that share a task."""
    out: list[Splits] = []
    room = 0
    for h in headers:
        frames = window.frames(h) if h.status == "ok" else 0
        frame_bytes = max(1, window.size * h.block * h.rate // window.rate) if frames else 1
        each, lo = max(1, split_bytes // frame_bytes), 0
        while lo < frames:
            if room < frame_bytes or not out:
                out.append(Splits([]))
                room = split_bytes
            hi = min(frames, lo + max(1, min(each, room // frame_bytes)))
            out[-1].ranges.append((h, lo, hi))
            room -= (hi - lo) * frame_bytes
            lo = hi
    return out


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        rate = int(options.get("sample_rate", 16000))
        self.folder, self.split_bytes = options["path"], int(options.get("split_bytes", 64 << 20))
        self.window = Window(rate, max(1, int(rate * float(options.get("window_ms", 40.0)) / 1000.0)))

    def partitions(self) -> list[InputPartition]:
        # without a partition Spark would call read() with none
        return plan_splits(list_headers(self.folder), self.window, self.split_bytes) or [Splits([])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.folder)
        for h, lo, hi in partition.ranges:
            for at, x in self.window.read(fs, h, lo, hi):
                offsets = pa.array(np.arange(0, x.size + 1, self.window.size, dtype=np.int32))
                samples = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([h.path] * len(x)), pa.array(np.arange(at, at + len(x))), samples], names=["path", "frame", "samples"])


class PcmFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_frames"

    def schema(self) -> str:
        return "path string, frame long, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self.options)


def read_pcm(spark: SparkSession, folder: str, *, sample_rate: int = 16000, window_ms: float = 40.0, split_bytes: int = 64 << 20) -> DataFrame:
    """(path, frame, samples) of a folder's WAV files, or of one file, read by byte ranges."""
    spark.dataSource.register(PcmFrames)
    return spark.read.format("pcm_frames").option("sample_rate", sample_rate).option("window_ms", window_ms).option("split_bytes", split_bytes).load(folder)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status, rate, channels, bits, samples, duration_s) of a folder's WAV files: which can be read, and why not."""
    rows = [(h.path, h.status, h.rate, h.channels, h.bits, h.samples, h.samples / h.rate if h.rate else 0.0) for h in list_headers(folder)]
    return spark.createDataFrame(rows, "path string, status string, rate int, channels int, bits int, samples long, duration_s double")


def stream_header(rate: int, channels: int) -> bytes:
    """Header of 16-bit PCM whose length is not known beforehand."""
    form = struct.pack("<HHIIHH", INTEGER, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", UNKNOWN_LENGTHS[1]) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", UNKNOWN_LENGTHS[1])


def write_wav(samples: DataFrame, folder: str, *, rate: int, channels: int) -> DataFrame:
    """Streams ``folder/<name>.wav`` of 16-bit samples from rows (name, at, values: an integer for each channel), in order of ``at``.

    Gives (name, samples) of what was written. The rows of a recording meet in one task, sorted, and are written as they
    pass. A file gets its name only when it is whole, so a task may run again. Null values are silence.
    """
    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        now = out = part = None
        n = 0

        def end():
            out.close()
            fs.move(part, f"{base}/{now}.wav")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n], pa.int64())], names=["name", "samples"])

        for b in batches:
            names = b.column(0).to_pylist()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            flat = b.column(1)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if names[lo] != now:
                    if out:
                        yield end()
                    now, n, part = names[lo], 0, f"{base}/.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(part)
                    out.write(stream_header(rate, channels))
                x = np.array([v if v is not None else [0] * channels for v in flat.slice(lo, hi - lo).to_pylist()], dtype=np.float64)
                out.write(np.clip(np.nan_to_num(x), -32768, 32767).astype("<i2").tobytes())
                n += hi - lo
        if out:
            yield end()

    by = samples.where("name is not null").repartition("name").sortWithinPartitions("name", "at")
    return by.select("name", "values").mapInArrow(run, "name string, samples long")
