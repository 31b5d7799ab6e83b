"""Sessions that lose no row, and folders watched for new recordings.

Spark's own session windows drop rows that come after the watermark has passed them. Here sessions are merged in a state store,
and such rows come out as rows of a second kind, so that on-time and late events together are the input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tempora.sources.files import VIDEO_SUFFIXES

SESSION, LATE = "session", "late"


class SessionProcessor(StatefulProcessor):
    """Open sessions of one key as a short list of [start, end, events, peak] in milliseconds, closed by timers of the watermark.

    Sessions a row lies between are merged; at most those within the watermark's delay are open, so the list is short.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions string")

    def _load(self) -> list:
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def _save(self, sessions: list) -> None:
        if sessions:
            self.open.update((json.dumps(sessions),))
        else:
            self.open.clear()

    def _rows(self, key, kind: str, sessions: list) -> pd.DataFrame:
        at = lambda i: pd.to_datetime([s[i] for s in sessions], unit="ms", utc=True).tz_localize(None)
        return pd.DataFrame({"key": key[0], "kind": kind, "start": at(0), "end": at(1), "events": [s[2] for s in sessions], "peak": [s[3] for s in sessions]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, sessions, late = timerValues.getCurrentWatermarkInMs(), self._load(), []
        for part in rows:
            for at, value in zip(part["at_ms"].tolist(), part["value"].tolist(), strict=True):
                if at < passed:
                    late.append([at, at, 1, value])
                    continue
                new, apart = [at, at, 1, value], []
                for s in sessions:
                    if s[0] - self.gap <= at <= s[1] + self.gap:
                        new = [min(new[0], s[0]), max(new[1], s[1]), new[2] + s[2], max(new[3], s[3])]
                    else:
                        apart.append(s)
                sessions = sorted([*apart, new])
        self._save(sessions)
        for s in sessions:
            self.handle.registerTimer(s[1] + self.gap + 1)
        if late:
            yield self._rows(key, LATE, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, sessions = timerValues.getCurrentWatermarkInMs(), self._load()
        # no row on time can reach these any more
        done = [s for s in sessions if s[1] + self.gap < passed]
        self._save([s for s in sessions if s not in done])
        if done:
            yield self._rows(key, SESSION, done)

    def close(self) -> None:
        pass


def sessions_with_late(df: DataFrame, *, key: str, ts: str = "ts", value: str = "value", gap_s: float = 1800.0, late: str = "1 hour") -> DataFrame:
    """(key, kind, start, end, events, peak): sessions once they are over, and each row that came too late as a row of its own.

    Rows at most ``gap_s`` apart are one session. Rows without a key or time have no session and go. Needs the RocksDB
    state store provider. Sessions still open when a stream ends are in its checkpoint, not in its output.
    """
    marked = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    # a plain number: a column that carries the watermark would have late rows dropped before they get here
    rows = marked.select(F.col(key).alias("key"), F.unix_millis("__at").alias("at_ms"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(int(gap_s * 1000)), f"key {kind}, kind string, start timestamp_ntz, end timestamp_ntz, events long, peak double", "Append", "EventTime")


def new_videos(spark: SparkSession, folder: str, *, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, length, modificationTime) of the videos of a folder, each once, over restarts of the query as well.

    Spark's file source keeps the files it has handed out in the query's checkpoint. Contents are not read.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    x = spark.readStream.schema(kind).format("binaryFile").option("maxFilesPerTrigger", per_batch).load(folder)
    return x.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*VIDEO_SUFFIXES)).select("path", "length", "modificationTime")
