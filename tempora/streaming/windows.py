"""Event-time windows over a stream: tumbling tempo windows, sessions, and the camera in a state store.

Streams carry ``timestamp``; a ``timestamp_ntz`` column is cast (UTC sessions) before it can have a watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tempora.operators.camera import TRACK, Camera, CameraConfig, Face, State, resolve


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tempo(df: DataFrame, *, key: str, ts: str = "ts", value: str = "value", size: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling windows of a key: events, sum and highest value. Rows later than the watermark are dropped by Spark."""
    by = timed(df, ts, late).groupBy(F.window(ts, size).alias("w"), key)
    return by.agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.max(value).alias("peak")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total", "peak")


def sessions(df: DataFrame, *, key: str, ts: str = "ts", value: str = "value", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: rows at most ``gap`` apart."""
    by = timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return by.agg(F.count("*").alias("events"), F.max(value).alias("peak")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "peak")


class CameraProcessor(StatefulProcessor):
    """The camera of one episode, its state kept between batches of frames (t, diff, cx, cy, w, h, score; one row per face or frame)."""

    def __init__(self, cfg: CameraConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("camera", "raw binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cam = Camera(self.cfg, pickle.loads(self.state.get()[0]) if self.state.exists() else State())
        frames = pd.concat(list(rows)).sort_values("t", kind="stable")
        out = []
        for t, f in frames.groupby("t", sort=True):
            seen = [Face(complex(r.cx, r.cy), r.w, r.h, r.score) for r in f.itertuples() if not pd.isna(r.cx)]
            diff = f["diff"].iloc[0]
            at, zoom, held, cut = cam.step(float(t), seen, None if pd.isna(diff) else float(diff))
            out.append((key[0], float(t), at.real, at.imag, zoom, held, cut))
        self.state.update((pickle.dumps(cam.s),))
        yield pd.DataFrame(out, columns=["episode_id", "t", "cx", "cy", "zoom", "has_face", "is_cut"])

    def close(self) -> None:
        pass


def camera_track(frames: DataFrame, cfg: CameraConfig | None = None, key_type: str = "long") -> DataFrame:
    """Camera states of a stream of frames; needs the RocksDB state store provider."""
    return frames.groupBy("episode_id").transformWithStateInPandas(CameraProcessor(cfg or resolve()), f"episode_id {key_type}, {TRACK}", "Append", "None")
