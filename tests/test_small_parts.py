"""Parts that no query reaches: scans, sinks, signal helpers, fallbacks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import dsp
from tempora.operators import events, moments
from tempora.plans.config import Scoring, Validation
from tempora.sources import files


def test_videos_of_a_folder(spark, tmp_path):
    for n in ("b.MP4", "a.mkv", "c.mov", "d.txt", "mp4"):
        (tmp_path / n).write_bytes(b"12345")
    rows = files.find_videos(spark, str(tmp_path)).collect()
    assert [r["path"].split("/")[-1] for r in rows] == ["a.mkv", "b.MP4", "c.mov"] and {r["length"] for r in rows} == {5} and "content" not in rows[0]
    assert files.find_videos(spark, str(tmp_path), content=True).first()["content"] == b"12345"


def test_artifacts_are_written_by_episode(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x"), (1, 0.25, None), (2, 1.0, "y")], "episode_id long, score double, text string")
    files.write_artifact(df, str(tmp_path / "out"))
    files.write_artifact(df.where("episode_id = 2"), str(tmp_path / "out"))  # again: what was there goes
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["episode_id=2"]
    assert [(r["episode_id"], r["score"], r["text"]) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(2, 1.0, "y")]


def test_debug_output_takes_the_form_of_its_rows(spark, tmp_path):
    files.write_debug(spark.createDataFrame([("a line",)], "value string"), str(tmp_path / "text"))
    files.write_debug(spark.createDataFrame([(1, "a")], "n int, value string"), str(tmp_path / "rows"))
    part = lambda name: "".join(p.read_text() for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
    assert part("text") == "a line\n" and json.loads(part("rows")) == {"n": 1, "value": "a"}


def test_frames_drop_what_is_left(spark):
    df = spark.createDataFrame([([float(i) for i in range(n)],) for n in (0, 2, 3, 7)], "s array<double>")
    got = [r["f"] for r in df.select(dsp.frames_of(F.col("s"), 3).alias("f")).collect()]
    assert got == [[], [], [[0, 1, 2]], [[0, 1, 2], [3, 4, 5]]]


def test_thumbnails_are_grey_levels(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (50, 70, 3), dtype=np.uint8)
    df = spark.createDataFrame([(px.tobytes(), 50, 70), (bytes([255] * 12), 2, 2), (None, 2, 2), (b"", 0, 0), (b"x", None, 2)], "px binary, h int, w int")
    got = [r["t"] for r in df.select(dsp.grey_thumbnail(F.col("px"), F.col("h"), F.col("w"), 4).alias("t")).collect()]
    at = lambda n: [0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1]
    assert got[0] == pytest.approx([float(px[y, x] @ [0.299, 0.587, 0.114]) / 255 for y in at(50) for x in at(70)])
    assert got[1] == pytest.approx([1.0] * 16) and got[2:] == [None] * 3


def test_box_of_what_is_transparent(spark):
    a = np.full((6, 9), 255, np.uint8)
    a[2:4, 3:7] = 0
    a[1, 8] = 1  # nearly is not fully
    df = spark.createDataFrame([(a.tobytes(), 6, 9), (bytes([9] * 4), 2, 2), (None, 2, 2), (b"x", None, 1)], "a binary, h int, w int")
    got = [tuple(r["b"]) for r in df.select(dsp.alpha_box(F.col("a"), F.col("h"), F.col("w")).alias("b")).collect()]
    assert got == [(3, 2, 7, 4), (None,) * 4, (None,) * 4, (None,) * 4]


def test_debounced_times(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.3, 0.31, 0.7, 0.9],), ([],), ([5.0],)], "t array<double>")
    assert [r["d"] for r in df.select(events.debounced(F.col("t"), 0.3).alias("d")).collect()] == [[0.0, 0.3, 0.7], [], [5.0]]


def test_whole_episode_as_a_moment(spark):
    eps = spark.createDataFrame([(1, 20.0), (2, 0.2)], "episode_id long, duration_s double")
    got = moments.full_length(eps, F.lit("T")).orderBy("episode_id").collect()
    assert [(r["title"], [tuple(s) for s in r["segs"]], r["duration_s"]) for r in got] == [("T", [(0, 20)], 20), ("T", [(0, 1)], 1)]


def test_candidates_that_no_moment_covers(spark):
    c = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 8.0, 18.0), (1, 3, 30.0, 40.0), (2, 1, 0.0, 10.0)], "episode_id long, rank int, start_s double, end_s double")
    m = spark.createDataFrame([(1, [{"start": 0.0, "end": 4.0}, {"start": 5.0, "end": 9.0}]), (1, [{"start": 30.0, "end": 35.0}])], "episode_id long, segs array<struct<start:double,end:double>>")
    # 8 of 10 are covered, 1 of 10, and just half
    assert sorted((r["episode_id"], r["rank"]) for r in moments.uncovered(c, m).collect()) == [(1, 2), (1, 3), (2, 1)]


def test_silent_moments_are_fatal_unless_loud(spark):
    from tempora.operators.timeline import build_timeline

    eps = spark.createDataFrame([(1, 60.0)], "episode_id long, duration_s double")
    seg = spark.createDataFrame([(1, 0.0, 10.0, 30)], "episode_id long, start_s double, end_s double, words int")
    audio = spark.createDataFrame([(1, 40.0, 50.0, 0.9, 0.4, "strong")], "episode_id long, start_s double, end_s double, peak double, sharpness double, category string")
    faces = spark.createDataFrame([], "episode_id long, start_s double, end_s double, faces int, max_face_ratio double")
    none = spark.createDataFrame([], "episode_id long, t double, diff double")
    t = build_timeline(eps, seg, audio, faces, none.select("episode_id", "t"), none, 0.5)
    m = spark.createDataFrame([(1, k, [{"start": a, "end": b}]) for k, a, b in (("spoken", 1.0, 9.0), ("silent", 20.0, 30.0), ("loud", 41.0, 49.0))], "episode_id long, key string, segs array<struct<start:double,end:double>>")
    got = {r["key"]: r["fatal"] for r in moments.evaluate(m, t, None, Scoring(), Validation()).collect()}
    assert got["spoken"] is None and got["loud"] is None and got["silent"] == moments.EMPTY
