"""Streams: sessions with late rows as a second output, and folders watched over restarts."""

from datetime import datetime, timedelta

from tempora.streaming import late

BASE = datetime(2024, 1, 1)


def drain(df, checkpoint, sink):
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_sessions_and_late_rows_are_the_input(spark, tmp_path):
    batches = [
        [("a", 0, 1.0), ("a", 10, 5.0), ("b", 5, 3.0), (None, 5, 1.0), ("a", None, 1.0)],
        [("a", 15, 4.0), ("b", 1000, 1.0)],  # the first joins the open session
        [("a", 20, 9.0), ("a", 1001, 1.0), ("b", 990, 7.0)],  # the first is far behind the watermark now
        [("c", 5000, 0.0)],
        [("c", 5001, 0.5), ("b", 3, 2.0)],
        [("d", 99000, 0.0)], [("d", 99001, 0.0)],
    ]
    src, schema = tmp_path / "in", "k string, ts timestamp_ntz, value double"
    for i, rows in enumerate(batches):  # a restart of the query before each batch
        made = [(k, None if s is None else BASE + timedelta(seconds=s), v) for k, s, v in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        drain(late.sessions_with_late(stream, key="k", gap_s=30, late="60 seconds"), str(tmp_path / "state"), str(tmp_path / "out"))
    at = lambda t: (t - BASE).total_seconds()
    got = sorted((r["key"], r["kind"], at(r["start"]), at(r["end"]), r["events"], r["peak"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", "late", 20, 20, 1, 9.0), ("a", "session", 0, 15, 3, 5.0), ("a", "session", 1001, 1001, 1, 1.0),
        ("b", "late", 3, 3, 1, 2.0), ("b", "session", 5, 5, 1, 3.0), ("b", "session", 990, 1000, 2, 7.0), ("c", "session", 5000, 5001, 2, 0.5),
    ]
    # on time, late and still open together are what came in
    assert sum(r[4] for r in got) + 2 == sum(k is not None and s is not None for rows in batches for k, s, _ in rows)


def test_each_video_once_over_restarts(spark, tmp_path):
    folder, found = tmp_path / "videos", []
    folder.mkdir()
    for names in (["a.mp4", "notes.txt", "B.MKV"], [], ["c.mov", "a2.mp4"], ["d.avi"]):
        for n in names:
            (folder / n).write_bytes(b"x" * 5)
        drain(late.new_videos(spark, str(folder), per_batch=1), str(tmp_path / "seen"), str(tmp_path / "list"))
        rows = spark.read.parquet(str(tmp_path / "list")).collect()
        found = sorted(r["path"].split("/")[-1] for r in rows)
        assert all(r["length"] == 5 for r in rows)
    assert found == ["B.MKV", "a.mp4", "a2.mp4", "c.mov"]
