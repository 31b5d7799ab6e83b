"""Invariants and exact values of the engine's own operators, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tempora.functions import dsp, intervals, text
from tempora.operators import camera, events, matching, moments, narrative, scoring, timeline
from tempora.plans.config import Scoring, Validation, normal_weights, window_lengths
from tempora.sources import channels


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.fixture(scope="module")
def inputs(spark):
    seg = spark.createDataFrame([(1, i, i * 3.0, i * 3.0 + 2.4, f"line {i}", 6) for i in range(20)], "episode_id long, seg_id long, start_s double, end_s double, text string, words int")
    audio = spark.createDataFrame([(1, 10.0, 11.0, 0.9, 0.4, "strong"), (1, 40.0, 41.0, 0.3, 0.1, "soft")], "episode_id long, start_s double, end_s double, peak double, sharpness double, category string")
    faces = spark.createDataFrame([(1, 5.0, 25.0, 1, 0.12)], "episode_id long, start_s double, end_s double, faces int, max_face_ratio double")
    cuts = spark.createDataFrame([(1, t) for t in (4.0, 12.0, 18.0, 30.0, 44.0)], "episode_id long, t double")
    motion = spark.createDataFrame([(1, float(t), 0.1 + 0.01 * (t % 5)) for t in range(0, 60, 2)], "episode_id long, t double, diff double")
    hooks = spark.createDataFrame([(1, 9.5, 11.0, 0.8, "question", "why?")], "episode_id long, start_s double, end_s double, score double, type string, text string")
    eps = spark.createDataFrame([(1, 60.0), (2, 0.0)], "episode_id long, duration_s double")
    return eps, seg, audio, faces, cuts, motion, hooks


def test_timeline_has_a_cell_for_each_half_second(spark, inputs):
    eps, seg, audio, faces, cuts, motion, _ = inputs
    rows = timeline.build_timeline(eps, seg, audio, faces, cuts, motion, 0.5).collect()
    assert [r["episode_id"] for r in rows] == [1]
    t = rows[0]
    assert len(t["speech"]) == 120 and sum(t["cuts"]) == 5
    assert sum(t["words"]) == pytest.approx(120)
    assert t["face"][9] == 0 and all(v == 1 for v in t["face"][10:50])
    assert max(t["audio_energy"]) == 1 and t["audio_energy"][80] == pytest.approx(0.6 / 3)


def test_candidates_are_ranked_and_apart(spark, inputs):
    eps, seg, audio, faces, cuts, motion, hooks = inputs
    t = timeline.build_timeline(eps, seg, audio, faces, cuts, motion, 0.5)
    cfg = Scoring.resolve({"max_candidates": 4})
    rows = scoring.build_candidates(t, hooks, 8, 16, cfg).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and 1 < len(rows) <= 4
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))
    for i, a in enumerate(rows):
        assert 0 <= a["score"] <= 1 and all(0 <= v <= 1 for v in a["signals"])
        for b in rows[:i]:
            shared = max(0, min(a["end_s"], b["end_s"]) - max(a["start_s"], b["start_s"]))
            assert shared / min(a["duration_s"], b["duration_s"]) <= 0.45 + 1e-9
    short = scoring.build_candidates(t, hooks, 90, 120, cfg).collect()
    assert len(short) == 1 and (short[0]["start_s"], short[0]["end_s"]) == (0, 60)


def test_config_zeros():
    c = Scoring.resolve({"words_per_s_ref": 0, "length_steps": 0, "empty_window_penalty": 0, "nms_overlap": 0, "weights": {"face": -1, "hook": "x", "odd": 3}})
    assert (c.words_per_s_ref, c.length_steps, c.empty_window_penalty, c.nms_overlap) == (3.0, 1, 1.0, 0.0)
    assert c.weights["face"] == 0 and sum(c.weights.values()) == pytest.approx(1) and "odd" not in c.weights
    assert normal_weights({k: 0 for k in c.weights}) == normal_weights()
    assert window_lengths(10, 30, 3) == [10, 20, 30] and window_lengths(0.2, 0.1, 3) == [1.0]


def test_islands_close_at_the_end(spark):
    df = spark.createDataFrame([(1, i, on, s) for i, (on, s) in enumerate(zip([False, True, True, True, False, True], [0.0, 0.5, 0.9, 0.4, 0.0, 0.3]))], "k int, i int, on boolean, s double")
    rows = events.mask_events(df, key="k", frame="i", on="on", strength="s", frame_s=0.1).orderBy("start_s").collect()
    assert [(r["start_s"], r["end_s"], r["peak"], r["frames"]) for r in rows] == [(0.1, 0.4, 0.9, 3), (0.5, 0.6, 0.3, 1)]


def test_gap_merge_is_a_fold_in_time_order(spark):
    ev = [(1, 0.0, 0.16, 0.5, 0.4, 4, "soft"), (1, 0.2, 0.3, 0.9, 0.8, 2, "strong"), (1, 0.34, 0.4, 0.2, 0.1, 1, "soft"), (1, 1.0, 1.1, 0.3, 0.3, 1, "soft")]
    df = spark.createDataFrame(ev, "k int, start_s double, end_s double, peak double, mean double, frames int, category string")
    a, b = events.merge_gaps(df, key="k").orderBy("start_s").collect()
    assert (a["start_s"], a["end_s"], a["peak"], a["frames"], a["category"]) == (0.0, 0.4, 0.9, 7, "strong")
    assert a["mean"] == pytest.approx(((0.4 + 0.8) / 2 + 0.1) / 2) and b["frames"] == 1


def test_hooks_by_cue(spark):
    lines = {"Почему так?": ("question", 0.70), "признаюсь, устал": ("confession", 0.7), "я покажу дальше": ("promise", 0.75), "ну и...": ("interruption", 0.6), "обычная фраза": None}
    for line, want in lines.items():
        got = one(spark, narrative.hook_of(F.lit(line)).alias("h"))["h"]
        assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("spans", "kw", "want"), [
    ([(-5, 10)], {}, [(0, 10)]),
    ([(0, 10), (5, 15)], {}, [(0, 15)]),
    ([(0, 50)], {"max_s": 30}, [(0, 30)]),
    ([(10, 14)], {"min_s": 10}, [(10, 20)]),
    ([(0, 2)], {"min_s": 20, "duration": 10}, []),
    ([(0, 5), (5.01, 9)], {}, [(0, 9)]),
    ([(1.3, 8.2)], {"points": [1.0, 8.0, 30]}, [(1.0, 8.0)]),
])
def test_repair(spans, kw, want):
    fix = intervals.Repair(Validation(), kw.get("min_s", 1), kw.get("max_s", 60))
    assert fix(spans, kw.get("points", []), kw.get("duration", 100))[0] == want


def test_interval_algebra(spark):
    sp = lambda *x: F.array(*[intervals.span(F.lit(float(a)), F.lit(float(b))) for a, b in x])
    r = one(spark, intervals.subtract(intervals.span(F.lit(0.0), F.lit(10.0)), sp((2, 4), (6, 12))).alias("s"), intervals.free_gap(F.lit(5.0), sp((2, 4), (6, 12)), F.lit(20.0)).alias("g"), intervals.snap(F.lit(5.0), F.array(F.lit(4.8), F.lit(5.2)), F.lit(0.6), F.lit(0.0), F.lit(9.0)).alias("n"), intervals.overlap_ratio(sp((0, 10)), sp((5, 20))).alias("o"))
    assert [tuple(x) for x in r["s"]] == [(0, 2), (4, 6)] and tuple(r["g"]) == (4, 6) and r["n"] == 4.8 and r["o"] == 0.5


def test_answers_in_every_form(spark):
    raw = ['```json\n{"moment_1": {"title": "A", "segments": {"segment_2": {"start": 5, "end": 6}, "segment_1": {"start": 1, "end": 2}}}}\n```', '[{"title": "B", "segments": [{"start": 3, "end": 4}, {"start": 9, "end": 8}]}, {"start": 1, "end": 7}]', '{"m": "{\\"start\\": 2, \\"end\\": 3}"}', "not json", None]
    df = spark.createDataFrame(list(enumerate(raw)), "episode_id int, raw_json string")
    got = {(r["episode_id"], r["key"]): [tuple(s) for s in r["segs"]] for r in moments.decode_answers(df).collect()}
    assert got == {(0, "moment_1"): [(1, 2), (5, 6)], (1, "moment_1"): [(3, 4)], (1, "moment_2"): [(1, 7)], (2, "m"): [(2, 3)]}


def test_select_moments_fills_up(spark, inputs):
    eps, seg, audio, faces, cuts, motion, hooks = inputs
    t = timeline.build_timeline(eps, seg, audio, faces, cuts, motion, 0.5)
    c = scoring.build_candidates(t, hooks, 8, 16, Scoring())
    answers = spark.createDataFrame([(1, '{"moment_1": {"title": "A", "segments": {"segment_1": {"start": 9, "end": 20}}}}')], "episode_id long, raw_json string")
    rows = moments.select_moments(answers, episodes=eps, timeline=t, hooks=hooks, candidates=c, segments=seg, cuts=cuts, min_s=8, max_s=16, min_count=3, max_count=5, scoring=Scoring()).orderBy("moment_no").collect()
    assert [r["source"] for r in rows] == ["llm", "heuristic_candidate", "heuristic_candidate"] and rows[0]["title"] == "A"


def test_text(spark):
    r = one(
        spark, text.subtitle(F.lit("это <h1>важно</h1>, очень_да!")).alias("a"), text.chunks(text.timed_tokens(text.tokens(F.lit("один <hl>два три</hl> пять")), F.lit(0.0), F.lit(6.0)), 2).alias("c"), text.episode_range(F.lit("2-3,7,1,1")).alias("e"),
        text.show_name(F.lit("Ад_1080p_серия"), "x").alias("n"), text.clip_title(F.lit("moment_1"), F.lit("f_b")).alias("t"), text.title_of(F.lit("a, b c d e f g")).alias("h"), text.quality(F.lit("720p")).alias("q"), text.wrap_words(F.lit("a b c"), 2).alias("w"), text.has_emoji(F.lit("x 😀")).alias("m"),
    )
    assert r["a"] == "ЭТО <hl>ВАЖНО</hl> ОЧЕНЬ ДА" and [c["text"] for c in r["c"]] == ["один <hl>два</hl>", "<hl>три</hl> пять"]
    assert (r["e"], r["n"], r["t"], r["h"], r["q"], r["w"], r["m"]) == ([1, 2, 3, 7], "Ад серия", "f b", "A B C D E F", 720, "a b\nc", True)
    got = spark.createDataFrame([("a <hl>b</hl> c </hl>",), (None,)], "s string").select(text.spans("s").alias("s")).collect()
    assert [(x["text"], x["highlighted"]) for x in got[0]["s"]] == [("a ", False), ("b", True), (" c ", False)] and got[1]["s"] == []
    with pytest.raises(Exception, match="reversed"):
        one(spark, text.episode_range(F.lit("5-2")))


def test_dsp(spark):
    hi, lo = ([math.sin(2 * math.pi * f * i / 8000) for i in range(400)] for f in (2000, 200))
    df = spark.createDataFrame([(hi,), (lo,), ([],)], "s array<double>")
    rows = df.select(dsp.rms(F.col("s")).alias("r"), dsp.zero_crossing_rate(F.col("s")).alias("z"), dsp.spectral_centroid(F.col("s"), 8000).alias("c"), dsp.compress_dialogue(F.col("s")).alias("q")).collect()
    assert rows[0]["z"] > rows[1]["z"] and rows[0]["c"] > rows[1]["c"] and rows[2]["r"] == 0 and rows[2]["q"] == []
    assert max(map(abs, rows[1]["q"])) <= 0.98 + 1e-9


def test_camera_keeps_its_limits():
    cfg = camera.resolve({"profile": "operator"})
    cam = camera.Camera(cfg)
    last = None
    for i in range(80):
        faces = [camera.Face(complex(0.3 + 0.4 * (i > 20), 0.5), 0.1, 0.15, 0.9)] if i < 60 else []
        at, zoom, held, cut = cam.step(i / 8, faces, 0.01)
        assert 0 <= at.real <= 1 and 0 <= at.imag <= 1 and zoom == 1.0 and not cut
        assert last is None or abs(at - last) <= cfg.max_center_speed / 8 * 1.4 + 1e-9
        last = at
    assert not held


def test_camera_changes_face_only_after_a_while():
    cam = camera.Camera(camera.CameraConfig())
    old, new = camera.Face(0.3 + 0.5j, 0.1, 0.1, 0.5), camera.Face(0.6 + 0.5j, 0.3, 0.3, 0.99)
    cam.step(0, [old], None)
    kept = [cam.step(i / 8, [old, new], 0.0) and cam.s.face is old for i in range(1, 5)]
    assert kept == [True, True, True, False]


def test_interpolation_is_held_at_the_ends(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 2.0)], "episode_id int, t double, zoom double")
    t = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 3.0)], "episode_id int, t double")
    assert [r["zoom"] for r in camera.interpolate(s, t, ["zoom"]).orderBy("t").collect()] == [0.0, 1.0, 2.0]


def test_streams_and_players(spark):
    s = spark.createDataFrame([(1, 1080, False, True), (1, 720, True, False), (1, 480, True, True), (2, 1080, False, False)], "k int, quality int, is_master boolean, is_mp4 boolean")
    assert {r["k"]: r["quality"] for r in matching.pick_stream(s, key="k", max_quality=720).collect()} == {1: 720, 2: 1080}
    p = spark.createDataFrame([(1, 0, "Alpha", "vk"), (1, 1, "Beta", "kodik"), (1, 2, "Beta", None)], "k int, no int, label string, player string")
    assert [r["no"] for r in matching.order_players(p, key="k", voice="alpha").orderBy("rank").collect()] == [0, 1]


def test_requests_and_stages(tmp_path):
    assert channels.request_of({"name": "A", "count": 3, "quality": "720p"}) == channels.Request("A", "3", None, 720, None)
    assert channels.request_of(("A", "1-3", "V")).voice == "V"
    with pytest.raises(ValueError):
        channels.request_of("A")
    assert "clips" in channels.enabled_stages(["music"]) and channels.enabled_stages(["title"]) == {"title"}
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "B").mkdir()
    assert channels.discover(tmp_path) == ["B"] and channels.valid_channels(tmp_path) == ["B"]


def test_stream_of_tempo_windows(spark, tmp_path):
    from tempora.streaming import windows

    src = str(tmp_path / "in")
    spark.sql("SELECT id % 2 AS k, timestamp_seconds(1700000000 + id) AS ts, double(id) AS value FROM range(60)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windows.tempo(stream, key="k").writeStream.format("memory").queryName("tempo").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tempo").agg(F.sum("events")).first()[0] == 60


def test_streamed_camera_equals_batch(spark, tmp_path):
    from tempora.streaming import windows

    rows = [(1, i / 8, 0.01, 0.3 + 0.01 * (i % 9), 0.5, 0.1, 0.1, 0.9) for i in range(24)]
    frames = spark.createDataFrame(rows, "episode_id long, t double, diff double, cx double, cy double, w double, h double, score double")
    want = camera.track(frames.select("episode_id", "t", "diff"), frames.select("episode_id", "t", "cx", "cy", "w", "h", "score")).orderBy("t").collect()
    src = str(tmp_path / "frames")
    frames.coalesce(1).write.parquet(src)
    out = windows.camera_track(spark.readStream.schema(frames.schema).parquet(src))
    q = out.writeStream.format("memory").queryName("camera").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("camera").orderBy("t").collect()
    assert [r["t"] for r in got] == [r["t"] for r in want] and all(abs(a["cx"] - b["cx"]) < 1e-12 for a, b in zip(got, want))


def test_detections_that_are_small_or_unsure_go(spark):
    rows = [(1, 0.0, 0.5, 0.5, 0.2, 0.3, 0.9), (1, 0.0, 0.1, 0.5, 0.008, 0.3, 0.9), (1, 0.0, 0.2, 0.5, 0.0, 0.3, 0.9), (1, 0.0, 0.3, 0.5, 0.2, 0.3, 0.4), (1, 0.0, 0.4, 0.5, 0.1, 0.1, 0.5), (1, 0.0, 0.6, 0.5, 0.2, 0.3, None)]
    d = spark.createDataFrame(rows, "episode_id long, t double, cx double, cy double, w double, h double, score double")
    kept = lambda **k: sorted(r["cx"] for r in camera.large_and_sure(d, 1920, 1080, **k).collect())
    assert kept(min_face_ratio=0.05, min_confidence=0.5) == [0.4, 0.5]
    assert kept(min_face_ratio=0.11, min_confidence=0.5) == [0.5]  # 0.1 of the height is below 0.11 of it
    assert kept(min_face_ratio=0.0) == [0.3, 0.4, 0.5, 0.6]  # 16 pixels at least


def test_faces_are_taken_by_falling_score(spark):
    frames = spark.createDataFrame([(1, i / 8, 0.0 if i else None) for i in range(16)], "episode_id long, t double, diff double")
    twins = spark.createDataFrame([(1, i / 8, cx, 0.5, 0.1, 0.1, score) for i in range(16) for cx, score in ((0.3, 0.6), (0.7, 0.9))], "episode_id long, t double, cx double, cy double, w double, h double, score double")
    last = camera.track(frames, twins).orderBy(F.desc("t")).first()
    assert last["cx"] > 0.5


def test_transcript_as_it_is_shown(spark):
    segments = "array<struct<start:double,text:string,words:array<struct<word:string,start:double>>>>"
    rows = [([(0.0, "so, <hl>this_is</hl> it!", [("so,", 0.0), ("<h1>this_is</h1>", 0.1), ("!", 0.2)]), (1.0, "...", [("?", 1.0)]), (2.0, None, None)],)]
    out, joined = text.sanitised(F.col("s"))
    r = spark.createDataFrame(rows, f"s {segments}").select(out.alias("s"), joined.alias("text")).first()
    assert r["text"] == "SO <hl>THIS IS</hl> IT" and [x["text"] for x in r["s"]] == ["SO <hl>THIS IS</hl> IT", "", ""]
    assert [(w["word"], w["start"]) for w in r["s"][0]["words"]] == [("SO", 0.0), ("<hl>THISIS</hl>", 0.1)] and r["s"][1]["words"] is None and r["s"][2]["words"] is None


def test_payload_has_eight_blocks_in_order(spark):
    import json

    from tempora.sources import files

    eps = spark.createDataFrame([(1,), (2,)], "episode_id long")
    lines = spark.createDataFrame([(1, "[0.00-1.00] hello\n")], "episode_id long, text string")
    c = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.9)], "episode_id long, rank int, score double")
    got = {r["episode_id"]: r["payload"].split("\n") for r in files.prompt_payload(eps, lines, candidates=c, hooks=c.limit(0)).collect()}
    for one_ in got.values():
        assert one_[0] == one_[-1] == files.RULE and [x for x in one_ if x in files.BLOCKS.values()] == list(files.BLOCKS.values())
    last = got[1][got[1].index(files.BLOCKS["candidates"]) + 1 : -1]
    assert json.loads("\n".join(last)) == [{"rank": 1, "score": 0.9}, {"rank": 2, "score": 0.5}] and got[2][-2] == "[]" and "[0.00-1.00] hello" in got[1]
    with pytest.raises(ValueError):
        files.prompt_payload(eps, lines, other=c)


def test_names_of_files(spark):
    rows = [("Show: one/two", 3, "Voice", 720), ("Show", 4, None, None)]
    x = spark.createDataFrame(rows, "title string, episode int, voice string, q int").select(text.episode_file_name(F.col("title"), F.col("episode"), F.col("voice"), F.col("q")).alias("n"))
    assert [r["n"] for r in x.collect()] == ["Show-_one-two_-_Серия_3_-_Voice_-_720p.mp4", "Show_-_Серия_4_-_auto.mp4"]
    names = spark.createDataFrame([(' a<b>:"c"/d\\e|f?*g  «h» .',), ("___",), (None,), ("x" * 200,), ("!!!",)], "n string").select(text.safe_filename("n").alias("s"), text.file_stem("n").alias("f")).collect()
    assert [r["s"] for r in names] == ["a_b_c_d_e_f_g_h", "", None, "x" * 150, "!!!"] and names[1]["f"] == "___" and names[4]["f"] == "episode" and names[2]["f"] is None


def test_config_of_another_channel_is_warned_of(tmp_path):
    assert channels.ensure_config(tmp_path, "one", "channel_name: one\n") == "channel_name: one\n"
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        channels.ensure_config(tmp_path, "one", "")
    (tmp_path / "one" / "config.yaml").write_text("a: 1\nchannel_name: 'two'  # moved\n")
    with pytest.warns(UserWarning, match="two"):
        channels.ensure_config(tmp_path, "one", "")


@pytest.mark.parametrize(("spans", "limits", "want"), [
    ([(0, 10), (20, 30), (40, 50)], (5, 24), [(0, 10), (20, 30), (40, 44)]),  # the last gives up what it has above the minimum
    ([(0, 20), (30, 34), (40, 44)], (5, 24), [(0, 20), (30, 34)]),  # one at the minimum goes whole
    ([(0, 4), (10, 14)], (12, 30), [(0, 4), (10, 18)]),  # grows forward
    ([(0, 4), (54, 60)], (14, 30), [(0, 4), (50, 60)]),  # and back, at the end of the source
    ([(0, 10), (10, 20)], (5, 30), [(0, 20)]),
    ([(0, 10), (5, 20)], (5, 30), [(0, 20)]),  # what an earlier piece holds is taken
    ([(70, 80), (9, 3)], (5, 30), []),
])
def test_cut_lists_are_repaired(spans, limits, want):
    fix = intervals.Repair(Validation.resolve({"min_segment_s": 4.0, "snap_tolerance_s": 0.0}), *limits)
    assert fix([(float(a), float(b)) for a, b in spans], [], 60.0)[0] == want


def test_spectral_centroid_of_a_tone(spark):
    tone = [math.sin(2 * math.pi * 1000 * i / 16000) for i in range(640)]
    got = spark.createDataFrame([(tone,), ([0.0] * 640,)], "samples array<double>").select(dsp.spectral_centroid("samples", 16000).alias("c")).collect()
    assert got[0]["c"] == pytest.approx(1000, abs=5) and got[1]["c"] == 0


def test_whole_analysis_runs(spark, inputs):
    from tempora.plans import analyze

    _, seg, audio, faces, cuts, motion, _ = inputs
    a = analyze.analyze(seg, audio, faces, motion, cuts, min_s=10.0, max_s=20.0)
    assert a.episodes.collect()[0]["duration_s"] == pytest.approx(59.4) and a.candidates.count() > 0
    answers = spark.createDataFrame([(1, '{"m": {"title": "a", "segments": [{"start": 6.0, "end": 20.0}]}}')], "episode_id long, raw_json string")
    chosen = analyze.validate(a, answers, seg, cuts, min_s=10.0, max_s=20.0, max_count=2).collect()
    assert chosen and analyze.fallback(a, 1, "t").count() == 1
