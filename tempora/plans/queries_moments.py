"""Timeline, windows, candidates and moments over the events table."""

from pyspark.sql import functions as F

from tempora.operators import scoring, timeline
from tempora.plans.stand_ins import CFG, MAX_S, MIN_S, SQL, WINDOWS, signals
from tempora.plans.stand_ins import timeline as make_timeline


def _grid(spark, d):
    s = signals(spark, d)
    return s, s.episodes.withColumn("cells", F.ceil(F.col("duration_s") / CFG.cell_s).cast("int"))


def r8(c, name=None):
    """Eight decimals, as the SQL twins round: a nudge first, as sums in another order differ around exact halves.

    By the nearest whole number of 1e-8, as after the nudge no half is left; Spark's own rounding makes a decimal of each number.
    """
    return (F.rint(((F.col(c) if isinstance(c, str) else c) + 1e-12) * 1e8) / 1e8 + 0.0).alias(name or c)


def timeline_speech(spark, d):
    s, eps = _grid(spark, d)
    return timeline.speech_cells(s.segments, eps, CFG.cell_s).select("episode_id", "cell", r8("speech"), r8("words"))


def timeline_energy_max(spark, d):
    s, eps = _grid(spark, d)
    return timeline.energy_cells(s.audio, eps, CFG.cell_s).select("episode_id", "cell", r8("audio_energy"), r8("audio_sharpness"))


def timeline_face(spark, d):
    s, eps = _grid(spark, d)
    return timeline.face_cells(s.faces, eps, CFG.cell_s).select("episode_id", "cell", r8("face"), r8("face_ratio"))


def timeline_points(spark, d):
    s, eps = _grid(spark, d)
    return timeline.point_cells(s.cuts, s.motion, eps, CFG.cell_s).select("episode_id", "cell", r8("cuts"), r8(F.coalesce("motion", F.lit(0.0)), "motion"))


def timeline_grid(spark, d):
    t = make_timeline(spark, d)
    x = t.select("episode_id", r8("motion_ref"), F.posexplode(F.arrays_zip(*timeline.SIGNALS)).alias("cell", "c"))
    return x.select("episode_id", "cell", "motion_ref", *[r8(F.col("c")[s], s) for s in timeline.SIGNALS])


def _scored(spark, d, *only):
    return scoring.score_windows(make_timeline(spark, d), signals(spark, d).hooks, MIN_S, MAX_S, CFG, only)


AT = ["episode_id", "start_s", "end_s"]


def window_stats(spark, d):
    told = ("speech_density", "words_per_s", "energy_p90", "energy_mean", "sharpness", "face_coverage", "face_peak", "cuts_per_min", "motion_mean")
    return _scored(spark, d, *[f"s_{x}" for x in told]).select(*AT, *[r8(F.col("stats")[x], x) for x in told])


def longest_silence(spark, d):
    return _scored(spark, d, "s_longest_silence_s").select(*AT, r8(F.col("stats.longest_silence_s"), "longest_silence_s"))


def window_signals(spark, d):
    told = ("transcript", "audio", "face", "scene", "pacing")
    return _scored(spark, d, *told).select(*AT, *[r8(F.col("signals")[x], x) for x in told])


def hook_head_signal(spark, d):
    x = scoring.window_heads(make_timeline(spark, d), signals(spark, d).hooks, MIN_S, MAX_S, CFG)
    return x.select("episode_id", "start_s", *[r8(c) for c in ("hook", "hook_text_score", "hook_audio", "hook_face", "hook_speech")], "hook_type", "hook_text")


def candidate_scores(spark, d):
    return _scored(spark, d, "warned").select(*AT, "duration_s", "score", F.concat_ws("; ", "warnings").alias("warnings"))


def _candidates(spark, d):
    return scoring.build_candidates(make_timeline(spark, d), signals(spark, d).hooks, MIN_S, MAX_S, CFG)


def candidates_nms(spark, d):
    return _candidates(spark, d).select("episode_id", "rank", "start_s", "end_s", "score")


def prompt_topk(spark, d):
    p = scoring.for_prompt(_candidates(spark, d), 8)
    return p.select("episode_id", "rank", "start_s", "end_s", "duration_s", "score", *[r8(F.round(F.col("signals")[x], 3), x) for x in ("transcript", "audio", "face", "scene", "pacing", "hook")], "hook_type", "hook_text", F.concat_ws("; ", "warnings").alias("warnings"))


QUERIES = {f.__name__: f for f in (timeline_speech, timeline_energy_max, timeline_face, timeline_points, timeline_grid, window_stats, longest_silence, window_signals, hook_head_signal, candidate_scores, candidates_nms, prompt_topk)}

_R = lambda *xs: ", ".join(f"round({x} + 1e-12, 8) AS {x}" for x in xs)
_W = f"WITH {SQL}, {WINDOWS}"
CHOSEN = """
ordered AS (SELECT episode_id, list(struct_pack(s := start_s, e := end_s, n := len, score := score) ORDER BY score DESC, start_s, len) AS every FROM scored GROUP BY 1),
chosen AS (SELECT episode_id, list_reduce(every, lambda acc, c: CASE WHEN len(acc) < 12 AND len(list_filter(acc, lambda a: greatest(0, least(a.e, c[1].e) - greatest(a.s, c[1].s)) / least(a.n, c[1].n) > 0.45)) = 0 THEN list_concat(acc, c) ELSE acc END, []) AS picks
  FROM (SELECT episode_id, list_transform(every, lambda x: [x]) AS every FROM ordered)),
cand AS (SELECT episode_id, generate_subscripts(picks, 1) AS rank, unnest(picks) AS p FROM chosen)"""
ORACLES = {
    "timeline_speech": f"WITH {SQL} SELECT episode_id, cell, {_R('speech', 'words')} FROM c_speech",
    "timeline_energy_max": f"WITH {SQL} SELECT episode_id, cell, {_R('audio_energy', 'audio_sharpness')} FROM c_energy",
    "timeline_face": f"WITH {SQL} SELECT episode_id, cell, {_R('face', 'face_ratio')} FROM c_face",
    "timeline_points": f"WITH {SQL} SELECT episode_id, cell, round(coalesce(cuts, 0) + 1e-12, 8) AS cuts, round(coalesce(motion, 0) + 1e-12, 8) AS motion FROM c_mot FULL JOIN c_cut USING (episode_id, cell)",
    "timeline_grid": f"WITH {SQL} SELECT episode_id, cell, {_R('motion_ref', 'speech', 'words', 'audio_energy', 'audio_sharpness', 'face', 'face_ratio', 'cuts', 'motion')} FROM cells JOIN refs USING (episode_id)",
    "window_stats": f"{_W} SELECT episode_id, start_s, end_s, round(density + 1e-12, 8) AS speech_density, round(wps + 1e-12, 8) AS words_per_s, round(e90 + 1e-12, 8) AS energy_p90, round(em + 1e-12, 8) AS energy_mean, round(sharp + 1e-12, 8) AS sharpness, round(face + 1e-12, 8) AS face_coverage, round(ratio + 1e-12, 8) AS face_peak, round(cpm + 1e-12, 8) AS cuts_per_min, round(motion + 1e-12, 8) AS motion_mean FROM agg",
    "longest_silence": f"{_W} SELECT episode_id, start_s, end_s, round(silence::DOUBLE + 1e-12, 8) AS longest_silence_s FROM sig",
    "window_signals": f"{_W} SELECT episode_id, start_s, end_s, {_R('transcript', 'audio', 'scene', 'pacing')}, round(face_sig + 1e-12, 8) AS face FROM sig",
    "hook_head_signal": f"{_W} SELECT episode_id, start_s, round(hook + 1e-12, 8) AS hook, round(ht + 1e-12, 8) AS hook_text_score, round(ha + 1e-12, 8) AS hook_audio, round(hf + 1e-12, 8) AS hook_face, round(hs + 1e-12, 8) AS hook_speech, htype AS hook_type, htext AS hook_text FROM hook",
    "candidate_scores": f"{_W} SELECT episode_id, start_s, end_s, len AS duration_s, score, array_to_string(warnings, '; ') AS warnings FROM scored",
    "candidates_nms": f"{_W}, {CHOSEN} SELECT episode_id, rank::INT AS rank, p.s AS start_s, p.e AS end_s, p.score AS score FROM cand",
    "prompt_topk": f"{_W}, {CHOSEN} SELECT c.episode_id, rank::INT AS rank, p.s AS start_s, p.e AS end_s, p.n AS duration_s, s.score, " + ", ".join(f"round(round({a}, 3) + 1e-12, 8) AS {b}" for a, b in (("transcript", "transcript"), ("audio", "audio"), ("face_sig", "face"), ("scene", "scene"), ("pacing", "pacing"), ("hook", "hook"))) + ", htype AS hook_type, htext AS hook_text, array_to_string(warnings, '; ') AS warnings FROM cand c JOIN scored s ON c.episode_id = s.episode_id AND c.p.s = s.start_s AND c.p.n = s.len WHERE rank <= 8",
}
