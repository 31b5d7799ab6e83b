"""Events, frames, hooks and tempo over embeddings, events and conversations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import dsp
from tempora.functions.text import word_count
from tempora.operators import camera, events, narrative
from tempora.plans.stand_ins import SQL, read, signals

FRAME_S = 0.04
#: Cue words that occur in ``conversations``; the defaults do not.
WORDS = narrative.Lexicon(question=r"\b(this)\b", confession=r"\b(from|with)\b", promise=r"\b(for)\b", interruption=r"\b(was)\b", emotion=r"\b(view|error)\b")


def frames(spark, d):
    """An episode for each label of ``embeddings``; a vector is a frame of samples, in the order of vec_id."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = read(spark, d, "embeddings").where("label is not null").withColumn("frame", F.row_number().over(w) - 1)
    return x.select(F.col("label").alias("episode_id"), "frame", "vec_id", "embedding", dsp.rms(F.col("embedding")).alias("rms"), dsp.zero_crossing_rate(F.col("embedding")).alias("zcr"))


def transcript(spark, d):
    """A segment for each turn of ``conversations``: three words a second, one turn after another."""
    n = word_count(F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = read(spark, d, "conversations").withColumn("words", n).withColumn("upto", F.sum("words").over(w))
    return x.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_id"), ((F.col("upto") - F.col("words")) / 3.0).alias("start_s"), (F.col("upto") / 3.0).alias("end_s"), "text", "words").where("end_s > start_s")


def audio_frame_rms_zcr(spark, d):
    return frames(spark, d).select("episode_id", "vec_id", F.round("rms", 6).alias("rms"), F.round("zcr", 6).alias("zcr"))


def audio_global_stats(spark, d):
    return events.audio_stats(frames(spark, d), key="episode_id", frame_s=FRAME_S)


def _motion(spark, d):
    return events.motion(frames(spark, d), key="episode_id", order="frame", pixels="embedding").select("episode_id", "frame", "diff")


def motion_lag_diff(spark, d):
    return _motion(spark, d).select("episode_id", "frame", F.round("diff", 6).alias("diff"))


def cut_detect_p90(spark, d):
    return events.cuts(_motion(spark, d), key="episode_id").select("episode_id", "frame", F.round("diff", 6).alias("diff"))


def rolling_median_cuts(spark, d):
    x = events.adaptive_cuts(_motion(spark, d), key="episode_id", order="frame", times=1.1)
    return x.select("episode_id", "frame", F.round("median", 9).alias("median"), "is_cut")


def _islands(spark, d):
    x = events.loud_frames(frames(spark, d), key="episode_id", level="rms", strong_q=0.7, soft_q=0.4)
    part = lambda c: events.mask_events(x, key="episode_id", frame="frame", on=c, strength="rms", frame_s=FRAME_S, min_event_ms=30.0).withColumn("category", F.lit(c))
    return part("strong").unionByName(part("soft"))


def peak_islands(spark, d):
    return _islands(spark, d)


def gap_merge_sessions(spark, d):
    return events.merge_gaps(_islands(spark, d), key="episode_id", gap_s=0.05).select("episode_id", "start_s", "end_s", "peak", "frames", "category")


def gap_merge_fold(spark, d):
    """The order-dependent mean of merged events; no SQL twin, tested against a loop."""
    return events.merge_gaps(_islands(spark, d), key="episode_id", gap_s=0.05)


def event_features(spark, d):
    f = frames(spark, d).withColumn("centroid", dsp.spectral_centroid(F.col("embedding"), 16000))
    x = events.event_features(_islands(spark, d), f, key="episode_id", frame_s=FRAME_S)
    return x.select("episode_id", "start_s", "end_s", "category", "rms_mean", "rms_p95", "zcr_mean", "centroid_mean", "sharpness")


def event_labels_topk(spark, d):
    s = signals(spark, d)
    x = s.audio.withColumn("end_s", F.col("start_s") + (F.col("event_id") % 5) * 0.1 + 0.1).withColumn("sharpness", F.col("sharpness") * 0.5)
    x = x.withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))
    return events.labelled_top(x, key="episode_id", max_events=20).select("episode_id", "event_id", "type", "duration_s", "hint", "category")


def tempo_windows(spark, d):
    s = signals(spark, d)
    return narrative.tempo_windows(s.episodes, s.segments, s.cuts, s.motion, 24.0)


def visual_summary(spark, d):
    s = signals(spark, d)
    return narrative.visual_summary(s.episodes, s.faces, s.cuts, s.motion)


def hook_classify_topk(spark, d):
    return narrative.hooks(transcript(spark, d), WORDS, 3).select("episode_id", "rank", "start_s", "end_s", "type", "score", "text")


def emotion_peaks(spark, d):
    s = signals(spark, d)
    seg = s.segments.withColumn("seg_id", F.split("text", " ")[1].cast("long"))
    return narrative.emotion_peaks(s.audio, seg, WORDS, cell_s=6.0).select("episode_id", "rank", "start_s", "end_s", "score", "category", "transcript")


def face_activity(spark, d):
    x = frames(spark, d).select("episode_id", (F.col("frame") * 5.0).alias("t"), (F.col("vec_id") % 3).cast("int").alias("faces"), ((F.col("vec_id") % 16) / 100.0).alias("ratio"))
    ends = x.groupBy("episode_id").agg(F.max("t").alias("duration_s"))
    top, coverage = events.face_activity(x, ends, max_events=10)
    return top.join(coverage, "episode_id").select("episode_id", "start_s", "end_s", "faces", "max_face_ratio", F.round("coverage", 6).alias("coverage"))


def spectral_centroid(spark, d):
    x = read(spark, d, "embeddings")
    return x.select("vec_id", F.round(dsp.spectral_centroid(F.col("embedding"), 16000), 3).alias("centroid"))


def compress_dialogue(spark, d):
    x = read(spark, d, "embeddings").select("vec_id", F.posexplode(dsp.compress_dialogue(F.col("embedding"))).alias("i", "v"))
    return x.select("vec_id", "i", F.round("v", 6).alias("v"))


def face_saliency(spark, d):
    n = F.col("event_id")
    x = read(spark, d, "events").select(n, dsp.saliency((n % 7) / 7.0, (n % 11) / 11.0, (n % 13) / 13.0, (n % 5) / 10.0, (n % 3) / 10.0).alias("s"), dsp.ken_burns(n / 10.0, 12.0, pan=0.03, tilt=0.02, zoom=0.1).alias("k"))
    return x.select("event_id", F.round("s", 6).alias("saliency"), (F.round("k.dx", 6) + 0.0).alias("dx"), (F.round("k.dy", 6) + 0.0).alias("dy"), F.round("k.zoom", 6).alias("zoom"))


def _camera_inputs(spark, d):
    x = frames(spark, d)
    f = x.select("episode_id", (F.col("frame") / 8.0).alias("t")).join(_motion(spark, d).select("episode_id", (F.col("frame") / 8.0).alias("t"), "diff"), ["episode_id", "t"], "left")
    n = F.col("vec_id")
    det = x.where(n % 5 > 0).select("episode_id", (F.col("frame") / 8.0).alias("t"), (0.3 + (n % 17) / 50.0).alias("cx"), (0.3 + (n % 23) / 60.0).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.15).alias("h"), (0.75 + (n % 4) / 16.0).alias("score"))
    return f, det


def camera_track(spark, d):
    return camera.track(*_camera_inputs(spark, d)).select("episode_id", "t", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "zoom")], "has_face", "is_cut")


def asof_interpolate(spark, d):
    s = signals(spark, d)
    states = s.motion.select("episode_id", "t", F.col("diff").alias("cx")).groupBy("episode_id", "t").agg(F.max("cx").alias("cx"))
    times = s.episodes.select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(720), F.lit(10))).alias("t")).withColumn("t", F.col("t").cast("double"))
    return camera.interpolate(states, times, ["cx"]).select("episode_id", "t", F.round("cx", 6).alias("cx"))


QUERIES = {f.__name__: f for f in (
    audio_frame_rms_zcr, audio_global_stats, motion_lag_diff, cut_detect_p90, rolling_median_cuts, peak_islands, gap_merge_sessions, gap_merge_fold, event_features, event_labels_topk, tempo_windows, visual_summary,
    hook_classify_topk, emotion_peaks, face_activity, spectral_centroid, compress_dialogue, face_saliency, camera_track, asof_interpolate,
)}

FRAMES = """
fr AS (SELECT label AS episode_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, embedding AS px,
  sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS rms,
  list_sum(list_transform(range(2, len(embedding) + 1), lambda i: CASE WHEN (embedding[i] >= 0) <> (embedding[i - 1] >= 0) THEN 1.0 ELSE 0.0 END))::DOUBLE / (len(embedding) - 1) AS zcr FROM embeddings WHERE label IS NOT NULL),
mo AS (SELECT episode_id, frame, list_sum(list_transform(range(1, len(px) + 1), lambda i: abs(px[i]::DOUBLE - before[i]::DOUBLE))) / len(px) AS diff
  FROM (SELECT *, lag(px) OVER (PARTITION BY episode_id ORDER BY frame) AS before FROM fr) WHERE before IS NOT NULL)"""
ISLANDS = """
lim AS (SELECT episode_id, greatest(quantile_cont(rms, 0.7), 0.02) AS hi, greatest(quantile_cont(rms, 0.4), 0.02) AS lo FROM fr GROUP BY 1),
fl AS (SELECT fr.*, rms >= hi AS strong, rms >= lo AND rms < hi AS soft FROM fr JOIN lim USING (episode_id)),
isl AS (SELECT episode_id, category, min(frame) AS a, max(frame) + 1 AS b, max(rms) AS peak, avg(rms) AS mean, count(*) AS frames FROM (
  SELECT episode_id, 'strong' AS category, frame, rms, frame - row_number() OVER (PARTITION BY episode_id ORDER BY frame) AS g FROM fl WHERE strong
  UNION ALL SELECT episode_id, 'soft', frame, rms, frame - row_number() OVER (PARTITION BY episode_id ORDER BY frame) FROM fl WHERE soft) GROUP BY episode_id, category, g HAVING count(*) * 0.04::DOUBLE * 1000 >= 30),
evt AS (SELECT episode_id, round(a * 0.04::DOUBLE, 3) AS start_s, round(b * 0.04::DOUBLE, 3) AS end_s, round(peak, 6) AS peak, round(mean, 6) AS mean, frames, category FROM isl)"""
#: Mean frequency of each vector's magnitude spectrum, by a discrete Fourier transform.
SPECTRUM = """
smp AS (SELECT vec_id, len(embedding) AS size, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mag AS (SELECT vec_id, size, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / size)), 2) + pow(sum(x * sin(2 * pi() * k * i / size)), 2)) AS m
  FROM smp, (SELECT unnest(range(0, 33)) AS k) WHERE k <= size // 2 GROUP BY vec_id, size, k),
spec AS (SELECT vec_id, sum(k * 16000.0::DOUBLE / size * m) / greatest(sum(m), 1e-12) AS centroid FROM mag GROUP BY vec_id)"""
ORACLES = {
    "audio_frame_rms_zcr": f"WITH {FRAMES} SELECT episode_id, vec_id, round(rms, 6) AS rms, round(zcr, 6) AS zcr FROM fr",
    "audio_global_stats": f"WITH {FRAMES} SELECT episode_id, round(avg(rms), 6) AS rms_mean, round(stddev_pop(rms), 6) AS rms_std, round(quantile_cont(rms, 0.9), 6) AS rms_p90, round(quantile_cont(rms, 0.95), 6) AS rms_p95, round(max(rms), 6) AS rms_max, round(avg(zcr), 6) AS zcr_mean, count(*) AS frames, round(count(*) * 0.04::DOUBLE, 3) AS duration_s FROM fr GROUP BY 1",
    "motion_lag_diff": f"WITH {FRAMES} SELECT episode_id, frame, round(diff, 6) AS diff FROM mo",
    "cut_detect_p90": f"WITH {FRAMES} SELECT episode_id, frame, round(diff, 6) AS diff FROM mo JOIN (SELECT episode_id, greatest(0.12, quantile_cont(diff, 0.9)) AS cut_at FROM mo GROUP BY 1) USING (episode_id) WHERE diff >= cut_at",
    "rolling_median_cuts": f"WITH {FRAMES}, m AS (SELECT *, coalesce(quantile_cont(diff, 0.5) OVER (PARTITION BY episode_id ORDER BY frame ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), 0) AS median FROM mo) SELECT episode_id, frame, round(median, 9) AS median, diff >= greatest(0.12, 1.1 * median) AS is_cut FROM m",
    "peak_islands": f"WITH {FRAMES}, {ISLANDS} SELECT * FROM evt",
    "gap_merge_sessions": f"WITH {FRAMES}, {ISLANDS}, s AS (SELECT *, max(end_s) OVER (PARTITION BY episode_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM evt), g AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_s - reached > 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_s, end_s) AS n FROM s) SELECT episode_id, min(start_s) AS start_s, max(end_s) AS end_s, max(peak) AS peak, sum(frames)::BIGINT AS frames, CASE WHEN bool_or(category = 'strong') THEN 'strong' ELSE 'soft' END AS category FROM g GROUP BY episode_id, n",
    "gap_merge_fold": f"""WITH {FRAMES}, {ISLANDS}, s AS (SELECT *, max(end_s) OVER (PARTITION BY episode_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM evt),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_s - reached > 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_s, end_s) AS n FROM s)
SELECT episode_id, min(start_s) AS start_s, max(end_s) AS end_s, max(peak) AS peak, list_reduce(list(mean ORDER BY start_s, end_s, mean), lambda a, m: round((a + m) / 2, 6)) AS mean,
  sum(frames)::BIGINT AS frames, CASE WHEN bool_or(category = 'strong') THEN 'strong' ELSE 'soft' END AS category FROM g GROUP BY episode_id, n""",
    "spectral_centroid": f"WITH {SPECTRUM} SELECT vec_id, round(centroid, 3) AS centroid FROM spec",
    "event_features": f"""WITH {FRAMES}, {ISLANDS}, {SPECTRUM},
j AS (SELECT e.episode_id, start_s, end_s, category, avg(rms) AS rm, quantile_cont(rms, 0.95) AS rp, avg(zcr) AS z, avg(centroid) AS c
  FROM evt e JOIN fr ON e.episode_id = fr.episode_id AND frame >= round(start_s / 0.04) AND frame < round(end_s / 0.04) JOIN spec ON spec.vec_id = fr.vec_id GROUP BY ALL)
SELECT episode_id, start_s, end_s, category, round(rm, 6) AS rms_mean, round(rp, 6) AS rms_p95, round(z, 6) AS zcr_mean, round(c, 3) AS centroid_mean, round(0.65 * z + 0.35 * least(1, greatest(0, c / 8000)), 6) AS sharpness FROM j""",
    "event_labels_topk": f"""WITH {SQL}, x AS (SELECT episode_id, event_id, peak, category, round(s, 3) AS start_s, round(s + (event_id % 5) * 0.1::DOUBLE + 0.1::DOUBLE, 3) AS end_s, sharpness * 0.5::DOUBLE AS sharp, max(peak) OVER (PARTITION BY episode_id) AS top FROM aud),
y AS (SELECT *, round(end_s - start_s, 3) AS duration_s, CASE WHEN top > 0 THEN peak / top END AS share, row_number() OVER (PARTITION BY episode_id ORDER BY CASE WHEN category = 'strong' THEN 0 ELSE 1 END, peak DESC, start_s, end_s) AS n FROM x)
SELECT episode_id, event_id, CASE WHEN share >= 0.9 THEN 'взрыв' WHEN share >= 0.75 THEN 'крик' WHEN share >= 0.6 THEN 'удар' ELSE 'пик' END AS type, duration_s,
CASE WHEN category = 'strong' THEN CASE WHEN sharp >= 0.35::DOUBLE AND duration_s <= 0.35::DOUBLE THEN 'резкий_пик' WHEN sharp >= 0.25::DOUBLE AND duration_s >= 0.35::DOUBLE THEN 'крик_или_шум' ELSE 'громкий_момент' END WHEN sharp >= 0.30::DOUBLE THEN 'интересный_шум' ELSE 'фон_или_музыка' END AS hint, category FROM y WHERE n <= 20""",
    "tempo_windows": f"""WITH {SQL}, w AS (SELECT episode_id, unnest(range(0, 30)) AS cell FROM eps),
sp AS (SELECT episode_id, cell, sum(greatest(0, least(cell * 24 + 24.0, least(e, 720)) - greatest(cell * 24.0, s))) AS spoken FROM (SELECT *, unnest(range(greatest(0, floor(s / 24))::INT, least(30, ceil(least(e, 720) / 24))::INT)) AS cell FROM seg) GROUP BY ALL),
c AS (SELECT episode_id, floor(t / 24)::INT AS cell, count(*) AS cuts FROM cut WHERE t >= 0 AND t < 720 GROUP BY ALL), m AS (SELECT episode_id, floor(t / 24)::INT AS cell, avg(diff) AS motion FROM mot WHERE t >= 0 AND t < 720 GROUP BY ALL),
x AS (SELECT w.*, least(1, coalesce(spoken, 0) / 24) AS density, coalesce(cuts, 0) AS cuts, motion FROM w LEFT JOIN sp USING (episode_id, cell) LEFT JOIN c USING (episode_id, cell) LEFT JOIN m USING (episode_id, cell))
SELECT episode_id, round(cell * 24.0, 3)::DOUBLE AS start_s, round(cell * 24.0 + 24, 3)::DOUBLE AS end_s, round(density, 4) AS speech_density, round(greatest(0, 1 - density), 4) AS silence_ratio, cuts, round(motion, 4) AS motion_intensity FROM x""",
    "visual_summary": f"""WITH {SQL}, f AS (SELECT episode_id, count(*) AS n, sum(e - s) AS tm, sum((e - s) * ratio) AS wt FROM fac GROUP BY 1), c AS (SELECT episode_id, count(*) AS cuts FROM cut GROUP BY 1), m AS (SELECT episode_id, avg(diff) AS mn, quantile_cont(diff, 0.9) AS p90 FROM mot GROUP BY 1)
SELECT episode_id, coalesce(n, 0) AS face_events, round(coalesce(tm, 0), 3) AS face_time_s, round(coalesce(tm, 0) / 720, 4) AS coverage_ratio, round(coalesce(wt / tm, 0), 4) AS avg_face_ratio, coalesce(cuts, 0) AS cut_count, round(coalesce(cuts, 0) * 60.0::DOUBLE / 720, 3) AS cuts_per_min, round(mn, 4) AS motion_mean, round(p90, 4) AS motion_p90 FROM eps LEFT JOIN f USING (episode_id) LEFT JOIN c USING (episode_id) LEFT JOIN m USING (episode_id)""",
    "hook_classify_topk": r"""WITH n AS (SELECT conv_id AS episode_id, turn, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM conversations),
s AS (SELECT *, sum(words) OVER (PARTITION BY episode_id ORDER BY turn) AS upto FROM n), seg AS (SELECT episode_id, (upto - words) / 3.0::DOUBLE AS s, upto / 3.0::DOUBLE AS e, text FROM s WHERE words > 0),
k AS (SELECT *, regexp_matches(text, '(?i)\b(this)\b') OR contains(text, '?') AS q, regexp_matches(text, '(?i)\b(from|with)\b') AS c, regexp_matches(text, '(?i)\b(for)\b') AS p, regexp_matches(text, '(?i)\b(was)\b') AS i FROM seg),
h AS (SELECT episode_id, round(s, 3) AS start_s, round(e, 3) AS end_s, CASE WHEN i THEN 'interruption' WHEN p THEN 'promise' WHEN c THEN 'confession' WHEN q THEN 'question' END AS type,
round(least(0.95::DOUBLE, greatest(CASE WHEN q THEN 0.65::DOUBLE ELSE 0 END, CASE WHEN c THEN 0.7::DOUBLE ELSE 0 END, CASE WHEN p THEN 0.75::DOUBLE ELSE 0 END, CASE WHEN i THEN 0.6::DOUBLE ELSE 0 END) + CASE WHEN text LIKE '%?' OR text LIKE '%!' THEN 0.05::DOUBLE ELSE 0 END), 3) AS score, text FROM k WHERE (q OR c OR p OR i) AND text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, start_s, end_s, text) AS rank FROM h) SELECT episode_id, rank::INT AS rank, start_s, end_s, type, score, text FROM r WHERE rank <= 3""",
    "emotion_peaks": f"""WITH {SQL}, a AS (SELECT *, max(peak) OVER (PARTITION BY episode_id) AS top FROM aud), mk AS (SELECT *, split_part(text, ' ', 2)::BIGINT AS id FROM seg WHERE regexp_matches(text, '(?i)\\b(view|error)\\b')),
j AS (SELECT a.event_id, arg_min(m.text, m.id) AS quote FROM a JOIN mk m ON a.episode_id = m.episode_id AND m.e >= a.s AND m.s <= a.e GROUP BY 1),
x AS (SELECT a.*, quote, 0.6 * peak / top + 0.4 * CASE WHEN quote IS NULL THEN 0 ELSE 1 END AS raw FROM a LEFT JOIN j USING (event_id)), y AS (SELECT episode_id, round(s, 3) AS start_s, round(e, 3) AS end_s, round(least(raw, 0.98), 3) AS score, peak, category, coalesce(quote, '') AS transcript FROM x WHERE raw >= 0.55),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, start_s, end_s, peak, category) AS rank FROM y) SELECT episode_id, rank::INT AS rank, start_s, end_s, score, category, transcript FROM r WHERE rank <= 12""",
    "face_activity": f"""WITH {FRAMES}, x AS (SELECT episode_id, frame, frame * 5.0::DOUBLE AS t, vec_id % 3 AS faces, (vec_id % 16) / 100.0::DOUBLE AS ratio FROM fr), d AS (SELECT episode_id, max(t) AS dur FROM x GROUP BY 1),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY episode_id ORDER BY frame) AS g FROM x WHERE faces > 0), e AS (SELECT g.episode_id, min(t) AS start_s, least(max(t) + 5, any_value(dur)) AS end_s, max(faces)::INT AS faces, max(ratio) AS max_face_ratio, any_value(dur) AS dur FROM g JOIN d USING (episode_id) GROUP BY g.episode_id, g),
f AS (SELECT * FROM e WHERE end_s > start_s), r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY faces DESC, start_s) AS n, round(sum(end_s - start_s) OVER (PARTITION BY episode_id) / greatest(dur, 1e-6), 6) AS coverage FROM f) SELECT episode_id, start_s, end_s, faces, max_face_ratio, coverage FROM r WHERE n <= 10""",
    "compress_dialogue": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, greatest(-1.0, least(1.0, unnest(embedding)::DOUBLE)) AS x FROM embeddings), a AS (SELECT *, abs(x) AS m FROM e),
b AS (SELECT *, CASE WHEN m > 0.39::DOUBLE THEN 0.39::DOUBLE + (m - 0.39::DOUBLE) / 4 WHEN m >= 0.31::DOUBLE THEN m + (m - 0.31::DOUBLE) / 0.08::DOUBLE * (0.39::DOUBLE + (m - 0.39::DOUBLE) / 4 - m) ELSE m END AS y FROM a),
c AS (SELECT *, sign(x) * CASE WHEN y < 0.02::DOUBLE THEN 0.02::DOUBLE * sqrt(y / 0.02::DOUBLE) ELSE y END * 1.6::DOUBLE AS z FROM b), p AS (SELECT *, max(abs(z)) OVER (PARTITION BY vec_id) AS peak FROM c)
SELECT vec_id, i::INT AS i, round(CASE WHEN peak > 0.98 THEN z * (0.98::DOUBLE / peak) ELSE z END, 6) AS v FROM p""",
    "face_saliency": """WITH x AS (SELECT event_id, (event_id % 7) / 7.0::DOUBLE AS sc, (event_id % 11) / 11.0::DOUBLE AS cx, (event_id % 13) / 13.0::DOUBLE AS cy, (event_id % 5) / 10.0::DOUBLE * ((event_id % 3) / 10.0::DOUBLE) AS area, event_id / 10.0::DOUBLE * (2 * pi() / 12) AS ph FROM events)
SELECT event_id, round(0.45 * sc + 0.35 * least(1, sqrt(area) / 0.35) + 0.2 * (1 - least(1, sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5)) / 0.7071)), 6) AS saliency, round(sin(ph) * 0.03, 6) + 0.0 AS dx, round(cos(ph * 0.7) * 0.02, 6) + 0.0 AS dy, round(greatest(0.8, 1 + sin(ph * 0.85) * 0.1), 6) AS zoom FROM x""",
    "asof_interpolate": f"""WITH {SQL}, st AS (SELECT episode_id, t, max(diff) AS cx FROM mot GROUP BY ALL), tm AS (SELECT episode_id, unnest(range(0, 721, 10))::DOUBLE AS t FROM eps),
a AS (SELECT tm.episode_id, tm.t, st.t AS t0, st.cx AS c0 FROM tm ASOF LEFT JOIN st ON tm.episode_id = st.episode_id AND tm.t >= st.t), b AS (SELECT tm.episode_id, tm.t, st.t AS t1, st.cx AS c1 FROM tm ASOF LEFT JOIN st ON tm.episode_id = st.episode_id AND tm.t <= st.t)
SELECT episode_id, t, round(CASE WHEN t0 IS NULL THEN c1 WHEN t1 IS NULL THEN c0 WHEN t1 > t0 THEN c0 * (1 - (t - t0) / (t1 - t0)) + c1 * ((t - t0) / (t1 - t0)) ELSE c0 END, 6) AS cx FROM a JOIN b USING (episode_id, t)""",
}
