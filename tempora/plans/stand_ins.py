"""Inputs of the operators made from the driver's tables, which hold no video signals.

They show operator semantics, not media quality. An episode is a user of ``events``, in hours since
2024-01-01; every rule here has its twin in ``SQL``.
"""

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.plans.config import Scoring

#: Hours in place of seconds: 24 to 48 hour windows on a grid of one hour, thresholds scaled with it.
CFG = Scoring.resolve({
    "cell_s": 1.0, "step_s": 1.0, "length_steps": 3, "hook_window_s": 2.0, "min_speech_density": 0.08, "min_face_coverage": 0.2, "speech_sweet_spot": (0.1, 0.3),
    "cuts_per_min_sweet_spot": (0.5, 3.0), "max_silence_gap_s": 12.0, "target_face_ratio": 0.1, "words_per_s_ref": 0.5,
})
MIN_S, MAX_S, DURATION = 24.0, 48.0, 720.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """episodes, segments, audio, faces, cuts, motion and hooks of the events table."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), "event_id", "event_type", "value", hours.alias("t"))
    n = F.col("event_id")
    kind = F.col("event_type")
    until = lambda x: (F.col("t") + x).alias("end_s")
    start = F.col("t").alias("start_s")
    return SimpleNamespace(
        episodes=ev.select("episode_id", F.lit(DURATION).alias("duration_s")).distinct(),
        segments=ev.select("episode_id", start, until(F.lit(0.5) + (n % 3) * 0.75), (n % 7).cast("int").alias("words"), F.concat_ws(" ", kind, n.cast("string")).alias("text")),
        audio=ev.select("episode_id", start, until(F.lit(1.0)), F.col("value").alias("peak"), F.when(kind.isin("error", "purchase"), "strong").otherwise("soft").alias("category"), ((n % 10) / 10.0).alias("sharpness"), n.alias("event_id")),
        faces=ev.where(kind == "view").select("episode_id", start, until(F.lit(4.0)), (1 + n % 3).cast("int").alias("faces"), ((n % 16) / 101.0).alias("max_face_ratio")),
        cuts=ev.where(kind == "click").select("episode_id", "t"),
        motion=ev.select("episode_id", "t", ((n % 100) / 100.0).alias("diff")),
        hooks=ev.where(kind == "signup").select("episode_id", start, until(F.lit(1.0)), ((50 + 10 * (n % 5)) / 100.0).alias("score"), F.element_at(F.array(*map(F.lit, ("question", "confession", "promise", "interruption"))), (n % 4 + 1).cast("int")).alias("type"), F.concat_ws(" ", kind, n.cast("string")).alias("text")),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.operators.timeline import build_timeline

    s = signals(spark, sf_dir)
    return build_timeline(s.episodes, s.segments, s.audio, s.faces, s.cuts, s.motion, CFG.cell_s)


SQL = """
ev AS (SELECT user_id AS episode_id, event_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9 AS t FROM events),
eps AS (SELECT DISTINCT episode_id, 720.0::DOUBLE AS duration_s FROM ev),
seg AS (SELECT episode_id, t AS s, t + (0.5::DOUBLE + (event_id % 3) * 0.75::DOUBLE) AS e, event_id % 7 AS words, event_type || ' ' || event_id AS text FROM ev),
aud AS (SELECT episode_id, event_id, t AS s, t + 1.0::DOUBLE AS e, value AS peak, CASE WHEN event_type IN ('error', 'purchase') THEN 'strong' ELSE 'soft' END AS category, (event_id % 10) / 10.0::DOUBLE AS sharpness FROM ev),
fac AS (SELECT episode_id, t AS s, t + 4.0::DOUBLE AS e, 1 + event_id % 3 AS faces, (event_id % 16) / 101.0::DOUBLE AS ratio FROM ev WHERE event_type = 'view'),
cut AS (SELECT episode_id, t FROM ev WHERE event_type = 'click'),
mot AS (SELECT episode_id, t, (event_id % 100) / 100.0::DOUBLE AS diff FROM ev),
hk AS (SELECT episode_id, t AS s, t + 1.0::DOUBLE AS e, (50 + 10 * (event_id % 5)) / 100.0::DOUBLE AS score, ['question', 'confession', 'promise', 'interruption'][event_id % 4 + 1] AS type, event_type || ' ' || event_id AS text FROM ev WHERE event_type = 'signup'),
c_speech AS (SELECT episode_id, cell, least(1.0, sum(cov)) AS speech, sum(words * cov / (e - s)) AS words FROM (
  SELECT *, greatest(0, least(cell + 1.0, e) - greatest(cell::DOUBLE, s)) AS cov FROM (SELECT *, unnest(range(greatest(0, floor(s))::INT, least(720, ceil(e))::INT)) AS cell FROM seg)) WHERE cov > 0 GROUP BY ALL),
c_energy AS (SELECT episode_id, cell, greatest(0, max(lv)) AS audio_energy, greatest(0, max(sharpness)) AS audio_sharpness FROM (
  SELECT *, greatest(0, least(cell + 1.0, e) - greatest(cell::DOUBLE, s)) AS cov FROM (
    SELECT aud.*, peak / top * CASE WHEN category = 'strong' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS lv, unnest(range(greatest(0, floor(s))::INT, least(720, ceil(e))::INT)) AS cell
    FROM aud JOIN (SELECT episode_id, max(peak) AS top FROM aud GROUP BY 1 HAVING max(peak) > 0) USING (episode_id))) WHERE cov > 0 GROUP BY ALL),
c_face AS (SELECT episode_id, cell, least(1.0, sum(cov)) AS face, greatest(0, max(ratio)) AS face_ratio FROM (
  SELECT *, greatest(0, least(cell + 1.0, e) - greatest(cell::DOUBLE, s)) AS cov FROM (SELECT *, unnest(range(greatest(0, floor(s))::INT, least(720, ceil(e))::INT)) AS cell FROM fac)) WHERE cov > 0 GROUP BY ALL),
c_cut AS (SELECT episode_id, least(719, greatest(0, floor(t)))::INT AS cell, count(*)::DOUBLE AS cuts FROM cut GROUP BY ALL),
c_mot AS (SELECT episode_id, least(719, greatest(0, floor(t)))::INT AS cell, max(diff) AS motion FROM mot GROUP BY ALL),
cells AS (SELECT episode_id, cell, coalesce(speech, 0) AS speech, coalesce(words, 0) AS words, coalesce(audio_energy, 0) AS audio_energy, coalesce(audio_sharpness, 0) AS audio_sharpness,
  coalesce(face, 0) AS face, coalesce(face_ratio, 0) AS face_ratio, coalesce(cuts, 0) AS cuts, coalesce(motion, 0) AS motion
  FROM (SELECT episode_id, unnest(range(720))::INT AS cell FROM eps) LEFT JOIN c_speech USING (episode_id, cell) LEFT JOIN c_energy USING (episode_id, cell)
  LEFT JOIN c_face USING (episode_id, cell) LEFT JOIN c_cut USING (episode_id, cell) LEFT JOIN c_mot USING (episode_id, cell)),
refs AS (SELECT episode_id, greatest(1e-3::DOUBLE, coalesce(quantile_cont(motion, 0.9) FILTER (WHERE motion > 0), 0.15::DOUBLE)) AS motion_ref FROM cells GROUP BY 1)"""

WINDOWS = """
win AS (SELECT episode_id, start_s, start_s + len AS end_s, len FROM (SELECT episode_id, len, unnest(range(0, (720 - len)::INT + 1))::DOUBLE AS start_s FROM eps, (VALUES (24.0::DOUBLE), (36.0), (48.0)) l(len))),
runs AS (SELECT *, cell - row_number() OVER (PARTITION BY episode_id ORDER BY cell) AS island FROM cells WHERE speech < 0.2),
gap AS (SELECT episode_id, start_s, len, max(n) AS longest FROM (SELECT w.episode_id, start_s, len, island, count(*) AS n FROM win w JOIN runs r ON w.episode_id = r.episode_id AND r.cell >= start_s AND r.cell < end_s GROUP BY ALL) GROUP BY ALL),
agg AS (SELECT w.episode_id, w.start_s, w.end_s, w.len, avg(speech) AS density, sum(words) / len AS wps, quantile_cont(audio_energy, 0.9) AS e90, avg(audio_energy) AS em, max(audio_sharpness) AS sharp,
  avg(face) AS face, max(face_ratio) AS ratio, sum(cuts) / len * 60 AS cpm, avg(motion) AS motion FROM win w JOIN cells c ON w.episode_id = c.episode_id AND c.cell >= w.start_s AND c.cell < w.end_s GROUP BY w.episode_id, w.start_s, w.end_s, w.len),
heads AS (SELECT episode_id, start_s, least(720, start_s + 2) AS head_end FROM (SELECT DISTINCT episode_id, start_s FROM win)),
head_cells AS (SELECT h.episode_id, start_s, quantile_cont(audio_energy, 0.9) AS ha, avg(face) AS hf, avg(speech) AS hs FROM heads h JOIN cells c ON h.episode_id = c.episode_id AND c.cell >= start_s AND c.cell < head_end GROUP BY ALL),
head_text AS (SELECT h.episode_id, start_s, arg_max(struct_pack(score := score, type := type, text := text), (score, -s)) AS k FROM heads h JOIN hk ON h.episode_id = hk.episode_id AND least(hk.e, head_end) - greatest(hk.s, start_s) > 0 GROUP BY ALL),
hook AS (SELECT c.episode_id, c.start_s, coalesce(k.score, 0) AS ht, coalesce(k.type, '') AS htype, coalesce(k.text, '') AS htext, ha, hf, hs,
  greatest(0, least(1, (0.5 * coalesce(k.score, 0) + 0.3 * ha + 0.2 * hf) * CASE WHEN hs < 0.1 AND ha < 0.2 THEN 0.4 ELSE 1 END)) AS hook
  FROM head_cells c LEFT JOIN head_text t ON c.episode_id = t.episode_id AND c.start_s = t.start_s),
sig AS (SELECT a.*, coalesce(longest, 0) * 1.0 AS silence, ht, htype, htext, ha, hf, hs, hook,
  greatest(0, least(1, 0.6 * greatest(0, least(1, 1 - greatest(0.1 - density, density - 0.3, 0) / 0.2)) + 0.4 * greatest(0, least(1, wps / 0.5)))) AS transcript,
  greatest(0, least(1, 0.55 * e90 + 0.30 * em + 0.15 * sharp)) AS audio,
  greatest(0, least(1, 0.65 * face + 0.35 * greatest(0, least(1, ratio / 0.1)))) AS face_sig,
  greatest(0, least(1, 0.6 * greatest(0, least(1, 1 - greatest(0.5 - cpm, cpm - 3.0, 0) / 3.75)) + 0.4 * greatest(0, least(1, motion / motion_ref)))) AS scene,
  greatest(0, least(1, 0.45 * (1 - least(1, coalesce(longest, 0) / 12.0)) + 0.35 * (1 - greatest(0, least(1, 1 - density))) + 0.20 * greatest(0, least(1, cpm / 30)))) AS pacing
  FROM agg a JOIN refs USING (episode_id) LEFT JOIN gap USING (episode_id, start_s, len) JOIN hook USING (episode_id, start_s)),
scored AS (SELECT *, round(greatest(0, least(1, (0.24 * transcript + 0.20 * audio + 0.14 * face_sig + 0.12 * scene + 0.14 * pacing + 0.16 * hook)
  * CASE WHEN round(density, 3) < 0.08 THEN 0.55 ELSE 1 END * CASE WHEN round(face, 3) < 0.2 THEN 0.85 ELSE 1 END)), 4) AS score,
  list_filter([CASE WHEN round(density, 3) < 0.08 THEN 'мало речи' END, CASE WHEN round(face, 3) < 0.2 THEN 'лиц почти нет' END, CASE WHEN hook < 0.2 THEN 'слабый вход' END, CASE WHEN round(silence, 2) > 12 THEN 'провисание в середине' END], lambda x: x IS NOT NULL) AS warnings FROM sig)"""
