"""Recordings read by byte ranges, edit decisions and their time map, answers of several attempts."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import dsp, text
from tempora.operators import edits, layout, moments
from tempora.plans.config import Validation
from tempora.plans.queries_text import ASKED, EVALUATED, _asked
from tempora.plans.stand_ins import CFG, SQL, read, signals, timeline
from tempora.sources import wav
from tempora.sources.scratch import scratch_path

#: Recordings of ``events``: a file for each user, a sample of three channels for each event.
RATE, WINDOW_MS, SPLIT_BYTES = 1000, 8.0, 4096

#: Frames a second of a clip, as no length here is a whole number of frames: sums in another order differ around those.
FPS = 1.9137


def r8(c, name):
    """Eight decimals, after a nudge, as the SQL twins round."""
    return F.round(c + 1e-12, 8).alias(name)


def recordings(spark, d) -> str:
    """The folder of WAV files made of ``events``."""
    n = F.col("event_id")
    levels = F.array(F.floor(F.col("value") * 16), (n * 37) % 20001 - 10000, (n * 53) % 10007 - 5000)
    x = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.struct("ts", "event_id").alias("at"), levels.alias("values"))
    folder = scratch_path(spark, "recordings")
    wav.write_wav(x, folder, rate=RATE, channels=3).write.format("noop").mode("overwrite").save()
    return folder


def pcm_frames(spark, d):
    x = wav.read_pcm(spark, recordings(spark, d), sample_rate=RATE, window_ms=WINDOW_MS, split_bytes=SPLIT_BYTES)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return x.select(name.alias("name"), "frame", F.round(dsp.rms(F.col("samples")), 8).alias("rms"), F.round(dsp.zero_crossing_rate(F.col("samples")), 8).alias("zcr"), F.round(F.element_at("samples", 1), 8).alias("first"))


def _moments(spark, d):
    """Up to three clips an episode: every third signup begins a piece of clip 1, 2 or 3."""
    n = F.split("text", " ")[1].cast("long")
    x = signals(spark, d).hooks.select("episode_id", "start_s", n.alias("n"), (F.col("start_s") + 6.0 + n % 9).alias("end_s"))
    x = x.withColumn("moment_no", (F.row_number().over(Window.partitionBy("episode_id").orderBy("start_s", "n")) - 1) % 3 + 1)
    piece = F.struct("start_s", "n", "end_s")
    by = x.groupBy("episode_id", "moment_no").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    return by.select("episode_id", "moment_no", F.transform("all", lambda p: F.struct(p["start_s"].alias("start"), p["end_s"].alias("end"))).alias("segs"))


def _decisions(spark, d):
    return edits.edit_decisions(_moments(spark, d), F.element_at(F.array(F.lit(1.25), F.lit(0.0), F.lit(0.8)), F.col("moment_no")))


def edit_decisions(spark, d):
    return _decisions(spark, d).select("episode_id", "moment_no", "piece", *[r8(F.col(c), c) for c in ("src_start_s", "src_end_s", "out_start_s", "out_end_s")], "speed")


def edit_words(spark, d):
    x = edits.intervals_through(signals(spark, d).segments, _decisions(spark, d))
    return x.select("episode_id", "text", "moment_no", "piece", r8(F.col("out_start_s"), "out_start_s"), r8(F.col("out_end_s"), "out_end_s"), "whole")


def edit_cuts(spark, d):
    e = _decisions(spark, d)
    moved = edits.points_through(signals(spark, d).cuts, e).select("episode_id", "moment_no", "out_t", F.lit("source").alias("kind"))
    x = moved.unionByName(edits.seams(e).withColumn("kind", F.lit("seam")))
    return x.select("episode_id", "moment_no", "kind", r8(F.col("out_t"), "out_t"))


def edit_camera(spark, d):
    states = signals(spark, d).motion.groupBy("episode_id", "t").agg(F.max("diff").alias("cx"))
    x = edits.camera_through(_decisions(spark, d), states, FPS, ["cx"])
    return x.select("episode_id", "moment_no", "piece", "frame", r8(F.col("t"), "t"), F.round("cx", 6).alias("cx"))


STRICT = Validation.resolve({"enabled": False, "min_speech_density": 0.12, "min_audio_energy": 0.5})


def _tries(spark, d):
    """Three answers an episode: the first and second are broken, empty or missing for some, the third for a few."""
    e = F.col("episode_id")
    one = _asked(spark, d).withColumn("n", F.col("key") % 4)
    span = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
    one = one.withColumn("m", F.to_json(F.struct(F.concat(F.lit("clip "), "key").alias("title"), F.transform("segs", span).alias("segments"))))
    by = one.groupBy("episode_id", F.when(F.col("n") == 0, 1).when(F.col("n") == 1, 2).otherwise(3).alias("attempt")).agg(F.array_sort(F.collect_list(F.struct("key", "m"))).alias("all"))
    raw = F.concat(F.lit("["), F.array_join(F.transform("all", lambda m: m["m"]), ", "), F.lit("]"))
    spoiled = F.when((F.col("attempt") == 1) & (e % 3 == 0), "no json").when((F.col("attempt") == 2) & (e % 5 < 2), "{}").when((F.col("attempt") == 3) & (e % 4 == 0), '{"broken"').when((F.col("attempt") == 3) & (e % 4 == 1), "{}")
    return by.where(~((F.col("attempt") == 1) & (e % 3 == 1))).select("episode_id", "attempt", F.coalesce(spoiled, raw).alias("raw_json"))


def _spares(spark, d):
    """Purchases as candidates, in order of time."""
    n = F.col("event_id")
    x = signals(spark, d).audio.where((F.col("category") == "strong") & (n % 3 == 0))
    w = Window.partitionBy("episode_id").orderBy("start_s", n)
    head = F.struct(F.struct(F.concat(F.lit("spare "), n.cast("string")).alias("hook_text")).alias("head")).alias("stats")
    empty = F.struct(*[F.lit(0.0).alias(k) for k in CFG.weights])
    return x.select("episode_id", F.row_number().over(w).alias("rank"), "start_s", (F.col("start_s") + 12.0 + n % 5).alias("end_s"), F.lit(0.5).alias("score"), empty.alias("signals"), head)


def answer_attempts(spark, d):
    s = signals(spark, d)
    x = moments.first_usable(_tries(spark, d), episodes=s.episodes, timeline=timeline(spark, d), hooks=s.hooks, candidates=_spares(spark, d), segments=s.segments, cuts=s.cuts, min_s=1.0, max_s=1e6, min_count=1, max_count=1000, scoring=CFG, cfg=STRICT)
    return x.select("episode_id", F.coalesce("attempt", F.lit(0)).alias("attempt"), "title", F.size("segs").alias("n_segs"), F.round("duration_s", 3).alias("duration_s"), "source")


#: Advances by a rule, as no font is at hand: 300 to 900 thousandths, by code point.
GLYPHS = layout.Metrics(tuple(300 + 100 * (i % 7) for i in range(0x250)), other=700, line=1150, stroke=1)
MARKED = layout.Metrics(tuple(400 + 100 * (i % 7) for i in range(0x250)), other=800, line=1300, stroke=2)


def subtitle_lines(spark, d):
    x = read(spark, d, "conversations").where("text is not null")
    tagged = F.regexp_replace("text", r"(\S+\s+\S+\s+)([^\s<]+)", "$1<hl>$2</hl>")
    made = text.spans(tagged)
    x = x.select("conv_id", "turn", made.alias("s"))
    lines = layout.lay_out(F.col("s"), size=40, max_width=640, plain=GLYPHS, highlighted=MARKED)
    height = layout.line_height(F.col("s"), size=40, plain=GLYPHS, highlighted=MARKED)
    x = x.select("conv_id", "turn", F.posexplode(lines).alias("line", "l"), height.alias("height"))
    return x.select("conv_id", "turn", "line", F.array_join(F.transform("l.tokens", lambda t: t["text"]), "").alias("text"), F.size(F.filter("l.tokens", lambda t: t["highlighted"])).alias("marked"), F.col("l.width").alias("width"), "height")


def title_fit(spark, d):
    title = text.title_of(F.col("text"), "CLIP")
    x = read(spark, d, "documents").where("text is not null").select("doc_id", title.alias("t"))
    fit = layout.fit_title(F.split(text.wrap_words(F.col("t"), 3), "\n"), size=96, least=24, max_width=900, max_height=260, metrics=GLYPHS)
    return x.select("doc_id", F.col("t").alias("title"), fit.alias("f")).select("doc_id", "title", "f.size", "f.tries", "f.fits")


QUERIES = {f.__name__: f for f in (subtitle_lines, title_fit, pcm_frames, edit_decisions, edit_words, edit_cuts, edit_camera, answer_attempts)}

EDITS = """
pc AS (
  SELECT episode_id, (row_number() OVER (PARTITION BY episode_id ORDER BY s, n) - 1) % 3 + 1 AS moment_no, s, s + 6.0::DOUBLE + n % 9 AS e, n
  FROM (SELECT episode_id, s, split_part(text, ' ', 2)::BIGINT AS n FROM hk)),
sp AS (SELECT *, CASE moment_no WHEN 1 THEN 1.25::DOUBLE WHEN 2 THEN 1.0 ELSE 0.8 END AS speed FROM pc),
ed AS (
  SELECT episode_id, moment_no::INT AS moment_no, (row_number() OVER w)::INT AS piece, s AS a, e AS b, speed,
    (sum(e - s) OVER w - (e - s)) / speed AS oa, sum(e - s) OVER w / speed AS ob
  FROM sp WINDOW w AS (PARTITION BY episode_id, moment_no ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_UNITS = "list_sum(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 592 THEN {1} + 100 * (unicode(c) % 7) ELSE {2} END))"
_SIZES = ", ".join(f"({i + 1}, {s})" for i, s in enumerate(layout.ladder(96, 24)[:-1]))
ORACLES = {
    "subtitle_lines": rf"""
WITH RECURSIVE g AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '(\S+\s+\S+\s+)([^\s<]+)', '\1<hl>\2</hl>', 'g'), '<hl>\S+?</hl>|[^\s<]\S*\s*') AS ts FROM conversations WHERE text IS NOT NULL),
k AS (SELECT conv_id, turn, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS raw FROM g),
m AS (SELECT conv_id, turn, i, starts_with(raw, '<hl>') AS hl, replace(replace(raw, '<hl>', ''), '</hl>', '') AS t FROM k),
w AS (SELECT *, CASE WHEN hl THEN ceil({_UNITS.format("t", 400, 800)} * 40 / 1000.0::DOUBLE)::INT + 4 ELSE ceil({_UNITS.format("t", 300, 700)} * 40 / 1000.0::DOUBLE)::INT + 2 END AS width FROM m),
r AS (
  SELECT conv_id, turn, i, hl, t, width, 0 AS line, width AS used FROM w WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.turn, w.i, w.hl, w.t, w.width, CASE WHEN used + w.width <= 640 THEN line ELSE line + 1 END, CASE WHEN used + w.width <= 640 THEN used + w.width ELSE w.width END
  FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.i = r.i + 1)
SELECT conv_id, turn, line, string_agg(t, '' ORDER BY i) AS text, count(*) FILTER (WHERE hl)::INT AS marked, max(used)::INT AS width, {max(-(-1150 * 40 // 1000) + 2, -(-1300 * 40 // 1000) + 4) + 2} AS height
FROM r GROUP BY conv_id, turn, line""",
    "title_fit": rf"""
WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s\-]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, trim(left(upper(array_to_string(string_split(t, ' ')[1:6], ' ')), 45)) AS t FROM x), z AS (SELECT doc_id, CASE WHEN t <> '' THEN t ELSE 'CLIP' END AS title FROM y),
v AS (SELECT *, regexp_extract_all(title, '\S+') AS ws FROM z), l AS (SELECT doc_id, title, list_transform(range(0, ((len(ws) + 2) // 3)::BIGINT), lambda i: array_to_string(ws[i * 3 + 1:i * 3 + 3], ' ')) AS ls FROM v),
b AS (SELECT doc_id, title, list_max(list_transform(ls, lambda q: {_UNITS.format("q", 300, 700)})) AS units, len(ls) AS n FROM l),
f AS (SELECT b.*, k, s, ceil(units * s / 1000.0::DOUBLE) + 2 <= 900 AND ceil(n * 1150 * s / 1000.0::DOUBLE) + 2 <= 260 AS ok FROM b, (VALUES {_SIZES}) z(k, s))
SELECT doc_id, title, coalesce(arg_min(s, k) FILTER (WHERE ok), {layout.ladder(96, 24)[-1]})::INT AS size, coalesce(min(k) FILTER (WHERE ok), 20)::INT AS tries, bool_or(ok) AS fits FROM f GROUP BY doc_id, title""",
    "pcm_frames": """
WITH x AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    (greatest(-32768, least(32767, floor(value * 16))) + (event_id * 37) % 20001 - 10000 + (event_id * 53) % 10007 - 5000) / 32768.0::DOUBLE / 3 AS v
  FROM events),
y AS (SELECT *, i // 8 AS frame, lag(v) OVER (PARTITION BY user_id, i // 8 ORDER BY i) AS before FROM x)
SELECT 'u' || user_id AS name, frame, round(sqrt(avg(v * v)), 8) AS rms,
  round(sum(CASE WHEN before IS NOT NULL AND (v >= 0) <> (before >= 0) THEN 1.0 ELSE 0.0 END)::DOUBLE / 7, 8) AS zcr, round(max(CASE WHEN i % 8 = 0 THEN v END), 8) AS first
FROM y GROUP BY user_id, frame HAVING count(*) = 8""",
    "edit_decisions": f"""WITH {SQL}, {EDITS}
SELECT episode_id, moment_no, piece, round(a + 1e-12, 8) AS src_start_s, round(b + 1e-12, 8) AS src_end_s, round(oa + 1e-12, 8) AS out_start_s, round(ob + 1e-12, 8) AS out_end_s, speed FROM ed""",
    "edit_words": f"""WITH {SQL}, {EDITS}
SELECT g.episode_id, text, moment_no, piece, round(oa + (greatest(s, a) - a) / speed + 1e-12, 8) AS out_start_s, round(oa + (least(e, b) - a) / speed + 1e-12, 8) AS out_end_s, s >= a AND e <= b AS whole
FROM seg g JOIN ed ON g.episode_id = ed.episode_id AND a < e AND b > s""",
    "edit_cuts": f"""WITH {SQL}, {EDITS}
SELECT c.episode_id, moment_no, 'source' AS kind, round(oa + (t - a) / speed + 1e-12, 8) AS out_t FROM cut c JOIN ed ON c.episode_id = ed.episode_id AND a <= t AND b > t
UNION ALL SELECT episode_id, moment_no, 'seam', round(oa + 1e-12, 8) FROM ed WHERE piece > 1""",
    "edit_camera": f"""WITH {SQL}, {EDITS},
fr AS (SELECT episode_id, moment_no, piece, unnest(range(ceil(oa * {FPS}::DOUBLE)::BIGINT, ceil(ob * {FPS}::DOUBLE)::BIGINT)) AS frame, a, oa, speed FROM ed),
tm AS (SELECT *, a + (frame / {FPS}::DOUBLE - oa) * speed AS t FROM fr), st AS (SELECT episode_id, t, max(diff) AS cx FROM mot GROUP BY ALL),
lo AS (SELECT tm.*, st.t AS t0, st.cx AS c0 FROM tm ASOF LEFT JOIN st ON tm.episode_id = st.episode_id AND tm.t >= st.t),
hi AS (SELECT tm.episode_id, moment_no, frame, st.t AS t1, st.cx AS c1 FROM tm ASOF LEFT JOIN st ON tm.episode_id = st.episode_id AND tm.t <= st.t)
SELECT episode_id, moment_no, piece, frame, round(t + 1e-12, 8) AS t,
  round(CASE WHEN t0 IS NULL THEN c1 WHEN t1 IS NULL THEN c0 WHEN t1 > t0 THEN c0 * (1 - (t - t0) / (t1 - t0)) + c1 * ((t - t0) / (t1 - t0)) ELSE c0 END, 6) AS cx
FROM lo JOIN hi USING (episode_id, moment_no, frame)""",
    "answer_attempts": f"""WITH {SQL}, {ASKED.replace('ask AS', 'asked AS')},
spare AS (SELECT episode_id, event_id, row_number() OVER (PARTITION BY episode_id ORDER BY s, event_id) AS rank, s AS a, s + 12.0::DOUBLE + event_id % 5 AS b FROM aud WHERE category = 'strong' AND event_id % 3 = 0),
ask AS (SELECT episode_id, key, i, a, b FROM asked UNION ALL SELECT episode_id, -1 - event_id, 0, a, b FROM spare), {EVALUATED},
judged AS (SELECT episode_id, key, sum(round(density, 3) * share) AS density, max(audio) AS loudest, sum(end_s - start_s) AS size, count(*) AS n_segs FROM j GROUP BY ALL),
good AS (SELECT *, CASE WHEN key % 4 = 0 THEN 1 WHEN key % 4 = 1 THEN 2 ELSE 3 END AS attempt FROM judged WHERE NOT (density < 0.12::DOUBLE AND loudest < 0.5::DOUBLE)),
tries AS (SELECT episode_id, CASE WHEN key % 4 = 0 THEN 1 WHEN key % 4 = 1 THEN 2 ELSE 3 END AS attempt FROM asked GROUP BY ALL),
own AS (SELECT * FROM good WHERE key >= 0 AND NOT (attempt = 1 AND episode_id % 3 < 2) AND NOT (attempt = 2 AND episode_id % 5 < 2) AND NOT (attempt = 3 AND episode_id % 4 < 2)),
stop AS (SELECT episode_id, min(attempt) FILTER (WHERE attempt < 3) AS early FROM own GROUP BY 1),
last AS (SELECT episode_id FROM tries WHERE attempt = 3 AND episode_id % 4 <> 0),
pick AS (SELECT o.episode_id, o.attempt, 'clip ' || key AS title, n_segs, size, 'llm' AS source FROM own o JOIN stop s USING (episode_id) WHERE o.attempt = s.early OR (s.early IS NULL AND o.attempt = 3)),
fill AS (
  SELECT g.episode_id, 3 AS attempt, 'SPARE ' || (-1 - key) AS title, n_segs, size, 'heuristic_candidate' AS source, row_number() OVER (PARTITION BY g.episode_id ORDER BY rank) AS n
  FROM good g JOIN spare p ON p.episode_id = g.episode_id AND p.event_id = -1 - g.key WHERE g.key < 0 AND g.episode_id IN (FROM last) AND g.episode_id NOT IN (SELECT episode_id FROM pick)),
got AS (SELECT * FROM pick UNION ALL SELECT * EXCLUDE (n) FROM fill WHERE n = 1)
SELECT episode_id, attempt::INT AS attempt, title, n_segs::INT AS n_segs, round(size, 3) AS duration_s, source FROM got
UNION ALL SELECT episode_id, 0, 'SPARE ' || event_id, 1, round(b - a, 3), 'heuristic_candidate' FROM spare WHERE rank = 1 AND episode_id NOT IN (SELECT episode_id FROM got)""",
}
