"""Intervals, moments, text and choices over events, conversations, documents, pages, part and orders."""

from pyspark.sql import functions as F

from tempora.functions import intervals, text
from tempora.operators import matching, moments, scoring
from tempora.plans.config import Validation
from tempora.plans.queries_moments import CHOSEN
from tempora.plans.stand_ins import CFG, MAX_S, MIN_S, SQL, WINDOWS, read, signals, timeline
from tempora.sources import files

CHECK = Validation.resolve({"min_segment_s": 4.0, "snap_tolerance_s": 2.0})


def _asked(spark, d):
    """A moment of up to three spans for each signup of an episode: (episode_id, key, segs)."""
    ev = signals(spark, d).hooks
    n = F.split("text", " ")[1].cast("long")
    one = lambda k: F.struct((F.col("start_s") + k * (n % 13)).alias("start"), (F.col("start_s") + k * (n % 13) + 6 + n % 9).alias("end"))
    return ev.select("episode_id", n.alias("key"), F.array(*[one(float(k)) for k in range(3)]).alias("segs"))


def snap_nearest(spark, d):
    s = signals(spark, d)
    points = moments.snap_points(s.segments, s.cuts, CHECK)
    x = s.episodes.join(points, "episode_id").select("episode_id", "points", F.explode(F.sequence(F.lit(0), F.lit(720), F.lit(24))).alias("at"))
    return x.select("episode_id", "at", F.round(intervals.snap(F.col("at").cast("double"), F.col("points"), F.lit(2.0), F.lit(0.0), F.lit(720.0)), 6).alias("snapped"), F.size("points").alias("n_points"))


def interval_subtract(spark, d):
    x = signals(spark, d).faces.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("taken"))
    x = x.select("episode_id", F.posexplode(intervals.subtract(intervals.span(F.lit(0.0), F.lit(720.0)), F.col("taken"))).alias("i", "p"))
    return x.select("episode_id", F.round("p.start", 6).alias("start_s"), F.round("p.end", 6).alias("end_s"))


def moment_weighted_eval(spark, d):
    x = moments.evaluate(_asked(spark, d), timeline(spark, d), signals(spark, d).hooks, CFG, CHECK)
    r9 = lambda c: F.floor(c * 1e9 + 0.5) / 1e9  # noqa: E731  as the SQL twin rounds: 0.5350951835 is a little under a half there, and a half to F.round
    return x.select("episode_id", "key", F.round("speech_density", 3).alias("speech_density"), *[r9(F.col("signals")[c]).alias(c) for c in ("transcript", "audio", "face", "scene", "pacing", "hook")], "score", "fatal")


def repair_segments(spark, d):
    s = signals(spark, d)
    x = moments.repaired(_asked(spark, d), moments.snap_points(s.segments, s.cuts, CHECK), s.episodes, 12.0, 30.0, CHECK)
    return x.select("episode_id", "key", F.posexplode("segs").alias("i", "p"), F.array_join("notes", "; ").alias("notes")).select("episode_id", "key", "i", "p.start", "p.end", "notes")


def _answers(spark, d):
    """Model answers made of the moments asked for: a fenced object for even episodes, a list for odd ones."""
    span = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
    x = _asked(spark, d).withColumn("s", F.to_json(F.map_from_entries(F.transform("segs", lambda p, i: F.struct(F.concat(F.lit("segment_"), (3 - i).cast("string")), span(p))))))
    x = x.withColumn("m", F.concat(F.lit('{"title": "clip '), F.col("key"), F.lit('", "segments": '), "s", F.lit("}")))
    by = x.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("key", "m"))).alias("all"))
    obj = F.concat(F.lit("```json\n{"), F.array_join(F.transform("all", lambda e: F.concat(F.lit('"moment_'), e["key"].cast("string"), F.lit('": '), e["m"])), ", "), F.lit("}\n```"))
    lst = F.concat(F.lit("["), F.array_join(F.transform("all", lambda e: e["m"]), ", "), F.lit("]"))
    return by.select("episode_id", F.when(F.col("episode_id") % 2 == 0, obj).otherwise(lst).alias("raw_json"))


def model_json_decode(spark, d):
    x = moments.decode_answers(_answers(spark, d))
    x = x.select("episode_id", "title", F.posexplode("segs").alias("i", "p"))
    return x.select("episode_id", "title", "i", F.round("p.start", 6).alias("start_s"), F.round("p.end", 6).alias("end_s"))


def select_moments(spark, d):
    s = signals(spark, d)
    t = timeline(spark, d)
    c = scoring.build_candidates(t, s.hooks, MIN_S, MAX_S, CFG)
    x = moments.select_moments(_answers(spark, d), episodes=s.episodes, timeline=t, hooks=s.hooks, candidates=c, segments=s.segments, cuts=s.cuts, min_s=12.0, max_s=48.0, min_count=4, max_count=6, scoring=CFG, cfg=CHECK, fallback_title="clip")
    return x.select("episode_id", "moment_no", "title", F.size("segs").alias("n_segs"), "duration_s", "score", "source")


def heuristic_moments(spark, d):
    c = scoring.build_candidates(timeline(spark, d), signals(spark, d).hooks, MIN_S, MAX_S, CFG)
    x = moments.heuristic_moments(c, 3, "clip")
    return x.select("episode_id", "moment_no", "title", "duration_s", "score", "source")


def transcript_projection(spark, d):
    x = read(spark, d, "conversations")
    return x.select("conv_id", "turn", text.collapse(F.col("text")).alias("text"), text.word_count(F.col("text")).cast("long").alias("words"))


def transcript_render(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("episode_id"), F.col("turn").cast("double").alias("start_s"), (F.col("turn") + 0.5).alias("end_s"), "text")
    return files.rendered_transcript(x).select("episode_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").alias("chars"))


def text_caps_strip(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", text.subtitle(F.col("text")).alias("caps"))


def title_from_text(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", text.title_of(F.col("text"), "CLIP").alias("title"))


def word_chunks(spark, d):
    x = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", text.chunks(text.timed_tokens(text.tokens(F.col("text")), F.col("turn").cast("double"), F.col("turn") + 1.0), 5).alias("c"))
    x = x.select("conv_id", "turn", F.posexplode("c").alias("i", "c"))
    return x.select("conv_id", "turn", "i", F.col("c.text").alias("text"), F.round("c.start", 6).alias("start_s"), F.round("c.end", 6).alias("end_s"))


def title_wrap(spark, d):
    return read(spark, d, "part").select("p_partkey", text.wrap_words(F.col("p_name"), 2).alias("lines"))


def episode_range_parse(spark, d):
    k = F.col("o_orderkey")
    spec = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 3).cast("string"), F.lit(", "), (k % 11 + 1).cast("string"))
    x = read(spark, d, "orders").select("o_orderkey", F.explode(text.episode_range(spec)).alias("episode"))
    return x


def clean_names(spark, d):
    raw = F.concat(F.col("p_name"), F.lit("_1080p_"), F.col("p_brand"))
    titled = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("moment_"), F.col("p_partkey").cast("string"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return read(spark, d, "part").select("p_partkey", text.show_name(raw, "show").alias("name"), text.clip_title(titled, F.col("p_brand")).alias("title"), text.quality(F.concat((F.col("p_size") * 10).cast("string"), F.lit("p"))).alias("quality"))


def message_html(spark, d):
    x = read(spark, d, "part")
    return x.select("p_partkey", text.message(F.array(F.concat(F.col("p_name"), F.lit(" <b> & 'x'")), F.lit("")), F.col("p_brand")).alias("message"))


def batch_of_ten(spark, d):
    x = matching.batches(read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item")), key="l_suppkey", order="item", size=10)
    return x.groupBy("l_suppkey", "batch").agg(F.count("*").alias("items"), F.min("item").alias("first_item"))


def new_files_anti(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("path"))
    o = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("path"))
    return files.new_files(c, o)


def stream_pick(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey"), (F.col("l_quantity") * 30).cast("int").alias("quality"), (F.col("l_returnflag") == "R").alias("is_master"), (F.col("l_linestatus") == "F").alias("is_mp4"), "l_linenumber")
    return matching.pick_stream(x, key="l_orderkey", max_quality=720).select("l_orderkey", "quality", "is_master", "is_mp4")


def fuzzy_title_match(spark, d):
    p = read(spark, d, "part")
    q = F.concat(F.lit("query "), (F.col("p_partkey") % 20).cast("string"))
    x = p.select(q.alias("query"), F.col("p_partkey").alias("no"), F.col("p_name").alias("title"), F.col("p_type").alias("original_title"))
    return matching.best_title(x)


def similar_part_names(spark, d):
    p = read(spark, d, "part")
    named = p.select(F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    x = matching.similar_texts(p.select(F.col("p_name").alias("text")), named, least=0.7)
    return x.select("a", "b", F.round("ratio", 9).alias("ratio"))


def player_order(spark, d):
    p = read(spark, d, "part")
    x = p.select((F.col("p_partkey") % 50).alias("episode"), F.col("p_partkey").alias("no"), F.when(F.col("p_size") % 3 == 0, "Studio").when(F.col("p_size") % 3 == 1, "stud").otherwise("xyz").alias("label"), F.element_at(F.array(*map(F.lit, (*matching.PLAYERS, "other"))), (F.col("p_partkey") % 9 + 1).cast("int")).alias("player"))
    return matching.order_players(x, key="episode", voice="studio").select("episode", "no", "rank", F.round("voice_score", 6).alias("voice_score"))


def safe_file_names(spark, d):
    return read(spark, d, "pages").select("page_id", text.safe_filename("url").alias("safe"), text.file_stem("url").alias("stem"))


def visible_region(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10 - 300).alias("s"), (F.col("l_tax") * 1000).alias("n"))
    b = intervals.visible_bounds(F.col("s"), F.col("n"), F.lit(100.0))
    return x.select("l_orderkey", "l_linenumber", F.round(intervals.visible_centre(F.col("s"), F.col("n"), F.lit(100.0)), 6).alias("centre"), F.round(b["start"], 6).alias("left"), F.round(b["width"], 6).alias("width"))


QUERIES = {f.__name__: f for f in (
    snap_nearest, interval_subtract, moment_weighted_eval, repair_segments, model_json_decode, select_moments, heuristic_moments, transcript_projection, transcript_render, text_caps_strip, title_from_text, word_chunks, title_wrap,
    episode_range_parse, clean_names, message_html, batch_of_ten, new_files_anti, stream_pick, fuzzy_title_match, similar_part_names, player_order, safe_file_names, visible_region,
)}

ASKED = "ask AS (SELECT episode_id, split_part(text, ' ', 2)::BIGINT AS key, k AS i, s + k * (split_part(text, ' ', 2)::BIGINT % 13) AS a, s + k * (split_part(text, ' ', 2)::BIGINT % 13) + 6 + split_part(text, ' ', 2)::BIGINT % 9 AS b FROM hk, (SELECT unnest(range(0, 3)) AS k))"
EVALUATED = """win AS (SELECT DISTINCT episode_id, a AS start_s, b AS end_s, b - a AS len, greatest(0, floor(a))::INT AS lo, CASE WHEN least(720, ceil(b)) <= greatest(0, floor(a)) THEN least(720, greatest(0, floor(a)) + 1) ELSE least(720, ceil(b)) END::INT AS hi FROM ask),
runs AS (SELECT *, cell - row_number() OVER (PARTITION BY episode_id ORDER BY cell) AS island FROM cells WHERE speech < 0.2),
gap AS (SELECT episode_id, start_s, end_s, max(n) AS longest FROM (SELECT w.episode_id, start_s, end_s, island, count(*) AS n FROM win w JOIN runs r ON w.episode_id = r.episode_id AND r.cell >= lo AND r.cell < hi GROUP BY ALL) GROUP BY ALL),
agg AS (SELECT w.episode_id, w.start_s, w.end_s, w.len, coalesce(avg(speech), 0) AS density, coalesce(sum(words), 0) / greatest(1e-6, w.len) AS wps, coalesce(quantile_cont(audio_energy, 0.9), 0) AS e90, coalesce(avg(audio_energy), 0) AS em, coalesce(max(audio_sharpness), 0) AS sharp,
  coalesce(avg(face), 0) AS face, coalesce(max(face_ratio), 0) AS ratio, coalesce(sum(cuts), 0) / greatest(1e-6, w.len) * 60 AS cpm, coalesce(avg(motion), 0) AS motion FROM win w LEFT JOIN cells c ON w.episode_id = c.episode_id AND c.cell >= w.lo AND c.cell < w.hi GROUP BY w.episode_id, w.start_s, w.end_s, w.len),
sig AS (SELECT a.*, 0.6 * greatest(0, least(1, 1 - greatest(0.1 - density, density - 0.3, 0) / 0.2)) + 0.4 * greatest(0, least(1, wps / 0.5)) AS transcript,
  greatest(0, least(1, 0.55 * e90 + 0.30 * em + 0.15 * sharp)) AS audio, greatest(0, least(1, 0.65 * face + 0.35 * greatest(0, least(1, ratio / 0.1)))) AS face_sig,
  greatest(0, least(1, 0.6 * greatest(0, least(1, 1 - greatest(0.5 - cpm, cpm - 3.0, 0) / 3.75)) + 0.4 * greatest(0, least(1, motion / motion_ref)))) AS scene,
  greatest(0, least(1, 0.45 * (1 - least(1, coalesce(longest, 0) / 12.0)) + 0.35 * (1 - greatest(0, least(1, 1 - density))) + 0.20 * greatest(0, least(1, cpm / 30)))) AS pacing
  FROM agg a JOIN refs USING (episode_id) LEFT JOIN gap USING (episode_id, start_s, end_s)),
j AS (SELECT k.episode_id, key, (b - a) / sum(b - a) OVER (PARTITION BY k.episode_id, key) AS share, s.* EXCLUDE (episode_id) FROM ask k JOIN sig s ON k.episode_id = s.episode_id AND k.a = s.start_s AND k.b = s.end_s)"""
_PUNCT = r"[.,!?:;\-—–()\[\]\"''«»…]+"
#: Similarity of ``pairs`` (a, b) as ``ratios`` (a, b, ratio), by taking out the longest common block, the first of equals, again and again.
RATIOS = """
blocks AS (
  SELECT a, b, a AS x, b AS y, 0 AS got FROM pairs
  UNION ALL
  SELECT a, b, CASE WHEN side = 0 THEN substr(x, 1, m.i - 1) ELSE substr(x, m.i + m.k, 1000) END,
    CASE WHEN side = 0 THEN substr(y, 1, m.j - 1) ELSE substr(y, m.j + m.k, 1000) END, CASE WHEN side = 0 THEN m.k ELSE 0 END
  FROM (
    SELECT a, b, x, y, list_max(list_transform(range(1, length(x) + 1), lambda i: list_max(list_transform(range(1, length(y) + 1), lambda j:
      struct_pack(k := coalesce(list_max(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: substr(x, i, k) = substr(y, j, k))), 0), ni := -i, nj := -j))))) AS z
    FROM blocks WHERE x <> '' AND y <> ''),
    LATERAL (SELECT z.k AS k, -z.ni AS i, -z.nj AS j) m, (SELECT unnest([0, 1]) AS side) WHERE m.k > 0),
ratios AS (SELECT a, b, 2.0::DOUBLE * sum(got) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)"""
ORACLES = {
    "fuzzy_title_match": f"""
WITH RECURSIVE r AS (SELECT 'query ' || p_partkey % 20 AS query, p_partkey AS no, p_name AS title, p_type AS original_title FROM part),
pairs AS (SELECT DISTINCT lower(title) AS a, query AS b FROM r UNION SELECT DISTINCT lower(original_title), query FROM r), {RATIOS},
s AS (SELECT query, no, title, greatest(x.ratio, y.ratio) AS score FROM r JOIN ratios x ON x.a = lower(title) AND x.b = query JOIN ratios y ON y.a = lower(original_title) AND y.b = query)
SELECT query, no, title, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, no) AS n FROM s) WHERE n = 1""",
    "safe_file_names": r"""
SELECT page_id, left(trim(regexp_replace(url, '[<>:"/\\|?*«»\s_]+', '_', 'g'), '._'), 150) AS safe,
  coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(url, '[/\\:*?"<>|]', '-', 'g'), '[^\p{L}\p{N} _-]', '', 'g')), ' +', '_', 'g'), ''), CASE WHEN url IS NOT NULL THEN 'episode' END) AS stem
FROM pages""",
    "similar_part_names": f"""
WITH RECURSIVE pairs AS (SELECT DISTINCT lower(p.p_name) AS a, lower(q.p_name || ' ' || q.p_brand) AS b FROM (SELECT DISTINCT p_name FROM part) p, (SELECT DISTINCT p_name, p_brand FROM part) q), {RATIOS}
SELECT a, b, round(ratio, 9) AS ratio FROM ratios WHERE ratio >= 0.7""",
    "snap_nearest": f"""WITH {SQL}, p AS (SELECT DISTINCT episode_id, round(p, 3) AS p FROM (SELECT episode_id, unnest([s, e]) AS p FROM seg UNION ALL SELECT episode_id, t FROM cut) WHERE p >= 0), n AS (SELECT episode_id, count(*) AS n_points FROM p GROUP BY 1),
q AS (SELECT episode_id, unnest(range(0, 721, 24))::INT AS at_h FROM eps), b AS (SELECT q.episode_id, at_h, arg_min(p, (abs(p - at_h), p)) AS p FROM q JOIN p ON q.episode_id = p.episode_id AND abs(p - at_h) < 2 AND p <= 720 GROUP BY ALL)
SELECT q.episode_id, at_h AS "at", round(coalesce(p, at_h::DOUBLE), 6) AS snapped, n_points::INT AS n_points FROM q JOIN n USING (episode_id) LEFT JOIN b USING (episode_id, at_h)""",
    "interval_subtract": f"""WITH {SQL}, x AS (SELECT episode_id, s, least(e, 720.0) AS e FROM fac WHERE s < 720 AND e > 0), m AS (SELECT *, max(e) OVER (PARTITION BY episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM x),
g AS (SELECT episode_id, coalesce(reached, 0.0) AS a, s AS b FROM m UNION ALL SELECT episode_id, max(e), 720.0 FROM x GROUP BY 1) SELECT episode_id, round(a, 6) AS start_s, round(b, 6) AS end_s FROM g WHERE b > a""",
    "moment_weighted_eval": f"""WITH {SQL}, {ASKED}, {EVALUATED},
hd AS (SELECT episode_id, key, a AS h0, least(720, a + 2) AS h1 FROM ask WHERE i = 0),
hb AS (SELECT *, greatest(0, floor(h0))::INT AS lo, CASE WHEN least(720, ceil(h1)) <= greatest(0, floor(h0)) THEN least(720, greatest(0, floor(h0)) + 1) ELSE least(720, ceil(h1)) END::INT AS hi FROM hd),
hc AS (SELECT h.episode_id, h.key, coalesce(quantile_cont(audio_energy, 0.9), 0) AS ha, coalesce(avg(face), 0) AS hf, coalesce(avg(speech), 0) AS hs
  FROM hb h LEFT JOIN cells c ON c.episode_id = h.episode_id AND c.cell >= h.lo AND c.cell < h.hi GROUP BY h.episode_id, h.key),
ht AS (SELECT h.episode_id, h.key, max(k.score) AS words FROM hd h JOIN hk k ON k.episode_id = h.episode_id AND least(k.e, h1) - greatest(k.s, h0) > 0 GROUP BY h.episode_id, h.key),
ho AS (SELECT hc.episode_id, hc.key, greatest(0, least(1, (0.5 * coalesce(words, 0) + 0.3 * ha + 0.2 * hf) * CASE WHEN hs < 0.1 AND ha < 0.2 THEN 0.4 ELSE 1 END)) AS hook
  FROM hc LEFT JOIN ht ON ht.episode_id = hc.episode_id AND ht.key = hc.key),
mw AS (SELECT episode_id, key, sum(round(density, 3) * share) AS density, sum(transcript * share) AS transcript, sum(audio * share) AS audio, max(audio) AS loudest, sum(face_sig * share) AS face, sum(scene * share) AS scene, sum(pacing * share) AS pacing FROM j GROUP BY episode_id, key)
SELECT episode_id, key, round(density, 3) AS speech_density, round(transcript, 9) AS transcript, round(audio, 9) AS audio, round(face, 9) AS face, round(scene, 9) AS scene, round(pacing, 9) AS pacing, round(hook, 9) AS hook,
  round(0.24 * transcript + 0.20 * audio + 0.14 * face + 0.12 * scene + 0.14 * pacing + 0.16 * hook, 4) AS score,
  CASE WHEN density < 0.05 AND loudest < 0.15 THEN '{moments.EMPTY}' END AS fatal FROM mw JOIN ho USING (episode_id, key)""",
    "model_json_decode": f"WITH {SQL}, {ASKED} SELECT episode_id, 'clip ' || key AS title, (2 - i)::INT AS i, round(a, 6) AS start_s, round(b, 6) AS end_s FROM ask",
    "heuristic_moments": f"""WITH {SQL}, {WINDOWS}, {CHOSEN} SELECT c.episode_id, rank::INT AS moment_no, CASE WHEN trim(htext) = '' THEN 'clip' ELSE upper(htext) END AS title, p.n AS duration_s, s.score, 'heuristic_candidate' AS source FROM cand c JOIN scored s ON c.episode_id = s.episode_id AND c.p.s = s.start_s AND c.p.n = s.len WHERE rank <= 3""",
    "transcript_projection": r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM conversations",
    "transcript_render": r"SELECT conv_id AS episode_id, md5(string_agg(printf('[%.2f-%.2f] %s', turn::DOUBLE, turn + 0.5::DOUBLE, text) || chr(10), '' ORDER BY turn)) AS md5, length(string_agg(printf('[%.2f-%.2f] %s', turn::DOUBLE, turn + 0.5::DOUBLE, text) || chr(10), '' ORDER BY turn))::INT AS chars FROM conversations GROUP BY 1",
    "text_caps_strip": rf"SELECT doc_id, trim(regexp_replace(upper(regexp_replace(trim(regexp_replace(replace(replace(text, 'ß', 'ss'), '_', ' '), '\s+', ' ', 'g')), '{_PUNCT}', '', 'g')), '\s+', ' ', 'g')) AS caps FROM documents WHERE text IS NOT NULL",
    "title_from_text": r"WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s\-]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, trim(left(upper(array_to_string(string_split(t, ' ')[1:6], ' ')), 45)) AS t FROM x) SELECT doc_id, CASE WHEN t <> '' THEN t ELSE 'CLIP' END AS title FROM y",
    "word_chunks": r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations WHERE text IS NOT NULL), n AS (SELECT *, len(ws) AS n, unnest(range(0, ((len(ws) + 4) // 5)::BIGINT)) AS i FROM w)
SELECT conv_id, turn, i::INT AS i, array_to_string(ws[i * 5 + 1:i * 5 + 5], ' ') AS text, round(turn + i * 5 * (1.0::DOUBLE / n), 6) AS start_s, round(least(turn + 1.0::DOUBLE, turn + (least(i * 5 + 5, n) - 1) * (1.0::DOUBLE / n) + 1.0::DOUBLE / n), 6) AS end_s FROM n""",
    "title_wrap": r"WITH w AS (SELECT p_partkey, regexp_extract_all(p_name, '\S+') AS ws FROM part) SELECT p_partkey, array_to_string(list_transform(range(0, ((len(ws) + 1) // 2)::BIGINT), lambda i: array_to_string(ws[i * 2 + 1:i * 2 + 2], ' ')), chr(10)) AS lines FROM w",
    "episode_range_parse": "SELECT DISTINCT o_orderkey, unnest(list_concat(range(o_orderkey % 7 + 1, o_orderkey % 7 + 4), [o_orderkey % 11 + 1]))::INT AS episode FROM orders",
    "clean_names": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9_]+', ' ', 'g'), '[_\s]+', ' ', 'g')) AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS title, p_size * 10 AS quality FROM part",
    "message_html": "SELECT p_partkey, p_name || ' &lt;b&gt; &amp; &#x27;x&#x27;' || chr(10) || chr(10) || '<b>Название аниме:</b> ' || p_brand AS message FROM part",
    "batch_of_ten": "SELECT l_suppkey, (n // 10)::INT AS batch, count(*) AS items, min(item) AS first_item FROM (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS n FROM lineitem) GROUP BY 1, 2",
    "new_files_anti": "SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "stream_pick": "SELECT l_orderkey, quality, is_master, is_mp4 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY quality > 720, is_master, quality DESC, is_mp4 DESC) AS n FROM (SELECT l_orderkey, (l_quantity * 30)::INT AS quality, l_returnflag = 'R' AS is_master, l_linestatus = 'F' AS is_mp4 FROM lineitem)) WHERE n = 1",
    "player_order": "SELECT episode, no, row_number() OVER (PARTITION BY episode ORDER BY voice_score DESC, no % 9, no)::INT AS rank, voice_score FROM (SELECT p_partkey % 50 AS episode, p_partkey AS no, [1.0, 0.8, 0.0][p_size % 3 + 1]::DOUBLE AS voice_score FROM part)",
    "visible_region": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 - 300 AS s, l_tax * 1000 AS n FROM lineitem), y AS (SELECT *, greatest(0, least(100, s)) AS lo, greatest(greatest(0, least(100, s)), least(100, s + n)) AS hi FROM x), z AS (SELECT *, CASE WHEN hi > lo THEN lo + (hi - lo) / 2 ELSE 50 END AS c, greatest(1, least(100, abs(n))) AS spare FROM y)
SELECT l_orderkey, l_linenumber, round(c, 6) AS centre, round(CASE WHEN hi > lo THEN lo ELSE greatest(0, least(100 - spare, c - spare / 2)) END, 6) AS left, round(CASE WHEN hi > lo THEN hi - lo ELSE spare END, 6) AS width FROM z""",
}
