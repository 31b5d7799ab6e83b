"""Hooks, emotion peaks, tempo windows and the visual summary of episodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions.columns import explode_overlap


@dataclass(frozen=True)
class Lexicon:
    # Cue patterns, Unicode and without regard to case.
    question: str = r"\b(что|почему|как|зачем|кто|когда|где|какой|что-то|why|what|how|who|where|when)\b"
    confession: str = r"\b(признаюсь|признаю|если честно|честно говоря|мне стыдно|я боюсь|я никогда|я всегда)\b"
    promise: str = r"\b(обещаю|мы обещаем|я покажу|покажу дальше|сейчас покажу|скоро будет|в следующем)\b"
    interruption: str = r"(\.\.\.|—|–|…)"
    emotion: str = r"\b(вау|ого|ужас|страшно|люблю|ненавижу|боже|нет|да)\b"


# Score of each cue, in the order in which a later one names the hook.
CUES = (("question", 0.65), ("confession", 0.70), ("promise", 0.75), ("interruption", 0.60))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def hook_of(text: Column, words: Lexicon = Lexicon()) -> Column:
    """Struct (type, score) of a text, null without a cue: the last cue that fits names it, the highest scores it."""
    hit = {n: matches(text, getattr(words, n)) for n, _ in CUES}
    hit["question"] = hit["question"] | text.contains("?")
    kind = F.coalesce(*[F.when(hit[n], n) for n, _ in reversed(CUES)])
    score = F.greatest(*[F.when(hit[n], s).otherwise(0.0) for n, s in CUES])
    score = F.least(F.lit(0.95), score + F.when(text.endswith("?") | text.endswith("!"), 0.05).otherwise(0.0))
    return F.when((text != "") & kind.isNotNull(), F.struct(kind.alias("type"), F.round(score, 3).alias("score")))


def hooks(segments: DataFrame, words: Lexicon = Lexicon(), top: int = 50) -> DataFrame:
    """The best hooks of each episode: by score as shown, then start."""
    x = segments.withColumn("h", hook_of(F.col("text"), words)).where("h is not null").select("episode_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "h.type", "h.score", "text")
    w = Window.partitionBy("episode_id").orderBy(F.col("score").desc(), "start_s", "end_s", "text")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def emotion_peaks(audio: DataFrame, segments: DataFrame, words: Lexicon = Lexicon(), *, cell_s: float = 10.0, least: float = 0.55, top: int = 12) -> DataFrame:
    """Loud events, more so where a segment they touch has an emotional mark; the first such segment is quoted.

    Only marked segments can matter, and both sides are put on a coarse grid, so that touching
    intervals (ends included) meet on equal cells.
    """
    w = Window.partitionBy("episode_id")
    e = audio.withColumn("__top", F.max("peak").over(w)).where("end_s > start_s").withColumn("__id", F.xxhash64("episode_id", "start_s", "end_s", "peak", "category"))
    marked = segments.where(F.col("text").contains("!") | matches(F.col("text"), words.emotion)).select("episode_id", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), "text", "seg_id")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell_s), F.floor(F.col(b) / cell_s)))
    near = e.select("__id", "episode_id", "start_s", "end_s", cells("start_s", "end_s").alias("c")).join(marked.withColumn("c", cells("s0", "s1")), ["episode_id", "c"]).where("s1 >= start_s and s0 <= end_s")
    quote = near.groupBy("__id").agg(F.min_by("text", "seg_id").alias("quote"))
    x = e.join(quote, "__id", "left")
    raw = 0.6 * F.col("peak") / F.when(F.col("__top") == 0, 1.0).otherwise(F.col("__top")) + 0.4 * F.col("quote").isNotNull().cast("int")
    x = x.withColumn("raw", raw).where(F.col("raw") >= least)
    x = x.select("episode_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.round(F.least(F.col("raw"), F.lit(0.98)), 3).alias("score"), "peak", "category", F.coalesce("quote", F.lit("")).alias("transcript"))
    r = Window.partitionBy("episode_id").orderBy(F.col("score").desc(), "start_s", "end_s", "peak", "category")
    return x.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top)


def tempo_windows(episodes: DataFrame, segments: DataFrame, cuts: DataFrame, motion: DataFrame, window_s: float = 5.0) -> DataFrame:
    """Tumbling windows of each episode, the last one cut at its end: speech density, silence, cuts, mean motion."""
    eps = episodes.where("duration_s > 0").withColumn("cells", F.ceil(F.col("duration_s") / window_s).cast("int"))
    base = eps.select("episode_id", "duration_s", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    clipped = segments.join(eps, "episode_id").withColumn("end_s", F.least("end_s", "duration_s"))
    speech = explode_overlap(clipped, "start_s", "end_s", window_s, F.col("cells")).groupBy("episode_id", "cell").agg(F.sum("covered").alias("spoken"))
    at = lambda df: df.join(eps.select("episode_id", "duration_s"), "episode_id").where("t >= 0 and t < duration_s").withColumn("cell", F.floor(F.col("t") / window_s).cast("int"))
    c = at(cuts).groupBy("episode_id", "cell").agg(F.count("*").alias("cuts"))
    m = at(motion).groupBy("episode_id", "cell").agg(F.avg("diff").alias("motion"))
    x = base.join(speech, ["episode_id", "cell"], "left").join(c, ["episode_id", "cell"], "left").join(m, ["episode_id", "cell"], "left")
    start = F.col("cell") * window_s
    end = F.least("duration_s", start + window_s)
    density = F.least(F.lit(1.0), F.coalesce("spoken", F.lit(0.0)) / (end - start))
    return x.select("episode_id", F.round(start, 3).alias("start_s"), F.round(end, 3).alias("end_s"), F.round(density, 4).alias("speech_density"), F.round(F.greatest(F.lit(0.0), 1.0 - density), 4).alias("silence_ratio"), F.coalesce("cuts", F.lit(0)).alias("cuts"), F.round("motion", 4).alias("motion_intensity"))


def visual_summary(episodes: DataFrame, faces: DataFrame, cuts: DataFrame, motion: DataFrame) -> DataFrame:
    """Face time and coverage, duration-weighted face size, cut rate, mean and 90th percentile of motion."""
    size = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s") - F.col("start_s")).otherwise(0.0)
    f = faces.groupBy("episode_id").agg(F.count("*").alias("events"), F.sum(size).alias("time"), F.sum(size * F.coalesce("max_face_ratio", F.lit(0.0))).alias("weighted"))
    c = cuts.groupBy("episode_id").agg(F.count("*").alias("cuts"))
    m = motion.groupBy("episode_id").agg(F.avg("diff").alias("mean"), F.percentile("diff", F.lit(0.9)).alias("p90"))
    x = episodes.join(f, "episode_id", "left").join(c, "episode_id", "left").join(m, "episode_id", "left").fillna(0, ["events", "time", "weighted", "cuts"])
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = F.col("duration_s")
    return x.select("episode_id", F.col("events").alias("face_events"), F.round("time", 3).alias("face_time_s"), F.round(per(F.col("time"), d), 4).alias("coverage_ratio"), F.round(per(F.col("weighted"), F.col("time")), 4).alias("avg_face_ratio"), F.col("cuts").alias("cut_count"), F.round(per(F.col("cuts") * 60.0, d), 3).alias("cuts_per_min"), F.round("mean", 4).alias("motion_mean"), F.round("p90", 4).alias("motion_p90"))
