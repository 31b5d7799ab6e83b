"""Events from frames and masks: islands, gap-merged events, features, labels, cuts and motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions.columns import mean_abs_diff

# Labels and hints of events.
BURST, SHOUT, HIT, PEAK = "взрыв", "крик", "удар", "пик"
SHARP_PEAK, SHOUT_OR_NOISE, LOUD, ODD_NOISE, BACKGROUND = "резкий_пик", "крик_или_шум", "громкий_момент", "интересный_шум", "фон_или_музыка"


def islands(df: DataFrame, *, key: str, order: str, on: str, values: dict[str, Column] | None = None) -> DataFrame:
    """Runs of consecutive rows for which the boolean column ``on`` holds: key, first and last ``order``, rows, and ``values`` aggregated.

    A null ``on`` counts as off; a run that reaches the last row is closed there.
    """
    w = Window.partitionBy(key).orderBy(order)
    state = F.coalesce(F.col(on), F.lit(False))
    changed = F.coalesce((state != F.lag(state).over(w)).cast("int"), F.lit(0))
    x = df.withColumn("__run", F.sum(changed).over(w)).where(state)
    return x.groupBy(key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"), *[c.alias(n) for n, c in (values or {}).items()]).drop("__run")


def mask_events(df: DataFrame, *, key: str, frame: str, on: str, strength: str, frame_s: float, min_event_ms: float = 60.0) -> DataFrame:
    """Events of a mask over frames: start_s, end_s, peak, mean, frames; shorter ones are dropped."""
    found = islands(df, key=key, order=frame, on=on, values={"peak": F.max(strength), "mean": F.avg(strength)})
    return found.where(F.col("frames") * frame_s * 1000.0 >= min_event_ms).select(
        key, F.round(F.col("first") * frame_s, 3).alias("start_s"), F.round((F.col("last") + 1) * frame_s, 3).alias("end_s"), F.round("peak", 6).alias("peak"), F.round("mean", 6).alias("mean"), "frames"
    )


def loud_frames(df: DataFrame, *, key: str, level: str, strong_q: float = 0.92, soft_q: float = 0.80, least: float = 0.02, soft: bool = True) -> DataFrame:
    """``df`` with thresholds per key and flags: strong at or above its percentile (and ``least``), soft below it but above its own."""
    t = df.groupBy(key).agg(F.greatest(F.percentile(level, F.lit(strong_q)), F.lit(least)).alias("strong_at"), F.greatest(F.percentile(level, F.lit(soft_q)), F.lit(least)).alias("soft_at"))
    x = df.join(t, key)
    strong = F.col(level) >= F.col("strong_at")
    return x.withColumn("strong", strong).withColumn("soft", (F.col(level) >= F.col("soft_at")) & ~strong if soft else F.lit(False))


def merge_gaps(df: DataFrame, *, key: str, gap_s: float = 0.08) -> DataFrame:
    """Events at most ``gap_s`` apart become one: widest span, highest peak, strong if one is; frames are added.

    ``mean`` is folded in time order, each next event weighing as much as all before it. A gap is the
    difference of the two rounded times as doubles.
    """
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    reached = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = F.when(reached.isNull(), 1).otherwise((F.col("start_s") - reached > gap_s).cast("int"))
    x = df.withColumn("__far", far).withColumn("__group", F.sum("__far").over(w))
    by = x.groupBy(key, "__group").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("peak").alias("peak"), F.sum("frames").alias("frames"), F.bool_or(F.col("category") == "strong").alias("any_strong"),
        F.min_by("category", F.struct("start_s", "end_s")).alias("category"), F.array_sort(F.collect_list(F.struct("start_s", "end_s", "mean"))).alias("all"),
    )
    mean = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0))["mean"], lambda a, e: F.round((a + e["mean"]) / 2, 6))
    return by.select(key, "start_s", "end_s", F.round("peak", 6).alias("peak"), mean.alias("mean"), "frames", F.when(F.col("any_strong"), "strong").otherwise(F.col("category")).alias("category"))


def event_features(events: DataFrame, frames: DataFrame, *, key: str, frame_s: float) -> DataFrame:
    """rms_mean, rms_p95, zcr_mean, centroid_mean and sharpness of each event over its frames.

    An event becomes a row for each of its frames, so frames meet events by (key, frame), not by range.
    """
    e = events.withColumn("__id", F.xxhash64(key, "start_s", "end_s"))
    lo, hi = F.round(F.col("start_s") / frame_s).cast("int"), F.round(F.col("end_s") / frame_s).cast("int")
    each = e.select("__id", key, F.when(lo < hi, F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(1)) - 1)).alias("all")).select("__id", key, F.explode("all").alias("frame"))
    got = each.join(frames, [key, "frame"]).groupBy("__id").agg(F.avg("rms").alias("rms_mean"), F.percentile("rms", F.lit(0.95)).alias("rms_p95"), F.avg("zcr").alias("z"), F.avg("centroid").alias("c"))
    out = e.join(got, "__id", "left")
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n)
    return out.select(*events.columns, zero(F.col("rms_mean"), 6).alias("rms_mean"), zero(F.col("rms_p95"), 6).alias("rms_p95"), zero(F.col("z"), 6).alias("zcr_mean"), zero(F.col("c"), 3).alias("centroid_mean"), zero(sharpness(F.col("z"), F.col("c")), 6).alias("sharpness"))


def sharpness(zcr: Column, centroid: Column) -> Column:
    return 0.65 * zcr + 0.35 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), centroid / 8000.0))


def peak_label(peak: Column, top: Column) -> Column:
    share = F.when(top > 0, peak / top)
    return F.when(share >= 0.9, BURST).when(share >= 0.75, SHOUT).when(share >= 0.6, HIT).otherwise(PEAK)


def event_hint(category: Column, sharp: Column, duration: Column) -> Column:
    strong = F.when((sharp >= 0.35) & (duration <= 0.35), SHARP_PEAK).when((sharp >= 0.25) & (duration >= 0.35), SHOUT_OR_NOISE).otherwise(LOUD)
    return F.when(category == "strong", strong).otherwise(F.when(sharp >= 0.30, ODD_NOISE).otherwise(BACKGROUND))


def labelled_top(events: DataFrame, *, key: str, max_events: int = 120) -> DataFrame:
    """Labels and hints, and the ``max_events`` events of a key: strong before soft, then by peak, then by time."""
    top = F.max("peak").over(Window.partitionBy(key))
    x = events.withColumn("type", peak_label(F.col("peak"), top)).withColumn("duration_s", F.round(F.col("end_s") - F.col("start_s"), 3))
    x = x.withColumn("hint", event_hint(F.col("category"), F.col("sharpness"), F.col("duration_s")))
    w = Window.partitionBy(key).orderBy(F.when(F.col("category") == "strong", 0).otherwise(1), F.col("peak").desc(), "start_s", "end_s")
    return x.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_events).drop("__n")


def audio_stats(frames: DataFrame, *, key: str, frame_s: float) -> DataFrame:
    """Global statistics of a key's frames."""
    r = lambda c, n, d=6: F.round(c, d).alias(n)
    return frames.groupBy(key).agg(
        r(F.avg("rms"), "rms_mean"), r(F.stddev_pop("rms"), "rms_std"), r(F.percentile("rms", F.lit(0.9)), "rms_p90"), r(F.percentile("rms", F.lit(0.95)), "rms_p95"), r(F.max("rms"), "rms_max"), r(F.avg("zcr"), "zcr_mean"),
        F.count("*").alias("frames"), r(F.count("*") * frame_s, "duration_s", 3),
    )


def analyze_audio(frames: DataFrame, *, key: str = "episode_id", frame_s: float = 0.04, min_event_ms: float = 60.0, gap_s: float = 0.08, max_events: int = 120) -> DataFrame:
    """Audio events of frames (key, frame, rms, zcr, centroid): islands of loud frames, merged, featured, labelled."""
    x = loud_frames(frames, key=key, level="rms")
    part = lambda c: mask_events(x, key=key, frame="frame", on=c, strength="rms", frame_s=frame_s, min_event_ms=min_event_ms).withColumn("category", F.lit(c))
    merged = merge_gaps(part("strong").unionByName(part("soft")), key=key, gap_s=gap_s) if gap_s > 0 else part("strong").unionByName(part("soft"))
    return labelled_top(event_features(merged, frames, key=key, frame_s=frame_s), key=key, max_events=max_events)


def motion(frames: DataFrame, *, key: str, order: str, pixels: str) -> DataFrame:
    """``diff``: mean absolute difference of each frame to the one before; the first has none."""
    w = Window.partitionBy(key).orderBy(order)
    return frames.withColumn("diff", mean_abs_diff(F.col(pixels), F.lag(pixels).over(w))).where("diff is not null").drop(pixels)


def cuts(series: DataFrame, *, key: str, least: float = 0.12, q: float = 0.9) -> DataFrame:
    """Rows of a motion series at or above the key's percentile, and ``least``."""
    at = series.groupBy(key).agg(F.greatest(F.lit(least), F.percentile("diff", F.lit(q))).alias("cut_at"))
    return series.join(at, key).where("diff >= cut_at")


def adaptive_cuts(series: DataFrame, *, key: str, order: str, least: float = 0.12, times: float = 4.0, frames: int = 40) -> DataFrame:
    """``median`` of the up to ``frames`` differences before each, and ``is_cut``: at least ``times`` that, and ``least``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-frames, -1)
    m = F.coalesce(F.percentile("diff", F.lit(0.5)).over(w), F.lit(0.0))
    return series.withColumn("median", m).withColumn("is_cut", F.col("diff") >= F.greatest(F.lit(least), F.col("median") * times))


def debounced(times: Column, apart: float) -> Column:
    """Of a sorted array of times those at least ``apart`` after the last one that was taken."""
    return F.aggregate(times, F.array().cast("array<double>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(F.concat(F.array(F.lit(-1e300)), acc), -1) >= apart), F.concat(acc, F.array(t))).otherwise(acc))


def face_activity(detections: DataFrame, durations: DataFrame, *, interval_s: float = 5.0, max_events: int = 120) -> tuple[DataFrame, DataFrame]:
    """Face events from samples (episode_id, t, faces, ratio), and each episode's coverage before events are cut to ``max_events``."""
    x = detections.withColumn("on", F.col("faces") > 0)
    found = islands(x, key="episode_id", order="t", on="on", values={"faces": F.max("faces"), "max_face_ratio": F.max("ratio")}).join(durations, "episode_id")
    events = found.select("episode_id", F.col("first").alias("start_s"), F.least(F.col("last") + interval_s, "duration_s").alias("end_s"), F.col("faces").cast("int").alias("faces"), "max_face_ratio", "duration_s").where("end_s > start_s")
    coverage = events.groupBy("episode_id").agg((F.sum(F.col("end_s") - F.col("start_s")) / F.greatest(F.first("duration_s"), F.lit(1e-6))).alias("coverage"))
    w = Window.partitionBy("episode_id").orderBy(F.col("faces").desc(), "start_s")
    top = events.drop("duration_s").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_events).drop("__n")
    return top, coverage
