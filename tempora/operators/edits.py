"""Edit decisions: the pieces of chosen moments, and the piecewise linear map from source time to the finished clip's.

A clip is its moment's pieces in their order, end to end, played at a speed. Words, cuts and other intervals or points of
an episode go through the map by an equi-join on the episode: its pieces come along as one short array (moments times
pieces), so there is no join by range, and nothing is sorted. The way back, from frames of a clip to source times, finds
its piece in the clip's own array and then meets camera states by an as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.columns import lit
from tempora.operators import camera

PIECE = "struct<piece:int,src_start_s:double,src_end_s:double,out_start_s:double,out_end_s:double,speed:double>"


def pieces_of(segs: Column, speed: Column) -> Column:
    """Array of pieces of a cut list: empty and reversed spans go, output time is the running length over the speed."""
    kept = F.filter(segs, lambda s: s["end"] > s["start"])
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast(f"array<{PIECE}>").alias("made"))

    def add(acc, s):
        end = acc["at"] + (s["end"] - s["start"]) / speed
        piece = F.struct((F.size(acc["made"]) + 1).alias("piece"), s["start"].cast("double").alias("src_start_s"), s["end"].cast("double").alias("src_end_s"), acc["at"].alias("out_start_s"), end.alias("out_end_s"), speed.alias("speed"))
        return F.struct(end.alias("at"), F.concat(acc["made"], F.array(piece)).alias("made"))

    return F.aggregate(kept, zero, add, lambda acc: acc["made"])


def edit_decisions(moments: DataFrame, speed: Column | float = 1.0) -> DataFrame:
    """(episode_id, moment_no, piece, src_start_s, src_end_s, out_start_s, out_end_s, speed) of moments (episode_id, moment_no, segs).

    A speed of zero, below zero or none is 1, as is one that is not a number.
    """
    v = lit(speed).cast("double")
    v = F.when(v.isNull() | F.isnan(v) | (v <= 0), 1.0).otherwise(v)
    return moments.select("episode_id", "moment_no", F.inline(pieces_of(F.col("segs"), v)))


def _maps(decisions: DataFrame) -> DataFrame:
    piece = F.struct("moment_no", "piece", "src_start_s", "src_end_s", "out_start_s", "speed")
    return decisions.groupBy("episode_id").agg(F.sort_array(F.collect_list(piece)).alias("__pieces"))


def intervals_through(rows: DataFrame, decisions: DataFrame, *, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``rows`` (episode_id, start, end, ...) once for each piece they share time with: moment_no, piece, out_start_s, out_end_s, whole.

    What is outside the piece is cut off; ``whole`` says that nothing was. Rows that only touch a piece are not in it.
    """
    s, e = F.col(start), F.col(end)
    x = rows.join(_maps(decisions), "episode_id")
    x = x.withColumn("__p", F.explode(F.filter("__pieces", lambda p: (p["src_start_s"] < e) & (p["src_end_s"] > s))))
    p = F.col("__p")
    out = lambda t: p["out_start_s"] + (t - p["src_start_s"]) / p["speed"]
    return x.select(
        *rows.columns, p["moment_no"].alias("moment_no"), p["piece"].alias("piece"), out(F.greatest(s, p["src_start_s"])).alias("out_start_s"), out(F.least(e, p["src_end_s"])).alias("out_end_s"),
        ((s >= p["src_start_s"]) & (e <= p["src_end_s"])).alias("whole"),
    )


def points_through(rows: DataFrame, decisions: DataFrame, *, t: str = "t") -> DataFrame:
    """``rows`` (episode_id, t, ...) once for each piece [start, end) that holds them: moment_no, piece, out_t."""
    at = F.col(t)
    x = rows.join(_maps(decisions), "episode_id")
    x = x.withColumn("__p", F.explode(F.filter("__pieces", lambda p: (p["src_start_s"] <= at) & (p["src_end_s"] > at))))
    p = F.col("__p")
    return x.select(*rows.columns, p["moment_no"].alias("moment_no"), p["piece"].alias("piece"), (p["out_start_s"] + (at - p["src_start_s"]) / p["speed"]).alias("out_t"))


def seams(decisions: DataFrame) -> DataFrame:
    """(episode_id, moment_no, out_t): where one piece of a clip meets the next, which a viewer sees as a cut."""
    return decisions.where("piece > 1").select("episode_id", "moment_no", F.col("out_start_s").alias("out_t"))


def frame_times(decisions: DataFrame, fps: float) -> DataFrame:
    """(episode_id, moment_no, piece, frame, out_t, t): the source time of each frame of each clip, from 0 and before its end."""
    whole = F.when(F.col("out_end_s") * fps == F.floor(F.col("out_end_s") * fps), F.floor(F.col("out_end_s") * fps) - 1).otherwise(F.floor(F.col("out_end_s") * fps))
    x = decisions.withColumn("__lo", F.ceil(F.col("out_start_s") * fps)).withColumn("__hi", whole).where("__lo <= __hi")
    x = x.withColumn("frame", F.explode(F.sequence("__lo", "__hi")))
    out_t = F.col("frame") / F.lit(float(fps))
    return x.select("episode_id", "moment_no", "piece", "frame", out_t.alias("out_t"), (F.col("src_start_s") + (out_t - F.col("out_start_s")) * F.col("speed")).alias("t"))


def camera_through(decisions: DataFrame, states: DataFrame, fps: float, columns: list[str]) -> DataFrame:
    """``frame_times`` with the camera's ``columns`` at each frame, interpolated between the states (episode_id, t, ...) around its source time."""
    frames = frame_times(decisions, fps)
    at = camera.interpolate(states, frames.select("episode_id", "t").distinct(), columns)
    return frames.join(at, ["episode_id", "t"])
