"""Sliding windows over timelines: statistics, six signals, a composite score, ranked candidates.

A timeline row holds its episode's arrays, and all that windows need is in it and in the episode's hooks: one pass over
these rows scores every window, with numpy, an episode at a time. What windows are scored by comes from structures of the whole
episode: running totals for means and sums, a wavelet matrix for percentiles, sparse tables for peaks and silences. No window's
cells are looked at. Windows leave as flat rows, a stretch of them at a time; where only ranked candidates are asked for, the greedy
choice is made beside the scores and no other window leaves. There is no range join, and after the timeline no shuffle of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import ranks
from tempora.plans.config import Scoring, window_lengths

SILENT = 0.2
# Texts of warnings.
LOW_SPEECH, LOW_FACE, WEAK_HOOK, SAGGING = "мало речи", "лиц почти нет", "слабый вход", "провисание в середине"
WARNINGS = (LOW_SPEECH, LOW_FACE, WEAK_HOOK, SAGGING)

SIGNALS = ("transcript", "audio", "face", "scene", "pacing", "hook")
SHOWN = ("speech_density", "words_per_s", "longest_silence_s", "energy_p90", "energy_mean", "sharpness", "face_coverage", "face_peak", "cuts_per_min", "motion_mean")
HEAD = ("hook", "hook_text_score", "hook_audio", "hook_face", "hook_speech", "hook_type", "hook_text")
#: Flat columns of a window, as they leave Python. ``warned`` has a bit for each of ``WARNINGS``.
FLAT = [(c, "double") for c in ("start_s", "end_s", "duration_s", "score", *SIGNALS)] + [(f"s_{c}", "double") for c in SHOWN] + [(f"h_{c}", "string" if c in HEAD[-2:] else "double") for c in HEAD] + [("warned", "int")]
FLAT_ALWAYS = ("start_s", "end_s", "duration_s", "score")
#: Windows scored at a time, and rows of a batch at least, if there are more.
STRETCH = 1 << 15


# ---------------------------------------------------------------- one episode


def clip01(x: np.ndarray) -> np.ndarray:
    """Into [0, 1]; NaN is 0."""
    return np.clip(np.where(np.isnan(x), 0.0, x), 0.0, 1.0)


def sweet_spot(x: np.ndarray, low: float, high: float, falloff: float = 1.0) -> np.ndarray:
    """1 within [low, high], falling off linearly over ``falloff`` times the width on either side."""
    low, high = min(low, high), max(low, high)
    span = max(1e-6, (high - low) * falloff)
    return clip01(1.0 - np.maximum(np.maximum(low - x, x - high), 0.0) / span)


class Episode:
    """One timeline row with its hooks: scores any of its windows."""

    def __init__(self, signals: dict[str, np.ndarray], duration: float, motion_ref: float, hooks: list[dict], cfg: Scoring):
        self.stats, self.duration, self.motion_ref, self.cfg = ranks.WindowStats(signals, SILENT), duration, motion_ref, cfg
        # the best score wins; of equal ones the first in the list
        good = [(i, h) for i, h in enumerate(hooks) if h["start"] is not None and h["end"] is not None and h["score"] is not None and not h["score"] <= 0]
        good.sort(key=lambda x: (-np.inf if np.isnan(x[1]["score"]) else -x[1]["score"], x[0]))
        self.hooks = [h for _, h in good]
        self.types, self.texts = ([h[c] or "" for h in self.hooks] + [""] for c in ("type", "text"))
        self.powers = np.array([h["score"] for h in self.hooks] + [0.0], np.float64)

    def heads(self, start: np.ndarray) -> dict[str, np.ndarray]:
        """The hook signal of windows that begin at ``start``, with its evidence; ``which`` is the place of its hook."""
        end = np.minimum(self.duration, start + self.cfg.hook_window_s)
        lo, hi = ranks.cells_of(start, end, self.stats.cells, self.cfg.cell_s)
        audio, face, speech = self.stats.energy.percentile(lo, hi, 0.9), self.stats.mean("face", lo, hi), self.stats.mean("speech", lo, hi)
        which = np.full(len(start), len(self.hooks))
        for i in range(len(self.hooks) - 1, -1, -1):  # better ones later, over the others
            which[(self.hooks[i]["end"] > start) & (self.hooks[i]["start"] < end)] = i
        text = self.powers[which]
        raw = 0.5 * text + 0.3 * audio + 0.2 * face
        mute = (speech < 0.1) & (audio < 0.2)
        return {"hook": clip01(np.where(mute, raw * 0.4, raw)), "hook_text_score": text, "hook_audio": audio, "hook_face": face, "hook_speech": speech, "which": which}

    def look(self, start: np.ndarray, end: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Statistics and signals, but for the hook, of the windows [start, end), unrounded."""
        cfg = self.cfg
        w = self.stats.of(*ranks.cells_of(start, end, self.stats.cells, cfg.cell_s))
        span = np.maximum(1e-6, end - start)
        s = {
            "speech_density": w["speech"], "words_per_s": w["words"] / span, "longest_silence_s": w["hush"] * cfg.cell_s, "energy_p90": w["energy_p90"], "energy_mean": w["energy"], "sharpness": w["sharpness"],
            "face_coverage": w["face"], "face_peak": w["face_peak"], "cuts_per_min": w["cuts"] / span * 60.0, "motion_mean": w["motion"],
        }
        gap = max(1e-6, cfg.max_silence_gap_s)
        of = {
            "transcript": 0.6 * sweet_spot(s["speech_density"], *cfg.speech_sweet_spot) + 0.4 * clip01(s["words_per_s"] / cfg.words_per_s_ref),
            "audio": 0.55 * s["energy_p90"] + 0.30 * s["energy_mean"] + 0.15 * s["sharpness"],
            "face": 0.65 * s["face_coverage"] + 0.35 * clip01(s["face_peak"] / max(1e-6, cfg.target_face_ratio)),
            "scene": 0.6 * sweet_spot(s["cuts_per_min"], *cfg.cuts_per_min_sweet_spot, falloff=1.5) + 0.4 * clip01(s["motion_mean"] / self.motion_ref),
            "pacing": 0.45 * (1.0 - clip01(s["longest_silence_s"] / gap)) + 0.35 * (1.0 - clip01(1.0 - s["speech_density"])) + 0.20 * clip01(s["cuts_per_min"] / 30.0),
        }
        return s, {k: clip01(v) for k, v in of.items()}

    def windows(self, start: np.ndarray, end: np.ndarray, no: np.ndarray, heads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Columns ``FLAT`` of the windows [start, end); the hook is that of ``heads`` at ``no``.

        Penalties go by the statistics as they are shown, with three decimals; the score is clamped and has four.
        """
        cfg, (s, of) = self.cfg, self.look(start, end)
        of["hook"] = heads["hook"][no]
        raw = sum((cfg.weights[k] * of[k] for k in cfg.weights), np.zeros(len(start)))
        few_words = ranks.half_up(s["speech_density"], 3) < cfg.min_speech_density
        few_faces = (ranks.half_up(s["face_coverage"], 3) < cfg.min_face_coverage) & (cfg.min_face_coverage > 0)
        raw = raw * np.where(few_words, cfg.empty_window_penalty, 1.0)
        raw = raw * np.where(few_faces, cfg.low_face_penalty, 1.0)
        warned = few_words + 2 * few_faces + 4 * (of["hook"] < 0.2) + 8 * (ranks.half_up(s["longest_silence_s"], 2) > cfg.max_silence_gap_s)
        out = {"start_s": ranks.half_up(start, 3), "end_s": ranks.half_up(end, 3), "duration_s": ranks.half_up(end - start, 3), "score": ranks.half_up(clip01(raw), 4), **of, **{f"s_{k}": v for k, v in s.items()}}
        return out | self.evidence(heads, no) | {"warned": warned.astype(np.int32)}

    def evidence(self, heads: dict[str, np.ndarray], no) -> dict[str, np.ndarray]:
        """Columns ``h_`` of the heads ``no``."""
        which = pa.array(heads["which"][no])
        return {f"h_{k}": heads[k][no] for k in HEAD[:-2]} | {"h_hook_type": pa.array(self.types, pa.string()).take(which), "h_hook_text": pa.array([t[:160] for t in self.texts], pa.string()).take(which)}


def windows_of(duration: float, min_s: float, max_s: float, cfg: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of starts of an episode's sliding windows; the whole episode if none fits."""
    step = max(0.25, cfg.step_s)
    sizes = [n for n in window_lengths(min_s, max_s, cfg.length_steps) if duration >= n]
    no = [np.arange(int(np.floor((duration - n + 1e-6) / step)) + 1) for n in sizes]
    if not no:
        return np.zeros(1), np.array([duration], np.float64), np.zeros(1, np.int64)
    return np.concatenate([i * step for i in no]), np.concatenate([i * step + n for i, n in zip(no, sizes, strict=True)]), np.concatenate(no)


def chosen(score: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, cfg: Scoring) -> list[int]:
    """Greedy choice by (-score, start, size) of windows that overlap no chosen one too much, in order; at most ``max_candidates`` (one at least)."""
    order = np.lexsort((size, start, -score))
    start, end, size = start[order], end[order], size[order]
    left, out = np.ones(len(order), bool), []
    while len(out) < max(1, cfg.max_candidates) and left.any():
        i = int(left.argmax())
        left[i] = False
        out.append(int(order[i]))
        least = np.minimum(size[i], size)
        shared = np.maximum(0.0, np.minimum(end[i], end) - np.maximum(start[i], start))
        left &= ~(shared / np.where(least == 0, 1.0, least) > cfg.nms_overlap)
    return out


# ---------------------------------------------------------------- tables


def episodes_in(batch: pa.RecordBatch, cfg: Scoring) -> Iterator[Episode]:
    """The episodes of a batch of rows with ``ranks.SIGNALS``, duration_s, motion_ref and hooks."""
    cells = {}
    for s in ranks.SIGNALS:
        a = batch.column(s)
        cells[s] = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
    duration, ref, hooks = (batch.column(c) for c in ("duration_s", "motion_ref", "hooks"))
    for i in range(batch.num_rows):
        x = {s: values[at[i] : at[i + 1]].astype(np.float64, copy=False) for s, (at, values) in cells.items()}
        yield Episode(x, float(duration[i].as_py()), float(ref[i].as_py()), hooks[i].as_py() or [], cfg)


def _scorer(names: list[str], min_s: float, max_s: float, cfg: Scoring, kind: str):
    """A function of batches: rows of their episodes with ``names``, of ``FLAT``. ``kind`` says which: every window, the chosen ("best") with their rank, or the heads."""
    step = max(0.25, cfg.step_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, rows = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(p[names[0]]) for p in parts]
            key = pa.array([i.as_py() for i in ids], ids[0].type).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            cols = [pa.concat_arrays([p[c] for p in parts]) if isinstance(parts[0][c], pa.Array) else pa.array(np.concatenate([p[c] for p in parts])) for c in names]
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([key, *cols], names=["episode_id", *names])

        for b in batches:
            key = b.column("episode_id")
            for i, e in enumerate(episodes_in(b, cfg)):
                start, end, no = windows_of(e.duration, min_s, max_s, cfg)
                starts = np.arange(no.max() + 1) * step
                heads = e.heads(starts)
                stretches = [slice(at, at + STRETCH) for at in range(0, len(no), STRETCH)]
                made = (e.windows(start[s], end[s], no[s], heads) for s in stretches)
                if kind == "heads":
                    made = iter([{"start_s": ranks.half_up(starts, 3), **e.evidence(heads, slice(None))}])
                if kind == "best":
                    kept = [{c: x[c] for c in ("score", "start_s", "end_s", "duration_s")} for x in made]
                    picks = np.array(chosen(*[np.concatenate([x[c] for x in kept]) for c in ("score", "start_s", "end_s", "duration_s")], cfg), np.int64)
                    made = iter([e.windows(start[picks], end[picks], no[picks], heads) | {"rank": np.arange(1, len(picks) + 1, dtype=np.int32)}])
                for x in made:
                    ids.append(key[i])
                    parts.append(x)
                    rows += len(x[names[0]])
                    if rows >= STRETCH:
                        yield flush()
                        rows = 0
        if parts:
            yield flush()

    return run


def dealt(timeline: DataFrame, hooks: DataFrame | None) -> DataFrame:
    """Timeline rows with their hooks, dealt out by episode."""
    spark = timeline.sparkSession
    # timelines are small for the work in them: by size alone they would all be put in one task
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = timeline.select("episode_id", "duration_s", F.col("motion_ref").cast("double").alias("motion_ref"), *ranks.SIGNALS)
    return with_hooks(x.repartition(tasks, "episode_id"), hooks)


def _rows(timeline: DataFrame, hooks: DataFrame | None, min_s: float, max_s: float, cfg: Scoring, kind: str, flat: list[tuple[str, str]]) -> DataFrame:
    out = T.StructType([timeline.schema["episode_id"], *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in flat)).fields])
    return dealt(timeline, hooks).mapInArrow(_scorer([c for c, _ in flat], min_s, max_s, cfg, kind), out)


def _windows(timeline: DataFrame, hooks: DataFrame | None, min_s: float, max_s: float, cfg: Scoring, kind: str, only: tuple[str, ...] | None = None) -> DataFrame:
    flat = [(c, t) for c, t in FLAT if only is None or c in only or c in FLAT_ALWAYS] + [("rank", "int")] * (kind == "best")
    have = {c for c, _ in flat}
    part = lambda names, prefix="": [F.col(prefix + c).alias(c) for c in names if prefix + c in have]
    head = part(HEAD, "h_")
    stats = part(SHOWN, "s_") + ([F.struct(*head).alias("head")] if head else [])
    out = ["episode_id", *["rank"] * (kind == "best"), "start_s", "end_s", "duration_s", "score"]
    out += [F.struct(*x).alias(n) for n, x in (("signals", part(SIGNALS)), ("stats", stats)) if x]
    if "warned" in have:
        out.append(F.get(F.array(*[F.array(*[F.lit(t) for i, t in enumerate(WARNINGS) if n >> i & 1]).cast("array<string>") for n in range(1 << len(WARNINGS))]), F.col("warned")).alias("warnings"))
    return _rows(timeline, hooks, min_s, max_s, cfg, kind, flat).select(*out)


def score_windows(timeline: DataFrame, hooks: DataFrame | None, min_s: float, max_s: float, cfg: Scoring, only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for every window of every episode: start_s, end_s, duration_s, score, signals, stats, warnings.

    ``hooks`` is (episode_id, start_s, end_s, score, type, text); those of an episode are taken in
    the order of their score, then their start. ``only`` names what is needed of signals, stats and warnings,
    as in ``FLAT``: rows leave Python whole, so that what nobody reads costs as much as what is read.
    """
    return _windows(timeline, hooks, min_s, max_s, cfg, "every", only)


def window_heads(timeline: DataFrame, hooks: DataFrame | None, min_s: float, max_s: float, cfg: Scoring) -> DataFrame:
    """A row for every start of windows, which those of all lengths share: start_s, and the hook signal of its head with evidence."""
    x = _rows(timeline, hooks, min_s, max_s, cfg, "heads", [("start_s", "double"), *((c, t) for c, t in FLAT if c.startswith("h_"))])
    return x.select("episode_id", "start_s", *[F.col(f"h_{c}").alias(c) for c in HEAD])


def with_hooks(timeline: DataFrame, hooks: DataFrame | None) -> DataFrame:
    kind = "array<struct<start:double,end:double,score:double,type:string,text:string>>"
    if hooks is None:
        return timeline.withColumn("hooks", F.array().cast(kind))
    by = hooks.where("end_s > start_s").groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), F.col("start_s").cast("double").alias("start"), F.col("end_s").cast("double").alias("end"), F.col("score").cast("double").alias("score"), "type", "text"))).alias("hooks"))
    return timeline.join(by.select("episode_id", F.transform("hooks", lambda h: F.struct(*[h[c].alias(c) for c in ("start", "end", "score", "type", "text")])).alias("hooks")), "episode_id", "left")


def build_candidates(timeline: DataFrame, hooks: DataFrame | None, min_s: float, max_s: float, cfg: Scoring) -> DataFrame:
    """Ranked candidates of each episode, with signals, stats and warnings."""
    return _windows(timeline if cfg.enabled else timeline.limit(0), hooks, min_s, max_s, cfg, "best")


def for_prompt(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """The first candidates of each episode, flat."""
    s = F.col("stats")
    return candidates.where(F.col("rank") <= limit).select(
        "episode_id", "rank", "start_s", "end_s", "duration_s", "score", "signals", F.round(s["speech_density"], 3).alias("speech_density"), F.round(s["face_coverage"], 3).alias("face_coverage"),
        F.round(s["cuts_per_min"], 2).alias("cuts_per_min"), F.round(s["longest_silence_s"], 2).alias("longest_silence_s"), s["head"]["hook_type"].alias("hook_type"), s["head"]["hook_text"].alias("hook_text"), "warnings",
    )
