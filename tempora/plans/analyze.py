"""The analytic query as a whole: signals of many episodes to ranked candidates and moments.

``analyze`` is one lazy plan keyed by episode. Model answers come from outside as a table, so
``validate`` is a second plan; where answers are missing, ``fallback`` takes its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import moments, narrative, scoring, timeline
from tempora.plans.config import Scoring, Validation


@dataclass
class Analysis:
    episodes: DataFrame
    timeline: DataFrame
    hooks: DataFrame
    candidates: DataFrame
    emotion: DataFrame
    tempo: DataFrame
    visual: DataFrame


def analyze(segments: DataFrame, audio: DataFrame, faces: DataFrame, motion: DataFrame, cuts: DataFrame, *, min_s: float = 30.0, max_s: float = 90.0, scoring_cfg: dict | None = None, words: narrative.Lexicon = narrative.Lexicon()) -> Analysis:
    """Everything that is known of the episodes before a model is asked. ``segments`` needs seg_id and words."""
    cfg = Scoring.resolve(scoring_cfg)
    segments = segments.where(F.col("start_s").isNotNull() & (F.col("end_s") > F.col("start_s")))
    eps = timeline.episode_duration(segments, audio, faces)
    hooks = narrative.hooks(segments, words)
    t = timeline.build_timeline(eps, segments, audio, faces, cuts, motion, cfg.cell_s)
    return Analysis(eps, t, hooks, scoring.build_candidates(t, hooks, min_s, max_s, cfg), narrative.emotion_peaks(audio, segments, words), narrative.tempo_windows(eps, segments, cuts, motion), narrative.visual_summary(eps, faces, cuts, motion))


def validate(a: Analysis, answers: DataFrame, segments: DataFrame, cuts: DataFrame, *, min_s: float = 30.0, max_s: float = 90.0, min_count: int = 1, max_count: int = 5, scoring_cfg: dict | None = None, validation_cfg: dict | None = None) -> DataFrame:
    return moments.select_moments(answers, episodes=a.episodes, timeline=a.timeline, hooks=a.hooks, candidates=a.candidates, segments=segments, cuts=cuts, min_s=min_s, max_s=max_s, min_count=min_count, max_count=max_count, scoring=Scoring.resolve(scoring_cfg), cfg=Validation.resolve(validation_cfg))


def fallback(a: Analysis, count: int, title: str = "") -> DataFrame:
    return moments.heuristic_moments(a.candidates, count, title)
