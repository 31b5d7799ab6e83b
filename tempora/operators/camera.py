"""A virtual camera that follows a face: a state machine per episode, in time order.

Every frame depends on the state the one before left, so this is imperative code over one episode's
rows. ``Camera`` is that machine alone; batch runs it by ``applyInPandas``, streaming keeps it in a
state store (``tempora.streaming``). Points and velocities are complex numbers, x + iy.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field, fields, replace
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

CENTRE = 0.5 + 0.5j
REFERENCE_FPS = 8.0
NEVER = -1e9


@dataclass(frozen=True)
class CameraConfig:
    # Base settings.
    aspect: float = 0.0  # width of the crop over the width of the scaled frame; 0 means a 9:16 crop of a 16:9 frame
    analysis_fps: float = 8.0
    match_tolerance: float = 0.18
    max_miss_time: float = 2.5
    face_switch_margin: float = 0.15
    face_switch_hold_s: float = 0.5
    face_filter: float = 0.78
    max_face_step: float = 0.04
    stabilization_strength: float = 0.2
    smoothing: float = 0.92
    follow_stiffness: float = 9.0
    follow_damping: float = 2.2
    max_center_accel: float = 1.0
    max_center_speed: float = 0.45
    velocity_decay: float = 0.10
    velocity_soften: float = 0.8
    predictive_lead: float = 0.08
    human_lag: float = 0.03
    center_dead_zone: float = 0.035
    single_face_centering: bool = True
    side_bias: float = 0.22
    side_bias_strength: float = 0.35
    eye_level_lift: float = 0.12
    face_margin: float = 0.08
    face_coverage: float = 0.0
    max_zoom: float = 1.0
    min_zoom: float = 1.0
    zoom_smoothing: float = 0.75
    max_zoom_speed: float = 0.25
    scene_cut_detection: bool = True
    scene_cut_threshold: float = 0.06
    scene_cut_relative: float = 4.0
    scene_cut_window: int = 40
    scene_cut_min_interval_s: float = 0.4
    fallback_recenter_s: float = 3.0
    ken_burns_period: float = 12.0
    ken_burns_pan_amplitude: float = 0.03
    ken_burns_tilt_amplitude: float = 0.02
    ken_burns_zoom_amplitude: float = 0.0


# Profiles.
PROFILES = {
    "static": {"follow_stiffness": 2.0, "follow_damping": 5.0, "max_center_speed": 0.05, "max_center_accel": 0.35, "smoothing": 0.95, "predictive_lead": 0.0, "center_dead_zone": 0.06, "face_filter": 0.88},
    "operator": {"follow_stiffness": 8.4, "follow_damping": 2.35, "max_center_speed": 0.40, "max_center_accel": 0.85, "smoothing": 0.93, "predictive_lead": 0.065, "center_dead_zone": 0.052, "face_filter": 0.80},
    "action": {"follow_stiffness": 15.0, "follow_damping": 1.2, "max_center_speed": 0.80, "max_center_accel": 1.4, "smoothing": 0.86, "predictive_lead": 0.10, "center_dead_zone": 0.03, "face_filter": 0.72},
}


def resolve(given: dict | None = None) -> CameraConfig:
    """Base settings, then those of the profile (unknown ones mean ``operator``), then what is given and not None."""
    given = given or {}
    known = {f.name for f in fields(CameraConfig)}
    profile = PROFILES.get(str(given.get("profile") or "operator").lower(), PROFILES["operator"])
    return replace(CameraConfig(), **{**profile, **{k: v for k, v in given.items() if k in known and v is not None}})


def clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def shortened(v: complex, most: float) -> complex:
    """``v``, no longer than ``most``; a limit of zero is none."""
    n = abs(v)
    return v * (most / n) if n > most > 0 else v


def per_step(alpha: float, dt: float) -> float:
    """A smoothing factor meant for the reference frame rate, for a step of ``dt``."""
    alpha = clamp(alpha, 0.0, 0.999)
    return alpha ** (dt * REFERENCE_FPS) if alpha > 0 else 0.0


@dataclass
class Face:
    centre: complex
    width: float
    height: float
    score: float

    def weight(self) -> float:
        # As in functions.dsp.saliency.
        return 0.45 * self.score + 0.35 * min(1.0, math.sqrt(max(0.0, self.width * self.height)) / 0.35) + 0.20 * (1.0 - min(1.0, abs(self.centre - CENTRE) / 0.7071))


@dataclass
class State:
    face: Face | None = None
    faces: int = 0
    seen: float = NEVER
    wish: float = 0.0  # how long another face has been better
    filtered: complex | None = None
    anchor: complex = CENTRE
    anchored: float = NEVER
    camera: complex | None = None
    aim: complex = CENTRE
    velocity: complex = 0j
    zoom: float = 1.0
    cut_at: float = NEVER
    diffs: list[float] = field(default_factory=list)


class Camera:
    def __init__(self, cfg: CameraConfig = CameraConfig(), state: State | None = None):
        self.cfg, self.s, self.dt = cfg, state or State(), 1.0 / max(1.0, cfg.analysis_fps)

    def step(self, t: float, faces: list[Face], diff: float | None) -> tuple[complex, float, bool, bool]:
        """Centre, zoom, whether a face is followed, and whether the frame is a cut."""
        cut = self._cut(t, diff)
        if cut:
            self.s.face, self.s.filtered, self.s.wish, self.s.velocity = None, None, 0.0, 0j
        jumped = self._choose(t, faces)
        held = self.s.face is not None and t - self.s.seen < self.cfg.max_miss_time
        alone = self.cfg.single_face_centering and held and self.s.faces == 1
        calm = self.cfg.stabilization_strength if alone else 0.0
        dead = min(0.35, self.cfg.center_dead_zone + 0.08 * calm) if calm else self.cfg.center_dead_zone
        fastest = max(0.05, self.cfg.max_center_speed * (1 - 0.25 * calm)) if calm else self.cfg.max_center_speed
        if held:
            target, zoom = self._on_face(t, cut or jumped, alone, calm)
        else:
            target, zoom = self._drift(t)
            dead *= 0.4
        if self.s.camera is None or cut:
            self.s.camera = self.s.aim = target
            self.s.velocity, self.s.zoom = 0j, zoom
        else:
            smooth = per_step(min(0.985, self.cfg.smoothing + 0.08 * calm) if calm else self.cfg.smoothing, self.dt)
            self.s.aim = self.s.aim * smooth + target * (1 - smooth)
            self._follow(dead, fastest)
            self._breathe(zoom)
        self._guard()
        return self.s.camera, self.s.zoom, held, cut

    def _cut(self, t: float, diff: float | None) -> bool:
        if not self.cfg.scene_cut_detection or diff is None:
            return False
        recent = self.s.diffs
        usual = median(recent) if recent else 0.0
        hit = diff >= max(self.cfg.scene_cut_threshold, self.cfg.scene_cut_relative * usual) and t - self.s.cut_at >= self.cfg.scene_cut_min_interval_s
        self.s.diffs = list(deque([*recent, diff], maxlen=max(4, int(self.cfg.scene_cut_window))))
        if hit:
            self.s.cut_at = t
        return hit

    def _choose(self, t: float, faces: list[Face]) -> bool:
        """Keep, change or forget the followed face; True if the focus jumped."""
        s = self.s
        if not faces:
            s.wish = 0.0
            if s.face is not None and t - s.seen >= self.cfg.max_miss_time:
                s.face = s.filtered = None
            return False
        best = max(faces, key=Face.weight)
        jumped, pick = True, best
        if s.face is not None:
            same = min(faces, key=lambda f: abs(f.centre - s.face.centre))
            if abs(same.centre - s.face.centre) <= self.cfg.match_tolerance:
                better = best is not same and best.weight() > same.weight() + self.cfg.face_switch_margin
                s.wish = s.wish + self.dt if better else 0.0
                jumped = better and s.wish >= self.cfg.face_switch_hold_s
                pick = best if jumped else same
        if jumped:
            s.wish = 0.0
        s.face, s.seen, s.faces = pick, t, len(faces)
        return jumped

    def _on_face(self, t: float, fresh: bool, alone: bool, calm: float) -> tuple[complex, float]:
        c, s = self.cfg, self.s
        if s.filtered is None or fresh:
            s.filtered = s.face.centre
        else:
            keep = per_step(min(0.995, c.face_filter + 0.1 * calm) if calm else c.face_filter, self.dt)
            near = s.filtered + shortened(s.face.centre - s.filtered, c.max_face_step)
            s.filtered = s.filtered * keep + near * (1 - keep)
        x, y = s.filtered.real, s.filtered.imag
        if c.eye_level_lift > 0:
            y = clamp(y - s.face.height * c.eye_level_lift, 0.0, 1.0)
        y = clamp(y, 0.05, 0.95)
        if c.side_bias > 0 and not alone:
            pull = c.side_bias_strength * (1.0 - 2.0 * abs(x - 0.5))
            x += pull * ((0.5 - c.side_bias if x < 0.5 else 0.5 + c.side_bias) - x)
        s.anchor, s.anchored = complex(clamp(x, 0.0, 1.0), y), t
        zooms = c.face_coverage > 0 and c.max_zoom > 1
        return s.anchor, clamp(c.face_coverage / max(s.face.height, 1e-3), c.min_zoom, max(1.0, c.max_zoom)) if zooms else 1.0

    def _drift(self, t: float) -> tuple[complex, float]:
        """Without a face: a slow drift about the last one, which gives way to the centre."""
        c, s = self.cfg, self.s
        back = clamp((t - s.anchored) / c.fallback_recenter_s, 0.0, 1.0) if c.fallback_recenter_s > 0 and s.anchored > NEVER else 0.0
        phase = 2 * math.pi * t / max(1e-3, c.ken_burns_period)
        # As in functions.dsp.ken_burns.
        at = s.anchor + back * (CENTRE - s.anchor) + complex(c.ken_burns_pan_amplitude * math.sin(phase), c.ken_burns_tilt_amplitude * math.cos(0.7 * phase))
        zoom = max(0.8, 1.0 + c.ken_burns_zoom_amplitude * math.sin(0.85 * phase)) if c.ken_burns_zoom_amplitude else 1.0
        return complex(clamp(at.real, 0.0, 1.0), clamp(at.imag, 0.0, 1.0)), zoom

    def _follow(self, dead: float, fastest: float) -> None:
        """A damped oscillator towards the aim, with a dead zone and caps on acceleration, speed and step."""
        c, s, dt = self.cfg, self.s, self.dt
        off = s.aim - s.camera
        far = abs(off)
        if far < dead:
            s.velocity *= max(0.0, 1.0 - c.follow_damping * dt)
            goal = s.camera
        else:
            goal = s.camera + (off * ((far - dead) / far) if far > 1e-6 else off)
        eager, quick = (1.5, 1.4) if far > 0.10 else (1.0, 1.0)
        if c.predictive_lead > 0:
            goal += s.velocity * c.predictive_lead
            goal = complex(clamp(goal.real, 0.0, 1.0), clamp(goal.imag, 0.0, 1.0))
        pull = (goal - s.camera) * (1.0 - c.human_lag)
        force = shortened(pull * c.follow_stiffness * eager - s.velocity * c.follow_damping, c.max_center_accel)
        s.velocity = shortened((s.velocity + force * dt) * c.velocity_soften * max(0.0, 1.0 - c.velocity_decay), fastest * quick)
        s.camera += shortened(s.velocity * dt, fastest * dt)

    def _breathe(self, target: float) -> None:
        c, s = self.cfg, self.s
        keep = per_step(c.zoom_smoothing, self.dt)
        z = s.zoom * keep + target * (1 - keep)
        if c.max_zoom_speed > 0:
            z = clamp(z, s.zoom - c.max_zoom_speed * self.dt, s.zoom + c.max_zoom_speed * self.dt)
        s.zoom = clamp(z, min(1.0, c.min_zoom), max(1.0, c.max_zoom))

    def _guard(self) -> None:
        """The crop stays inside the frame, and the margin is kept."""
        c, s = self.cfg, self.s
        if c.face_margin > 0:
            share = c.aspect or (9 / 16) / (16 / 9)
            half = lambda part: max(c.face_margin, min(0.5, part / (2 * max(s.zoom, 1e-3))))
            gx, gy = half(share), half(1.0)
            s.camera = complex(clamp(s.camera.real, gx, 1 - gx), clamp(s.camera.imag, gy, 1 - gy))


TRACK = "t double, cx double, cy double, zoom double, has_face boolean, is_cut boolean"


def large_and_sure(detections: DataFrame, width: float, height: float, *, min_face_ratio: float, min_confidence: float = 0.0, least_pixels: float = 16.0) -> DataFrame:
    """Detections that count: boxes with an area, no side below the least size in pixels, sure enough.

    The least size is a share of the frame's shorter side. Boxes are relative to the frame.
    """
    from pyspark.sql import functions as F

    least = max(least_pixels, min(width, height) * min_face_ratio)
    sure = F.coalesce("score", F.lit(0.0)) >= min(max(min_confidence, 0.0), 1.0)
    return detections.where((F.col("w") > 0) & (F.col("h") > 0) & (F.least(F.col("w") * width, F.col("h") * height) >= least) & sure)


def track(frames: DataFrame, detections: DataFrame, cfg: CameraConfig | None = None) -> DataFrame:
    """Camera states of each episode.

    ``frames`` is (episode_id, t, diff: difference to the frame before, null for the first), ``detections``
    (episode_id, t, cx, cy, w, h, score); those of a frame are taken by falling score. A task holds one episode's frames.
    """
    from pyspark.sql import functions as F

    cfg = cfg or resolve()
    seen = detections.groupBy("episode_id", "t").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "cx", "cy", "w", "h", "score"))).alias("faces"))
    kind = frames.schema["episode_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cam, rows = Camera(cfg), []
        for r in pdf.sort_values("t", kind="stable").itertuples():
            faces = [Face(complex(f["cx"], f["cy"]), f["w"], f["h"], f["score"]) for f in (r.faces if r.faces is not None else [])]
            at, zoom, held, cut = cam.step(r.t, faces, None if pd.isna(r.diff) else r.diff)
            rows.append((r.episode_id, r.t, at.real, at.imag, zoom, held, cut))
        return pd.DataFrame(rows, columns=["episode_id", "t", "cx", "cy", "zoom", "has_face", "is_cut"])

    return frames.select("episode_id", "t", "diff").join(seen, ["episode_id", "t"], "left").groupBy("episode_id").applyInPandas(run, f"episode_id {kind}, {TRACK}")


def interpolate(states: DataFrame, times: DataFrame, values: list[str]) -> DataFrame:
    """``values`` of ``states`` (episode_id, t, ...) at the rows of ``times`` (episode_id, t), linear between states, held at both ends.

    States and times are put in one order per episode and neighbours are found by windows: no range join.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    point = F.struct("t", *values)
    both = states.select("episode_id", "t", point.alias("at")).unionByName(times.select("episode_id", "t", F.lit(None).cast(states.select(point.alias("p")).schema["p"].dataType).alias("at")))
    # both neighbours look back, one of them in reversed order: a frame that looks ahead is worked out anew for each row
    w = Window.partitionBy("episode_id")
    x = both.withColumn("a", F.last("at", ignorenulls=True).over(w.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("b", F.last("at", ignorenulls=True).over(w.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))).where("at is null")
    share = F.when(F.col("b.t") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0)
    mix = lambda v: F.coalesce(F.col(f"a.{v}") * (1 - share) + F.col(f"b.{v}") * share, f"a.{v}", f"b.{v}")
    return x.select("episode_id", "t", *[mix(v).alias(v) for v in values])
