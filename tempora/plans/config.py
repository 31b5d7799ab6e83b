"""Settings of scoring and validation, resolved on the driver. They never touch rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

# Default signal weights.
WEIGHTS = {"transcript": 0.24, "audio": 0.20, "face": 0.14, "scene": 0.12, "pacing": 0.14, "hook": 0.16}


def _number(value, default: float, *, zero: float | None = None) -> float:
    """A missing value is the default; so is a zero, unless ``zero`` says what it means."""
    if value is None:
        return default
    value = float(value)
    return value or (default if zero is None else zero)


@dataclass(frozen=True)
class Scoring:
    # Default thresholds.
    enabled: bool = True
    cell_s: float = 0.5
    step_s: float = 1.0
    length_steps: int = 3
    hook_window_s: float = 2.0
    max_candidates: int = 12
    nms_overlap: float = 0.45
    min_speech_density: float = 0.18
    min_face_coverage: float = 0.0
    speech_sweet_spot: tuple[float, float] = (0.45, 0.88)
    cuts_per_min_sweet_spot: tuple[float, float] = (6.0, 40.0)
    max_silence_gap_s: float = 2.5
    target_face_ratio: float = 0.10
    words_per_s_ref: float = 3.0
    empty_window_penalty: float = 0.55
    low_face_penalty: float = 0.85
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    @classmethod
    def resolve(cls, given: dict | None = None) -> "Scoring":
        """Defaults under ``given``. Zeros follow the documented rules: for references, windows and
        steps they mean the default, for penalties they mean none, for thresholds they stay zero."""
        given = dict(given or {})
        base = cls()
        out = {}
        for f in fields(cls):
            if f.name == "weights" or f.name not in given:
                continue
            v, d = given[f.name], getattr(base, f.name)
            if f.name == "enabled":
                out[f.name] = bool(v)
            elif f.name.endswith("_spot"):
                out[f.name] = tuple(map(float, v))
            elif f.name in ("words_per_s_ref", "target_face_ratio", "max_silence_gap_s", "hook_window_s", "step_s"):
                out[f.name] = _number(v, d)
            elif f.name == "max_candidates":
                out[f.name] = int(_number(v, d))
            elif f.name == "length_steps":
                out[f.name] = max(1, int(_number(v, d, zero=1)))
            elif f.name.endswith("_penalty"):
                out[f.name] = _number(v, d, zero=1.0)
            else:
                out[f.name] = _number(v, d, zero=0.0)
        out["weights"] = normal_weights(given.get("weights"))
        return replace(base, **out)


def normal_weights(given: dict | None = None) -> dict[str, float]:
    """Known numeric weights over the defaults, negatives as zero, summing to one; all zero means the defaults."""
    w = dict(WEIGHTS)
    for k, v in given.items() if isinstance(given, dict) else ():
        try:
            w[k] = float(v) if k in w else w[k]
        except (KeyError, TypeError, ValueError):
            pass
    w = {k: max(0.0, v) for k, v in w.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else normal_weights()


@dataclass(frozen=True)
class Validation:
    # Default limits of moments.
    enabled: bool = True
    min_segment_s: float = 1.2
    snap_tolerance_s: float = 0.6
    snap_to_speech: bool = True
    snap_to_cuts: bool = True
    min_speech_density: float = 0.05
    min_audio_energy: float = 0.15
    fill_from_candidates: bool = True
    hook_warn_threshold: float = 0.2

    @classmethod
    def resolve(cls, given: dict | None = None) -> "Validation":
        own = asdict(cls())
        return cls(**{k: (type(own[k])(v) if v is not None else own[k]) for k, v in {**own, **{k: v for k, v in (given or {}).items() if k in own}}.items()})


def window_lengths(low: float, high: float, steps: int) -> list[float]:
    """Evenly spaced window lengths from ``low`` (one second at least) to ``high``."""
    low = max(1.0, float(low))
    high = max(low, float(high))
    if steps == 1 or high <= low:
        return [low]
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]
