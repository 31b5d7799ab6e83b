"""Signal processing: native array expressions, and Arrow functions where there is no expression for it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.columns import array_sum


def frames_of(samples: Column, size: int) -> Column:
    """Array of windows of ``size`` samples; what is left at the end is dropped."""
    n = F.floor(F.size(samples) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(array_sum(F.transform(samples, lambda x: x.cast("double") * x.cast("double"))) / F.size(samples))).otherwise(0.0)


def zero_crossing_rate(samples: Column) -> Column:
    """Sign changes per step; zero counts as positive. Windows of fewer than two samples have none."""
    n = F.size(samples)
    signs = F.transform(samples, lambda x: F.when(x >= 0, 1).otherwise(-1))
    flips = F.zip_with(F.slice(signs, 2, F.greatest(n - 1, F.lit(0))), F.slice(signs, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    return F.when(n > 1, array_sum(flips) / (n - 1)).otherwise(0.0)


def spectral_centroid(samples: Column, sample_rate: int = 16000) -> Column:
    """Mean frequency of the magnitude spectrum, by a real FFT over an Arrow batch."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for i, v in enumerate(x):
            if v is not None and len(v):
                m = np.abs(np.fft.rfft(np.asarray(v, dtype=np.float64)))
                out[i] = float((np.fft.rfftfreq(len(v), 1.0 / sample_rate) * m).sum() / max(float(m.sum()), 1e-12))
        return pd.Series(out)

    return run(samples)


def compress_dialogue(samples: Column, *, threshold: float = 0.35, ratio: float = 4.0, soft_knee: float = 0.08, makeup_gain: float = 1.6, noise_floor: float = 0.02, output_ceiling: float = 0.98) -> Column:
    """Soft-knee compression of a window of samples in [-1, 1], element by element.

    Above the knee the excess is divided by ``ratio``; inside it the plain and the compressed level are
    blended; levels under the noise floor follow a square root; gain is applied; and a window whose peak
    is above the ceiling is scaled to it.
    """
    low, high = (max(threshold - soft_knee / 2, 0.0), min(threshold + soft_knee / 2, 1.0)) if soft_knee > 0 else (threshold, threshold)

    def level(a: Column) -> Column:
        squeezed = high + (a - high) / ratio
        share = (a - low) / max(soft_knee, 1e-6)
        out = F.when(a > high, squeezed)
        if soft_knee > 0:
            out = out.when(a >= low, a + share * (squeezed - a))
        return out.otherwise(a)

    def quiet(a: Column) -> Column:
        return F.when(a < noise_floor, noise_floor * F.sqrt(a / noise_floor)).otherwise(a) if noise_floor > 0 else a

    def one(x: Column) -> Column:
        x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
        return F.signum(x) * quiet(level(F.abs(x))) * makeup_gain

    loud = F.transform(samples, one)
    ceiling = min(max(output_ceiling, 1e-6), 0.999)
    peak = F.coalesce(F.array_max(F.transform(loud, lambda v: F.abs(v))), F.lit(0.0))
    return F.when(peak > ceiling, F.transform(loud, lambda v: v * (F.lit(ceiling) / peak))).otherwise(loud)


def grey_thumbnail(pixels: Column, height: Column, width: Column, size: int = 32) -> Column:
    """``size`` x ``size`` grey levels in [0, 1] of RGB bytes (rows of pixels), by nearest sample."""

    @F.pandas_udf("array<double>")
    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for raw, rows, cols in zip(px, h, w, strict=True):
            if raw is None or not (rows > 0 and cols > 0):  # nulls come as NaN
                out.append(None)
                continue
            a = np.frombuffer(raw, np.uint8).reshape(int(rows), int(cols), 3).astype(np.float64) / 255.0
            pick = lambda n: np.linspace(0, n - 1, size).astype(int)
            # Weights of red, green and blue in luma.
            out.append((a[np.ix_(pick(int(rows)), pick(int(cols)))] @ np.array([0.299, 0.587, 0.114])).ravel())
        return pd.Series(out)

    return run(pixels, height, width)


def alpha_box(alpha: Column, height: Column, width: Column) -> Column:
    """Bounds (left, top, right, bottom) of pixels that are fully transparent in a mask of bytes; null if none is."""

    @F.pandas_udf("left int, top int, right int, bottom int")
    def run(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, r, c in zip(a, h, w, strict=True):
            known = raw is not None and r > 0 and c > 0  # nulls come as NaN
            y, x = np.nonzero(np.frombuffer(raw, np.uint8).reshape(int(r), int(c)) == 0) if known else ((), ())
            rows.append((x.min(), y.min(), x.max() + 1, y.max() + 1) if len(x) else (None,) * 4)
        return pd.DataFrame(rows, columns=["left", "top", "right", "bottom"]).astype("Int32")

    return run(alpha, height, width)


def ken_burns(t: Column, period: float, *, pan: float, tilt: float, zoom: float) -> Column:
    """Slow drift: struct (dx, dy, zoom) at time ``t``; zoom stays at 0.8 or more."""
    phase = t * (2 * np.pi / max(period, 1e-3))
    # The tilt runs at 0.7 and the zoom at 0.85 of the pan's pace.
    return F.struct((F.sin(phase) * pan).alias("dx"), (F.cos(phase * 0.7) * tilt).alias("dy"), F.greatest(F.lit(0.8), 1.0 + F.sin(phase * 0.85) * zoom).alias("zoom"))


def saliency(score: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """How much a detected face matters: confidence, size and closeness to the centre, in relative coordinates."""
    # Weights, the side of a full-size face, and the distance from the centre to a corner.
    size = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), w * h)) / 0.35)
    off = F.least(F.lit(1.0), F.sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5)) / 0.7071)
    return 0.45 * score + 0.35 * size + 0.20 * (1.0 - off)
