"""Order statistics and peaks of many windows over one array, without looking at a window's elements.

A wavelet matrix keeps the array's ranks bit by bit, highest bit first, with running counts of zeros: the k-th smallest
element of any window takes one step a bit. A sparse table keeps peaks of stretches of 1, 2, 4, ... elements: any window is
covered by two of them. Both are built once for an episode and answer all of its windows at once.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np


class RankMatrix:
    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(np.asarray(values, np.float64), return_inverse=True)
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(len(self.values) - 1, 0).bit_length() - 1, -1, -1):
            one = rank >> bit & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(1 - one)])))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest element, from 0, of each window [lo, hi) with more than ``k`` elements."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            up = k >= b - a
            k -= np.where(up, b - a, 0)
            rank |= np.where(up, 1 << bit, 0)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        return self.values[rank]

    def percentile(self, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
        """Linear percentile of each window [lo, hi); 0 for an empty one."""
        out, some = np.zeros(len(lo)), np.flatnonzero(hi > lo)
        lo, hi = lo[some], hi[some]
        at = (hi - lo - 1) * q
        low = np.floor(at).astype(np.int64)
        x, y = self.smallest(lo, hi, low), self.smallest(lo, hi, np.minimum(low + 1, hi - lo - 1))
        out[some] = x + (y - x) * (at - low)
        return out


class PeakTable:
    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.float64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.maximum(last[:-half], last[half:]))

    def peak(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Highest element of each window [lo, hi); 0 for an empty one."""
        out, some = np.zeros(len(lo)), np.flatnonzero(hi > lo)
        lo, hi = lo[some], hi[some]
        level = np.frexp(hi - lo)[1] - 1
        got = np.zeros(len(some))
        for k in np.unique(level):
            i = level == k
            got[i] = np.maximum(self.rows[k][lo[i]], self.rows[k][hi[i] - (1 << k)])
        out[some] = got
        return out


def cells_of(start: np.ndarray, end: np.ndarray, cells: int, cell_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells [lo, hi) of windows, one at least where the grid has one left."""
    at = lambda x: np.where(np.isnan(x), 0.0, x)  # noqa: E731  as Spark makes an integer of it
    lo = np.minimum(cells, np.maximum(0, np.floor(at(start) / cell_s))).astype(np.int64)
    hi = np.maximum(0, np.minimum(cells, np.ceil(at(end) / cell_s))).astype(np.int64)
    return lo, np.where(hi <= lo, np.minimum(cells, lo + 1), hi)


#: What is told of each window.
STATS = ("speech", "words", "hush", "energy_p90", "energy", "sharpness", "face", "face_peak", "cuts", "motion")
SIGNALS = ("speech", "words", "audio_energy", "audio_sharpness", "face", "face_ratio", "cuts", "motion")
#: Signals of which windows need sums.
SUMMED = ("speech", "words", "audio_energy", "face", "cuts", "motion")
_DIGITS = Context(prec=400)


def hush_before(silent: np.ndarray) -> np.ndarray:
    """For each cell the length of the silence that ends with it."""
    at = np.arange(len(silent))
    return at - np.maximum.accumulate(np.where(silent, -1, at)) if len(silent) else at


def loud_from(silent: np.ndarray) -> np.ndarray:
    """For each cell the first one from it on that is not silent; the number of cells if there is none."""
    n = len(silent)
    return np.minimum.accumulate(np.where(silent, n, np.arange(n))[::-1])[::-1]


class WindowStats:
    """What any window of one episode is told by. Built once, it answers windows a stretch at a time.

    Running totals are kept with more digits than a double has, so that the difference of two of them is the sum of the cells
    between them and not off in its last digits: shares such as 0.0625 are rounded and compared afterwards.
    """

    def __init__(self, x: dict[str, np.ndarray], silent: float):
        self.x, self.cells = x, len(x["speech"])
        self.upto = {s: np.concatenate([[0], np.cumsum(x[s], dtype=np.longdouble)]) for s in SUMMED}
        hush = hush_before(x["speech"] < silent)
        self.loud, self.hush = np.append(loud_from(x["speech"] < silent), self.cells), PeakTable(hush)
        self.energy, self.sharpness, self.face = RankMatrix(x["audio_energy"]), PeakTable(x["audio_sharpness"]), PeakTable(x["face_ratio"])

    def total(self, name: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        upto = self.upto[name]
        if not np.isfinite(upto[-1]):  # of no use behind the first such cell
            return np.array([self.x[name][a:b].sum() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.float64)
        return (upto[hi] - upto[lo]).astype(np.float64)

    def mean(self, name: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.total(name, lo, hi) / np.maximum(hi - lo, 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """Means, sums, the p90 and peaks of the signals in the windows [lo, hi), and cells of the longest silence."""
        # a silence that the window begins in is cut at its start; any other begins inside it
        first = np.minimum(self.loud[lo], hi) - lo
        return {
            "speech": self.mean("speech", lo, hi), "words": self.total("words", lo, hi), "hush": np.maximum(first, self.hush.peak(lo + first, hi)), "energy_p90": self.energy.percentile(lo, hi, 0.9),
            "energy": self.mean("audio_energy", lo, hi), "sharpness": self.sharpness.peak(lo, hi), "face": self.mean("face", lo, hi), "face_peak": self.face.peak(lo, hi),
            "cuts": self.total("cuts", lo, hi), "motion": self.mean("motion", lo, hi),
        }


def stats_of(x: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, silent: float) -> dict[str, np.ndarray]:
    return WindowStats(x, silent).of(lo, hi)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark does it: the decimals that a number is shown with, halves away from zero."""
    times = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        y = x * times
        whole = np.rint(y)
        out = whole / times + 0.0
        close = np.flatnonzero(~((np.abs(y - whole) < 0.4999) & (np.abs(y) < 1 << 50)))
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _DIGITS)) + 0.0 if np.isfinite(x[i]) else x[i]
    return out
