"""Column helpers shared by the operators: clamps, overlaps, statistics of arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clip01(x: Column) -> Column:
    """Into [0, 1]; NaN is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def sweet_spot(x: Column, low: float, high: float, falloff: float = 1.0) -> Column:
    """1 within [low, high], falling off linearly over ``falloff`` times the width on either side."""
    low, high = min(low, high), max(low, high)
    span = max(1e-6, (high - low) * falloff)
    away = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return clip01(1.0 - away / span)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def explode_overlap(df: DataFrame, start: str, end: str, cell_s: float, cells: Column) -> DataFrame:
    """A row for each grid cell that an interval touches: ``cell``, and ``covered`` in the unit of time.

    Turns an interval-overlap join into an equi-join on (key, cell). Intervals that are empty,
    reversed, not finite or off the grid give no row.
    """
    s, e = F.col(start), F.col(end)
    lo = F.greatest(F.lit(0), F.floor(s / cell_s)).cast("int")
    hi = F.least(cells, F.ceil(e / cell_s)).cast("int")
    out = df.where(e > s).where(~F.isnan(s) & ~F.isnan(e)).withColumns({"__lo": lo, "__hi": hi}).where("__lo < __hi")
    out = out.withColumn("cell", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)))
    at = F.col("cell") * cell_s
    return out.withColumn("covered", overlap(at, at + cell_s, s, e)).where("covered > 0").drop("__lo", "__hi")


def point_cell(t: Column, cell_s: float, cells: Column) -> Column:
    """The cell of a point in time, kept on the grid."""
    return F.least(cells - 1, F.greatest(F.lit(0), F.floor(t / cell_s))).cast("int")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` worked out once: inside higher-order functions a repeated expression is evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def array_mean(a: Column) -> Column:
    """0 for an empty array."""
    return let(a, lambda x: F.when(F.size(x) > 0, array_sum(x) / F.size(x)).otherwise(F.lit(0.0)))


def array_peak(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0.0))


def array_percentile(a: Column, q: float) -> Column:
    """Linear percentile of an array, 0 for an empty one."""

    def of_sorted(s):
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        x, y = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, x + (y - x) * (at - low)).otherwise(F.lit(0.0))

    return let(F.sort_array(a), of_sorted)


def longest_run(a: Column, hit) -> Column:
    """Length of the longest run of elements for which ``hit`` holds."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, x):
        now = F.when(hit(x), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(a, zero, step, lambda acc: acc["best"])


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays; null if either is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
