"""Alignment: weak signals of an episode on one time grid.

All inputs carry ``episode_id``. Intervals become rows of the cells they touch, points a row of their
cell; aggregates by (episode, cell) add them up, with partial sums. Cells in which something is are then
dealt out by episode and set into its arrays, which is all that scoring needs. Nothing is joined by range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.columns import explode_overlap, point_cell

SIGNALS = ("speech", "words", "audio_energy", "audio_sharpness", "face", "face_ratio", "cuts", "motion")
#: How a cell's values meet: shares of time are added up to one, counts are added, levels keep the highest.
SHARES, SUMS, LEVELS = ("speech", "face"), ("words", "cuts"), ("audio_energy", "audio_sharpness", "face_ratio", "motion")
SOFT_LEVEL = 0.6
MOTION_DEFAULT, MOTION_LEAST = 0.15, 1e-3


def _cells(cell_s: float):
    return F.ceil(F.col("duration_s") / cell_s).cast("int")


def with_grid(df: DataFrame, episodes: DataFrame) -> DataFrame:
    return df.join(episodes.select("episode_id", "cells"), "episode_id")


def speech_cells(segments: DataFrame, episodes: DataFrame, cell_s: float) -> DataFrame:
    """(episode_id, cell, speech, words): share of the cell that is spoken, and words by covered share of their segment."""
    x = explode_overlap(with_grid(segments, episodes), "start_s", "end_s", cell_s, F.col("cells"))
    return x.groupBy("episode_id", "cell").agg(F.least(F.lit(1.0), F.sum(F.col("covered") / cell_s)).alias("speech"), F.sum(F.coalesce(F.col("words"), F.lit(0)) * (F.col("covered") / (F.col("end_s") - F.col("start_s")))).alias("words"))


def energy_cells(audio: DataFrame, episodes: DataFrame, cell_s: float) -> DataFrame:
    """(episode_id, cell, audio_energy, audio_sharpness): highest level of the events that touch the cell.

    An event's energy is its peak over the episode's highest, less for events that are not strong.
    """
    top = audio.groupBy("episode_id").agg(F.max("peak").alias("top")).where("top > 0")
    level = F.coalesce(F.col("peak"), F.lit(0.0)) / F.col("top") * F.when(F.col("category") == "strong", 1.0).otherwise(SOFT_LEVEL)
    x = explode_overlap(with_grid(audio, episodes), "start_s", "end_s", cell_s, F.col("cells")).join(top, "episode_id")
    return x.groupBy("episode_id", "cell").agg(F.greatest(F.lit(0.0), F.max(level)).alias("audio_energy"), F.greatest(F.lit(0.0), F.max(F.coalesce("sharpness", F.lit(0.0)))).alias("audio_sharpness"))


def face_cells(faces: DataFrame, episodes: DataFrame, cell_s: float) -> DataFrame:
    """(episode_id, cell, face, face_ratio): share of the cell with a face, and the largest face."""
    x = explode_overlap(with_grid(faces, episodes), "start_s", "end_s", cell_s, F.col("cells"))
    return x.groupBy("episode_id", "cell").agg(F.least(F.lit(1.0), F.sum(F.col("covered") / cell_s)).alias("face"), F.greatest(F.lit(0.0), F.max(F.coalesce("max_face_ratio", F.lit(0.0)))).alias("face_ratio"))


def point_cells(cuts: DataFrame, motion: DataFrame, episodes: DataFrame, cell_s: float) -> DataFrame:
    """(episode_id, cell, cuts, motion): cuts counted, and the strongest motion, by floor, kept on the grid."""
    at = lambda df: with_grid(df, episodes).where(F.col("t").isNotNull() & ~F.isnan("t")).withColumn("cell", point_cell(F.col("t"), cell_s, F.col("cells")))
    c = at(cuts).select("episode_id", "cell", F.lit(1.0).alias("cuts"), F.lit(None).cast("double").alias("motion"))
    m = at(motion).select("episode_id", "cell", F.lit(0.0).alias("cuts"), F.col("diff").alias("motion"))
    return c.unionByName(m).groupBy("episode_id", "cell").agg(F.sum("cuts").alias("cuts"), F.greatest(F.lit(0.0), F.max("motion")).alias("motion"))


#: Which signals each part of a timeline tells of.
PARTS = (("speech", "words"), ("audio_energy", "audio_sharpness"), ("face", "face_ratio"), ("cuts", "motion"))
#: Cells of a batch of timelines at least, if there are more.
BATCH_CELLS = 1 << 16


def _motion_ref(motion: np.ndarray) -> float:
    """The 90th percentile of the cells that move."""
    moving = np.sort(motion[~(motion <= 0)])
    if not len(moving):
        return MOTION_DEFAULT
    at = (len(moving) - 1) * 0.9
    x, y = moving[int(at)], moving[min(int(at) + 1, len(moving) - 1)]
    return float(np.maximum(MOTION_LEAST, x + (y - x) * (at - int(at))))


def _arrays(names: list[str]):
    """A function of batches (episode_id, part, cell, a, b), an episode's rows together and its part -1 first: its cells, its duration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, done, cells = None, None, [], 0  # the episode whose rows go on, and those that wait to leave

        def flush() -> pa.RecordBatch:
            ids = pa.array([i.as_py() for i, _, _ in done], done[0][0].type)
            ends = np.concatenate([[0], np.cumsum([g.shape[1] for _, _, g in done])]).astype(np.int32)
            one = [pa.ListArray.from_arrays(ends, np.concatenate([g[k] for _, _, g in done])) for k in range(len(SIGNALS))]
            refs = pa.array([_motion_ref(g[SIGNALS.index("motion")]) for _, _, g in done], pa.float64())
            cols = [ids, *one, refs, pa.array([d for _, d, _ in done], pa.float64()), pa.array([g.shape[1] for _, _, g in done], pa.int32())]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0), b.num_rows
            other = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
            part, cell = (b.column(c).to_numpy() for c in (1, 2))
            a, v = (pc.fill_null(b.column(c), 0.0).to_numpy() for c in (3, 4))
            for lo, hi in zip(edges, edges[1:]):
                if part[lo] < 0:
                    if grid is not None:
                        done.append(now + (grid,))
                        cells += grid.shape[1]
                        if cells >= BATCH_CELLS:
                            yield flush()
                            cells = 0
                    now, grid = (ids[lo], float(a[lo])), np.zeros((len(SIGNALS), int(cell[lo])))
                at = lo + np.searchsorted(part[lo:hi], np.arange(len(PARTS) + 1))
                for p, names_of in enumerate(PARTS):
                    s = slice(at[p], at[p + 1])
                    for x, name in zip((a, v), names_of):
                        grid[SIGNALS.index(name), cell[s]] = x[s]
        if grid is not None:
            done.append(now + (grid,))
            yield flush()

    return run


def build_timeline(episodes: DataFrame, segments: DataFrame, audio: DataFrame, faces: DataFrame, cuts: DataFrame, motion: DataFrame, cell_s: float = 0.5) -> DataFrame:
    """One row per episode: duration_s, cells, motion_ref and an array for each signal, a value per cell.

    ``episodes`` is (episode_id, duration_s); episodes without a positive duration have no timeline.
    """
    cell_s = max(0.1, float(cell_s))
    eps = episodes.where("duration_s > 0 AND episode_id IS NOT NULL").withColumn("cells", _cells(cell_s))
    made = [speech_cells(segments, eps, cell_s), energy_cells(audio, eps, cell_s), face_cells(faces, eps, cell_s), point_cells(cuts, motion, eps, cell_s)]
    # only cells in which something is travel, and a row that opens the episode; each cell has one row from each part at most
    opening = eps.select("episode_id", F.lit(-1).alias("part"), F.col("cells").alias("cell"), F.col("duration_s").cast("double").alias("a"), F.lit(0.0).alias("b"))
    some = [x.select("episode_id", F.lit(p).alias("part"), "cell", F.col(PARTS[p][0]).cast("double").alias("a"), F.col(PARTS[p][1]).cast("double").alias("b")) for p, x in enumerate(made)]
    spark = episodes.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = reduce(lambda x, y: x.union(y), [opening, *some]).repartition(tasks, "episode_id").sortWithinPartitions("episode_id", "part")
    fields = ", ".join([*(f"{s} array<double>" for s in SIGNALS), "motion_ref double, duration_s double, cells int"])
    out = T.StructType([episodes.schema["episode_id"], *T._parse_datatype_string(fields).fields])
    return rows.mapInArrow(_arrays(out.names), out).withColumn("duration_s", F.col("duration_s").cast(episodes.schema["duration_s"].dataType))


def episode_duration(segments: DataFrame, audio: DataFrame, faces: DataFrame) -> DataFrame:
    """(episode_id, duration_s): the latest end among transcript, sound and faces."""
    ends = segments.select("episode_id", F.col("end_s").alias("e")).union(audio.select("episode_id", "end_s")).union(faces.select("episode_id", "end_s"))
    return ends.groupBy("episode_id").agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("duration_s"))
