"""File scans and artifact sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of videos.
VIDEO_SUFFIXES = ("mp4", "mov", "mkv")


def find_videos(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """Videos of a folder (path, length, modificationTime), not of its sub-folders, by suffix in any case, in order of path.

    File contents are read only if ``content``: Spark's binary reader skips a column that is not selected.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    x = x.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*VIDEO_SUFFIXES))
    return (x if content else x.drop("content")).orderBy("path")


def new_files(after: DataFrame, before: DataFrame, key: str = "path") -> DataFrame:
    """Files of ``after`` that ``before`` does not have."""
    return after.join(before.select(key).distinct(), key, "left_anti")


def write_artifact(df: DataFrame, path: str, *, by: str = "episode_id") -> None:
    """JSON artifacts, a folder for each episode; Spark's committer makes them appear whole or not at all."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_debug(df: DataFrame, path: str) -> None:
    """Structured rows as JSON, a single text column as text."""
    kind = df.schema.fields
    (df.write.mode("overwrite").text if len(kind) == 1 and kind[0].dataType.simpleString() == "string" else df.write.mode("overwrite").json)(path)


def rendered_transcript(segments: DataFrame) -> DataFrame:
    """(episode_id, text): ``[s.ss-e.ee] text`` lines in order."""
    line = F.format_string("[%.2f-%.2f] %s\n", "start_s", "end_s", "text")
    by = segments.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", line.alias("line")))).alias("all"))
    return by.select("episode_id", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("text"))


# Labels of the blocks, in their order.
BLOCKS = {
    "transcript": "ТРАНСКРИПТ ДЛЯ АНАЛИЗА:", "audio": "АУДИО ДЛЯ АНАЛИЗА:", "faces": "ЛИЦА ДЛЯ АНАЛИЗА:", "visual": "ВИЗУАЛ ДЛЯ АНАЛИЗА:",
    "tempo": "ТЕМП ДЛЯ АНАЛИЗА:", "emotion": "ЭМОЦИИ ДЛЯ АНАЛИЗА:", "hooks": "HOOKS ДЛЯ АНАЛИЗА:", "candidates": "КАНДИДАТЫ ДЛЯ АНАЛИЗА:",
}
RULE = "---"


def prompt_payload(episodes: DataFrame, transcript: DataFrame, **signals: DataFrame) -> DataFrame:
    """(episode_id, payload): labelled blocks of text for a model, between rules.

    ``transcript`` is (episode_id, text); each of ``signals``, named as in ``BLOCKS``, becomes an indented JSON array of its
    rows in the order of its columns. A block without rows is an empty array, or empty text.
    """
    if unknown := set(signals) - set(BLOCKS):
        raise ValueError(f"unknown blocks: {sorted(unknown)}")
    out = episodes.select("episode_id").join(transcript.select("episode_id", F.col("text").alias("transcript")), "episode_id", "left")
    for name, rows in signals.items():
        row = F.struct(*[c for c in rows.columns if c != "episode_id"])
        block = F.to_json(F.array_sort(F.collect_list(row)), {"pretty": "true"})
        out = out.join(rows.groupBy("episode_id").agg(block.alias(name)), "episode_id", "left")
    text = lambda name: F.coalesce(F.col(name), F.lit("" if name == "transcript" else "[]")) if name in out.columns else F.lit("[]")
    parts = [x for name, label in BLOCKS.items() for x in (F.lit(label), text(name))]
    return out.select("episode_id", F.concat_ws("\n", F.lit(RULE), *parts, F.lit(RULE)).alias("payload"))
