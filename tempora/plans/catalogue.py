"""Named queries over the driver's tables, and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.plans import queries_events, queries_media, queries_moments, queries_text

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (queries_moments, queries_events, queries_text, queries_media)


def queries() -> dict[str, Query]:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.ORACLES.items()}
