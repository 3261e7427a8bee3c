"""Streams: scanning and scoring are stateless; counts by kind run in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crf
from ..operators import gbdt, text


def hits(stream: DataFrame, key: str, column: str = "text", model: crf.Model | None = None) -> DataFrame:
    """A row a hit; works on streams as on tables, without state."""
    return text.pii_hits(stream, key, column, model)


def scores(stream: DataFrame, model: gbdt.Model, columns: list[str]) -> DataFrame:
    return gbdt.score(stream, model, columns)


def kind_counts(stream: DataFrame, time: str, column: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits by kind and tumbling window; rows later than `late` are dropped with their state."""
    found = text.with_hits(stream.withWatermark(time, late), column).select(time, F.explode("pii.kind").alias("kind"))
    return found.groupBy(F.window(time, window), "kind").agg(F.count("*").alias("hits"))
