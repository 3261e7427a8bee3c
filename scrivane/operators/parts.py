"""How rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions of at most about `rows` rows, and at least one a core: for rows of few bytes and much work, which the splits of a small file
    would give to a single task. The rows are counted first."""
    n = df.count()
    return df.repartition(max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), -(-n // rows)))
