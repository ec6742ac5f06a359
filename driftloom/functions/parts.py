"""How tables are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """df in at least as many parts as there are cores: work that is heavy by row is not left to a scan of few parts.

    A plan with an exchange is dealt already; to ask for its number of parts would run it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
