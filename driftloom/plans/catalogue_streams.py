"""Queries that go through a stream's state: a stop and a new start, debounced batches as state, and totals by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scratch import shared_folder
from driftloom.streaming import watch
from driftloom.streaming.incremental import IncrementalSession

from .catalogue import SQL, query
from .sides import FLAGS, SIDES, sides


@query(SQL["upsert_latest"])
def stream_upsert_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is stopped right after its third commit, and a new one goes on."""
    return watch.stream_latest(spark, sf_dir, stop_after=2).select("user_id", "event_id", "value")


@query(SQL["debounce_batches"])
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.stream_debounced(spark, sf_dir, 600_000).select("user_id", "n", "first_us", "last_us")


@query(
    f"""WITH {SIDES}, {FLAGS}, changed AS (SELECT source AS repo, count(*) AS files FROM sides WHERE before IS DISTINCT FROM after GROUP BY 1),
risks AS (SELECT source AS repo, count(*) AS risks, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'low') AS low FROM rated GROUP BY 1)
SELECT repo, files, coalesce(risks, 0) AS risks, coalesce(high, 0) AS high, coalesce(low, 0) AS low, CASE WHEN high > 0 THEN 3 WHEN low > 0 THEN 1 ELSE 0 END::INTEGER AS exit_code FROM changed LEFT JOIN risks USING (repo)"""
)
def incremental_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files in a first batch, where some have not changed yet; three batches then bring changes, take some back, and bring them again."""
    digit = F.col("doc_id") % 10
    files = sides(spark, sf_dir).select(F.col("source").alias("repo"), "path", "before", "after", digit.alias("digit"))
    back = files.withColumn("after", F.col("before"))
    batches = (
        files.where("digit NOT IN (4, 5, 6, 7)").unionByName(back.where("digit IN (4, 5, 6, 7)")),
        files.where("digit IN (4, 6)").unionByName(back.where("digit = 2")),
        files.where("digit IN (5, 7)").unionByName(back.where("digit = 4")),
        files.where("digit IN (2, 4)"),
    )
    session = IncrementalSession(spark, shared_folder(spark, "driftloom-session"))
    for k, batch in enumerate(batches):
        session.apply(batch.drop("digit"), k)
    return session.totals().select("repo", "files", "risks", "high", "low", F.col("exit_code").cast("int").alias("exit_code"))
