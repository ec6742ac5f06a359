"""The watcher as a stream: debounced batches, their classification, keyed upserts, and full refreshes."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from driftloom.functions import paths as P
from driftloom.functions.scratch import shared_folder
from driftloom.sources import documents

from . import debounce
from .incremental import IncrementalSession
from .tables import KeyedState, last_of

# The quiet time that ends a batch, and files at the root whose change asks for a full scan.
DEBOUNCE = "400 milliseconds"
FULL_SCAN_FILES = ("package.json", ".gitignore", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")


def debounced(events: DataFrame, key: str, time: str, gap: str = DEBOUNCE, late: str | None = None) -> GroupedData:
    """Events grouped to batches that a gap ends. late: the watermark that bounds a stream's state."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(key, F.session_window(time, gap))


def wanted(path: Column) -> Column:
    """Events that say anything: not of ignored or temporary files, nor of generated ones that are not parsed."""
    return P.is_git_state(path) | (~P.is_always_ignored(path) & ~P.is_temp_file(path) & ~(P.is_generated(path) & ~P.is_analyzable(path) & ~needs_full_scan(path)))


def needs_full_scan(path: Column) -> Column:
    return P.is_git_state(path) | path.isin(*FULL_SCAN_FILES) | path.endswith("/.gitignore") | (~P.is_analyzable(path) & ~P.is_generated(path))


def classify(events: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """by, full_scan, paths (sorted; empty if all is scanned) of each batch."""
    p = F.col(path)
    out = events.where(wanted(p)).groupBy(*by).agg(F.bool_or(needs_full_scan(p)).alias("full_scan"), F.array_sort(F.collect_set(F.when(P.is_analyzable(p), p))).alias("paths"))
    return out.withColumn("paths", F.when(F.col("full_scan"), F.array().cast("array<string>")).otherwise(F.col("paths")))


def latest(rows: DataFrame, key: str, order: list[str], gone: str) -> DataFrame:
    """The last row of each key by order, without keys whose last row says that they are gone."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last"))
    return last.select(key, "__last.*").where(~F.col(gone)).select(*rows.columns)


def emit_session(folder: str, batch: int, doc: dict) -> str:
    """Writes the session document of a batch; a batch that runs again replaces its own, and ``latest`` names the last."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    text = json.dumps(doc | {"batch": batch}, ensure_ascii=False)
    known = json.loads((at / "latest.json").read_text(encoding="utf-8"))["batch"] if (at / "latest.json").exists() else -1
    for name in (f"batch-{batch}.json", *(["latest.json"] if batch >= known else [])):
        part = at / f"{name}.part"
        part.write_text(text, encoding="utf-8")
        part.replace(at / name)
    return str(at / f"batch-{batch}.json")


class Stopped(Exception):
    """The stream was stopped between a batch's commit and the next."""


def _parts(spark: SparkSession, rows: DataFrame, folder: str, order: str, parts: int) -> DataFrame:
    """rows as a stream of files in order, one for each batch. A stream takes files by their times, so these are set."""
    rows.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(f"{folder}/input")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/input")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((s.getPath().getName(), s.getModificationTime(), s.getPath()) for s in files.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda x: x[0])
    first = min((t for _, t, _ in found), default=0)
    for k, (_, _, path) in enumerate(found):
        files.setTimes(path, first + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/input")


def _run(stream: DataFrame, folder: str, apply) -> None:  # noqa: ANN001
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if "Stopped" not in str(query.exception()):
            raise


def stream_latest(spark: SparkSession, sf_dir: str, stop_after: int | None = None, parts: int = 6) -> DataFrame:
    """The upsert of ``latest`` over the events as a stream that ends when all files have been read.

    stop_after: the stream fails right after it has committed that batch, and a new one goes on from the same folders.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("gone", F.col("event_type") == "error")
    kind = dict(events.dtypes)["ts"]
    folder = shared_folder(spark, "driftloom-stream")
    schema = f"user_id long, event_id long, ts {kind}, value double, gone boolean"
    stream = _parts(spark, events, folder, "event_id", parts)
    for stop in (stop_after, None) if stop_after is not None else (None,):
        state = KeyedState(spark, f"{folder}/state", schema, "user_id", ["ts", "event_id"], "gone")

        def apply(rows: DataFrame, batch: int, state: KeyedState = state, stop: int | None = stop) -> None:
            state.merge(rows, batch)
            if batch == stop:
                raise Stopped

        _run(stream, folder, apply)
    return state.live()


def stream_debounced(spark: SparkSession, sf_dir: str, gap_ms: int, late: str = "1 hour", parts: int = 4) -> DataFrame:
    """The batches of ``debounced`` over the events of users as a stream with state, in order of time. A last event of no user ends all batches."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", debounce.STORE)
    events = session.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(dict(events.dtypes)["user_id"]).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"))
    folder = shared_folder(spark, "driftloom-stream")
    stream = _parts(session, events.where("ts IS NOT NULL").unionByName(end), folder, "ts", parts)
    closed = debounce.debounced_stream(stream, "user_id", "ts", "event_type", gap_ms, late).where("user_id <> -1")
    query = closed.writeStream.format("parquet").option("path", f"{folder}/closed").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{folder}/closed")


def session_documents(session: IncrementalSession, rows: DataFrame) -> DataFrame:
    """repo, document (JSON) of the repositories that rows are of: their totals and flags as they are now."""
    head = session.tables.head()
    repos = rows.select("repo").distinct()
    flags = session.flags(head).join(repos, "repo", "left_semi")
    listed = flags.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "flag_id", "severity", "dismissed"))).alias("flags"))
    totals = repos.join(session.totals(head), "repo", "left").join(listed, "repo", "left")
    return totals.select("repo", F.to_json(F.struct(*[c for c in totals.columns])).alias("document"))


def run_sessions(changes: DataFrame, folder: str, stop: tuple[int, str] | None = None, **options) -> IncrementalSession:  # noqa: ANN003
    """Takes a stream of files (repo, path, before, after) into totals and writes a document for each batch, until its input ends.

    Both know a batch by its number, so that a batch that is run again after a failure changes nothing twice. A file that
    a batch has more than once counts as it is last, by ``at``. stop: a batch and where in it the stream fails, for tests.
    """
    spark = changes.sparkSession
    documents.register(spark)
    session = IncrementalSession(spark, f"{folder}/session", **options)

    def apply(rows: DataFrame, batch: int) -> None:
        files = last_of(rows, ["repo", "path"], ["at"]).select("repo", "path", "before", "after").persist()
        session.apply(files, batch)
        if stop == (batch, "applied"):
            raise Stopped
        session_documents(session, files).write.format(documents.FORMAT).option("path", f"{folder}/documents").option("batch", batch).mode("append").save()
        files.unpersist()
        if stop == (batch, "written"):
            raise Stopped

    _run(changes, folder, apply)
    return session
