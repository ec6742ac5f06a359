"""What the operators of this subpackage share: scratch tables in the shared folder, and guarded column selection."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern; words are maximal runs of other characters.
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder of its own only in local mode with the setting unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="driftloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/driftloom/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has what is at path now removed when the session's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Paths of the tables that the innermost ``passing`` is to remove.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if (own := _PASSING.get()) is not None:
        own.append(path)
    return out


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df.scratch)
        if (own := _PASSING.get()) is not None and df.scratch in own:
            own.remove(df.scratch)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are removed at the end, but for those given to what this yields, which are the caller's."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch)
        return df

    own: list[str] = []
    outer = _PASSING.set(own)
    try:
        yield keep
    finally:
        _PASSING.reset(outer)
        for path in own:
            if path not in kept:
                removed(spark, path)
        if (above := _PASSING.get()) is not None:
            above += [x for x in kept if x not in above]


#: Bits of a membership filter: a broadcast of at most 8 MB, whatever it is made of.
FILTER_BITS = 1 << 26
_BUCKET = 32_768  # bits of one of Spark's bitmaps


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def membership(keys: DataFrame) -> DataFrame:
    """A filter of the one column of keys: at most FILTER_BITS / 32,768 rows of 4 KB each, made map-side first."""
    at = keys.select(_bit(F.col(keys.columns[0])).alias("at"))
    number, place = F.bitmap_bucket_number("at"), F.bitmap_bit_position("at")
    return stored(at.groupBy(number.alias("of_bucket")).agg(F.bitmap_construct_agg(place).alias("bits")), "filter")


def may_hold(df: DataFrame, key: Column, held: DataFrame) -> DataFrame:
    """df with ``hit``: whether key may be among the keys of the filter. False is certain; no row is exchanged."""
    rows = df.withColumn("hit", _bit(key))
    rows = rows.join(F.broadcast(held), F.bitmap_bucket_number("hit") == F.col("of_bucket"), "left")
    place = F.bitmap_bit_position("hit")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("hit", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("of_bucket", "bits")


def packed(df: DataFrame) -> DataFrame:
    """df as one column ``row``, so that columns that an operator adds meet no others of their names; ``row.*`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def exchanged(df: DataFrame) -> bool:
    """Whether df's plan has an exchange. To ask for its number of parts would run it, and it is dealt to tasks anyway."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def dealt(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least as many parts as the cluster has cores: work that is heavy by row is not left to a scan of few parts."""
    context = df.sparkSession.sparkContext
    want = least or context.defaultParallelism
    return df if exchanged(df) or df.rdd.getNumPartitions() >= want else df.repartition(want)


def frequent(counts: DataFrame, word: str, n: str, most: int) -> dict[str, int]:
    """The words of counts (word, n) that are counted most often, at most ``most`` of them, each with its count.

    Words are taken by steps of a sixteenth of an octave of counts; of the step that would be too much, those with the
    least hashes. Little but the chosen words reaches the driver, and the choice does not depend on how rows are dealt.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 16)
    steps = {r["step"]: r["k"] for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}  # under 1,024 rows
    total, wanted = 0, F.lit(False)
    for s in sorted(steps, reverse=True):
        if total + steps[s] > most:
            part = int((most - total) / steps[s] * 1_000_000)
            wanted = wanted | ((step == s) & (F.pmod(F.xxhash64(word), F.lit(1_000_000)) < part))
            break
        total += steps[s]
        wanted = step >= s
    found = {r[word]: r[n] for r in counts.where(wanted).select(word, n).collect()}
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])


def word_counts(texts: Iterator[list], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(word, n) batches from lists of words: counted in the task, and handed on whenever ``most`` words are held."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.binary()), pa.array(np.fromiter(held.values(), np.int64, len(held)))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    for words in texts:
        held.update(words)
        if len(held) >= most:
            yield out()
            held.clear()
    if held:
        yield out()


#: What this worker process keeps from one task to the next: the caches of one operator at a time.
_WORKER: dict[str, object] = {}


def given_back() -> None:
    """Hands memory that Arrow's and the system's allocators keep for later back to the machine: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def forget(keeps: str = "") -> None:
    """Drops this worker's caches of other names."""
    if any(name != keeps for name in _WORKER):
        _WORKER.clear()
        given_back()


def worker_cache(name: str, make: Callable):  # noqa: ANN201
    """What make gave when this worker first asked for that name; caches of other names go."""
    if name not in _WORKER:
        forget(name)
        _WORKER[name] = make()
    return _WORKER[name]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for ``mapInArrow``, in a worker that keeps neither another operator's cache nor the memory of batches that are done."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from run(batches)
        given_back()

    return task


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
