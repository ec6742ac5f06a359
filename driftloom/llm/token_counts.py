"""Token counts through a digest cache.

Each text's digest is joined with a cache of (content digest, tokenizer version, counts). Only distinct
digests that the cache lacks are encoded; their counts are appended to it. Digests are written with their
documents' ids and compared with the cache before any text moves: a filter of those that it lacks is sent to all
tasks, and only texts that it lets through are exchanged, after equal ones of a task have been merged, so that a
group of copies of any size is a row per task.

Normalisation is null to empty and nothing else: any stronger folding could change a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_at_exit, may_hold, membership, passing, scratch_path, stored, text_of

CACHE_SCHEMA = "digest binary, tokenizer string, n_bytes long, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_version(name: str) -> str:
    """The file's name with a digest of its bytes: another vocabulary under the same name is another version."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f"{name}@{hashlib.sha256(f.read()).hexdigest()[:16]}"


def _counter(name: str):
    """A function from text to its number of tokens, loaded once for each Python worker."""
    import public_tokenizers

    if name not in _LOADED:
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
            _LOADED[name] = lambda text: len(encode(text, add_bos=False, add_eos=False))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[name] = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    return _LOADED[name]


def encode_misses(misses: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """(digest, text) to rows of the cache; one text is held as tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            sizes = [len(t.as_buffer()) if t.is_valid and t.as_buffer() is not None else 0 for t in texts]
            counts = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_bytes", "n_tokens"],
            )

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def missing_texts(keyed: DataFrame, misses: DataFrame) -> DataFrame:
    """(digest, text) of each of the digests that are missing; texts of others stay in the scan, but for those that the filter mistakes."""
    some = may_hold(keyed.select("digest", "text"), F.col("digest"), membership(misses)).where("hit")
    return some.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, digest of every row.

    A null text counts as empty (0 tokens). Repeated rows each get a row; a null doc_id stays null.
    Other columns are not read. cache_path: a folder that all executors share; it is appended to and
    may be given again, also after texts or the tokenizer have changed. Without one, the cache lives
    as long as the session. Concurrent runs may append a digest twice; reads take one row for each.
    """
    spark = docs.sparkSession
    shared = cache_path is not None
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    with passing(spark) as kept:
        digests = kept(stored(keyed.select("doc_id", "digest"), "digests"))
        known = _read_cache(spark, cache_path).where(F.col("tokenizer") == version)
        misses = stored(digests.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "misses")
        if not misses.isEmpty():
            encode_misses(missing_texts(keyed, misses), tokenizer, version).write.mode("append").parquet(cache_path)
    if not shared:
        drop_at_exit(spark, cache_path)
    counted = _read_cache(spark, cache_path).where(F.col("tokenizer") == version).drop("tokenizer")
    if shared:
        counted = stored(counted.dropDuplicates(["digest"]), "counted")
    return (
        digests.join(counted, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
    )
