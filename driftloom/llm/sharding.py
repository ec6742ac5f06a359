"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Within each source rows are shuffled by a seeded digest and ranked. A row's place is its rank, moved by a part of a
row that its source draws, over the source's number of rows; all rows are ordered by place and cut to equal counts. So
every shard has each source's share of rows, to within a row or two, and shards differ by one row at most.

Neither order is a sort of a whole source or a whole table in one task: digests and places are both spread evenly over
buckets, rows are ranked within their bucket, and sums over the buckets before it give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, stored, text_of

SHARDS = 40
#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: Buckets that rows are ranked in: one for so many rows, and at least LEAST_BUCKETS.
ROWS_OF_BUCKET, LEAST_BUCKETS = 50_000, 4_096


def number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_crc32 and copies of the distinct ones of these rows; texts stay in the scan."""
    text = text_of().cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def shuffled(rows: DataFrame, seed: str, buckets: int) -> DataFrame:
    """Each row as often as it occurs, with the digest that it is shuffled by and that digest's bucket."""
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size", "copy")
    rows = rows.withColumn("digest", F.md5(key.cast("binary")))
    return rows.withColumn("bucket", F.shiftright(number(F.col("digest")) * buckets, 32))


def placed(rows: DataFrame, seed: str) -> DataFrame:
    """rows with their rank in their source, from 0, and their place in the whole, from 0 up to 1."""
    so_far = Window.partitionBy("of_source").orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(so_far), F.lit(0))
    per = stored(per.select("of_source", "of_bucket", before.alias("before"), F.sum("n").over(Window.partitionBy("of_source")).alias("total")), "ranks")
    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "text_crc32", "size", "copy")
    ranked = rows.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(per, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    rank = F.col("before") + F.col("within")
    phase = number(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null"))).cast("binary"))).cast("double") / float(1 << 32)
    return ranked.select("doc_id", "source", "size", "text_crc32", rank.alias("rank"), ((rank.cast("double") + phase) / F.col("total").cast("double")).alias("place"))


def ordered(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with their position by place, from 0; sources by code point, null last, settle equal places."""
    rows = rows.withColumn("part", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)))
    per = rows.groupBy(F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = stored(per.select("of_part", before.alias("before")), "places")  # a row for each bucket
    within = Window.partitionBy("part").orderBy("place", F.asc_nulls_last("source"), "rank")
    out = rows.withColumn("within", F.row_number().over(within) - 1).join(per, F.col("part") == F.col("of_part"))
    return out.withColumn("position", F.col("before") + F.col("within"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = "shard") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``rows``: counts of shards are at most one apart, so grown_shard is null. Equal texts are dealt like all
    others: a third of all rows may be equal, and no shard could hold them. A null text has no bytes; a null source is
    a source; a null doc_id is shuffled by its text's digest; rows that are equal in all of this are told apart by a
    number. With fewer rows than shards some shards are empty. Other columns are not read. An empty table gives an
    empty result. Reruns agree.
    """
    with passing(docs.sparkSession) as kept:
        rows = stored(sized(docs), "sized")
        total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        buckets = max(LEAST_BUCKETS, -(-total // ROWS_OF_BUCKET))
        rows = stored(placed(shuffled(rows, seed, buckets), seed), "placed")
        out = kept(stored(ordered(rows, buckets).select("doc_id", "size", "text_crc32", "position"), "ordered"))
    at = F.expr(f"position * {shards} DIV {max(total, 1)}")
    slot = F.expr(f"position - (shard * {total} + {shards - 1}) DIV {shards}")
    out = out.withColumn("shard", at).withColumn("slot", slot)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 in SQL: its table by rule, and a function of a list of bytes.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
)"""


def crc_sql(blob: str) -> str:
    """The CRC-32 of a BLOB, where ``steps`` of CRC_TABLE is in scope."""
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH {CRC_TABLE}, sized AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + {OVERHEAD} AS size, {crc_sql("encode(coalesce(text, ''))")} AS text_crc32 FROM documents, crc
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) AS copy FROM sized
), hashed AS (
  SELECT *, md5('shard:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || size || ':' || copy) AS digest FROM numbered
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM hashed
), placed AS (
  SELECT *, (rank::DOUBLE + ('0x' || substr(md5('shard:' || coalesce(source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) / total::DOUBLE AS place FROM ranked
), positions AS (
  SELECT *, row_number() OVER (ORDER BY place, source ASC NULLS LAST, rank) - 1 AS position, count(*) OVER () AS n FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position * {SHARDS} // n)::INTEGER AS shard,
  (position - ((position * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM positions
"""
