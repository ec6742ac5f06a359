"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are summed for each source, targets are filled like water under each source's cap, and each
document is emitted floor(rate) times plus once more if a draw seeded by its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, packed, stored, text_of

#: Hexadecimal digits of the draw: 52 bits, which a double holds without rounding.
DRAW_DIGITS = 13


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def draw(seed: str, doc_id: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the id alone."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(sized: DataFrame, max_repeats: int, cycle: int) -> DataFrame:
    """source, source_size, target: one row for each source, from (source, size).

    The windows order the table of sources in one task: it has a row for each source and no documents, and is meant
    for up to some millions of them (a row takes under 100 bytes).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", F.asc_nulls_last("source"))
    everywhere, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1)
    per = per.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    per = per.withColumns({"left_size": F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_weight": F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    per = per.withColumn("level", F.col("left_size").cast("double") / F.col("left_weight"))
    per = per.withColumn("capped", F.col("level") > F.col("ratio"))
    # the level of the first source, by ratio, that its cap does not stop
    per = per.withColumn("final", F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everywhere)["level"])
    target = F.when(F.col("capped") | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def with_copies(rows: DataFrame, doc_id: Column, source: Column, seed: str, max_repeats: int, cycle: int) -> DataFrame:
    """rows (with a size, and no columns named below) with their source's size and target and their number of copies.

    The table of sources is written first: its size is then known, and Spark broadcasts it only if it is small.
    """
    per = stored(source_targets(rows.select(source.alias("source"), "size"), max_repeats, cycle), "sources").withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    out = rows.join(per, source.eqNullSafe(F.col("of_source"))).withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + (draw(seed, doc_id) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, seed: str = "mix:", max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row.

    Sources by code point, null last, weigh 1..cycle, repeating. Null texts have size 0; a null source is
    a source; rows of a null or repeated doc_id draw alike. Other columns are not read. Sources of size 0
    have target 0. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", size_of(text_of()).alias("size"))
    out = with_copies(sized, F.col("doc_id"), F.col("source"), seed, max_repeats, cycle)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, seed: str = "mix:", max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with docs' own columns, whatever their names."""
    sized = packed(docs).withColumn("size", size_of(F.coalesce("row.text", F.lit(""))))
    out = with_copies(sized, F.col("row.doc_id"), F.col("row.source"), seed, max_repeats, cycle).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio FROM per
), level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM capped WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT *, level > ratio AS stopped, min_by(level, ratio) FILTER (level <= ratio) OVER () AS f FROM level
), targets AS (
  SELECT source, source_size, CASE WHEN stopped OR f IS NULL THEN cap::DOUBLE ELSE least(f * weight, cap::DOUBLE) END AS target FROM final
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM (
  SELECT *, floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT AS copies FROM rated
)
"""
