"""Queries that are SQL text over the table functions: the rows of the operators that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources import table_functions

from .catalogue import SQL, _package_files, _read, query
from .catalogue_rules import statement_files


def _sql(files: DataFrame, text: str) -> DataFrame:
    """The rows of a statement over files, which it names {files}."""
    spark = files.sparkSession
    table_functions.register(spark)
    return spark.sql(text, files=files)


@query(SQL["statement_nodes"])
def statement_nodes_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(statement_files(spark, sf_dir), "SELECT path, node_id, state, depth, ord AS pre_ord FROM {files}, LATERAL drift_nodes(path, before, after)")


@query(SQL["manifest_entries"])
def manifest_entries_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(_package_files(spark, sf_dir), "SELECT path AS manifest, section, name, spec FROM {files}, LATERAL manifest_entries(path, content)")


@query(SQL["lockfile_names"])
def lockfile_names_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.translate("s_name", " ", "_"), F.lit(" v1.0.0 h1:x="))
    per = _read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    files = per.select(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("/go.sum")).alias("path"), "content")
    return _sql(files, "SELECT path AS lock_path, name FROM {files}, LATERAL locked_names(path, content) WHERE NOT loose")


@query("SELECT 's' || s_suppkey || '.go' AS path, count(*) AS statements, 'f' || s_suppkey AS first FROM supplier JOIN (SELECT unnest(range(3))) ON true GROUP BY s_suppkey")
def statements_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of two statements for each supplier, cut and counted in SQL."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("func f"), key, F.lit("(a int) int {\n\tb := a + "), key, F.lit("\n\treturn b\n}\n"))
    files = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key, F.lit(".go")).alias("path"), text.alias("content"))
    return _sql(files, "SELECT path, count(*) AS statements, min_by(name, ord) AS first FROM {files}, LATERAL source_statements(path, content) GROUP BY path")
