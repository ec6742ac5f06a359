"""Queries of review marks, approvals, hashes, matched findings and the orders of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import evalkit, nodes, triage
from driftloom.plans import replay

from .catalogue import _flags, _read, query
from .catalogue_rules import statement_files
from .sides import FLAGS, SIDES, sides


@query(
    f"""WITH {SIDES} SELECT s.path AS node_id, before IS DISTINCT FROM after AS changed, (before IS DISTINCT FROM after) AND s.doc_id % 3 <> 0 AND s.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS reviewed FROM sides s WHERE after IS NOT NULL"""
)
def reviewed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality have been reviewed, a third of them with another content than they have now."""
    both = sides(spark, sf_dir).where("after IS NOT NULL").withColumn("node_hash", F.md5(F.col("after").cast("binary")))
    state = F.when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    tree = both.select("doc_id", F.lit("r").alias("repo"), F.col("path").alias("node_id"), "node_hash", state.alias("state"))
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    kept = F.when(F.col("doc_id") % 3 == 0, "another").otherwise(F.col("node_hash"))
    marks = tree.join(good, "doc_id", "left_semi").select("repo", F.lit("reviewed").alias("kind"), F.col("node_id").alias("id"), kept.alias("hash"))
    return triage.with_reviewed(tree, marks).select("node_id", (F.col("state") != "unchanged").alias("changed"), "reviewed")


@query(
    """SELECT 'r' || c_nationkey AS repo, CASE WHEN c_nationkey = 3 THEN NULL ELSE max(c_name) END AS approved_fingerprint, CASE WHEN c_nationkey = 3 THEN NULL ELSE 't' END AS approved_at, min(c_name) AS trust_point FROM customer GROUP BY c_nationkey"""
)
def approval_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _read(spark, sf_dir, "customer").groupBy(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo")).agg(F.max("c_name").alias("approved_fingerprint"), F.min("c_name").alias("trust_point"))
    approvals = per.select("repo", "approved_fingerprint", F.lit("t").alias("approved_at"), "trust_point", F.lit(None).cast("string").alias("baseline"))
    return triage.revoke(approvals, "r3").drop("baseline")


@query("SELECT 'o' || o_custkey || '.ts' AS path, count(*) AS nodes, count(DISTINCT o_orderkey) AS hashes, count(*) FILTER (o_orderkey % 3 <> 2) AS changed FROM orders GROUP BY o_custkey")
def node_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that differ in anything have hashes of their own, and equal ones in another file have theirs."""
    tree = nodes.drift_nodes(statement_files(spark, sf_dir), facts=False)
    other = nodes.drift_nodes(statement_files(spark, sf_dir).withColumn("path", F.concat(F.lit("copy/"), "path")), facts=False)
    same = tree.select("path", "name", "node_hash", "state").join(other.select(F.expr("substring(path, 6)").alias("of"), F.col("name").alias("of_name"), F.col("node_hash").alias("of_hash")), (F.col("path") == F.col("of")) & (F.col("name") == F.col("of_name")) & (F.col("node_hash") == F.col("of_hash")))
    return same.groupBy("path").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_hash").alias("hashes"), F.count_if(F.col("state") != "unchanged").alias("changed"))


@query(
    f"""WITH {SIDES}, {FLAGS} SELECT rule AS type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rule) AS place FROM rated GROUP BY 1"""
)
def rules_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.by_rule(_flags(spark, sf_dir).select(F.col("rule").alias("type")))
    return replay.placed(rows).select("type", "n", F.col("place").cast("long").alias("place"))


@query("SELECT role AS model, round(avg(length(text) % 101))::BIGINT AS mean, row_number() OVER (ORDER BY round(avg(length(text) % 101)) DESC, role) AS place FROM conversations GROUP BY 1")
def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = evalkit.panel_totals(_read(spark, sf_dir, "conversations").select(F.col("role").alias("model"), (F.length("text") % 101).cast("long").alias("score")))
    return evalkit.models_in_order(totals).select("model", "mean", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id::VARCHAR AS case_id, avg(length(text) % 101) AS mean, row_number() OVER (ORDER BY avg(length(text) % 101), conv_id::VARCHAR) AS place FROM conversations GROUP BY conv_id")
def case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("case_id")).agg(F.avg((F.length("text") % 101).cast("long")).alias("mean"))
    return evalkit.cases_in_order(per)


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 'c' || k AS case_id, 0 AS expectation, CASE WHEN k % 4 = 0 THEN 1 WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 2 THEN 0 END::INTEGER AS finding FROM c
UNION ALL SELECT 'c' || k, 1, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 1 END::INTEGER FROM c"""
)
def finding_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expectations of each customer, the first in a file of its own, against findings that the customer's key chooses.

    0: both fit the first, the second is in its file, and the first is left for the other; 1: one each; 2: the same
    finding fits both and is taken once; 3: the severity is too low, and the words are others.
    """
    item = lambda text, severity, file, aliases: F.struct(F.lit(text).alias("text"), F.lit(severity).alias("severity"), F.lit(file).alias("file"), aliases.alias("aliases"))
    none = F.lit(None).cast("array<string>")
    words = lambda *x: F.array(*map(F.lit, x))
    expected = F.array(item("", "high", "a.ts", words("query", "sql")), item("", "low", None, words("log", "sql")))
    one, two = item("raw sql in a log", "high", "b.ts", none), item("raw sql", "high", "a.ts", none)
    low, other = item("raw query", "medium", "a.ts", none), item("style", "high", "a.ts", none)
    kind = F.col("c_custkey") % 4
    found = F.when(kind == 0, F.array(one, two)).when(kind == 1, F.array(two, item("noisy log", "low", "z.ts", none))).when(kind == 2, F.array(two)).otherwise(F.array(low, other))
    cases = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), expected.alias("expected"), found.alias("findings"))
    return evalkit.match_findings(cases.select("case_id", F.col("expected").cast(f"array<{evalkit.ITEM}>").alias("expected"), F.col("findings").cast(f"array<{evalkit.ITEM}>").alias("findings"))).select("case_id", "expectation", "finding")
