"""Golden cases, reviewers' answers and replay targets as tables, and the packets that reviewers get."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import drift, nodes, patches, rules

FLAG = "struct<type:string,severity:string,file_path:string,node_path:string,aliases:array<string>>"
CASE_SCHEMA = f"case_id string, title string, before map<string,string>, after map<string,string>, expected_exit int, changed_files long, risk_count long, required array<{FLAG}>, forbidden array<{FLAG}>, decision string, accepted array<string>"
ANSWER_SCHEMA = "case_id string, evaluator string, kind string, external boolean, decision string, findings array<struct<text:string,severity:string,file:string>>, notes array<string>"
DECISIONS = ("approve", "investigate", "block")
_ID = re.compile(r"^[a-z0-9][a-z0-9-]*$")


def read_cases(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Cases from JSON lines, of these ids if any are given; each file that only one side has was added or removed."""
    rows = spark.read.schema(CASE_SCHEMA).json(path)
    return rows.where(F.col("case_id").isin(ids)) if ids else rows


def invalid_cases(cases: DataFrame) -> DataFrame:
    """case_id, problem of cases that break the rules: ids, missing sides, unknown decisions, ids that repeat."""
    problem = (
        F.when(F.col("case_id").isNull() | ~F.col("case_id").rlike(_ID.pattern), "bad id")
        .when(F.coalesce(F.size("before") + F.size("after"), F.lit(0)) <= 0, "no files")
        .when(~F.coalesce(F.col("decision"), F.lit("")).isin(*DECISIONS), "unknown decision")
    )
    bad = cases.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("id repeats").alias("problem"))
    return bad.union(twice)


def case_files(cases: DataFrame) -> DataFrame:
    """case_id, path, state, before, after of all changed files; line ends are made alike first."""
    text = lambda c: F.regexp_replace(c, "\r\n", "\n")
    side = lambda c: cases.select("case_id", F.explode(c).alias("path", "content")).select(F.struct("case_id", "path").alias("key"), text("content").alias("content"))
    return drift.changed_files(side("before"), side("after"), "key").select("key.case_id", "key.path", "state", "before", "after")


def read_answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Answers from files or folders of JSON; kinds other than model and human are unknown, and only humans are external."""
    rows = spark.read.schema(ANSWER_SCHEMA).option("multiLine", "true").json(paths)
    kind = F.when(F.col("kind").isin("model", "human"), F.col("kind")).otherwise("unknown")
    return rows.withColumn("kind", kind).withColumn("external", F.coalesce(F.col("external"), F.lit(False)) & (F.col("kind") == "human"))


def case_reports(files: DataFrame) -> DataFrame:
    """case_id, report: what the rules say of changed files (case_id, path, before, after), the gravest first, and every change as a block."""
    parsed = files.select(F.col("case_id").alias("repo"), "path", "before", "after")
    flags = rules.flags(nodes.drift_nodes(parsed).withColumn("declared", F.array().cast("array<string>")))
    said = F.concat(F.lit("- "), F.initcap("severity"), F.lit(": "), "type", F.lit(" in "), "path", F.lit(" ("), "node_path", F.lit(")"))
    told = flags.groupBy(F.col("repo").alias("of")).agg(F.array_sort(F.collect_list(F.struct(T.severity_rank(F.col("severity")).alias("rank"), "path", "pre_ord", said.alias("said")))).alias("told"))
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1)
    block = F.concat(F.lit("### "), "path", F.lit("\n"), drift.diff_block(lines(F.col("before")), lines(F.col("after")), F.col("state"), 80))
    blocks = files.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("path", block.alias("block")))).alias("blocks"))
    out = blocks.join(told, F.col("case_id") == F.col("of"), "left")
    flagged = F.coalesce(F.array_join(F.transform("told", lambda x: x["said"]), "\n"), F.lit("No risks were found."))
    return out.select("case_id", F.concat_ws("\n\n", F.lit("## Risks"), flagged, F.lit("## Changes"), F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n")).alias("report"))


def write_packets(cases: DataFrame, folder: str, prompt: str) -> None:
    """For each case a blind packet: the question, the report, the patch, and what the case is called; nothing of what is expected."""
    files = case_files(cases)
    texts = patches.with_patch(files).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("path", "patch"))).alias("all"))
    texts = texts.select("case_id", F.array_join(F.transform("all", lambda x: x["patch"]), "").alias("patch"))
    rows = cases.select("case_id", "title").join(texts, "case_id").join(case_reports(files), "case_id")
    metadata = F.to_json(F.struct("case_id", "title"))
    parts = {"prompt": F.concat_ws("\n\n", "title", F.lit(prompt)), "report": F.col("report"), "patch": F.col("patch"), "metadata": metadata}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), text.alias("value")) for name, text in parts.items()]))
    # the writer ends each value with a line feed of its own
    out = rows.select("case_id", each.alias("part")).select("case_id", "part.name", F.regexp_replace("part.value", "\n$", "").alias("value"))
    out.write.mode("overwrite").partitionBy("case_id", "name").text(folder)


def replay_targets(path: str) -> list[tuple[str, str, str]]:
    """(label, repository, baseline) of a replay's configuration; entries without a repository are left out."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    entries = doc.get("targets", []) if isinstance(doc, dict) else doc
    return [(e.get("label") or Path(e["path"]).name, e["path"], e.get("baseline") or "head") for e in entries if isinstance(e, dict) and e.get("path")]
