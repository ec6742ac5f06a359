"""Flags over the recent history of several repositories: how often rules speak where nothing is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom import cli
from driftloom.sources.git import BaselineError

FLAG_SCHEMA = "target string, rule string, type string, path string"
FILE_SCHEMA = "target string, path string"


def replay(spark: SparkSession, targets: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flags, files, errors) of (label, repository, baseline) targets; one that fails is an error and no more."""
    flags, files, errors = [spark.createDataFrame([], FLAG_SCHEMA)], [spark.createDataFrame([], FILE_SCHEMA)], []
    for label, path, baseline in targets:
        try:
            found, _ = cli.run(spark, path, baseline)
        except BaselineError as e:
            errors.append((label, str(e)))
            continue
        flags.append(found.flags.select(F.lit(label).alias("target"), "rule", "type", "path"))
        files.append(found.files.select(F.lit(label).alias("target"), "path"))
    both = lambda parts: reduce(DataFrame.unionByName, parts)
    return both(flags), both(files), spark.createDataFrame(errors, "target string, error string")


def summary(flags: DataFrame, files: DataFrame) -> DataFrame:
    """target, files, flags, flags_per_file (0 without files); the row without a target is of all."""
    counts = files.rollup("target").agg(F.count(F.lit(1)).alias("files"))
    spoken = flags.rollup("target").agg(F.count(F.lit(1)).alias("flags")).withColumnRenamed("target", "__t")
    out = counts.join(spoken, F.col("target").eqNullSafe(F.col("__t")), "left").drop("__t").fillna(0, ["flags"])
    return out.withColumn("flags_per_file", F.coalesce(F.try_divide(F.col("flags"), F.col("files")), F.lit(0.0)))


def by_rule(flags: DataFrame) -> DataFrame:
    return flags.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def coverage(flags: DataFrame) -> DataFrame:
    """target, code, dependency: flags of code rules and of dependency rules."""
    dependency = F.col("rule").startswith("dep-") | F.col("rule").isin("script-changed", "cargo-build-script")
    return flags.groupBy("target").agg(F.count_if(~dependency).alias("code"), F.count_if(dependency).alias("dependency"))


def coverage_card(flags: DataFrame, files: DataFrame) -> list[dict]:
    """Of each target files, flags, and flags by kind; it is an error if kinds do not sum up to all flags. A row for each target reaches the driver."""
    kinds = {r["target"]: r for r in coverage(flags).collect()}
    out = []
    for r in summary(flags, files).where("target IS NOT NULL").orderBy("target").collect():
        code, dependency = (kinds[r["target"]][c] if r["target"] in kinds else 0 for c in ("code", "dependency"))
        if code + dependency != r["flags"]:
            raise ValueError(f"{r['target']}: {code} and {dependency} flags by kind, {r['flags']} in all")
        out.append({"target": r["target"], "files": r["files"], "flags": r["flags"], "code": code, "dependency": dependency})
    return out


def report(flags: DataFrame, files: DataFrame, errors: DataFrame, generated_at: str) -> str:
    """The replay as Markdown: targets, rules, and targets that failed."""
    rows = summary(flags, files).orderBy(F.asc_nulls_last("target")).collect()
    lines = ["# Replay", "", f"- generated: {generated_at}", "", "| Target | Files | Flags | Flags per file |", "|-|-|-|-|"]
    lines += [f"| {r['target'] or 'all'} | {r['files']} | {r['flags']} | {r['flags_per_file']:.2f} |" for r in rows]
    lines += ["", "| Finding | Flags |", "|-|-|", *(f"| {r['type']} | {r['n']} |" for r in by_rule(flags).collect())]
    failed = errors.orderBy("target").collect()
    return "\n".join([*lines, "", "## Failed", "", *(f"- {r['target']}: {r['error']}" for r in failed)] if failed else lines) + "\n"


def placed(rules: DataFrame) -> DataFrame:
    """rules (type, n) with ``place``: the most frequent first, then by name. A row for each rule."""
    return rules.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "type")))
