"""Roll-ups of flags and nodes to files and sessions, fingerprints, and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import text as T


def file_rollup(files: DataFrame, flags: DataFrame, nodes: DataFrame, key: str = "path") -> DataFrame:
    """files with risks (flags that are not dismissed), changed_nodes and reviewed_nodes; 0 where there are none."""
    risks = flags.groupBy(F.col(key).alias("__f")).agg(F.count_if(~F.col("dismissed")).alias("risks"))
    counts = nodes.groupBy(F.col(key).alias("__n")).agg(F.count_if(F.col("state") != "unchanged").alias("changed_nodes"), F.count_if(F.col("reviewed")).alias("reviewed_nodes"))
    out = files.join(risks, F.col(key) == F.col("__f"), "left").join(counts, F.col(key) == F.col("__n"), "left").drop("__f", "__n")
    return out.fillna(0, ["risks", "changed_nodes", "reviewed_nodes"])


def session_totals(files: DataFrame, by: list[str]) -> DataFrame:
    """Sums over files: risk_count, files with risks, changed and reviewed nodes, what is left to review, and, where
    files say so, those that were skipped."""
    skipped = [F.count_if("skipped").alias("skipped_files")] if "skipped" in files.columns else []
    out = files.groupBy(*by).agg(
        *skipped,
        F.sum("risks").alias("risk_count"),
        F.count_if(F.col("risks") > 0).alias("file_count"),
        F.count(F.lit(1)).alias("changed_files"),
        F.sum("changed_nodes").alias("changed_nodes"),
        F.sum("reviewed_nodes").alias("reviewed_nodes"),
    )
    return out.withColumn("pending_review", F.greatest(F.col("changed_nodes") - F.col("reviewed_nodes"), F.lit(0)))


def exit_code(flags: DataFrame, by: list[str]) -> DataFrame:
    """The greatest exit code of flags that are not dismissed, 0 without any."""
    code = F.when(~F.col("dismissed"), T.severity_exit(F.col("severity"))).otherwise(0)
    return flags.groupBy(*by).agg(F.max(code).alias("exit_code"))


def gate(code: Column, threshold: str) -> Column:
    """Whether a run fails: usage errors always do."""
    least = {"none": 99, "low": 1, "medium": 2, "high": 3}[threshold]
    return (code >= least) | (code == 64)


#: Parts that a repository's entries are dealt to before they are put in order and hashed.
FINGERPRINT_PARTS = 256


def _ordered_hash(rows: DataFrame, repo: str, value: Column, name: str) -> DataFrame:
    """repo, name: entries in order, as one text. Whoever has so many that this is too long takes ``fingerprint_parts``."""
    return rows.groupBy(repo).agg(F.array_join(F.array_sort(F.collect_list(value)), ";").alias(name))


def _entry(files: DataFrame) -> Column:
    return F.concat("path", F.lit("="), "content_hash", F.coalesce("skip_marker", F.lit("")))


def fingerprint(flags: DataFrame, files: DataFrame, others: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, fingerprint: of flag ids, path=hash entries and markers of other files, each in order.

    A row gathers one repository's entries, about a hundred bytes for each changed file.
    """
    parts = _ordered_hash(flags, repo, F.col("flag_id"), "f").join(_ordered_hash(files, repo, _entry(files), "p"), repo, "full_outer")
    parts = parts.join(_ordered_hash(others, repo, F.col("marker"), "o"), repo, "full_outer")
    return parts.select(repo, F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in "fpo"]).cast("binary")).alias("fingerprint"))


def large_fingerprint(flags: DataFrame, files: DataFrame, others: DataFrame, repo: str = "repo") -> DataFrame:
    """A fingerprint in two levels, for tables that stand for millions of files: entries are dealt to FINGERPRINT_PARTS
    by their hash, each part is put in order and hashed, and the parts' hashes are."""
    tagged = [x.select(F.col(repo), F.concat(F.lit(tag), v).alias("entry")) for x, tag, v in ((flags, "f|", F.col("flag_id")), (files, "p|", _entry(files)), (others, "o|", F.col("marker")))]
    rows = tagged[0].union(tagged[1]).union(tagged[2]).withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(FINGERPRINT_PARTS)))
    ordered = F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256)
    per = rows.groupBy(repo, "part").agg(ordered.alias("hash"))
    return per.groupBy(repo).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), ""), 256).alias("fingerprint"))


def file_order() -> list[Column]:
    return [F.desc("risks"), F.col("dir"), F.col("name")]


def flag_order() -> list[Column]:
    """Active ones first, then by severity and path, then as they stand in the file."""
    return [F.col("dismissed"), T.severity_rank(F.col("severity")), F.col("path"), F.col("pre_ord")]


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in its partition: for reports, so that one repository is a partition."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def default_selection(flags: DataFrame, files: DataFrame) -> DataFrame:
    """kind, id of what a report opens with: the first active flag, else the first file."""
    flag = flags.where(~F.col("dismissed")).orderBy(*flag_order()).limit(1).select(F.lit(0).alias("o"), F.lit("flag").alias("kind"), F.col("flag_id").alias("id"))
    file = files.orderBy(*file_order()).limit(1).select(F.lit(1).alias("o"), F.lit("file").alias("kind"), F.col("path").alias("id"))
    return flag.union(file).orderBy("o").limit(1).select("kind", "id")


def other_files(changed: DataFrame, with_results: DataFrame) -> DataFrame:
    """Changed files that have no results: they are listed, and nothing is said of them."""
    return changed.join(with_results.select("path").distinct(), "path", "left_anti")


def results(*tables: DataFrame) -> DataFrame:
    """The paths of all tables' results, each once."""
    out = tables[0].select("path")
    for other in tables[1:]:
        out = out.union(other.select("path"))
    return out.distinct()


def flag_counts(flags: DataFrame, target: str, rule: str = "rule") -> DataFrame:
    """Flags of each target and rule, of each target, and of all, told apart by ``level``."""
    return flags.rollup(target, rule).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
