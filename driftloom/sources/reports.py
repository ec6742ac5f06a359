"""Reports of many repositories as ordered lines: nothing of them is put together on the driver.

Every line has its repository and a key of its place. Lines are dealt to tasks by ranges of these, sorted there, and
written, so that the parts of a repository, taken by their names, are its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import drift
from driftloom.plans.check import Session

#: A line's place: its section, four keys of what it tells of, and the line within that.
KEYS = ("section", "a", "b", "c", "d", "line")


def _counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def _rows(frame: DataFrame, section: Column, keys: tuple[Column, Column, Column, Column], lines: Column) -> DataFrame:
    """Lines of each row of frame; keys: a number, two texts, and a number. Null lines are left out."""
    at = frame.select("repo", section.cast("int").alias("section"), *[k.alias(c) for k, c in zip(keys, KEYS[1:5], strict=True)], F.posexplode(F.array_compact(lines)).alias("line", "text"))
    return at.select("repo", "section", F.col("a").cast("long").alias("a"), "b", "c", F.col("d").cast("long").alias("d"), F.col("line").cast("int").alias("line"), "text")


def markdown_lines(found: Session, heads: DataFrame, generated_at: str, cap: int = 80) -> DataFrame:
    """repo, KEYS, text of the reports of all repositories of heads (repo, project, branch, baseline, path; null: not told).

    heads may have ``approved``.
    """
    none, zero = F.lit(""), F.lit(0)
    here = (zero, none, none, zero)
    totals = found.totals.select(F.col("repo").alias("__r"), "changed_files", "risk_count")
    own = heads.join(totals, F.col("repo") == F.col("__r"), "left").na.fill(0, ["changed_files", "risk_count"])
    told = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {c}: "), F.col(c))) for c in ("branch", "baseline", "path")]
    counts = F.concat(F.lit("- "), _counted(F.col("changed_files"), "changed file"), F.lit(", "), _counted(F.col("risk_count"), "active flag"))
    reviewed = F.when(F.coalesce("approved", F.lit(False)), "- reviewed").otherwise("- not reviewed") if "approved" in heads.columns else F.lit("- not reviewed")
    title = F.concat(F.lit("# Changes in "), F.coalesce("project", none))
    out = _rows(own, F.lit(0), here, F.array(title, none, *told, F.lit(f"- generated: {generated_at}"), counts, reviewed, none, F.lit("## Flags"), none))
    rank = T.severity_rank(F.col("severity"))
    active, gone = found.flags.where("NOT dismissed"), found.flags.where("dismissed")
    some = active.select("repo", "severity").distinct()
    quiet = heads.join(some.select(F.col("repo").alias("__r")).distinct(), F.col("repo") == F.col("__r"), "left_anti")
    parts = [_rows(quiet, F.lit(1), here, F.array(F.lit("None is active."), none))]
    parts.append(_rows(some, 2 + 2 * rank, here, F.array(F.concat(F.lit("### "), F.initcap("severity")), none)))
    nodes = found.nodes.select(F.col("repo").alias("__r"), F.col("node_id").alias("__id"), drift.diff_block(F.col("before"), F.col("after"), F.col("state"), cap).alias("__block"))
    shown = active.join(nodes.dropDuplicates(["__r", "__id"]), (F.col("repo") == F.col("__r")) & (F.col("node_id") == F.col("__id")), "left")
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    evidence = F.when(F.coalesce("evidence", none) != "", F.concat(F.lit("- line: "), quoted(F.col("evidence"))))
    flag = F.array(
        F.concat(F.lit("#### "), "type", F.lit(": "), quoted(F.col("path"))), none, F.concat(F.lit("- at "), "node_path"), F.concat(F.lit("- "), "desc"), evidence,
        none, F.lit("```diff"), F.coalesce("__block", none), F.lit("```"), none,
    )
    parts.append(_rows(shown, 3 + 2 * rank, (zero, F.col("path"), none, F.col("pre_ord")), flag))
    per = gone.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rows(per, F.lit(10), here, F.array(F.concat(F.lit("## Dismissed ("), F.col("n").cast("string"), F.lit(")")), none)))
    line = F.concat(F.lit("- ~~"), "type", F.lit("~~ "), quoted(F.col("path")), F.lit(", "), "node_path")
    parts.append(_rows(gone, F.lit(11), (rank, F.col("path"), none, F.col("pre_ord")), F.array(line)))
    parts.append(_rows(per, F.lit(12), here, F.array(none)))
    parts.append(_rows(heads, F.lit(13), here, F.array(F.lit("## Files"), none)))
    said = F.concat(F.lit("- "), quoted(F.concat("dir", "name")), F.lit(": "), "summary", F.lit(", "), _counted(F.col("risks"), "active flag"))
    parts.append(_rows(found.files, F.lit(14), (-F.col("risks"), F.col("dir"), F.col("name"), zero), F.array(said)))
    parts.append(_rows(heads, F.lit(15), here, F.array(none)))
    others = found.other_files.select("repo", "path")
    parts.append(_rows(others.select("repo").distinct(), F.lit(16), here, F.array(F.lit("## Other files"), none)))
    parts.append(_rows(others, F.lit(17), (zero, F.col("path"), none, zero), F.array(F.concat(F.lit("- "), quoted(F.col("path"))))))
    parts.append(_rows(others.select("repo").distinct(), F.lit(18), here, F.array(none)))
    for part in parts:
        out = out.unionByName(part)
    return out


def write_markdown(lines: DataFrame, folder: str, parts: int | None = None) -> None:
    """Writes a folder for each repository, whose files taken by name are its report: each has the lines of a range of places."""
    keys = ["repo", *KEYS]
    dealt = lines.repartitionByRange(parts, *keys) if parts else lines.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("repo", F.col("text").alias("value")).write.mode("overwrite").partitionBy("repo").text(folder)
