"""Session totals that batches of files change by their own share: nothing else is parsed or counted again.

For each file the state has what it adds to its repository's totals. A batch parses its files, takes away what they
added before and adds what they add now; shares, flags and totals change in one version. Work goes with the batch and
the buckets that its keys are in, not with the repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scratch import written
from driftloom.operators import nodes, rules, triage

from .tables import Table, Version, VersionedTables

COUNTS = ("files", "files_at_risk", "risks", "high", "medium", "low", "changed_nodes", "reviewed_nodes", "skipped")
_COUNTS = ", ".join(f"{c} long" for c in COUNTS)
FLAGS = "repo string, path string, flag_id string, rule string, type string, severity string, node_id string, node_hash string, dismissed boolean"


def file_shares(files: DataFrame, declared: DataFrame | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(repo, path, COUNTS) and the flags of changed files (repo, path, before, after).

    declared: (repo, name) of packages that manifests declare; state: of ``triage``. Both are read for these files only.
    """
    changed = files.where(~F.col("before").eqNullSafe(F.col("after")))
    tree = nodes.drift_nodes(changed)
    if declared is None:
        tree = tree.withColumn("declared", F.array().cast("array<string>"))
    else:
        names = declared.groupBy(F.col("repo").alias("of_repo")).agg(F.collect_set("name").alias("declared"))
        tree = tree.join(names, F.col("repo") == F.col("of_repo"), "left").withColumn("declared", F.coalesce("declared", F.array().cast("array<string>"))).drop("of_repo")
    tree = written(tree, "tree")
    found, seen = rules.flags(tree), tree
    if state is None:
        found, seen = found.withColumn("dismissed", F.lit(False)), seen.withColumn("reviewed", F.lit(False))
    else:
        found, seen = triage.with_dismissed(found, state), triage.with_reviewed(seen, state)
    flags = written(found.select(*[c.split(" ")[0] for c in FLAGS.split(", ")]), "flags")
    is_changed = F.col("state") != "unchanged"
    per_file = seen.groupBy("repo", "path").agg(F.count_if(is_changed).alias("changed_nodes"), F.count_if(is_changed & F.col("reviewed")).alias("reviewed_nodes"))
    active = ~F.col("dismissed")
    risks = flags.groupBy("repo", "path").agg(F.count_if(active).alias("risks"), *[F.count_if(active & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low")])
    skipped = nodes.is_oversized(F.col("path"), F.col("before"), F.col("after")).cast("long")
    rows = changed.select("repo", "path", F.lit(1).cast("long").alias("files"), skipped.alias("skipped")).join(per_file, ["repo", "path"], "left").join(risks, ["repo", "path"], "left").na.fill(0)
    return rows.withColumn("files_at_risk", (F.col("risks") > 0).cast("long")).select("repo", "path", *COUNTS), flags


def summed(shares: DataFrame) -> DataFrame:
    """repo, COUNTS: totals of shares."""
    return shares.groupBy("repo").agg(*[F.sum(c).alias(c) for c in COUNTS])


class IncrementalSession:
    """Shares and flags of files, and totals of repositories, in a folder that all writers share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, keep: int = 3) -> None:
        tables = {
            "shares": Table(f"repo string, path string, {_COUNTS}", ("repo", "path"), buckets),
            "flags": Table(FLAGS, ("repo", "path"), buckets),
            "totals": Table(f"repo string, {_COUNTS}", ("repo",), buckets),
        }
        self.tables = VersionedTables(spark, path, tables, keep)

    def apply(self, files: DataFrame, batch: int, declared: DataFrame | None = None, state: DataFrame | None = None, stream: str = "stream") -> None:
        """Takes in files (repo, path, before, after), one row each; a file whose sides are equal, or both null, has no share any more.

        A batch that runs again is known by its number and left out.
        """
        if self.tables.head().applied.get(stream, -1) >= batch:
            return
        shares, flags = file_shares(files, declared, state)
        shares = written(shares, "shares")
        paths = written(files.select("repo", "path").distinct(), "paths")

        def make(began: Version) -> dict | None:
            if began.applied.get(stream, -1) >= batch:
                return None
            touched = self.tables.touched("shares", paths)
            old = self.tables.read("shares", began, touched)
            left = old.join(paths, ["repo", "path"], "left_anti").unionByName(shares)
            other_flags = self.tables.read("flags", began, touched).join(paths, ["repo", "path"], "left_anti").unionByName(flags)
            gone = old.join(paths, ["repo", "path"], "left_semi")
            change = shares.select("repo", *COUNTS).unionByName(gone.select("repo", *[(-F.col(c)).alias(c) for c in COUNTS]))
            repos = self.tables.touched("totals", paths)
            totals = summed(self.tables.read("totals", began, repos).unionByName(change)).where("files > 0")
            folders = {"shares": self.tables.write("shares", left, touched), "flags": self.tables.write("flags", other_flags, touched), "totals": self.tables.write("totals", totals, repos)}
            return {"folders": folders, "applied": {stream: batch}}

        self.tables.change(make)

    def refresh(self, files: DataFrame, declared: DataFrame | None = None, state: DataFrame | None = None) -> None:
        """Replaces everything by a full analysis; batches of the epoch before are stale then."""
        shares, flags = file_shares(files, declared, state)
        shares = written(shares, "shares")

        def make(began: Version) -> dict:
            every = {t: list(range(self.tables.tables[t].buckets)) for t in ("shares", "flags", "totals")}
            rows = {"shares": shares, "flags": flags, "totals": summed(shares)}
            return {"folders": {t: self.tables.write(t, rows[t], every[t]) for t in rows}, "epoch": began.epoch + 1, "whole": True}

        self.tables.change(make)

    def totals(self, version: Version | None = None) -> DataFrame:
        exit_code = F.when(F.col("high") > 0, 3).when(F.col("medium") > 0, 2).when(F.col("low") > 0, 1).otherwise(0)
        return self.tables.read("totals", version).withColumn("exit_code", exit_code)

    def flags(self, version: Version | None = None) -> DataFrame:
        return self.tables.read("flags", version)
