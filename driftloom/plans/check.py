"""The whole analysis: changed files to nodes, flags, dependency findings, review state, sessions and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import paths as P
from driftloom.functions import text as T
from driftloom.operators import deps, drift, nodes, rules, session, triage
from driftloom.sources import manifests


@dataclass
class Session:
    """Tables of one analysis: flags and nodes have ``repo``; files are those with results, others are not parsed."""

    files: DataFrame
    nodes: DataFrame
    flags: DataFrame
    other_files: DataFrame
    totals: DataFrame
    held: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Lets go of what is kept for the tables."""
        for df in self.held:
            df.unpersist()


def dependency_flags(changed: DataFrame, worktree: DataFrame) -> DataFrame:
    """Rows like nodes and flags for changed manifests; worktree: (path, content) of all files that may be lockfiles.

    Entries of both sides are joined by manifest, section and name. A lockfile vouches for the manifest beside it;
    entries under another name are looked up by the name that the lockfile has for them. Where no name can be read
    from a lockfile, a name followed by @ in its text vouches.
    """
    eco = deps.ecosystem_of(F.col("manifest"))

    def side(c: str) -> DataFrame:
        rows = manifests.entries(changed.where(F.col(c).isNotNull()).select("path", F.col(c).alias("content")))
        indirect = (eco == "go") & (F.col("section") == "indirect")
        return rows.withColumn("indirect", indirect).withColumn("section", F.when(indirect, "require").otherwise(F.col("section")))

    before, after = side("before"), side("after")
    diff = drift.entry_diff(before, after, ["manifest", "section"], "name", "spec")
    facts = after.unionByName(before).groupBy(F.col("manifest").alias("of"), F.col("name").alias("of_name")).agg(F.max("vouch_name").alias("vouch_name"))
    diff = diff.join(facts, (F.col("manifest") == F.col("of")) & (F.col("name") == F.col("of_name"))).drop("of", "of_name")
    indirect = after.where("indirect").select(F.col("manifest").alias("of"), F.col("name").alias("of_name"), F.lit(True).alias("by_others")).distinct()
    diff = diff.join(indirect, (F.col("manifest") == F.col("of")) & (F.col("name") == F.col("of_name")), "left").drop("of", "of_name")
    own = changed.where(deps.ecosystem_of(F.col("path")).isNotNull()).select("path")
    locks = worktree.where(F.substring_index("path", "/", -1).isin(*manifests.LOCK_READERS))
    beside = deps.nearest_lockfile(own, locks).where("lock_path IS NOT NULL").select(F.col("path").alias("lock_of"), F.col("lock_path").alias("lock"))
    names = manifests.locked(locks).select(F.col("lock_path").alias("in_lock"), F.col("name").alias("known_name")).distinct()
    loose = manifests.loose_texts(locks).select(F.col("lock_path").alias("lock"), "lock_text")
    rows = diff.join(beside, F.col("manifest") == F.col("lock_of"), "left").join(names, (F.col("lock") == F.col("in_lock")) & (F.col("vouch_name") == F.col("known_name")), "left")
    rows = deps.loosely_vouched(rows, loose, "vouch_name", key="lock")
    known = F.col("known_name").isNotNull() | F.col("vouched")
    rows = rows.withColumns({"ecosystem": eco, "indirect": F.coalesce("by_others", F.lit(False)), "locked": F.col("lock").isNotNull(), "known": known})
    out = deps.dependency_findings(rows)
    line = lambda c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col(c), F.lit('"'))))
    file_id = F.when(F.col("manifest").endswith(".csproj"), F.concat(F.lit("csproj:"), "manifest")).when(F.col("manifest") == "Cargo.toml", "cargo_toml").otherwise(P.sanitize_id(F.col("manifest")))
    kind = F.when(F.col("rule") == "script-changed", "Script").when(F.col("rule") == "cargo-build-script", "Build script").when(F.col("ecosystem") == "go", "Module").otherwise("Dependency")
    kind = F.when((F.col("ecosystem") == "npm") & (F.col("section") == "scripts"), "Script").otherwise(kind)
    out = out.select(
        F.col("manifest").alias("path"), file_id.alias("file_id"), F.col("section").alias("signature"), "name", "state", "rule", "severity", "type",
        line("before").alias("before"), line("after").alias("after"), kind.alias("kind"),
    )
    out = deps.ordered(out)
    lifecycle = (F.col("rule") == "script-changed") & T.is_lifecycle(F.col("name"))
    desc = F.when(lifecycle, F.concat(F.lit("A script that installs run changed: "), "name")).otherwise(F.concat_ws(" ", "type", "name"))
    out = drift.with_node_ids(out.withColumn("desc", desc), "file_id", "signature", "kind", "name", "signature")
    out = out.withColumn("node_hash", F.sha2(F.to_json(F.struct("kind", "name", "signature", "state", "before", "after")), 256))
    return out.withColumn("flag_id", F.concat("rule", F.lit("@"), "node_id")).withColumn("node_path", F.concat_ws(" › ", "signature", "name"))


def declared_packages(worktree: DataFrame) -> DataFrame:
    """One row with ``declared``: the packages that the root manifest names in any section."""
    root = manifests.entries(worktree.where("path = 'package.json'")).where("section <> 'scripts'")
    return root.agg(F.array_sort(F.collect_set("name")).alias("declared"))


def analyze(changed: DataFrame, worktree: DataFrame, state: DataFrame, repo: str) -> Session:
    """Everything about changed files (path, before, after) of one repository.

    worktree: (path, content) of manifests and lockfiles as they are now; state: review state as triage.SCHEMA.
    """
    declared = [r["declared"] for r in declared_packages(worktree).collect()][0]  # one manifest's names
    skipped = nodes.skipped_files(changed)
    read = changed.where(P.is_analyzable(F.col("path")) & ~nodes.is_oversized(F.col("path"), F.col("before"), F.col("after")))
    tree = nodes.drift_nodes(read).withColumn("declared", F.lit(declared).cast("array<string>"))
    common = ["path", "file_id", "node_id", "kind", "name", "signature", "state", "before", "after", "node_hash"]
    # each is read by several tables of the session: worked out once, and again where an executor is lost
    tree = tree.persist()
    found = rules.flags(tree)
    dependencies = dependency_flags(changed, worktree).persist()
    all_nodes = tree.select(*common, "depth", "pre_ord").unionByName(dependencies.select(*common, F.lit(0).alias("depth"), "pre_ord")).withColumn("repo", F.lit(repo))
    columns = ["path", "file_id", "node_id", "node_path", "node_hash", "flag_id", "rule", "type", "severity", "desc"]
    flags = found.select(*columns, "evidence", "pre_ord").unionByName(dependencies.where("rule IS NOT NULL").select(*columns, F.lit(None).cast("string").alias("evidence"), "pre_ord"))
    flags = triage.with_dismissed(flags.withColumn("repo", F.lit(repo)), state).persist()
    all_nodes = triage.with_reviewed(all_nodes, state).persist()
    counts = drift.state_counts(all_nodes, ["path"]).select(F.col("path").alias("__p"), "summary")
    with_results = session.results(changed.where(P.is_analyzable(F.col("path"))), dependencies)
    left_out = skipped.select(F.col("path").alias("__s"), F.col("summary").alias("__why"), "skip_marker")
    files = with_results.join(counts, F.col("path") == F.col("__p"), "left").join(left_out, F.col("path") == F.col("__s"), "left")
    files = files.withColumn("summary", F.coalesce("__why", "summary", F.lit("Formatting only"))).withColumn("skipped", F.col("__s").isNotNull()).drop("__p", "__s", "__why")
    files = files.withColumn("dir", P.dir_of(F.col("path"))).withColumn("name", P.file_name(F.col("path"))).withColumn("repo", F.lit(repo))
    files = session.file_rollup(files, flags, all_nodes)
    others = session.other_files(changed.select("path"), with_results).withColumn("repo", F.lit(repo))
    totals = session.session_totals(files, ["repo"])
    codes = session.exit_code(flags, ["repo"]).withColumnRenamed("repo", "__r")
    totals = totals.join(codes, F.col("repo") == F.col("__r"), "left").drop("__r").fillna(0, ["exit_code"])
    return Session(files, all_nodes, flags, others, totals, (tree, dependencies, flags, all_nodes))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], triage.SCHEMA)
