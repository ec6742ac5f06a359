"""Review state: dismissals, reviewed nodes, approval. State is a table (repo, kind, id, hash); kinds: dismissed, reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "repo string, kind string, id string, hash string"


def _marks(state: DataFrame, kind: str, flag: str) -> DataFrame:
    return state.where(F.col("kind") == kind).select(F.col("repo").alias("__repo"), F.col("id").alias("__id"), F.col("hash").alias("__hash")).withColumn(flag, F.lit(True))


def with_dismissed(flags: DataFrame, state: DataFrame, flag_id: str = "flag_id", node_hash: str = "node_hash", repo: str = "repo") -> DataFrame:
    """flags with ``dismissed``: a dismissal holds while the node's content is what it was then."""
    marks = _marks(state, "dismissed", "__d")
    on = (F.col(flag_id) == F.col("__id")) & (F.col(repo) == F.col("__repo")) & (F.col("__hash") == F.col(node_hash)) & (F.col("__hash") != "")
    return flags.join(marks, on, "left").withColumn("dismissed", F.col("__d").isNotNull()).drop("__repo", "__id", "__hash", "__d")


def with_reviewed(nodes: DataFrame, state: DataFrame, node_id: str = "node_id", node_hash: str = "node_hash", repo: str = "repo") -> DataFrame:
    """nodes with ``reviewed``: only changed nodes count, and only with the content that was reviewed."""
    marks = _marks(state, "reviewed", "__r")
    on = (F.col(node_id) == F.col("__id")) & (F.col(repo) == F.col("__repo")) & (F.col("__hash") == F.col(node_hash))
    return nodes.join(marks, on, "left").withColumn("reviewed", F.col("__r").isNotNull() & (F.col("state") != "unchanged")).drop("__repo", "__id", "__hash", "__r")


def prune_reviewed(state: DataFrame, live_nodes: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Drops review marks of nodes that are gone."""
    live = live_nodes.select(F.col(node_id).alias("id")).distinct()
    return state.where("kind <> 'reviewed'").unionByName(state.where("kind = 'reviewed'").join(live, "id", "left_semi").select(*state.columns))


def adopt_legacy(state: DataFrame, flags: DataFrame, flag_id: str = "flag_id", node_hash: str = "node_hash") -> DataFrame:
    """Dismissals without a hash take that of the node which has their flag now."""
    now = flags.groupBy(F.col(flag_id).alias("__id")).agg(F.first(node_hash).alias("__hash"))
    out = state.join(now, (F.col("id") == F.col("__id")) & (F.col("kind") == "dismissed") & (F.col("hash") == ""), "left")
    return out.withColumn("hash", F.coalesce("__hash", "hash")).select(*state.columns)


def put(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State with rows added, in place of those of equal (repo, kind, id)."""
    keys = ["repo", "kind", "id"]
    return state.join(rows.select(*keys), keys, "left_anti").select(*state.columns).unionByName(rows.select(*state.columns))


def drop(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.join(rows.select("repo", "kind", "id"), ["repo", "kind", "id"], "left_anti").select(*state.columns)


def dismiss(state: DataFrame, flags: DataFrame, flag_ids: list[str]) -> DataFrame:
    """Dismisses flags by id; ids that no flag has change nothing."""
    rows = flags.where(F.col("flag_id").isin(flag_ids)).select("repo", F.lit("dismissed").alias("kind"), F.col("flag_id").alias("id"), F.col("node_hash").alias("hash"))
    return put(state, rows.distinct())


def dismiss_all(state: DataFrame, flags: DataFrame) -> DataFrame:
    rows = flags.select("repo", F.lit("dismissed").alias("kind"), F.col("flag_id").alias("id"), F.col("node_hash").alias("hash"))
    return put(state, rows.distinct())


def restore(state: DataFrame, repo: str, flag_ids: list[str]) -> DataFrame:
    return state.where(~((F.col("repo") == repo) & (F.col("kind") == "dismissed") & F.col("id").isin(flag_ids)))


def review(state: DataFrame, nodes: DataFrame, node_ids: list[str]) -> DataFrame:
    rows = nodes.where(F.col("node_id").isin(node_ids) & (F.col("state") != "unchanged"))
    return put(state, rows.select("repo", F.lit("reviewed").alias("kind"), F.col("node_id").alias("id"), F.col("node_hash").alias("hash")).distinct())


def unreview(state: DataFrame, repo: str, node_ids: list[str]) -> DataFrame:
    return state.where(~((F.col("repo") == repo) & (F.col("kind") == "reviewed") & F.col("id").isin(node_ids)))


def review_all(state: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """What approval does to marks: all changed nodes of the repository are reviewed, and nothing else is."""
    rows = nodes.where((F.col("state") != "unchanged") & (F.col("repo") == repo))
    kept = state.where(~((F.col("repo") == repo) & (F.col("kind") == "reviewed")))
    return kept.unionByName(rows.select("repo", F.lit("reviewed").alias("kind"), F.col("node_id").alias("id"), F.col("node_hash").alias("hash")).distinct())


def approval(state_approval: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """repo, approved, approved_at: an approval holds while the fingerprint is the approved one."""
    now = fingerprints.select(F.col("repo").alias("__repo"), F.col("fingerprint").alias("__now"))
    out = state_approval.join(now, F.col("repo") == F.col("__repo"), "left")
    out = out.withColumn("approved", F.coalesce(F.col("approved_fingerprint") == F.col("__now"), F.lit(False)))
    return out.select("repo", "approved", F.when(F.col("approved"), F.col("approved_at")).alias("approved_at"))


#: One row for each repository: what was approved and when, the trust point, and the baseline that is compared with.
APPROVALS = "repo string, approved_fingerprint string, approved_at string, trust_point string, baseline string"


def approve(state: DataFrame, approvals: DataFrame, nodes: DataFrame, fingerprints: DataFrame, repo: str, head: str | None, at: str) -> tuple[DataFrame, DataFrame]:
    """(state, approvals) after a repository's whole drift was approved.

    head is the commit that becomes the trust point. nodes and fingerprints are to be those of the analysis against
    the baseline that follows from it: else the approval would not hold for what it approves.
    """
    own = F.col("repo") == repo
    now = fingerprints.where(own).select(F.col("repo").alias("of"), F.col("fingerprint"))
    rows = approvals.where(own).unionByName(state.sparkSession.createDataFrame([(repo, None, None, None, None)], APPROVALS)).groupBy("repo").agg(F.max("trust_point").alias("trust_point"), F.max("baseline").alias("baseline"))
    rows = rows.join(now, F.col("repo") == F.col("of"), "left")
    point = F.coalesce(F.lit(head).cast("string"), F.col("trust_point"))
    rows = rows.select("repo", F.col("fingerprint").alias("approved_fingerprint"), F.lit(at).alias("approved_at"), point.alias("trust_point"), "baseline")
    return review_all(state, nodes, repo), approvals.where(~own).unionByName(rows)


def revoke(approvals: DataFrame, repo: str) -> DataFrame:
    """Approvals without the repository's; its trust point and baseline stay."""
    own, none = F.col("repo") == repo, F.lit(None).cast("string")
    return approvals.withColumns({c: F.when(own, none).otherwise(F.col(c)) for c in ("approved_fingerprint", "approved_at")})


def set_baseline(state: DataFrame, approvals: DataFrame, live_nodes: DataFrame, repo: str, spec: str) -> tuple[DataFrame, DataFrame]:
    """(state, approvals) with another baseline for a repository; head is kept as none. live_nodes: of the analysis against it."""
    wanted = None if spec.strip() in ("", "head") else spec
    own = F.col("repo") == repo
    others, mine = state.where(~own), state.where(own)
    out = approvals.withColumn("baseline", F.when(own, F.lit(wanted).cast("string")).otherwise(F.col("baseline")))
    return others.unionByName(prune_reviewed(mine, live_nodes.where(own))), out
