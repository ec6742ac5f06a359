"""What a reviewer does to a repository, each as one step: analysis, marks, and the state file that keeps them.

Approval pins the trust point to HEAD, finds the baseline that follows from it, analyses against that if it moved, and
keeps what it approves. Another baseline is found strictly, analysed against, and marks of nodes that are gone are
dropped. Nothing is saved if any of this fails.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import session, triage
from driftloom.sources import git, manifests, sinks

from . import check


def fingerprints(found: check.Session, changed: DataFrame) -> DataFrame:
    """repo, fingerprint of an analysis: its flags, the content of its files' nodes, and of the files that are not parsed."""
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "node_hash"))), lambda x: F.concat(x["node_id"], F.lit("="), x["node_hash"])), ";")
    nodes = found.nodes.where("state <> 'unchanged'").groupBy(F.col("repo").alias("__r"), F.col("path").alias("__p")).agg(F.sha2(told, 256).alias("content_hash"))
    files = found.files.join(nodes, (F.col("repo") == F.col("__r")) & (F.col("path") == F.col("__p")), "left")
    files = files.select("repo", "path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("skip_marker", F.lit("")).alias("skip_marker"))
    oid = F.coalesce(T.blob_oid(F.col("after")), F.lit("none"))
    others = found.other_files.join(changed.select("path", oid.alias("oid")), "path").select("repo", F.concat("path", F.lit("="), "oid").alias("marker"))
    return session.fingerprint(found.flags, files, others, "repo")


@dataclass
class Review:
    """A repository with its state file. ``found`` is the last analysis, against ``baseline``: (sha, spec, label)."""

    spark: SparkSession
    path: str
    state_file: str
    found: check.Session | None = None
    baseline: tuple[str | None, str, str] | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = git.repo_root(self.path)
        if self.root is None:
            raise git.BaselineError(f"{self.path} is in no repository")
        git.register(self.spark)
        rows, self.extra = sinks.load_state(self.state_file, self.root)
        self.state = sinks.state_frame(self.spark, rows)

    def _resolved(self, extra: dict, strict: bool = False) -> tuple[str | None, str, str]:
        return git.resolve_baseline(self.root, extra.get("baseline") or "head", extra.get("trustPoint"), strict=strict)

    def _analyze(self, baseline: tuple[str | None, str, str]) -> None:
        files = self.spark.read.format("git_files").option("path", self.root).option("baseline", baseline[0] or "").load()
        self.changed = files.where(~F.col("before").eqNullSafe(F.col("after"))).select("path", "before", "after").persist()
        listed = (git.git(self.root, "ls-files", "-co", "--exclude-standard", "-z") or "").split("\0")
        wanted = [p for p in listed if p.rsplit("/", 1)[-1] in manifests.LOCK_READERS or p == "package.json"]
        worktree = self.spark.createDataFrame([(p, git.worktree_content(self.root, p)) for p in wanted], "path string, content string").where("content IS NOT NULL")
        if self.found:
            self.found.close()
        self.found, self.baseline = check.analyze(self.changed, worktree, self.state, self.root), baseline

    def analyze(self) -> check.Session:
        """The analysis against the baseline that the state names, or HEAD if that cannot be found."""
        self._analyze(self._resolved(self.extra))
        return self.found

    def _save(self, state: DataFrame, extra: dict) -> None:
        """Keeps marks and settings of this repository: as many rows as a reviewer made."""
        rows = [tuple(r) for r in state.where(F.col("repo") == self.root).collect()]
        sinks.save_state(self.state_file, self.root, rows, {k: v for k, v in extra.items() if v})
        self.state, self.extra = sinks.state_frame(self.spark, rows), dict(extra)

    def _found(self) -> check.Session:
        return self.found or self.analyze()

    def fingerprint(self) -> str:
        """The fingerprint of what has changed; where nothing has, that of three empty lists."""
        self._found()
        row = fingerprints(self.found, self.changed).first()
        return row["fingerprint"] if row else hashlib.md5(b"||").hexdigest()

    def approved(self) -> bool:
        """Whether what is approved is what is there now."""
        return bool(self.extra.get("approvedFingerprint")) and self.fingerprint() == self.extra["approvedFingerprint"]

    def approve(self, at: str) -> None:
        self._found()
        extra = self.extra | {"trustPoint": git.head_sha(self.root) or self.extra.get("trustPoint")}
        baseline = self._resolved(extra)
        if baseline != self.baseline:
            self._analyze(baseline)
        extra |= {"approvedFingerprint": self.fingerprint(), "approvedAt": at}
        self._save(triage.review_all(self.state, self.found.nodes, self.root), extra)

    def revoke(self) -> None:
        """No approval any more; the trust point and the baseline stay."""
        self._save(self.state, {k: v for k, v in self.extra.items() if k not in ("approvedFingerprint", "approvedAt")})

    def set_baseline(self, spec: str) -> None:
        """Compares with another baseline from now on. It is an error if it cannot be found, and nothing changes then."""
        extra = self.extra | {"baseline": None if spec.strip() in ("", "head") else spec.strip()}
        self._analyze(self._resolved(extra, strict=True))
        self._save(triage.prune_reviewed(self.state, self.found.nodes.where("state <> 'unchanged'")), extra)

    def dismiss(self, flag_ids: list[str]) -> None:
        self._save(triage.dismiss(self.state, self._found().flags, flag_ids), self.extra)

    def dismiss_all(self) -> None:
        self._save(triage.dismiss_all(self.state, self._found().flags), self.extra)

    def restore(self, flag_ids: list[str]) -> None:
        self._save(triage.restore(self.state, self.root, flag_ids), self.extra)

    def review(self, node_ids: list[str]) -> None:
        self._save(triage.review(self.state, self._found().nodes, node_ids), self.extra)

    def unreview(self, node_ids: list[str]) -> None:
        self._save(triage.unreview(self.state, self.root, node_ids), self.extra)
