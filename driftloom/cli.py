"""``python -m driftloom.cli check [path] [--json | --md] [--baseline SPEC] [--state FILE]``: the exit code is the worst active flag's.

With a state file, a reviewer's steps: ``approve``, ``revoke``, ``baseline --to SPEC``, ``dismiss --id ID ...``, ``dismiss-all``,
``restore --id ID ...``, ``review --id ID ...`` and ``unreview --id ID ...``; they exit with 0.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftloom.plans import check, review
from driftloom.sources import git, manifests, sinks

USAGE = 64
#: What a reviewer does, by its command: of the review, what was asked, and the time.
STEPS = {
    "approve": lambda step, _, now: step.approve(now),
    "revoke": lambda step, *_: step.revoke(),
    "baseline": lambda step, asked, _: step.set_baseline(asked.to),
    "dismiss": lambda step, asked, _: step.dismiss(asked.id),
    "dismiss-all": lambda step, *_: step.dismiss_all(),
    "restore": lambda step, asked, _: step.restore(asked.id),
    "review": lambda step, asked, _: step.review(asked.id),
    "unreview": lambda step, asked, _: step.unreview(asked.id),
}


def run(spark: SparkSession, path: str, baseline: str | None = None, state_file: str | None = None) -> tuple[check.Session, dict]:
    root = git.repo_root(path)
    if root is None:
        raise git.BaselineError(f"{path} is in no repository")
    rows, extra = sinks.load_state(state_file, root) if state_file else ([], {})
    spec = baseline or extra.get("baseline") or "head"
    sha, spec, label = git.resolve_baseline(root, spec, extra.get("trustPoint"), strict=baseline is not None)
    git.register(spark)
    files = spark.read.format("git_files").option("path", root).option("baseline", sha or "").load()
    changed = files.where(~F.col("before").eqNullSafe(F.col("after"))).select("path", "before", "after")
    wanted = [p for p in (git.git(root, "ls-files", "-co", "--exclude-standard", "-z") or "").split("\0") if p.rsplit("/", 1)[-1] in manifests.LOCK_READERS or p == "package.json"]
    worktree = spark.createDataFrame([(p, git.worktree_content(root, p)) for p in wanted], "path string, content string").where("content IS NOT NULL")
    found = check.analyze(changed, worktree, sinks.state_frame(spark, rows), root)
    return found, {"project": git.project_name(root), "branch": git.current_branch(root), "baseline": label, "path": root}


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="driftloom", exit_on_error=False)
    parser.add_argument("command", choices=["check", *STEPS])
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--md", action="store_true")
    parser.add_argument("--baseline")
    parser.add_argument("--state")
    parser.add_argument("--to", default="head")
    parser.add_argument("--id", nargs="+", default=[])
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    try:
        asked = parser.parse_args(args)
        spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
        if asked.command in STEPS:
            if not asked.state:
                raise git.BaselineError("a step needs --state")
            STEPS[asked.command](review.Review(spark, asked.path, asked.state), asked, now)
            return 0
        found, head = run(spark, asked.path, asked.baseline, asked.state)
    except (argparse.ArgumentError, SystemExit, git.BaselineError) as e:
        print(e, file=sys.stderr)
        return USAGE
    doc = sinks.to_dict(found, head)
    if asked.md:
        print(sinks.markdown_report(found, head, now))
    else:
        print(sinks.json_report(found, head))
    return doc["session"]["exit_code"]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
