"""Snapshots of a repository: changed paths, contents on both sides, and the revisions that name a baseline.

The data source ``git_files`` lists the paths that differ between a baseline and the working tree on the driver, and reads
contents in tasks, unless the option ``contents`` is false.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, before_oid string, after_oid string, before_size long, after_size long, before string, after string"
# Branches that a merge base is looked for on, and the size from which files are listed but not parsed.
DEFAULT_BRANCHES = ("main", "master", "origin/main", "origin/master")
PARSE_CAP = 2 * 1024 * 1024


def git(root: str, *args: str, text: bool = True):  # noqa: ANN201
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if out.returncode:
        return None
    return out.stdout.decode("utf-8", "replace") if text else out.stdout


def repo_root(path: str) -> str | None:
    found = git(path, "rev-parse", "--show-toplevel")
    return found.strip() if found else None


def current_branch(root: str) -> str:
    return (git(root, "rev-parse", "--abbrev-ref", "HEAD") or "HEAD").strip()


def git_dirs(root: str) -> tuple[str | None, str | None]:
    """The metadata folder of this working tree and the one that its repository shares."""
    return tuple((git(root, "rev-parse", "--path-format=absolute", f) or "").strip() or None for f in ("--git-dir", "--git-common-dir"))  # type: ignore[return-value]


def resolve_rev(root: str, rev: str) -> str | None:
    found = git(root, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{rev}^{{commit}}")
    return found.strip() if found else None


def head_sha(root: str) -> str | None:
    return resolve_rev(root, "HEAD")


def merge_base_with_default(root: str) -> str | None:
    branch = next((b for b in DEFAULT_BRANCHES if resolve_rev(root, b)), None)
    found = git(root, "merge-base", "HEAD", branch) if branch else None
    return found.strip() if found else None


class BaselineError(ValueError):
    """A baseline was asked for by name and cannot be found."""


def resolve_baseline(root: str, spec: str = "head", trust_point: str | None = None, strict: bool = True) -> tuple[str | None, str, str]:
    """(sha, spec, label); without strict an unknown baseline falls back to HEAD."""
    try:
        if spec == "head":
            return None, spec, "HEAD"
        if spec == "trust-point":
            sha = resolve_rev(root, trust_point) if trust_point else None
            if not sha:
                raise BaselineError("no trust point has been set")
            return sha, spec, f"trust point @ {sha[:7]}"
        if spec == "merge-base":
            sha = merge_base_with_default(root)
            if not sha:
                raise BaselineError("no default branch was found")
            return sha, spec, f"merge-base @ {sha[:7]}"
        sha = resolve_rev(root, spec)
        if not sha:
            raise BaselineError(f"unknown revision: {spec}")
        named = spec.lower() in (sha, sha[:7])
        return sha, spec, f"@ {sha[:7]}" if named else f"{spec} @ {sha[:7]}"
    except BaselineError:
        if strict:
            raise
        return None, "head", "HEAD"


def changed_paths(root: str, sha: str | None = None) -> list[str]:
    """Paths that differ from the baseline in the index or the working tree, old names of renames and new files too."""
    base = sha or head_sha(root)
    out: set[str] = set()
    if base:
        for extra in ([], ["--cached"]):
            listed = git(root, "diff", "--name-only", "--no-renames", "--ignore-submodules=all", "-z", *extra, base)
            out |= set((listed or "").split("\0"))
    else:
        out |= set((git(root, "ls-files", "-z") or "").split("\0"))
    out |= set((git(root, "ls-files", "--others", "--exclude-standard", "-z") or "").split("\0"))
    return sorted(out - {""})


def is_ignored_untracked(root: str, path: str) -> bool:
    if git(root, "check-ignore", "-q", "--no-index", "--", path) is None:
        return False
    tracked = git(root, "ls-files", "--error-unmatch", "--", path) is not None
    return not tracked and git(root, "cat-file", "-e", f"HEAD:{path}") is None


def content_at(root: str, rev: str, path: str) -> str | None:
    return git(root, "cat-file", "blob", f"{rev}:{path}")


def blobs(root: str, names: list[str]) -> list[tuple[str | None, int | None]]:
    """(oid, size) of blobs by their names, without contents, from one process."""
    if not names:
        return []
    asked = "".join(f"{x}\0" for x in names).encode("utf-8", "surrogateescape")
    done = subprocess.run(["git", "-C", root, "cat-file", "-z", "--batch-check=%(objectname) %(objecttype) %(objectsize)"], input=asked, capture_output=True, check=False)
    lines = done.stdout.decode("utf-8", "replace").split("\n")
    out: list[tuple[str | None, int | None]] = []
    for line in lines[: len(names)]:
        part = line.rsplit(" ", 2)
        found = len(part) == 3 and part[1] == "blob" and part[2].isdigit()
        out.append((part[0], int(part[2])) if found else (None, None))
    return out + [(None, None)] * (len(names) - len(out))


def blob_texts(root: str, oids: list[str]) -> Iterator[str]:
    """The texts of blobs, one after the other, from one process."""
    if not oids:
        return
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
        for oid in oids:
            process.stdin.write(f"{oid}\n".encode())
            process.stdin.flush()
            size = int(process.stdout.readline().split()[2])
            data = process.stdout.read(size)
            process.stdout.read(1)
            yield data.decode("utf-8", "replace")
        process.stdin.close()


def worktree_content(root: str, path: str) -> str | None:
    """The text of a file, None if it is gone or no UTF-8."""
    try:
        return (Path(root) / path).read_bytes().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def worktree_blob(root: str, path: str) -> tuple[str | None, int | None]:
    """(oid, size), hashed as it is read."""
    try:
        at = Path(root) / path
        size = at.stat().st_size
        digest = hashlib.sha1(f"blob {size}\0".encode())
        with at.open("rb") as f:
            while data := f.read(1 << 20):
                digest.update(data)
        return digest.hexdigest(), size
    except OSError:
        return None, None


class PathRange(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.rev = options.get("baseline") or None
        self.per_task = int(options.get("filesPerTask", "64"))
        self.contents = options.get("contents", "true").lower() != "false"
        self.cap = int(options.get("parseCap", str(PARSE_CAP)))

    def partitions(self) -> list[PathRange]:
        paths = changed_paths(self.root, self.rev)
        return [PathRange(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)] or [PathRange([])]

    def read(self, partition: PathRange) -> Iterator[tuple]:
        rev = self.rev or "HEAD"
        before = blobs(self.root, [f"{rev}:{path}" for path in partition.paths])
        known = {path: (oid, size) for path, (oid, size) in zip(partition.paths, before, strict=True)}
        now = {path: worktree_blob(self.root, path) for path in partition.paths}
        changed = [path for path in partition.paths if known[path][0] != now[path][0]]
        small = {path for path in changed if self.contents and max(known[path][1] or 0, now[path][1] or 0) <= self.cap}
        texts = blob_texts(self.root, [known[path][0] for path in changed if path in small and known[path][0]])
        for path in changed:
            (before_oid, before_size), (after_oid, after_size) = known[path], now[path]
            text = next(texts) if path in small and before_oid else None
            yield path, before_oid, after_oid, before_size, after_size, text, worktree_content(self.root, path) if path in small and after_oid else None


class GitFiles(DataSource):
    """``spark.read.format("git_files").option("path", root).option("baseline", rev)``.

    Contents are read unless ``contents`` is false: columns that a query leaves out are read nevertheless. A task asks
    two git processes for all its paths.
    """

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:  # noqa: ANN001
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitFiles)


def project_name(root: str) -> str:
    return os.path.basename(os.path.normpath(root))
