"""Unified patches against git and their own application, ignore rules against git, and packets."""

from __future__ import annotations

import json
import random
import subprocess

import pytest

from driftloom.operators import ignores, patches
from driftloom.sources import cases
from driftloom.streaming import watch


def versions(rng):
    """A text and an edit of it; either may end without a line feed."""
    lines = [rng.choice("abcdefg") + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randint(0, 30))]
    before = "".join(lines)
    for _ in range(rng.randint(0, 5)):
        if lines and rng.random() < 0.5:
            lines.pop(rng.randrange(len(lines)))
        else:
            lines.insert(rng.randint(0, len(lines)), rng.choice("abcdxyz") + "\n")
    cut = lambda t: t[: rng.randint(max(0, len(t) - 1), len(t))]
    return cut(before), cut("".join(lines))


def test_a_patch_of_before_gives_after():
    rng = random.Random(6)
    for _ in range(1500):
        before, after = versions(rng)
        for b, a in ((before, after), (None, after), (before, None)):
            patch = patches.unified("d/x y.txt", b, a, rng.choice([0, 1, 3]))
            assert patches.applied(b, patch) == a, (b, a, patch)
    with pytest.raises(patches.Misfit):
        patches.applied("a\nb\n", patches.unified("x", "a\nc\n", "a\n"))


def test_git_takes_the_patches(tmp_path):
    rng, seen = random.Random(7), 0
    for _ in range(120):
        before, after = versions(rng)
        patch = patches.unified("f.txt", before, after)
        if not patch:
            continue
        (tmp_path / "f.txt").write_bytes(before.encode())
        done = subprocess.run(["git", "apply", "-"], input=patch.encode(), cwd=tmp_path, capture_output=True, check=False)
        assert done.returncode == 0 and (tmp_path / "f.txt").read_bytes() == after.encode(), (before, after, patch, done.stderr)
        seen += 1
    assert seen > 60


def test_heads_and_hunks():
    assert patches.unified("n.txt", None, "a\nb") == "diff --git a/n.txt b/n.txt\nnew file mode 100644\n--- /dev/null\n+++ b/n.txt\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\n"
    assert patches.unified("n.txt", "a\n", None).endswith("--- a/n.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n")
    text = "".join(f"{k}\n" for k in range(30))
    heads = [x for x in patches.unified("n", text, text.replace("\n5\n", "\nfive\n").replace("\n12\n", "\ntwelve\n").replace("\n25\n", "\n")).split("\n") if x.startswith("@@")]
    assert heads == ["@@ -3,14 +3,14 @@", "@@ -23,7 +23,6 @@"]
    assert patches.unified("n", "a", "a") == "" and patches.unified("n", None, "") == "diff --git a/n b/n\nnew file mode 100644\n"
    assert '"a/t\\tab"' in patches.unified("t\tab", "a\n", "b\n")


def test_patches_of_tables(spark):
    rows = spark.createDataFrame([(1, "a", "x\n", "y\n"), (2, "b", None, "é"), (3, "c", "z", None), (4, "d", "s", "s"), (5, "e", None, None)], "id int, path string, before string, after string")
    out = patches.with_applied(patches.with_patch(rows)).orderBy("id").collect()
    assert [r["applied"] for r in out] == ["y\n", "é", None, "s", None] and [bool(r["patch"]) for r in out] == [True, True, True, False, False]


PATTERNS = ("*.log", "!a.log", "build/", "/top", "docs/*.txt", "**/deep", "a/**/b", "x/**", "!x/keep", "foo?", "[ab]*.t", "[!a]c", "# no", "", "sp\\ ", "tail  ", "\\#h", "\\!n", "a*b", "*/mid", "**", "!*/", "d[", "q\\", "***", "a**b", "/", "e/", "!e/f")
NAMES = ("a", "b", "c", "ac", "bc", "a.log", "b.log", "build", "top", "docs", "r.txt", "deep", "x", "keep", "food", "foo", "a.t", "b.t", "sp ", "tail", "#h", "!n", "axb", "mid", "e", "f", "q")


@pytest.mark.parametrize("seed", range(4))
def test_ignore_rules_are_those_of_git(spark, tmp_path, seed):
    rng = random.Random(seed)
    files, expected = [], []
    for k in range(6):
        root = tmp_path / f"r{k}"
        root.mkdir()
        subprocess.run(["git", "init", "-q", str(root)], check=True, capture_output=True)
        paths = {"/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4))) for _ in range(40)}
        folders = {"", *("/".join(p.split("/")[:n]) + "/" for p in paths for n in range(1, len(p.split("/"))))}
        paths -= {f[:-1] for f in folders}
        for folder in ["", *rng.sample(sorted(folders), min(3, len(folders)))]:
            text = "\n".join(rng.choice(PATTERNS) for _ in range(rng.randint(1, 6))) + "\n"
            if folder:
                (root / folder).mkdir(parents=True, exist_ok=True)
            (root / folder / ".gitignore").write_text(text)
            files = [f for f in files if f[:2] != (f"r{k}", f"{folder}.gitignore")] + [(f"r{k}", f"{folder}.gitignore", text)]
        for p in paths:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text("x")
        done = subprocess.run(["git", "-C", str(root), "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(sorted(paths)).encode() + b"\0", capture_output=True, check=False)
        ignored = set(done.stdout.decode().split("\0"))
        expected += [(f"r{k}", p, p in ignored) for p in paths]
    rules = ignores.rule_files(spark.createDataFrame(files, "repo string, path string, content string"))
    asked = spark.createDataFrame([x[:2] for x in expected], "repo string, path string")
    got = {(r["repo"], r["path"]): r["ignored"] for r in ignores.with_ignored(asked, rules).collect()}
    wrong = [(r, p, want) for r, p, want in expected if got[r, p] != want]
    assert not wrong, (wrong[:3], [f for f in files if f[0] == wrong[0][0]])
    assert len(set(got.values())) == 2


def test_ignored_and_untracked_paths_leave_the_state(spark, tmp_path):
    state = watch.KeyedState(spark, f"file://{tmp_path}/state", "path string, at long, repo string, gone boolean", "path", ["at"], "gone")
    state.merge(spark.createDataFrame([(p, 1, "r", False) for p in ("a.ts", "out/b.ts", "out/kept.ts", "c.log", None)], "path string, at long, repo string, gone boolean"), 0)
    rules = ignores.rule_files(spark.createDataFrame([("r", ".gitignore", "out/\n*.log\n"), ("r", "x.txt", "*")], "repo string, path string, content string"))
    tracked = spark.createDataFrame([("r", "out/kept.ts"), ("other", "c.log")], "repo string, path string")
    state.drop(ignores.left_out(state.rows().select("repo", "path"), rules, tracked))
    assert {r["path"] for r in state.live().collect()} == {"a.ts", "out/kept.ts", None}


def test_packets_have_a_report_and_a_patch(spark, tmp_path):
    rows = [{"case_id": "one", "title": "T", "before": {"x.ts": "const a = 1;\n"}, "after": {"x.ts": "const a = 1;\neval(q);\n", "y.md": "new\n"}, "decision": "block"}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    cases.write_packets(cases.read_cases(spark, str(tmp_path / "c.json")), str(tmp_path / "packets"), "What is wrong?")
    parts = {r["name"]: r["value"] for r in spark.read.text(str(tmp_path / "packets"), wholetext=True).select("name", "value").collect()}
    assert set(parts) == {"prompt", "report", "patch", "metadata"}
    assert "What is wrong?" in parts["prompt"] and "Dynamic code execution" in parts["report"] and "block" not in "".join(parts.values())
    assert json.loads(parts["metadata"]) == {"case_id": "one", "title": "T"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.ts").write_text("const a = 1;\n")
    subprocess.run(["git", "apply", "-"], input=parts["patch"].encode(), cwd=tmp_path / "t", check=True, capture_output=True)
    assert (tmp_path / "t" / "x.ts").read_text() == "const a = 1;\neval(q);\n" and (tmp_path / "t" / "y.md").read_text() == "new\n"
