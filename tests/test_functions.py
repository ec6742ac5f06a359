from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import paths as P
from driftloom.functions import text as T


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*[f(F.col("x")).alias(n) for n, f in columns.items()]).collect()]


def test_languages(spark):
    got = values(spark, ["a.ts", "a.d.ts", "A.TSX", "x/y.mjs", "q.kts", "r.pyi", "s.md"], lang=P.lang_of, fam=lambda c: P.family_of(P.lang_of(c)))
    assert got == [("ts", "jsts"), (None, None), ("tsx", "jsts"), ("js", "jsts"), ("kotlin", "kotlin"), ("python", "python"), (None, None)]


def test_test_paths(spark):
    yes = ["a.test.ts", "src/x.spec.js", "a/__tests__/b.ts", "tests/a.rs", "b/fixtures/c.go", "x_test.go", "test_a.py", "d/conftest.py", "src/FooTest.java", "src/FooTests.CS", "foo.case.mjs", "w\\tests\\x.py"]
    no = ["src/Latest.cs", "src/Audit.java", "cases/a.ts", "Test.java", "contest.py", "src/testing.ts", "latest/x.go"]
    assert values(spark, yes, t=P.is_test_path) == [(True,)] * len(yes)
    assert values(spark, no, t=P.is_test_path) == [(False,)] * len(no)


def test_roles(spark):
    assert values(spark, ["build.rs", "a/Build.RS", "rebuild.rs"], b=P.is_build_script) == [(True,), (True,), (False,)]
    assert values(spark, ["a/node_modules/b.ts", "node_modules.ts", ".git/x"], b=P.is_always_ignored) == [(True,), (False,), (True,)]
    assert values(spark, ["x~", "a/.#b.ts", "4913", "b.swp", "c.ts"], b=P.is_temp_file) == [(True,), (True,), (True,), (True,), (False,)]
    assert values(spark, [".git/HEAD", ".git/refs/heads/a", ".git/config"], b=P.is_git_state) == [(True,), (True,), (False,)]


def test_path_parts(spark):
    assert values(spark, ["a/b/c.ts", "c.ts"], d=P.dir_of, n=P.file_name, s=P.sanitize_id) == [("a/b/", "c.ts", "a_b_c_ts"), ("", "c.ts", "c_ts")]


def test_patterns(spark):
    assert values(spark, ["/.*/", "/^a$/g", "[^]*", "/a{2,}/"], c=T.is_catch_all, a=T.has_anchor, b=T.is_bounded, u=T.is_unbounded) == [
        (True, False, False, True),
        (False, True, False, False),
        (True, False, False, True),
        (False, False, False, True),
    ]
    assert values(spark, [r"a\$", "a$", "^b"], a=T.has_anchor) == [(False,), (True,), (True,)]


def test_packages(spark):
    assert values(spark, ["@a/b/c", "lodash/x", "node:test", "fs/promises", "sqlite"], n=T.package_name, c=T.is_core_module) == [
        ("@a/b", False), ("lodash", False), ("node:test", True), ("fs", True), ("sqlite", False),
    ]


def test_texts(spark):
    assert values(spark, ["  a \n\t b  "], n=T.normalize, s=T.strip_ws) == [("a b", "ab")]
    assert values(spark, ["const x = 1;\nmore", "abcdefghij"], s=lambda c: T.snippet(c, 5)) == [("const…",), ("abcde…",)]
    assert values(spark, ["Flask[async]>=2 ; py # why", "# x", "-r a", "a"], n=T.requirement_name, s=T.requirement_spec)[0] == ("flask", "Flask[async]>=2")
    assert values(spark, ["# x", "-r a"], n=T.requirement_name) == [(None,), (None,)]
    counts = spark.createDataFrame([(1, 0, 2), (0, 0, 0)], "a int, m int, r int").select(T.summary(F.col("a"), F.col("m"), F.col("r")).alias("s"))
    assert [r["s"] for r in counts.collect()] == ["1 added · 2 removed", "Formatting only"]


def test_blob_oid_is_that_of_version_control(spark):
    assert values(spark, ["hello\n"], o=T.blob_oid) == [("ce013625030ba8dba906f756967f9e9ca394464a",)]
