from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from driftloom.operators import evalkit
from driftloom.plans import replay
from driftloom.sources import cases, sinks
from driftloom.streaming import watch

CASES = [
    {"case_id": "a-case", "title": "A", "before": {"x.ts": "a\r\nb", "y.ts": "same"}, "after": {"x.ts": "a\nc", "y.ts": "same", "z.ts": "new"}, "decision": "block"},
    {"case_id": "Bad", "title": "B", "before": {}, "after": {}, "decision": "perhaps"},
]


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, CASES)))
    rows = cases.read_cases(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in cases.case_files(rows).collect()} == {("a-case", "x.ts", "modified", "a\nb", "a\nc"), ("a-case", "z.ts", "added", None, "new")}
    assert [tuple(r) for r in cases.invalid_cases(rows).collect()] == [("Bad", "bad id")]
    assert cases.read_cases(spark, str(tmp_path / "c.json"), ["a-case"]).count() == 1
    cases.write_packets(rows.where("case_id = 'a-case'"), str(tmp_path / "packets"), "What is wrong?")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "packets" / "case_id=a-case")).collect())
    assert "- b" in text and "+ c" in text and "block" not in text


def test_answers(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"case_id": "a", "evaluator": "m", "kind": "robot", "external": True, "findings": [{"text": "x", "severity": "high", "file": "f"}]}))
    row = cases.read_answers(spark, [str(tmp_path)]).first()
    assert (row["kind"], row["external"], row["findings"][0]["severity"]) == ("unknown", False, "high")
    matched = evalkit.match_findings(spark.createDataFrame([("a", [{"text": None, "severity": "low", "file": None, "aliases": ["x"]}], [{"text": "x", "severity": "high", "file": "f", "aliases": None}])], f"case_id string, expected array<{evalkit.ITEM}>, findings array<{evalkit.ITEM}>"))
    assert matched.first()["finding"] == 0


def test_replay(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"label": "one", "path": "/nowhere"}, {"label": "none"}]}))
    targets = cases.replay_targets(str(tmp_path / "t.json"))
    assert targets == [("one", "/nowhere", "head")]
    flags, files, errors = replay.replay(spark, targets)
    assert flags.count() == files.count() == 0 and errors.first()["target"] == "one"
    flags = spark.createDataFrame([("a", "dep-added", "New dependency", "p"), ("a", "eval-call", "Dynamic code execution", "q")], replay.FLAG_SCHEMA)
    files = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], replay.FILE_SCHEMA)
    got = {r["target"]: (r["files"], r["flags"], r["flags_per_file"]) for r in replay.summary(flags, files).collect()}
    assert got == {"a": (2, 2, 1.0), "b": (1, 0, 0.0), None: (3, 2, 2 / 3)}
    assert {tuple(r) for r in replay.coverage(flags).collect()} == {("a", 1, 1)}


def test_reports_and_cards(spark, tmp_path):
    flags = spark.createDataFrame([("a", "dep-added", "New dependency", "p"), ("a", "eval-call", "Dynamic code execution", "q"), ("a", "cargo-build-script", "Build script changed", "r")], replay.FLAG_SCHEMA)
    files = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], replay.FILE_SCHEMA)
    errors = spark.createDataFrame([("c", "no repository")], "target string, error string")
    assert replay.coverage_card(flags, files) == [{"target": "a", "files": 2, "flags": 3, "code": 1, "dependency": 2}, {"target": "b", "files": 1, "flags": 0, "code": 0, "dependency": 0}]
    text = replay.report(flags, files, errors, "now")
    assert "| a | 2 | 3 | 1.50 |" in text and "| all | 3 | 3 | 1.00 |" in text and "- c: no repository" in text
    paths = sinks.write_results(str(tmp_path / "out"), {"x": "<é>"}, "# <b>")
    assert [p.rsplit(".", 1)[1] for p in paths] == ["json", "md", "html"] and "&lt;b&gt;" in (tmp_path / "out" / "latest.html").read_text()
    assert json.loads((tmp_path / "out" / "latest.json").read_text()) == {"x": "<é>"}


def test_sessions_of_batches(spark, tmp_path):
    for batch in (0, 1, 0):
        watch.emit_session(str(tmp_path), batch, {"flags": batch})
    assert json.loads((tmp_path / "latest.json").read_text()) == {"flags": 1, "batch": 1}
    state = watch.KeyedState(spark, f"file://{tmp_path}/state", "k long, at long, gone boolean", "k", ["at"], "gone")
    state.merge(spark.createDataFrame([(1, 1, False)], state.schema), 0)
    assert not state.settle(3) and state.live().count() == 1
    assert state.settle(0) and state.live().count() == 0 and state.epoch == 1


def test_buckets_hold_all_rows(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    assert evalkit.checked_buckets(rows, F.col("x"), 3).count() == 2
    with pytest.raises(ValueError):
        evalkit.checked_buckets(rows, F.col("x"), 4)
