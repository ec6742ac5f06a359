"""Scoring findings against expectations: recall, scores, agreement, roll-ups, and greedy one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"low": 1, "medium": 2, "high": 3}


def weighted_recall(weight: Column, matched: Column) -> Column:
    """The matched part of all expectations' weight; 1 where nothing is expected."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.when(matched, weight).otherwise(0)) / total).otherwise(1.0)


def agent_score(recall: Column, decision_right: Column, top_right: Column, localised: Column, false_positives: Column, benign_wrong: Column) -> Column:
    """Out of 100, rounded half up and never below 0."""
    one = lambda c: c.cast("int")
    raw = 60 * recall + 20 * one(decision_right) + 10 * one(top_right) + 10 * localised - 5 * false_positives - 50 * one(benign_wrong)
    return F.greatest(F.lit(0).cast("long"), F.round(raw).cast("long"))


def per_type_recall(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("type").agg(F.count(F.lit(1)).alias("expected"), F.count_if("matched").alias("matched"))
    return out.withColumn("recall", F.round(F.col("matched") / F.col("expected"), 6))


def agent_summary(scores: DataFrame) -> DataFrame:
    """One row: mean score, decision rate, micro precision and recall; scores: case_id, score, decision_right, expected, matched, findings."""
    return scores.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("score")).cast("long").alias("mean_score"), F.avg(F.col("decision_right").cast("int")).alias("decision_rate"),
        F.try_divide(F.sum("matched"), F.sum("findings")).alias("precision"), F.try_divide(F.sum("matched"), F.sum("expected")).alias("recall"),
    )


def suite_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count(F.lit(1)).alias("total"))


def agreement_matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    """A row for each case with each model's score; missing ones count as 100 in the mean."""
    out = scores.groupBy("case_id").pivot("model", models).agg(F.max("score"))
    full = lambda m: F.coalesce(F.col(m), F.lit(100))
    clean, poor = F.lit(True), F.lit(True)
    for m in models:
        clean, poor = clean & (full(m) == 100), poor & (F.coalesce(F.col(m), F.lit(0)) < 100)
    kind = F.when(clean, "clean").when(poor, "product-signal").otherwise("split")
    return out.withColumn("agreement", kind).withColumn("mean", sum((full(m) for m in models), F.lit(0)) / F.lit(float(len(models))))


def panel_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.round(F.avg("score")).cast("long").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most")).withColumn("spread", F.col("most") - F.col("least"))


def models_in_order(totals: DataFrame) -> DataFrame:
    """totals (model, mean) with ``place``: the best first, then by name."""
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "model")))  # a row for each model


def cases_in_order(matrix: DataFrame) -> DataFrame:
    """matrix (case_id, mean) with ``place``: the case that models found hardest first, then by name.

    A place is the number of cases with a lower mean, counted by mean, and the place among those of the same mean.
    """
    per = matrix.groupBy(F.col("mean").alias("__mean")).agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__mean").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each mean
    out = matrix.join(before, F.col("mean") == F.col("__mean"))
    within = F.row_number().over(Window.partitionBy("mean").orderBy("case_id"))
    return out.withColumn("place", (F.col("__before") + within).cast("long")).drop("__mean", "n", "__before")


def evaluator_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("evaluator", "kind").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("score")).cast("long").alias("mean"))


def external_coverage(rows: DataFrame) -> DataFrame:
    """case_id, evaluators, has_external_human; rows: case_id, evaluator, kind, external."""
    human = (F.col("kind") == "human") & F.col("external")
    return rows.groupBy("case_id").agg(F.count_distinct("evaluator").alias("evaluators"), F.bool_or(human).alias("has_external_human"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def buckets(rows: DataFrame, bucket: Column) -> DataFrame:
    out = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def checked_buckets(rows: DataFrame, bucket: Column, total: int) -> DataFrame:
    """``buckets``, after a check that they hold all of total rows."""
    out = buckets(rows, bucket)
    held = out.agg(F.sum("n")).first()[0] or 0
    if held != total:
        raise ValueError(f"buckets hold {held} of {total} rows")
    return out


def oracle_check(cases: DataFrame) -> DataFrame:
    """case_id, failures: what differs from expectations; cases: expected_* and actual_* of exit, changed_files, risk_count, and missing/forbidden counts.

    Where cases have expected_file_count and actual_file_count, an expectation that is not null is held against it.
    """
    part = lambda bad, text: F.when(bad, text)
    differs = [part(~F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}")), F.concat(F.lit(f"{c}: "), F.col(f"expected_{c}").cast("string"), F.lit(" expected, "), F.col(f"actual_{c}").cast("string"))) for c in ("exit", "changed_files", "risk_count")]
    if "expected_file_count" in cases.columns:
        wrong = F.col("expected_file_count").isNotNull() & ~F.col("expected_file_count").eqNullSafe(F.col("actual_file_count"))
        differs.append(part(wrong, F.concat(F.lit("file_count: "), F.col("expected_file_count").cast("string"), F.lit(" expected, "), F.coalesce(F.col("actual_file_count").cast("string"), F.lit("none")))))
    found = [part(F.col("missing") > 0, F.lit("required flags are missing")), part(F.col("forbidden") > 0, F.lit("forbidden flags were raised"))]
    out = cases.withColumn("failures", F.array_compact(F.array(*differs, *found)))
    return out.select("case_id", "failures", (F.size("failures") == 0).alias("passed"))


def assign(expected: list[dict], findings: list[dict]) -> list[int | None]:
    """For each expectation in order the finding that it takes: a finding is taken once, one in the expected file goes first.

    A finding fits if its text holds one of the expectation's aliases and its severity is no lower.
    """
    taken: set[int] = set()
    out: list[int | None] = []
    for e in expected:
        fits = [
            i
            for i, f in enumerate(findings)
            if i not in taken and RANK.get(f["severity"], 0) >= RANK.get(e["severity"], 0) and any(a in f["text"] for a in e["aliases"])
        ]
        best = next((i for i in fits if e["file"] and findings[i]["file"] == e["file"]), fits[0] if fits else None)
        if best is not None:
            taken.add(best)
        out.append(best)
    return out


ITEM = "struct<text:string,severity:string,file:string,aliases:array<string>>"


def match_findings(cases: DataFrame) -> DataFrame:
    """case_id, expectation, finding (null if missed) from case_id, expected and findings, arrays of ITEM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, k, x) for c, e, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for k, x in enumerate(assign(e or [], f or []))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["case_id", "expectation", "finding"])

    return cases.select(F.col("case_id").cast("string").alias("case_id"), "expected", "findings").mapInArrow(run, "case_id string, expectation int, finding int")


#: Fields of a flag, and those of an expected one: the last two ask for a part of nodePath and desc.
FLAG = ("type", "severity", "file_path", "node_path", "desc")
EXPECTED = ("type", "severity", "file_path", "node_path", "node_path_includes", "desc_includes")


def flag_fits(flag: dict, expected: dict) -> bool:
    """Whether a flag is what an expectation asks for; fields that it leaves out ask for nothing."""
    plain = lambda x: (x or "").strip().lower()
    same = lambda c, f=lambda x: x: not expected.get(c) or f(flag.get(c)) == f(expected[c])
    holds = lambda part, c: not expected.get(part) or expected[part] in (flag.get(c) or "")
    return same("type") and same("severity", plain) and same("file_path", plain) and same("node_path") and holds("node_path_includes", "node_path") and holds("desc_includes", "desc")


def assign_flags(expected: list[dict], flags: list[dict]) -> list[int | None]:
    """For each expectation in order the first fitting flag that none before it took."""
    taken: set[int] = set()
    out: list[int | None] = []
    for e in expected:
        found = next((i for i, f in enumerate(flags) if i not in taken and flag_fits(f, e)), None)
        if found is not None:
            taken.add(found)
        out.append(found)
    return out


def match_flags(cases: DataFrame) -> DataFrame:
    """case_id, expectation, flag (null if missing): places in the arrays expected (of EXPECTED) and flags (of FLAG) of each case."""
    kind = dict(cases.dtypes)["case_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, k, x) for c, e, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for k, x in enumerate(assign_flags(e or [], f or []))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.int32()), strict=True)], names=["case_id", "expectation", "flag"])

    return cases.select("case_id", "expected", "flags").mapInArrow(run, f"case_id {kind}, expectation int, flag int")


def file_failures(expected: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, failure: expected files (case_id, path, summary, risks; null asks for nothing) that are missing or differ."""
    have = files.select(F.col("case_id").alias("__case"), F.col("path").alias("__path"), F.col("summary").alias("__summary"), F.col("risks").alias("__risks"))
    rows = expected.join(have, (F.col("case_id") == F.col("__case")) & (F.col("path") == F.col("__path")), "left")
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    told = [F.when(differs(c), F.concat(F.lit(f"{c} of "), "path", F.lit(": "), F.col(c).cast("string"), F.lit(" expected, "), F.coalesce(F.col(f"__{c}").cast("string"), F.lit("none")))) for c in ("summary", "risks")]
    failures = F.when(F.col("__case").isNull(), F.array(F.concat(F.lit("no such file: "), "path"))).otherwise(F.array_compact(F.array(*told)))
    return rows.select("case_id", F.explode(failures).alias("failure"))


def top_risk_first(expected: list[dict], findings: list[dict]) -> bool:
    """Whether the first finding is one of the gravest expectations, in its file; without any, whether nothing was found."""
    if not expected:
        return not findings
    if not findings:
        return False
    weight = lambda x: RANK.get(x["severity"], 1)
    most, first = max(map(weight, expected)), findings[0]
    fits = lambda e: any(a in first["text"] for a in e["aliases"] or [""]) and weight(first) >= weight(e) and (not e["file"] or e["file"] == first["file"])
    return any(fits(e) for e in expected if weight(e) == most)


def inferred_decision(severities: Column) -> Column:
    """What a reviewer should decide, from the severities of what is expected."""
    return F.when(F.array_contains(severities, "high"), "block").when(F.size(severities) > 0, "investigate").otherwise("approve")
