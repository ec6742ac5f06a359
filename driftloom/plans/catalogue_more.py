"""More of the catalogue: scalar functions, review state, scoring and report rows, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import paths as P
from driftloom.functions import text as T
from driftloom.operators import evalkit, nodes, session, triage
from driftloom.streaming import watch

from .catalogue import FILES, _files, _flags, _judged, _read, query
from .sides import FLAGS, SIDES, sides

PATTERNS = "CASE p_partkey % 6 WHEN 0 THEN '/.*/' WHEN 1 THEN '/^[a-z]{8}$/i' WHEN 2 THEN '[^]*' WHEN 3 THEN '/a{2,}/' WHEN 4 THEN '^x+' ELSE 'y\\$' END"


@query(
    f"""WITH p AS (SELECT p_partkey, {PATTERNS} AS x FROM part), b AS (SELECT p_partkey, CASE WHEN x LIKE '/%' THEN regexp_replace(substr(x, 2), '/[^/]*$', '') ELSE x END AS y FROM p)
SELECT p_partkey, y IN ('.*', '.+', '^.*$', '^.+$', '[^]*', '[^]+') AS catch_all, starts_with(y, '^') OR (y LIKE '%$' AND y NOT LIKE '%\\$') AS anchored,
  regexp_matches(y, '\\{{\\d+(,\\d+)?\\}}') AS bounded, contains(y, '*') OR contains(y, '+') OR regexp_matches(y, '\\{{\\d+,\\}}') AS unbounded FROM b"""
)
def regex_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    x = F.when(k == 0, "/.*/").when(k == 1, "/^[a-z]{8}$/i").when(k == 2, "[^]*").when(k == 3, "/a{2,}/").when(k == 4, "^x+").otherwise("y\\$")
    rows = _read(spark, sf_dir, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", T.is_catch_all(F.col("x")).alias("catch_all"), T.has_anchor(F.col("x")).alias("anchored"), T.is_bounded(F.col("x")).alias("bounded"), T.is_unbounded(F.col("x")).alias("unbounded"))


@query(
    """WITH m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '@s/p' || c_custkey || '/x' WHEN 1 THEN 'lodash/f' WHEN 2 THEN 'node:test' WHEN 3 THEN 'fs/promises' WHEN 4 THEN './local' ELSE '@/alias' END AS module FROM customer)
SELECT c_custkey, CASE WHEN module LIKE '@s/%' THEN '@s/p' || c_custkey WHEN module = '@/alias' THEN '@' ELSE split_part(module, '/', 1) END AS package, module IN ('node:test', 'fs/promises') AS core, module IN ('./local', '@/alias') AS inside FROM m"""
)
def import_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    module = F.when(k == 0, F.concat(F.lit("@s/p"), F.col("c_custkey").cast("string"), F.lit("/x"))).when(k == 1, "lodash/f").when(k == 2, "node:test").when(k == 3, "fs/promises").when(k == 4, "./local").otherwise("@/alias")
    rows = _read(spark, sf_dir, "customer").select("c_custkey", module.alias("m"))
    return rows.select("c_custkey", T.package_name(F.col("m")).alias("package"), T.is_core_module(F.col("m")).alias("core"), T.is_relative_import(F.col("m")).alias("inside"))


@query(
    """SELECT page_id, trim(regexp_replace(lower(replace(url, '\\', '/')), '[^a-z0-9/._]+', ' ', 'g')) AS canonical, length(regexp_replace(html, '\\s', '', 'g'))::BIGINT AS bare,
  CASE WHEN length(split_part(html, chr(10), 1)) > 20 THEN substr(split_part(html, chr(10), 1), 1, 20) || '…' ELSE split_part(html, chr(10), 1) END AS head FROM pages"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages")
    return rows.select("page_id", T.canonical(F.col("url")).alias("canonical"), F.length(T.strip_ws(F.col("html"))).cast("long").alias("bare"), T.snippet(F.col("html"), 20).alias("head"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'trust point @ ' || substr(md5(o_orderkey::VARCHAR), 1, 7) WHEN 2 THEN '@ ' || substr(md5(o_orderkey::VARCHAR), 1, 7) ELSE 'v1 @ ' || substr(md5(o_orderkey::VARCHAR), 1, 7) END AS label FROM orders"""
)
def baseline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha, k = F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.col("o_orderkey") % 4
    spec = F.when(k == 0, "head").when(k == 1, "trust-point").when(k == 2, F.upper(T.short_sha(sha))).otherwise("v1")
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.baseline_label(spec, F.when(k != 0, sha)).alias("label"))


@query(f"WITH {SIDES}, {FLAGS}, c AS (SELECT source, max(CASE WHEN dismissed THEN 0 WHEN severity = 'high' THEN 3 ELSE 1 END)::INTEGER AS exit_code FROM judged GROUP BY 1) SELECT source, exit_code, exit_code >= 2 AS fails FROM c")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.exit_code(_judged(spark, sf_dir), ["source"]).withColumn("fails", session.gate(F.col("exit_code"), "medium"))


@query(FILES + " SELECT 'flag' AS kind, flag_id AS id FROM judged WHERE NOT dismissed ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 2 END, path, doc_id LIMIT 1")
def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return session.default_selection(judged.withColumn("pre_ord", F.col("doc_id")), _files(spark, sf_dir, judged))


@query(f"WITH {SIDES}, {FLAGS} SELECT flag_id AS id, CASE WHEN doc_id % 2 = 0 THEN node_hash ELSE 'kept' END AS hash FROM rated")
def adopted_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    state = flags.select("repo", F.lit("dismissed").alias("kind"), F.col("flag_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("kept").alias("hash"))
    return triage.adopt_legacy(state, flags).select("id", "hash")


@query(f"WITH {SIDES}, {FLAGS} SELECT flag_id AS id, node_hash AS hash FROM rated")
def all_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    old = flags.where("doc_id % 3 = 0").select("repo", F.lit("dismissed").alias("kind"), F.col("flag_id").alias("id"), F.lit("stale").alias("hash"))
    return triage.dismiss_all(old, flags).select("id", "hash")


@query(f"WITH {SIDES} SELECT path AS id, md5(after) AS hash FROM sides WHERE before IS DISTINCT FROM after AND after IS NOT NULL")
def reviewed_by_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sides(spark, sf_dir).where("after IS NOT NULL").select(
        F.lit("r").alias("repo"), F.col("path").alias("node_id"), F.md5(F.col("after").cast("binary")).alias("node_hash"), F.when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified").alias("state")
    )
    old = tree.limit(5).select("repo", F.lit("reviewed").alias("kind"), F.lit("gone").alias("id"), F.lit("x").alias("hash"))
    return triage.review_all(old, tree, "r").select("id", "hash")


@query("SELECT 'r' || (conv_id % 9) AS repo, bool_or(turn > 2) AND max(length(text)) % 2 = 0 AS approved FROM conversations GROUP BY 1")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _read(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("r"), (F.col("conv_id") % 9).cast("string")).alias("repo")).agg(F.bool_or(F.col("turn") > 2).alias("long"), (F.max(F.length("text")) % 2 == 0).alias("even"))
    asked = per.select("repo", F.when(F.col("long"), "yes").otherwise("no").alias("approved_fingerprint"), F.lit("t").alias("approved_at"))
    return triage.approval(asked, per.select("repo", F.when(F.col("even"), "yes").otherwise("never").alias("fingerprint"))).select("repo", "approved")


@query("SELECT role AS model, round(avg(length(text) % 101))::BIGINT AS mean, min(length(text) % 101)::BIGINT AS least, max(length(text) % 101)::BIGINT AS most, (max(length(text) % 101) - min(length(text) % 101))::BIGINT AS spread FROM conversations GROUP BY 1")
def panel_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.panel_totals(_read(spark, sf_dir, "conversations").select(F.col("role").alias("model"), (F.length("text") % 101).cast("long").alias("score")))


@query("SELECT conv_id AS case_id, count(DISTINCT role) AS evaluators, bool_or(role = 'user' AND turn % 2 = 0) AS has_external_human FROM conversations GROUP BY 1")
def external_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("evaluator"), F.when(F.col("role") == "user", "human").otherwise("model").alias("kind"), (F.col("turn") % 2 == 0).alias("external"))
    return evalkit.external_coverage(rows)


@query(
    f"""WITH {SIDES}, {FLAGS}, c AS (SELECT source AS case_id, count(*) AS found, count(*) FILTER (NOT dismissed) AS wanted FROM judged GROUP BY 1)
SELECT case_id, found = wanted AS passed, CASE WHEN found <> wanted THEN 1 ELSE 0 END::BIGINT AS n_failures FROM c"""
)
def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _judged(spark, sf_dir).groupBy(F.col("source").alias("case_id")).agg(F.count(F.lit(1)).alias("actual_risk_count"), F.count_if(~F.col("dismissed")).alias("expected_risk_count"))
    fixed = {f"{s}_{c}": F.lit(1) for s in ("expected", "actual") for c in ("exit", "changed_files")} | {"missing": F.lit(0), "forbidden": F.lit(0)}
    return evalkit.oracle_check(per.withColumns(fixed)).select("case_id", "passed", F.size("failures").cast("long").alias("n_failures"))


@query("SELECT count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed, count(*) AS total FROM labels WHERE quality IS NOT NULL")
def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.suite_summary(_read(spark, sf_dir, "labels").where("quality IS NOT NULL").select((F.col("quality") == 1).alias("passed")))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '.git/HEAD' WHEN 1 THEN 'node_modules/a.ts' WHEN 2 THEN 'dist/a.css' WHEN 3 THEN 'dist/a.ts' WHEN 4 THEN 'src/.gitignore' WHEN 5 THEN 'a.ts~' ELSE 'yarn.lock' END AS path FROM events)
SELECT event_id, event_id % 7 IN (0, 3, 4, 6) AS wanted, event_id % 7 IN (0, 4, 5, 6) AS full_scan FROM e"""
)
def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    path = F.when(k == 0, ".git/HEAD").when(k == 1, "node_modules/a.ts").when(k == 2, "dist/a.css").when(k == 3, "dist/a.ts").when(k == 4, "src/.gitignore").when(k == 5, "a.ts~").otherwise("yarn.lock")
    rows = _read(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return rows.select("event_id", watch.wanted(F.col("path")).alias("wanted"), watch.needs_full_scan(F.col("path")).alias("full_scan"))


@query(f"WITH {SIDES} SELECT source, sum(strlen(after) > 2000)::BIGINT AS skipped, sum(strlen(after) <= 2000)::BIGINT AS parsed FROM sides WHERE after IS NOT NULL GROUP BY 1")
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where("after IS NOT NULL").withColumn("large", nodes.largest_side(F.lit(None).cast("string"), F.col("after")) > 2000)
    return rows.groupBy("source").agg(F.count_if("large").alias("skipped"), F.count_if(~F.col("large")).alias("parsed"))


@query("SELECT s_suppkey, s_name LIKE '%1%' AS lifecycle FROM supplier")
def lifecycle_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_name").contains("1"), "postinstall").otherwise("test")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", T.is_lifecycle(name).alias("lifecycle"))


@query(f"WITH {SIDES} SELECT path, regexp_matches(path, '\\.(ts|py|rs|go)$') AS parsed FROM sides")
def analyzable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("path", P.is_analyzable(F.col("path")).alias("parsed"))
