"""The catalogue of queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import paths as P
from driftloom.functions import text as T
from driftloom.functions.scratch import written
from driftloom.operators import deps, drift, evalkit, nodes, rules, sequence, session, triage
from driftloom.sources import manifests
from driftloom.streaming import watch

from .sides import FLAGS, SIDES, changed_sides, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sides(spark, sf_dir)
    before = both.where("before IS NOT NULL").select("path", F.col("before").alias("content"))
    after = both.where("after IS NOT NULL").select("path", F.col("after").alias("content"))
    return drift.changed_files(before, after)


CHANGED = f"""WITH {SIDES}, changed AS (
  SELECT path, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS state
  FROM sides WHERE before IS DISTINCT FROM after
)"""


@query(CHANGED + " SELECT path, state, md5(before) AS before_md5, md5(after) AS after_md5 FROM changed")
def file_drift_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return _changed(spark, sf_dir).select("path", "state", md5("before"), md5("after"))


@query(
    CHANGED
    + """ SELECT split_part(path, '/', 1) AS dir, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'removed') AS removed,
  CASE WHEN count(*) = 0 THEN 'Formatting only' ELSE array_to_string(list_filter([CASE WHEN count(*) FILTER (state = 'added') > 0 THEN (count(*) FILTER (state = 'added'))::VARCHAR || ' added' END,
    CASE WHEN count(*) FILTER (state = 'modified') > 0 THEN (count(*) FILTER (state = 'modified'))::VARCHAR || ' modified' END,
    CASE WHEN count(*) FILTER (state = 'removed') > 0 THEN (count(*) FILTER (state = 'removed'))::VARCHAR || ' removed' END], lambda x: x IS NOT NULL), ' · ') END AS summary
  FROM changed GROUP BY 1"""
)
def file_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.state_counts(_changed(spark, sf_dir).withColumn("dir", F.substring_index("path", "/", 1)), ["dir"])


@query(
    CHANGED
    + r""" SELECT path, state FROM changed WHERE before IS NOT NULL AND after IS NOT NULL
  AND trim(regexp_replace(before, '\s+', ' ', 'g')) = trim(regexp_replace(after, '\s+', ' ', 'g'))"""
)
def formatting_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.with_formatting(_changed(spark, sf_dir)).where("formatting_only").select("path", "state")


@query(
    f"""WITH {SIDES} SELECT path, CASE split_part(path, '.', 2) WHEN 'ts' THEN 'ts' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' END AS lang,
  CASE split_part(path, '.', 2) WHEN 'ts' THEN 'TypeScript' WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' WHEN 'go' THEN 'Go' END AS label,
  CASE split_part(path, '.', 2) WHEN 'ts' THEN 'jsts' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' END AS family,
  split_part(path, '/', 1) || '/' AS dir, split_part(path, '/', 2) AS name, path LIKE '%/%' AS nested,
  regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS file_id, substr(regexp_replace(path, '[^A-Za-z0-9]', '_', 'g'), 1, 24) AS slug FROM sides"""
)
def path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    out = sides(spark, sf_dir).select("path", P.lang_of(path).alias("lang"))
    return out.select(
        "path", "lang", P.label_of(F.col("lang")).alias("label"), P.family_of(F.col("lang")).alias("family"), P.dir_of(path).alias("dir"), P.file_name(path).alias("name"),
        P.is_nested(path).alias("nested"), P.sanitize_id(path).alias("file_id"), P.slug(path).alias("slug"),
    )


_ROLE_PATHS = """SELECT path FROM (
  SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'src/a' || page_id || '.test.ts' WHEN 1 THEN 'tests/t' || page_id || '.py' WHEN 2 THEN 'app/FooTest.java' WHEN 3 THEN 'app/Latest.cs'
    WHEN 4 THEN 'pkg/x_test.go' WHEN 5 THEN 'pkg/test_' || page_id || '.py' WHEN 6 THEN 'build.rs' WHEN 7 THEN 'sub/Build.rs' WHEN 8 THEN 'node_modules/a/i.js' WHEN 9 THEN 'dist/x.js'
    WHEN 10 THEN 'src/.#x.ts' ELSE 'src/m' || page_id || '.ts' END AS path FROM pages)"""


@query(
    r"""SELECT path, (lower(path) LIKE '%.test.%' OR lower(path) LIKE 'tests/%' OR regexp_matches(path, '(^|/)[^/]+Tests?\.(java|cs|kt|swift)$') OR regexp_matches(lower(path), '_test\.(go|py)$|(^|/)test_[^/]*\.py$')) AS is_test,
  lower(split_part(path, '/', -1)) = 'build.rs' AS is_build_script, path LIKE 'node_modules/%' AS ignored, path LIKE 'dist/%' AS generated, path LIKE '%/.#%' AS temp FROM ("""
    + _ROLE_PATHS
    + ")"
)
def test_path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "pages").createOrReplaceTempView("pages_of_paths")
    rows = spark.sql(_ROLE_PATHS.replace("FROM pages)", "FROM pages_of_paths)"))
    path = F.col("path")
    return rows.select("path", P.is_test_path(path).alias("is_test"), P.is_build_script(path).alias("is_build_script"), P.is_always_ignored(path).alias("ignored"), P.is_generated(path).alias("generated"), P.is_temp_file(path).alias("temp"))


LINES = "lines AS (SELECT path, (i - 1)::INTEGER AS ord, l[i] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(after, chr(10)) AS l FROM sides WHERE after IS NOT NULL)))"


@query(f"WITH {SIDES}, {LINES} SELECT path, ord, md5(line) AS line_md5 FROM lines")
def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.line_nodes(sides(spark, sf_dir).where("after IS NOT NULL"), "path", "after")
    return rows.select("path", "ord", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(
    f"""WITH {SIDES}, {LINES}, n AS (
  SELECT *, substr(regexp_replace(line, '[^A-Za-z0-9]', '_', 'g'), 1, 24) AS slug, regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS file_id FROM lines
), w AS (SELECT *, row_number() OVER s - 1 AS k, count(*) OVER (PARTITION BY file_id, slug) AS c FROM n WINDOW s AS (PARTITION BY file_id, slug ORDER BY ord))
SELECT ord, file_id || ':root:Line:' || slug || CASE WHEN c > 1 THEN '#' || k ELSE '' END AS node_id FROM w"""
)
def node_ids_with_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.line_nodes(sides(spark, sf_dir).where("after IS NOT NULL"), "path", "after")
    rows = rows.select(P.sanitize_id(F.col("path")).alias("file_id"), F.lit("root").alias("parent"), F.lit("Line").alias("kind"), F.col("line").alias("name"), "ord")
    return drift.with_node_ids(rows, "file_id", "parent", "kind", "name", "ord").select("ord", "node_id")


@query(
    f"""WITH {SIDES}, l AS (SELECT path, string_split(before, chr(10)) AS b, string_split(after, chr(10)) AS a FROM sides WHERE before IS NOT NULL AND after IS NOT NULL AND before <> after)
SELECT path, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS n_new, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS n_gone,
  (len(list_filter(a, lambda x: x = a[1])) - len(list_filter(b, lambda x: x = a[1])))::BIGINT AS first_line_delta FROM l"""
)
def line_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where("before <> after").select("path", F.split("before", "\n", -1).alias("b"), F.split("after", "\n", -1).alias("a"))
    a, b = F.col("a"), F.col("b")
    first = F.get(a, F.lit(0))
    return rows.select(
        "path", F.size(drift.minus(a, b)).cast("long").alias("n_new"), F.size(drift.minus(b, a)).cast("long").alias("n_gone"), (drift.times(a, first) - drift.times(b, first)).cast("long").alias("first_line_delta")
    )


@query(None)
def line_sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where("before <> after").select("path", F.split("before", "\n", -1).alias("b"), F.split("after", "\n", -1).alias("a"))
    return sequence.sequence_join(rows, "path", "b", "a")


@query(None)
def word_lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("a"), F.split(F.reverse("text"), " ").alias("b"))
    return rows.select("item_id", sequence.lcs_length(F.col("a"), F.col("b")).cast("long").alias("lcs"))


@query(f"WITH {SIDES}, {FLAGS} SELECT path, regexp_extract(after, '[^\\n]*(?:AKIA[0-9A-Z]{{16}}|\\bsk-[A-Za-z0-9]{{16,}})[^\\n]*') AS evidence FROM rated WHERE rule = 'hardcoded-secret'")
def secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).where("rule = 'hardcoded-secret'").select("path", "evidence")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the whole registry over the whole texts of changed documents. They are written once, so that no use of them parses again."""
    changed = changed_sides(spark, sf_dir)
    tree = nodes.drift_nodes(changed).withColumn("declared", F.array().cast("array<string>"))
    found = rules.flags(tree).select(F.col("path").alias("at"), "rule", "severity", "evidence")
    own = changed.where("after IS NOT NULL").select("doc_id", "source", "path", F.md5(F.col("after").cast("binary")).alias("node_hash"))
    out = found.join(own, F.col("at") == F.col("path")).select("doc_id", "source", "path", "rule", "severity", "evidence", "node_hash")
    out = out.withColumn("flag_id", F.concat("rule", F.lit("@"), P.sanitize_id(F.col("path")))).withColumn("repo", F.lit("r"))
    return written(out, "flags")


def _triage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document of good quality has been dismissed, with the content that it has now, whatever was wrong with it."""
    good = _read(spark, sf_dir, "labels").where("quality = 1 AND doc_id % 3 = 0").select("doc_id").distinct()
    every = F.explode(F.array(*[F.lit(r.rule) for r in rules.RULES]))
    now = changed_sides(spark, sf_dir).where("after IS NOT NULL").join(good, "doc_id", "left_semi")
    rows = now.select(F.lit("r").alias("repo"), every.alias("rule"), "path", F.md5(F.col("after").cast("binary")).alias("node_hash"))
    rows = rows.withColumn("flag_id", F.concat("rule", F.lit("@"), P.sanitize_id(F.col("path"))))
    return rows.select("repo", F.lit("dismissed").alias("kind"), F.col("flag_id").alias("id"), F.col("node_hash").alias("hash"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(triage.with_dismissed(_flags(spark, sf_dir), _triage_state(spark, sf_dir)), "judged")


@query(f"WITH {SIDES}, {FLAGS} SELECT path, rule, severity FROM rated")
def first_match_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("path", "rule", "severity")


@query(f"WITH {SIDES}, {FLAGS} SELECT split_part(path, '.', 2) AS suffix, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'low') AS low FROM rated GROUP BY 1")
def rule_family_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).withColumn("suffix", F.substring_index("path", ".", -1))
    return rows.groupBy("suffix").pivot("severity", ["high", "low"]).count().na.fill(0)


@query(f"WITH {SIDES}, {FLAGS} SELECT flag_id, path, rule, dismissed FROM judged")
def dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("flag_id", "path", "rule", "dismissed")


@query(
    """WITH b AS (SELECT o_custkey, o_orderpriority AS name, max(o_orderkey) AS spec FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY ALL),
a AS (SELECT o_custkey, o_orderpriority AS name, max(o_orderkey) AS spec FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'modified' END AS state, b.spec AS before, a.spec AS after
FROM b FULL JOIN a ON b.o_custkey = a.o_custkey AND b.name = a.name WHERE b.spec IS DISTINCT FROM a.spec"""
)
def map_entry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    side = lambda w: orders.where(w).groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.max("o_orderkey").alias("spec"))
    cut = "o_orderdate < TIMESTAMP_NTZ '1995-01-01 00:00:00'"
    return drift.entry_diff(side(cut), side(f"NOT ({cut})"), ["o_custkey"], "name", "spec")


@query(
    """WITH p AS (SELECT p_brand, p_type, max(p_size)::BIGINT AS before, (max(p_size) + count(*) % 2)::BIGINT AS after FROM part GROUP BY ALL)
SELECT p_brand, p_type AS name, before, after FROM p WHERE before <> after"""
)
def version_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("long").alias("b"), (F.max("p_size") + F.count(F.lit(1)) % 2).cast("long").alias("a"))
    maps = per.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "b"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("p_type", "a"))).alias("a"))
    rows = maps.select("p_brand", F.explode(drift.map_diff(F.col("b"), F.col("a"))).alias("e"))
    return rows.where("e.state = 'modified'").select("p_brand", "e.name", "e.before", "e.after")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def lockfile_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return deps.unvouched(entries, _read(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    """WITH e AS (SELECT DISTINCT (o_custkey % 7)::VARCHAR AS manifest, o_orderpriority AS section, o_custkey::VARCHAR AS name FROM orders WHERE o_orderstatus = 'O'),
v AS (SELECT DISTINCT (c_custkey % 7)::VARCHAR AS manifest, c_custkey::VARCHAR AS name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 7 <> 3)
SELECT e.manifest, section, e.name, CASE WHEN e.manifest NOT IN (SELECT manifest FROM v) THEN 'dep-added-nolock' WHEN v.name IS NULL THEN 'dep-not-in-lockfile' ELSE 'dep-added' END AS rule,
  CASE WHEN e.manifest NOT IN (SELECT manifest FROM v) THEN 'low' WHEN v.name IS NULL THEN 'high' ELSE 'medium' END AS severity
FROM e LEFT JOIN v ON e.manifest = v.manifest AND e.name = v.name"""
)
def vouch_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = lambda c: (F.col(c) % 7).cast("string").alias("manifest")
    after = _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(manifest("o_custkey"), F.col("o_orderpriority").alias("section"), F.col("o_custkey").cast("string").alias("name"), F.lit("1").alias("spec")).distinct()
    vouched = _read(spark, sf_dir, "customer").where("c_custkey % 2 = 0 AND c_custkey % 7 <> 3").select(manifest("c_custkey"), F.col("c_custkey").cast("string").alias("name"))
    names = vouched.distinct().select(F.col("manifest").alias("of"), F.col("name").alias("known_name"))
    locked = vouched.select(F.col("manifest").alias("lock_of")).distinct()
    rows = drift.entry_diff(after.where("false"), after, ["manifest", "section"], "name", "spec")
    rows = rows.join(names, (F.col("manifest") == F.col("of")) & (F.col("name") == F.col("known_name")), "left").join(locked, F.col("manifest") == F.col("lock_of"), "left")
    rows = rows.withColumns({"ecosystem": F.lit("cargo"), "indirect": F.lit(False), "locked": F.col("lock_of").isNotNull(), "known": F.col("known_name").isNotNull()})
    return deps.dependency_findings(rows).select("manifest", "section", "name", "rule", "severity")


@query(
    """WITH t AS (SELECT s_nationkey::VARCHAR AS manifest, string_agg(s_name || '@1', ' ' ORDER BY s_suppkey) AS lock_text FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY ALL)
SELECT s.s_suppkey, s.s_name AS name, coalesce(contains(t.lock_text, s.s_name || '@'), false) AS vouched FROM supplier s LEFT JOIN t ON s.s_nationkey::VARCHAR = t.manifest"""
)
def loose_vouch(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _read(spark, sf_dir, "supplier").withColumn("manifest", F.col("s_nationkey").cast("string"))
    locks = supplier.where("s_suppkey % 2 = 0").groupBy("manifest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x["s_name"], F.lit("@1"))), " ").alias("lock_text"))
    return deps.loosely_vouched(supplier.select("s_suppkey", F.col("s_name").alias("name"), "manifest"), locks).select("s_suppkey", "name", "vouched")


@query("SELECT n_nationkey, n_name AS name, coalesce(r_name, n_name) AS vouch_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def rename_vouch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    renames = nation.join(region, F.col("n_nationkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("real_name"))
    return deps.with_vouch_names(nation.select("n_nationkey", F.col("n_name").alias("name")), renames)


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def undeclared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    return deps.undeclared(users, _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id")), "user_id")


@query(f"WITH {SIDES} SELECT l.doc_id::VARCHAR AS id, l.quality::VARCHAR AS hash FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM sides WHERE before IS DISTINCT FROM after)")
def prune_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _read(spark, sf_dir, "labels").select(F.lit("r").alias("repo"), F.lit("reviewed").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("hash"))
    live = sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after"))).select(F.col("doc_id").cast("string").alias("node_id"))
    return triage.prune_reviewed(state, live).select("id", "hash")


@query(f"WITH {SIDES} SELECT path FROM sides WHERE before IS DISTINCT FROM after AND (path LIKE '%.md' OR doc_id % 10 = 3) AND path NOT IN (SELECT path FROM sides WHERE doc_id % 10 = 0)")
def other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sides(spark, sf_dir)
    changed = both.where(~F.col("before").eqNullSafe(F.col("after"))).where(~P.is_analyzable(F.col("path")) | (F.col("doc_id") % 10 == 3)).select("path")
    return session.other_files(changed, both.where("doc_id % 10 = 0"))


@query(
    f"""WITH {SIDES}, {FLAGS} SELECT source, path, count(*) FILTER (NOT dismissed) AS risks, grouping(source, path)::BIGINT AS level FROM judged GROUP BY ROLLUP (source, path)"""
)
def file_risks_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).rollup("source", "path").agg(F.count_if(~F.col("dismissed")).alias("risks"), F.grouping_id().alias("level"))


def _files(spark: SparkSession, sf_dir: str, judged: DataFrame | None = None) -> DataFrame:
    """Changed files with their roll-ups; each file is one node, and those of good quality have been reviewed."""
    both = sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after")))
    good = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("__doc")).distinct()
    nodes = both.join(good, F.col("doc_id") == F.col("__doc"), "left").select("path", F.lit("modified").alias("state"), F.col("__doc").isNotNull().alias("reviewed"))
    files = both.select("doc_id", "source", "path", P.dir_of(F.col("path")).alias("dir"), P.file_name(F.col("path")).alias("name"))
    return session.file_rollup(files, _judged(spark, sf_dir) if judged is None else judged, nodes)


FILES = f"""WITH {SIDES}, {FLAGS}, files AS (
  SELECT s.doc_id, s.source, s.path, split_part(s.path, '/', 1) || '/' AS dir, split_part(s.path, '/', 2) AS name, coalesce(j.risks, 0) AS risks, 1::BIGINT AS changed_nodes,
    (s.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::BIGINT AS reviewed_nodes
  FROM sides s LEFT JOIN (SELECT path, count(*) FILTER (NOT dismissed) AS risks FROM judged GROUP BY 1) j ON s.path = j.path WHERE before IS DISTINCT FROM after
)"""


@query(
    FILES
    + """ SELECT source, sum(risks)::BIGINT AS risk_count, count(*) FILTER (risks > 0) AS file_count, count(*) AS changed_files, sum(changed_nodes)::BIGINT AS changed_nodes, sum(reviewed_nodes)::BIGINT AS reviewed_nodes,
  greatest(sum(changed_nodes) - sum(reviewed_nodes), 0)::BIGINT AS pending_review, any_value(x.exit_code) AS exit_code
FROM files JOIN (SELECT source, max(CASE WHEN dismissed THEN 0 WHEN severity = 'high' THEN 3 WHEN severity = 'medium' THEN 2 ELSE 1 END)::INTEGER AS exit_code FROM judged GROUP BY 1) x USING (source) GROUP BY source"""
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return session.session_totals(_files(spark, sf_dir, judged), ["source"]).join(session.exit_code(judged, ["source"]), "source")


@query(
    FILES
    + """ SELECT f.source, md5(coalesce(j.f, '') || '|' || f.p || '|' || coalesce(o.o, '')) AS fingerprint
FROM (SELECT source, string_agg(path || '=' || md5(coalesce(after, '')), ';' ORDER BY path || '=' || md5(coalesce(after, ''))) AS p FROM sides WHERE before IS DISTINCT FROM after GROUP BY 1) f
LEFT JOIN (SELECT source, string_agg(flag_id, ';' ORDER BY flag_id) AS f FROM judged GROUP BY 1) j USING (source)
LEFT JOIN (SELECT source, string_agg(path || '=' || doc_id, ';' ORDER BY path || '=' || doc_id) AS o FROM files WHERE doc_id % 10 = 3 GROUP BY 1) o USING (source)"""
)
def drift_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after")))
    files = both.select("source", "path", F.md5(F.coalesce("after", F.lit("")).cast("binary")).alias("content_hash"), F.lit("").alias("skip_marker"))
    others = both.where("doc_id % 10 = 3").select("source", F.concat("path", F.lit("="), F.col("doc_id").cast("string")).alias("marker"))
    return session.fingerprint(_judged(spark, sf_dir), files, others, "source")


@query(FILES + " SELECT path, risks, row_number() OVER (PARTITION BY source ORDER BY risks DESC, dir, name)::INTEGER AS rank FROM files")
def sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.ranked(_files(spark, sf_dir), ["source"], session.file_order()).select("path", "risks", "rank")


@query(f"WITH {SIDES}, {FLAGS} SELECT flag_id, row_number() OVER (PARTITION BY source ORDER BY dismissed, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, doc_id)::INTEGER AS rank FROM judged")
def sorted_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.ranked(_judged(spark, sf_dir).withColumn("pre_ord", F.col("doc_id")), ["source"], session.flag_order()).select("flag_id", "rank")


@query(
    f"""WITH {SIDES}, {FLAGS} SELECT source, rule, count(*) AS n, grouping(source, rule)::BIGINT AS level FROM judged GROUP BY ROLLUP (source, rule)"""
)
def flags_by_rule_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.flag_counts(_judged(spark, sf_dir), "source")


@query(
    f"""WITH {SIDES}, l AS (SELECT path, string_split(before, chr(10)) AS b, string_split(after, chr(10)) AS a FROM sides WHERE before <> after),
s AS (SELECT path, list_transform(b[:3], lambda x: '- ' || x) || CASE WHEN len(b) > 3 THEN ['- … ' || (len(b) - 3) || CASE WHEN len(b) = 4 THEN ' more line' ELSE ' more lines' END || ' (truncated)'] ELSE [] END AS b,
  list_transform(a[:3], lambda x: '+ ' || x) || CASE WHEN len(a) > 3 THEN ['+ … ' || (len(a) - 3) || CASE WHEN len(a) = 4 THEN ' more line' ELSE ' more lines' END || ' (truncated)'] ELSE [] END AS a FROM l)
SELECT path, md5(array_to_string(b || a, chr(10))) AS block_md5 FROM s"""
)
def diff_block_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where("before <> after").select("path", F.split("before", "\n", -1).alias("b"), F.split("after", "\n", -1).alias("a"))
    return rows.select("path", F.md5(drift.diff_block(F.col("b"), F.col("a"), F.lit("modified"), 3).cast("binary")).alias("block_md5"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us FROM s GROUP BY user_id, k"""
)
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = watch.debounced(_read(spark, sf_dir, "events"), "user_id", "ts", "10 minutes").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("user_id", "n", us("a").alias("first_us"), us("b").alias("last_us"))


EVENT_PATHS = """SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'signup' THEN 'package.json' WHEN 'error' THEN 'node_modules/x/a.ts' WHEN 'purchase' THEN 'docs/n' || (event_id % 5) || '.md'
  WHEN 'view' THEN 'src/f' || (event_id % 9) || '.ts' ELSE 'dist/b' || (event_id % 4) || '.css' END AS path FROM {events}"""


@query(
    "WITH e AS ("
    + EVENT_PATHS.format(events="events")
    + """), c AS (SELECT user_id, date_trunc('day', ts) AS d, path, path = 'package.json' OR path LIKE 'docs/%' AS scan FROM e WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE 'dist/%')
SELECT user_id, strftime(d, '%Y-%m-%d') AS batch, bool_or(scan) AS full_scan, CASE WHEN bool_or(scan) THEN '' ELSE array_to_string(list_sort(list_distinct(list(path))), ',') END AS paths FROM c GROUP BY ALL"""
)
def classify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "events").createOrReplaceTempView("events_of_paths")
    rows = spark.sql(EVENT_PATHS.format(events="events_of_paths")).withColumn("batch", F.date_format("ts", "yyyy-MM-dd"))
    out = watch.classify(rows, ["user_id", "batch"])
    return out.select("user_id", "batch", "full_scan", F.array_join("paths", ",").alias("paths"))


@query("SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, struct_pack(ts := ts, id := event_id)) <> 'error'")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("gone", F.col("event_type") == "error")
    return watch.latest(rows, "user_id", ["ts", "event_id"], "gone").select("user_id", "event_id", "value")


@query(SQL["upsert_latest"])
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.stream_latest(spark, sf_dir).select("user_id", "event_id", "value")


@query(
    f"""WITH {SIDES}, {FLAGS}, c AS (SELECT source AS case_id, count(*) AS expected, count(*) FILTER (NOT dismissed) AS matched, sum(CASE severity WHEN 'high' THEN 3 ELSE 1 END) AS w,
  sum(CASE WHEN NOT dismissed THEN CASE severity WHEN 'high' THEN 3 ELSE 1 END ELSE 0 END) AS mw, count(*) FILTER (dismissed AND doc_id % 2 = 0) AS fp FROM judged GROUP BY 1)
SELECT case_id, expected, matched, greatest(0, round(60 * (mw / w) + 20 * (fp = 0)::INTEGER + 20 - 5 * fp))::BIGINT AS score FROM c"""
)
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select(F.col("source").alias("case_id"), T.severity_weight(F.col("severity")).alias("weight"), (~F.col("dismissed")).alias("matched"), (F.col("dismissed") & (F.col("doc_id") % 2 == 0)).alias("false_positive"))
    per = rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("matched").alias("matched"), evalkit.weighted_recall(F.col("weight"), F.col("matched")).alias("recall"), F.count_if("false_positive").alias("fp")
    )
    score = evalkit.agent_score(F.col("recall"), (F.col("fp") == 0), F.lit(True), F.lit(1.0), F.col("fp"), F.lit(False))
    return per.select("case_id", "expected", "matched", score.alias("score"))


@query(f"WITH {SIDES}, {FLAGS} SELECT rule AS type, count(*) AS expected, count(*) FILTER (NOT dismissed) AS matched, round(count(*) FILTER (NOT dismissed) / count(*), 6) AS recall FROM judged GROUP BY 1")
def per_type_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.per_type_recall(_judged(spark, sf_dir).select(F.col("rule").alias("type"), (~F.col("dismissed")).alias("matched")))


@query(
    """WITH s AS (SELECT conv_id % 20 AS case_id, role, round(avg(length(text) % 101)) AS score FROM conversations GROUP BY ALL),
p AS (SELECT case_id, max(score) FILTER (role = 'user')::BIGINT AS "user", max(score) FILTER (role = 'assistant')::BIGINT AS assistant FROM s GROUP BY 1)
SELECT case_id, "user", assistant, CASE WHEN coalesce("user", 100) = 100 AND coalesce(assistant, 100) = 100 THEN 'clean' WHEN coalesce("user", 0) < 100 AND coalesce(assistant, 0) < 100 THEN 'product-signal' ELSE 'split' END AS agreement,
  (coalesce("user", 100) + coalesce(assistant, 100)) / 2.0 AS mean FROM p"""
)
def panel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 20).alias("case_id"), F.col("role").alias("model")).agg(F.round(F.avg(F.length("text") % 101)).cast("long").alias("score"))
    return evalkit.agreement_matrix(rows, ["user", "assistant"])


@query(
    """SELECT role AS evaluator, CASE WHEN role = 'user' THEN 'human' ELSE 'model' END AS kind, count(*) AS cases, round(avg(length(text) % 101))::BIGINT AS mean FROM conversations GROUP BY ALL"""
)
def evaluator_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("role").alias("evaluator"), F.when(F.col("role") == "user", "human").otherwise("model").alias("kind"), (F.length("text") % 101).alias("score"))
    return evalkit.evaluator_rollup(rows)


@query("SELECT conv_id AS case_id, role AS evaluator, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def duplicate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.duplicates(_read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("evaluator")), ["case_id", "evaluator"])


@query("SELECT coalesce(lang, 'other') AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.buckets(_read(spark, sf_dir, "documents"), F.coalesce("lang", F.lit("other")))


@query("SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS spec FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "spec"))


@query(f"WITH {SIDES} SELECT path, sha1('blob ' || strlen(after) || chr(0) || after) AS oid FROM sides WHERE after IS NOT NULL")
def blob_oids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).where("after IS NOT NULL").select("path", T.blob_oid(F.col("after")).alias("oid"))


@query(
    r"""SELECT doc_id, lower(trim(regexp_extract(l, '^([^=<>~! \[;@]*)', 1))) AS name, trim(split_part(l, ';', 1)) AS spec FROM (SELECT doc_id, 'Pkg' || (doc_id % 7) || '>=1.' || doc_id || ' ; extra' AS l FROM documents)"""
)
def requirement_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Pkg"), (F.col("doc_id") % 7).cast("string"), F.lit(">=1."), F.col("doc_id").cast("string"), F.lit(" ; extra  # why")).alias("l"))
    return rows.select("doc_id", T.requirement_name(F.col("l")).alias("name"), T.requirement_spec(F.col("l")).alias("spec"))


@query("SELECT source, path, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, 'm' || (doc_id % 4) AS path FROM documents)")
def union_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("source", F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("path"))
    both = docs.where("path < 'm2'").unionByName(docs.where("path >= 'm2'")).distinct()
    return both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))


@query(None)
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents parsed as sources of their suffix's language and matched as trees."""
    changed = sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after")))
    return nodes.drift_nodes(changed).select("path", "node_id", "kind", "state", "depth", "pre_ord", "node_hash")


@query(None)
def node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule registry over those nodes."""
    changed = sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after")))
    tree = nodes.drift_nodes(changed).withColumn("declared", F.array().cast("array<string>"))
    return rules.flags(tree).select("path", "flag_id", "rule", "severity", "node_path")


def _package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each region, with its nations as dependencies."""
    nation = _read(spark, sf_dir, "nation")
    per = nation.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", F.concat(F.lit("^"), F.col("n_nationkey").cast("string"))))))).alias("deps"))
    return per.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/package.json")).alias("path"), F.concat(F.lit('{"dependencies": '), "deps", F.lit("}")).alias("content"))


@query("SELECT 'r' || n_regionkey || '/package.json' AS manifest, 'dependencies' AS section, n_name AS name, '^' || n_nationkey AS spec FROM nation")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.entries(_package_files(spark, sf_dir)).select("manifest", "section", "name", "spec")


@query("SELECT 's' || (s_suppkey % 5) || '/go.sum' AS lock_path, s_name AS name FROM supplier")
def lockfile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.translate("s_name", " ", "_"), F.lit(" v1.0.0 h1:x="))
    per = _read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return manifests.locked(per.select(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("/go.sum")).alias("path"), "content"))


@query("SELECT 'r' || n_regionkey || '/package.json' AS path, CASE WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey || '/yarn.lock' END AS lock_path FROM (SELECT DISTINCT n_regionkey FROM nation)")
def nearest_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _package_files(spark, sf_dir).select("path")
    locks = files.where(F.substring("path", 2, 1).cast("int") % 2 == 0).select(F.explode(F.array(F.replace("path", F.lit("package.json"), F.lit("yarn.lock")), F.replace("path", F.lit("package.json"), F.lit("pnpm-lock.yaml")))).alias("path"))
    return deps.nearest_lockfile(files, locks)
