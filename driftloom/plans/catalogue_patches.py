"""Queries of patches, ignore rules, and the order of manifest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import deps, ignores, patches

from .catalogue import CHANGED, _changed, _read, query


@query(CHANGED + " SELECT path, state, after IS NULL AS gone, md5(coalesce(after, '')) AS patched, state = 'added' AS opens, CASE state WHEN 'removed' THEN 0 ELSE 1 END::BIGINT AS sides FROM changed")
def unified_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed document as a patch, which is applied to what was there before."""
    made = patches.with_patch(_changed(spark, sf_dir))
    out = patches.with_applied(made)
    opens = F.col("patch").contains("\nnew file mode 100644\n--- /dev/null\n") | F.col("patch").endswith("\nnew file mode 100644\n")
    sides = F.when(F.col("patch").contains("\n+++ /dev/null\n") | F.col("patch").endswith("\ndeleted file mode 100644\n"), 0).otherwise(1).cast("long")
    return out.select("path", "state", F.col("applied").isNull().alias("gone"), F.md5(F.coalesce("applied", F.lit("")).cast("binary")).alias("patched"), opens.alias("opens"), sides.alias("sides"))


#: Rule files of each supplier's nation, and what is left out by them.
_RULES = (("", "*.log\n!keep.log\nbuild/\n/top.ts\n"), ("src/", "*.tmp\ngen/**/x.ts\n!a.tmp\n"), ("lib/", "# all\n*\n!*.ts\n"))
_FILES = ("a.log", "keep.log", "build/x.ts", "top.ts", "src/top.ts", "src/a.tmp", "src/b.tmp", "src/gen/p/q/x.ts", "src/gen/x.ts", "lib/a.js", "lib/a.ts", "lib/in/a.ts")
_LEFT_OUT = ("a.log", "build/x.ts", "top.ts", "src/b.tmp", "src/gen/p/q/x.ts", "src/gen/x.ts", "lib/a.js", "lib/in/a.ts")


@query(
    f"""WITH files AS (SELECT unnest({list(_FILES)}) AS name), leaving AS (SELECT unnest({list(_LEFT_OUT)}) AS name)
SELECT o_orderkey, 'n' || c_nationkey AS repo, name || '' AS path, name IN (SELECT name FROM leaving) AND c_nationkey % 3 <> 0 AS ignored
FROM orders JOIN customer ON o_custkey = c_custkey JOIN files ON files.name = list_extract({list(_FILES)}, (o_orderkey % {len(_FILES)} + 1)::INTEGER)"""
)
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each order, in its customer's nation's repository; every third nation has no rule files."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    names = F.array(*[F.lit(x) for x in _FILES])
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), F.element_at(names, (F.col("o_orderkey") % len(_FILES) + 1).cast("int")).alias("path"))
    nations = _read(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("repo"))
    each = F.explode(F.array(*[F.struct(F.lit(f"{folder}.gitignore").alias("path"), F.lit(text).alias("content")) for folder, text in _RULES]))
    rules = ignores.rule_files(nations.select("repo", each.alias("file")).select("repo", "file.path", "file.content"))
    return ignores.with_ignored(rows, rules).select("o_orderkey", "repo", "path", "ignored")


_SECTIONS = "['optionalDependencies', 'scripts', 'dependencies', 'peerDependencies', 'devDependencies']"


@query(
    f"""WITH e AS (SELECT 'p' || p_size || CASE WHEN p_size % 2 = 0 THEN '/package.json' ELSE '/Cargo.toml' END AS path, list_extract({_SECTIONS}, (p_partkey % 5 + 1)::INTEGER) AS section, p_name || p_partkey AS name FROM part)
SELECT path, section, name, (row_number() OVER (PARTITION BY path ORDER BY CASE WHEN path NOT LIKE '%package.json' THEN 0 ELSE list_position(['dependencies', 'devDependencies', 'peerDependencies', 'optionalDependencies', 'scripts'], section) END, section, name) - 1)::INTEGER AS place FROM e"""
)
def manifest_entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.col("p_size") % 2 == 0, "/package.json").otherwise("/Cargo.toml")
    section = F.element_at(F.expr(f"array({_SECTIONS[1:-1]})"), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_size").cast("string"), file).alias("path"), section.alias("section"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return deps.ordered(rows, section="section").select("path", "section", "name", F.col("pre_ord").alias("place"))
