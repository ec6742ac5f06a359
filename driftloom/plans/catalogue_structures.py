"""Queries of structural search: whole documents as the arguments of calls, and rules on sources of very long parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import nodes, rules, structures
from driftloom.sources import tree

from .catalogue import _read, query

_FAMILY = "CASE lang WHEN 'de' THEN 'python' WHEN 'fr' THEN 'rust' WHEN 'es' THEN 'go' ELSE 'jsts' END"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, family, text: each document's words, four by four, as calls within the arguments of one call."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))
    four = F.expr("transform(sequence(0, size(w) div 4), g -> concat('x', get(w, g * 4), '(a.x', get(w, g * 4 + 1), '(x', get(w, g * 4 + 2), ', \"x', get(w, g * 4 + 3), '(q)\"), 1)'))")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.expr(_FAMILY).alias("family"), words.alias("w"))
    return docs.select("doc_id", "family", F.concat(F.lit("root("), F.array_join(F.array_compact(four), ", "), F.lit(")")).alias("text"))


#: The names that are called in those texts, in order.
_CALLED = """words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]+') AS w FROM documents
), called AS (
  SELECT doc_id, ['root'] || flatten(list_transform(range(0, len(w) // 4), lambda g: ['x' || w[g * 4 + 1], 'x' || w[g * 4 + 2]])) AS names FROM words
)"""


@query(f"WITH {_CALLED} SELECT doc_id, len(names)::BIGINT AS n, md5(array_to_string(names, ' ')) AS names FROM called")
def structural_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structures.with_captures(_calls(spark, sf_dir), tree.CALLEES, "callee", column="names")
    return found.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", " ").cast("binary")).alias("names"))


@query(f"WITH {_CALLED} SELECT name, count(*) AS n, min(place)::BIGINT AS first FROM (SELECT unnest(names) AS name, unnest(range(len(names))) AS place FROM called) GROUP BY 1")
def structural_capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structures.capture_rows(_calls(spark, sf_dir), tree.CALLEES, "callee")
    return rows.groupBy(F.col("captured").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("place").cast("long").alias("first"))


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '"\\', ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
SELECT doc_id, list_contains(w, '+1') AS any_origin, len(list_filter(w, lambda x: starts_with(x, '#'))) > 0 AS unverified, len(list_filter(w, lambda x: x = 'the' OR x = 'la')) > 0 AS evaluates FROM t"""
)
def structural_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), '"\\', ""), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = _read(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    said = F.transform("w", lambda x: F.concat(F.lit('"'), F.when(x == "+1", "*").when(x == "*", "-").otherwise(x), F.lit('"')))
    value = F.when(F.exists("w", lambda x: x.startswith("#")), "false").otherwise("true")
    call = F.when(F.exists("w", lambda x: x.isin("the", "la")), "window.eval").otherwise("eval.call")
    code = F.concat(F.lit("cors({ origin: ["), F.array_join(said, ", "), F.lit("], tls: { 'rejectUnauthorized': "), value, F.lit(" } });\n"), call, F.lit("(x) // eval(x)"))
    found = structures.with_hits(docs.select("doc_id", code.alias("text"), F.lit("jsts").alias("family")), tree.STRUCTURES["jsts"])
    has = lambda name: F.array_contains("hits", name)
    return found.select("doc_id", has("any-origin").alias("any_origin"), has("unverified-tls").alias("unverified"), has("eval").alias("evaluates"))


def _long(between: str) -> Column:
    """Some 100,000 characters of names made from a supplier's."""
    return F.regexp_replace(F.repeat(F.md5(F.col("s_name").cast("binary")), 2400), "(.{8})", "v$1" + between)


#: Kinds of sources by the supplier's key: ending, before and after with @ for the long part, what stands between its names, and the rule that speaks.
LONG = (
    (".ts", "export function f() {\n  if (ok(x)) { pay<@B>(x); }\n}\n", "export function f() {\n  pay<@B>(x);\n}\n", ", ", "guard-removed"),
    (".py", "class A:\n    def f(self):\n        if (@) and ok:\n            pay(1)\n", "class A:\n    def f(self):\n        pay(1)\n", " or ", "guard-removed"),
    (".ts", 'export const app = cors({ a: [@], origin: ["https://a.b"] });\n', 'export const app = cors({ a: [@], origin: ["https://a.b", "*"] });\n', ", ", "broadened-cors"),
    (".java", "@Note({@})\nclass A { void f() { log(1); } }\n", "@Note({@})\nclass A { void f() { if (false) { log(1); } } }\n", ", ", "removed-if-guard"),
    (".kt", "@Note(@)\nclass A { fun f() = db.query(escape(x)) }\n", "@Note(@)\nclass A { fun f() = db.query(x) }\n", ", ", "removed-sanitize"),
    (".cs", "[Note(@)]\nclass A { void F() { try { Pay(1); } catch (E e) { Log(e); } } }\n", "[Note(@)]\nclass A { void F() { Pay(1); } }\n", ", ", "removed-try-catch"),
    (".rs", "impl A {\n    fn f() { let r = Vec::<(@)>::new(); pay(r)?; }\n}\n", "impl A {\n    fn f() { let r = Vec::<(@)>::new(); pay(r).unwrap(); }\n}\n", ", ", "removed-try-catch"),
    (".swift", "class A { func f() { if ok(@) { pay(1) } } }\n", "class A { func f() { pay(1) } }\n", ", ", "guard-removed"),
)


def _long_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = after = ending = F.lit(None).cast("string")
    kind = F.col("s_suppkey") % len(LONG)
    for k, (end, b, a, between, _) in enumerate(LONG):
        ending = F.when(kind == k, end).otherwise(ending)
        before = F.when(kind == k, _filled(b, _long(between))).otherwise(before)
        after = F.when(kind == k, _filled(a, _long(between))).otherwise(after)
    path = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), ending)
    return _read(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"), before.alias("before"), after.alias("after"))


def _filled(text: str, part: Column) -> Column:
    return F.concat(*[x for k, piece in enumerate(text.replace("@Note", "\0").split("@")) for x in ([part] if k else []) + [F.lit(piece.replace("\0", "@Note"))]])


_RULE = f"CASE s_suppkey % {len(LONG)} " + " ".join(f"WHEN {k} THEN '{rule}'" for k, (*_, rule) in enumerate(LONG)) + " END"


@query(f"SELECT s_suppkey, {_RULE} AS rule FROM supplier")
def rules_on_long_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _long_sources(spark, sf_dir)
    flags = rules.flags(nodes.drift_nodes(sources).withColumn("declared", F.array().cast("array<string>")))
    return flags.select(F.col("path").alias("at"), "rule").join(sources.select("s_suppkey", "path"), F.col("at") == F.col("path")).select("s_suppkey", "rule")
