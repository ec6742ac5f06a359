"""The ordered registry of differential rules over changed nodes: for each node the first rule that matches gives its flag.

Rules are column expressions over a node's two sides and the facts that the parser found; a family of languages
takes part in a rule by having what the rule looks for. All patterns are literals, chosen by family.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import paths as P
from driftloom.functions import text as T
from driftloom.sources.packs import PACKS, Pack

from .drift import minus, times

ALL = tuple(PACKS)
# Patterns of the rules that are alike for all families.
SECRETS = (r"AKIA[0-9A-Z]{16}", r"\bsk-[A-Za-z0-9]{16,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
DEFINES_SANITIZER = r"\b(?:func|fn|def|fun|void|sub)\s+(?:sanitize|escape|validate)\w*"


@dataclass(frozen=True)
class Rule:
    rule: str
    type: str
    severity: str
    states: tuple[str, ...]
    families: tuple[str, ...]
    applies: Callable[[], Column]
    describes: Callable[[], Column]
    evidence: Callable[[], Column] | None = None


def side(which: str, view: str) -> Column:
    """A view of one side: text, code (no comments, no insides of strings) or plain (no comments)."""
    return F.col(f"{which}_text") if view == "text" else F.coalesce(F.col(f"{which}_facts.{view}"), F.col(f"{which}_text"))


def fact(which: str, name: str) -> Column:
    return F.coalesce(F.col(f"{which}_facts.{name}"), F.array().cast("array<string>"))


def by_family(pick: Callable[[Pack], str | None], test: Callable[[str], Column]) -> Column:
    """test of the family's own pattern; false for families without one."""
    out = F.lit(False)
    for family, pack in PACKS.items():
        if pattern := pick(pack):
            out = F.when(F.col("family") == family, test(pattern)).otherwise(out)
    return out


def matching(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def among(values: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*values)


def new(pattern: str, view: str) -> Column:
    return side("after", view).rlike(pattern) & ~side("before", view).rlike(pattern)


def gone(pattern: str, view: str) -> Column:
    return side("before", view).rlike(pattern) & ~side("after", view).rlike(pattern)


def viewed(in_strings: Callable[[Pack], bool], pick: Callable[[Pack], str | None]) -> Column:
    """A family's new pattern, looked for with or without the insides of strings as the family has it."""
    out = F.lit(False)
    for family, pack in PACKS.items():
        if pattern := pick(pack):
            out = F.when(F.col("family") == family, new(pattern, "plain" if in_strings(pack) else "code")).otherwise(out)
    return out


def line_with(pick: Callable[[Pack], str | None], view: str) -> Column:
    out = F.lit(None).cast("string")
    for family, pack in PACKS.items():
        if pattern := pick(pack):
            first = F.get(F.filter(F.split(side("after", view), "\n", -1), matching(pattern)), F.lit(0))
            out = F.when(F.col("family") == family, F.trim(first)).otherwise(out)
    return out


def newly(structure: str) -> Column:
    """Whether the tree of the side after has a structure that the side before has not."""
    return F.array_contains(fact("after", "hits"), structure) & ~F.array_contains(fact("before", "hits"), structure)


NOT_TEST = lambda: ~F.col("is_test")
IS_JS = lambda: F.col("family") == "jsts"


def _secret_line() -> Column:
    line = F.get(F.filter(F.split(side("after", "text"), "\n", -1), lambda x: x.rlike(SECRETS[0]) | x.rlike(SECRETS[1]) | x.rlike(SECRETS[2])), F.lit(0))
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _child_process() -> Column:
    imports = viewed(lambda p: p.import_in_strings, lambda p: p.subprocess_import)
    calls = by_family(lambda p: p.subprocess_call, lambda x: new(x, "code"))
    raw = new(PACKS["jsts"].subprocess_import, "text") | new(PACKS["jsts"].subprocess_call, "text")
    return NOT_TEST() & ~F.col("is_build_script") & F.when(IS_JS(), raw).otherwise(imports | calls)


def _cookie(pick: Callable[[Pack], str | None]) -> Column:
    context = IS_JS() | T.has_cookie_token(side("before", "text"))
    return NOT_TEST() & context & by_family(pick, lambda x: F.when(IS_JS(), gone(x, "text")).otherwise(gone(x, "code")))


def _same_site() -> Column:
    out = F.lit(False)
    for family, p in PACKS.items():
        if p.same_site and p.same_site_weak:
            view = "text" if family == "jsts" else "plain" if p.same_site_in_strings else "code"
            test = side("before", view).rlike(p.same_site) & side("after", view).rlike(p.same_site_weak)
            out = F.when(F.col("family") == family, test).otherwise(out)
    return NOT_TEST() & (IS_JS() | T.has_cookie_token(side("before", "text"))) & out


def _patterns(which: str) -> Column:
    """Pattern bodies of a side: literals, or what the family's constructors are given outside comments and strings."""
    out = F.when(IS_JS(), F.transform(fact(which, "patterns"), T.regex_body))
    for family, p in PACKS.items():
        if p.compiles_regex:
            out = out.when(F.col("family") == family, fact(which, "compiled"))
    return F.coalesce(out, F.array().cast("array<string>"))


def _loose_regex() -> Column:
    before, after = _patterns("before"), _patterns("after")
    added, removed = minus(after, before), minus(before, after)
    widened = ~F.exists(before, T.is_catch_all) & F.exists(added, T.is_catch_all)
    old, now = F.get(removed, F.lit(0)), F.get(added, F.lit(0))
    weaker = T.is_catch_all(now) | (T.has_anchor(old) & ~T.has_anchor(now)) | (T.is_bounded(old) & ~T.is_bounded(now) & T.is_unbounded(now))
    edited = (F.size(removed) == 1) & (F.size(added) == 1) & weaker & ~T.is_catch_all(old)
    return (F.col("kind") == "VariableDeclaration") & (widened | F.coalesce(edited, F.lit(False)))


def _verify_to_decode() -> Column:
    verifies = lambda c: F.exists(c, lambda x: x.startswith("verify") | x.isin("sign", "signAsync", "signSync"))
    decodes = lambda c: F.exists(c, lambda x: x.startswith("decode") | x.isin("parse", "parseJwt", "parseToken"))
    b, a = fact("before", "callees"), fact("after", "callees")
    return verifies(b) & ~verifies(a) & decodes(a) & ~decodes(b)


def _false_guard(which: str) -> Column:
    out = F.lit(False)
    for family, p in PACKS.items():
        out = F.when(F.col("family") == family, F.exists(fact(which, "conditions"), among(p.falsy))).otherwise(out)
    return out


def _removed_sanitizer() -> Column:
    b, a = fact("before", "callees"), fact("after", "callees")
    dropped = F.exists(b, lambda x: T.is_sanitizer(x) & (times(a, x) < times(b, x)))
    own = F.col("kind").isin("FunctionDeclaration", "MethodDeclaration", "ExportDeclaration") & T.is_sanitizer(F.col("name")) & side("after", "text").contains(F.col("name"))
    moved = (F.col("state") == "modified") & side("after", "code").rlike(DEFINES_SANITIZER)
    return ~own & ~moved & F.when(F.col("state") == "removed", F.exists(b, T.is_sanitizer)).otherwise(dropped)


def _unguarded() -> Column:
    """The first callee that was guarded wherever it stood and is not any more."""
    guarded_b, all_b, guarded_a, all_a = fact("before", "guarded"), fact("before", "callees"), fact("after", "guarded"), fact("after", "callees")
    free = F.filter(guarded_b, lambda x: (times(guarded_b, x) >= times(all_b, x)) & (times(all_a, x) > times(guarded_a, x)))
    converted = F.coalesce(F.col("after_facts.guard_clauses") > F.col("before_facts.guard_clauses"), F.lit(False))
    return F.when(~converted, F.get(free, F.lit(0)))


def _survivor() -> Column:
    """A call that a try block wrapped before and nothing handles now."""
    tried, a = fact("before", "tried"), fact("after", "callees")
    lost = (F.coalesce(F.col("before_facts.tries"), F.lit(0)) > 0) & (F.coalesce(F.col("after_facts.tries"), F.lit(0)) == 0)
    chained = IS_JS() & F.array_contains(a, "catch")
    return F.when(lost & ~chained, F.get(F.filter(tried, lambda x: F.array_contains(a, x)), F.lit(0)))


def _unwrapped() -> Column:
    p = PACKS["rust"]
    has = lambda which, marks: F.exists(F.array(*[F.lit(x) for x in marks]), lambda m: side(which, "text").contains(m))
    return (F.col("family") == "rust") & has("before", p.handled) & ~has("after", p.handled) & has("after", p.unwraps) & ~has("before", p.unwraps)


def _logging() -> tuple[Column, Column]:
    b, a = T.strip_ws(side("before", "text")), T.strip_ws(side("after", "text"))
    fresh = lambda x: a.contains(x) & ~b.contains(x)
    return fresh("redact:[]"), fresh('level:"debug"')


def _undeclared() -> Column:
    module = F.trim(F.col("name"))
    outside = (module != "") & ~T.is_relative_import(module) & ~T.is_core_module(module)
    return (F.col("kind") == "ImportDeclaration") & outside & ~F.array_contains(F.col("declared"), T.package_name(module))


def _say(text: str) -> Callable[[], Column]:
    return lambda: F.lit(text)


A, M, R = "added", "modified", "removed"
RULES: tuple[Rule, ...] = (
    Rule("hardcoded-secret", "Hardcoded secret", "high", (A, M), ALL, lambda: _secret_line().isNotNull(), _say("A line holds what looks like a credential."), _secret_line),
    Rule("eval-call", "Dynamic code execution", "high", (A, M), ("jsts", "python", "java", "csharp", "kotlin"), lambda: NOT_TEST() & F.when(IS_JS(), newly("eval")).otherwise(by_family(lambda p: p.evaluates, lambda x: new(x, "code"))), _say("Code is built and run at run time.")),
    Rule("fn-constructor", "Dynamic code execution", "high", (A, M), ("jsts",), lambda: newly("function-constructor"), _say("A function is built from text at run time.")),
    Rule("child-process", "Child process execution", "high", (A, M), ALL, _child_process, _say("Another program is run.")),
    Rule("tls-reject-false", "Disabled TLS verification", "high", (A, M), ALL, lambda: NOT_TEST() & F.when(IS_JS(), newly("unverified-tls")).otherwise(by_family(lambda p: p.tls, lambda x: new(x, "code"))), _say("Certificates are no longer verified."), lambda: line_with(lambda p: p.tls, "code")),
    Rule("env-tls-reject", "Disabled TLS verification", "high", (A, M), ("jsts", "python"), lambda: by_family(lambda p: p.env_tls, lambda x: F.when(IS_JS(), new(x, "text")).otherwise(new(x, "plain") & side("after", "text").contains("environ"))), _say("A variable of the environment turns certificate checks off.")),
    Rule("broadened-cors", "Broadened CORS", "high", (A, M), ALL, lambda: NOT_TEST() & F.when(IS_JS(), newly("any-origin")).otherwise(T.has_cors_token(side("after", "text")) & viewed(lambda p: p.cors_in_strings, lambda p: p.cors)), _say("Any origin is allowed.")),
    Rule("cookie-httponly-removed", "Weakened cookie flags", "high", (M,), tuple(f for f in ALL if f != "swift"), lambda: _cookie(lambda p: p.http_only), _say("Scripts can read a cookie now.")),
    Rule("cookie-secure-removed", "Weakened cookie flags", "high", (M,), tuple(f for f in ALL if f != "swift"), lambda: _cookie(lambda p: p.secure), _say("A cookie is sent over plain connections now.")),
    Rule("samesite-weakened", "Weakened cookie flags", "high", (M,), tuple(f for f in ALL if f != "swift"), _same_site, _say("A cookie is sent to other sites' requests now.")),
    Rule("loose-regex", "Loose regex pattern", "high", (A, M), ALL, _loose_regex, _say("A pattern lets more texts pass than before.")),
    Rule("verify-to-decode", "Crypto downgrade", "medium", (M,), ALL, _verify_to_decode, _say("A signature was verified before and is only decoded now.")),
    Rule("removed-if-guard", "Disabled guard", "low", (M,), ALL, lambda: _false_guard("after") & ~_false_guard("before"), _say("A condition is constantly false now.")),
    Rule("removed-sanitize", "Removed sanitization", "low", (M, R), ALL, _removed_sanitizer, _say("A call that sanitized or validated its input is gone.")),
    Rule("permissive-logging", "Permissive logging config", "low", (M,), ("jsts",), lambda: (F.col("kind") == "VariableDeclaration") & (_logging()[0] | _logging()[1]), lambda: F.array_join(F.array_compact(F.array(F.when(_logging()[0], "Nothing is redacted"), F.when(_logging()[1], "The level is debug"))), " and ")),
    Rule("unvetted-package", "Undeclared import", "medium", (A,), ("jsts",), _undeclared, lambda: F.concat(F.lit("No manifest declares "), F.col("name"))),
    Rule("guard-removed", "Guard removed", "medium", (M,), ALL, lambda: _unguarded().isNotNull(), lambda: F.concat(_unguarded(), F.lit(" ran behind a condition before and now always runs"))),
    Rule("removed-try-catch", "Error handling removed", "low", (M,), tuple(f for f in ALL if f != "go"), lambda: F.when(F.col("family") == "rust", _unwrapped()).otherwise(_survivor().isNotNull()), lambda: F.concat(F.lit("Failures are no longer handled"), F.coalesce(F.concat(F.lit(" around "), _survivor()), F.lit("")))),
)


#: The registry's expression for each session and set of rules: columns are named, not bound, and thousands of calls make one.
_BUILT: dict[tuple, Column] = {}


def _first_match(rules: tuple[Rule, ...]) -> Column:
    """A struct of the first rule that matches; null without one."""
    key = (id(SparkContext._active_spark_context), tuple(r.rule for r in rules))
    if key not in _BUILT:
        choices = []
        for r in rules:
            gate = F.col("state").isin(*r.states) & F.col("family").isin(*r.families)
            evidence = r.evidence() if r.evidence else F.lit(None).cast("string")
            found = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), r.describes().alias("desc"), evidence.alias("evidence"))
            choices.append(F.when(gate & F.coalesce(r.applies(), F.lit(False)), found))
        _BUILT[key] = F.coalesce(*choices)
    return _BUILT[key]


def flags(nodes: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """nodes (of drift_nodes, with ``declared``: packages that the repository declares) that a rule matches.

    Adds rule, type, severity, desc, evidence, flag_id and node_path. Node rows keep their own columns.
    """
    path = F.col("path")
    rows = nodes.withColumns({"is_test": P.is_test_path(path), "is_build_script": P.is_build_script(path), "before_text": T.joined(F.col("before")), "after_text": T.joined(F.col("after"))})
    out = rows.withColumn("__flag", _first_match(rules or RULES)).where("__flag IS NOT NULL")
    out = out.select(*nodes.columns, "__flag.*")
    where = F.when(F.col("parent_name").isNotNull(), F.concat("parent_name", F.lit(" › "), "name")).otherwise(F.col("name"))
    return out.withColumn("flag_id", F.concat("rule", F.lit("@"), "node_id")).withColumn("node_path", where)
