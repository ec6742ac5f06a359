"""Scalar functions over texts, line arrays and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order, their scores and exit codes; lifecycle scripts; core modules of the runtime.
SEVERITIES = ("high", "medium", "low")
WEIGHTS = {"high": 3, "medium": 2, "low": 1}
LIFECYCLE = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly")
CORE_MODULES = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs",
    "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def joined(lines: Column) -> Column:
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def normalize(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends: equal for texts that differ in formatting alone."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def snippet(text: Column, cap: int) -> Column:
    """The first line, trimmed and without a final semicolon, cut to cap characters and an ellipsis."""
    line = F.regexp_replace(F.trim(F.element_at(F.split(text, "\n"), 1)), ";$", "")
    return F.when(F.length(line) > cap, F.concat(F.substring(line, 1, cap), F.lit("…"))).otherwise(line)


def has_cors_token(text: Column) -> Column:
    return F.lower(text).rlike("cors|crossorigin|allowedorigin")


def has_cookie_token(text: Column) -> Column:
    return F.lower(text).contains("cookie")


def regex_body(literal: Column) -> Column:
    """What stands between the first slash and the last one, without flags."""
    body = F.regexp_replace(literal, "^/", "")
    return F.when(body.contains("/"), F.regexp_replace(body, "/[^/]*$", "")).otherwise(body)


# Patterns that match anything.
CATCH_ALL = (".*", ".+", "^.*$", "^.+$", "[\\s\\S]*", "[\\s\\S]+", "^[\\s\\S]*$", "^[\\s\\S]+$", "[^]*", "[^]+", "^[^]*$", "^[^]+$")


def is_catch_all(pattern: Column) -> Column:
    return regex_body(pattern).isin(*CATCH_ALL)


def has_anchor(pattern: Column) -> Column:
    return regex_body(pattern).rlike(r"^\^|(^|[^\\])\$$")


def is_bounded(pattern: Column) -> Column:
    return regex_body(pattern).rlike(r"\{\d+(,\d+)?\}")


def is_unbounded(pattern: Column) -> Column:
    return regex_body(pattern).rlike(r"[*+]|\{\d+,\}")


def package_name(module: Column) -> Column:
    return F.regexp_extract(module, r"^(@[^/]+/[^/]+|[^/]*)", 1)


def is_core_module(module: Column) -> Column:
    return module.startswith("node:") | F.substring_index(module, "/", 1).isin(*CORE_MODULES)


def is_relative_import(module: Column) -> Column:
    return module.rlike(r"^(\.|/|@/|~|#)")


def is_sanitizer(name: Column) -> Column:
    return F.substring_index(name, ".", -1).rlike("^(sanitize|escape|validate)")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def severity_exit(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def severity_weight(severity: Column) -> Column:
    return severity_exit(severity)


def summary(added: Column, modified: Column, removed: Column) -> Column:
    """Counts that are not zero, or that only formatting changed."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    text = F.array_join(F.array_compact(F.array(part(added, "added"), part(modified, "modified"), part(removed, "removed"))), " · ")
    return F.when(text == "", F.lit("Formatting only")).otherwise(text)


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(7))


def baseline_label(spec: Column, sha: Column) -> Column:
    """What reports call a baseline: the spec's own name and the commit it stands for."""
    at = F.concat(F.lit("@ "), short_sha(sha))
    named = F.when(spec == "trust-point", F.lit("trust point")).otherwise(spec)
    same = (F.lower(spec) == F.lower(short_sha(sha))) | (F.lower(spec) == F.lower(sha))
    return F.when(sha.isNull() | (spec == "head"), F.lit("HEAD")).when(same, at).otherwise(F.concat(named, F.lit(" "), at))


def requirement_name(line: Column) -> Column:
    body = F.trim(F.regexp_replace(line, "#.*$", ""))
    return F.when((body == "") | body.startswith("-"), F.lit(None).cast("string")).otherwise(F.lower(F.trim(F.regexp_extract(body, r"^([^=<>~! \[;@]*)", 1))))


def requirement_spec(line: Column) -> Column:
    return F.trim(F.substring_index(F.trim(F.regexp_replace(line, "#.*$", "")), ";", 1))


def canonical(text: Column) -> Column:
    """For matching findings: slashes alike, lower case, other characters as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "\\", "/")), "[^a-z0-9/._]+", " "))


def is_lifecycle(name: Column) -> Column:
    return name.isin(*LIFECYCLE)


def blob_oid(text: Column) -> Column:
    """The object id that version control gives to a text's UTF-8 bytes."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(text).cast("string").cast("binary"), F.unhex(F.lit("00")), text.cast("binary")))
