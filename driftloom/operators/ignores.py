"""Ignore rules as a join: the files that say what to leave out, and for every path whether they do.

A rule file is one row of compiled patterns at its folder. Each path is taken apart into its folders and itself, each of
these meets the rule files of the folders above it by their names, and the last pattern that matches decides, the
deepest file's first. A path is ignored if it or a folder above it is: what an ignored folder holds cannot be taken
back. Nothing is compared with patterns of other folders, and no path with all patterns of a repository.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = "array<struct<expression:string,negated:boolean,folders:boolean>>"
RULE_FILE = ".gitignore"


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The expression of a set of characters that begins at a bracket, and the place after it."""
    k = at + 1
    negated = k < len(glob) and glob[k] in "!^"
    k += negated
    out, first = "", k
    while k < len(glob) and (glob[k] != "]" or k == first):
        if glob.startswith("[:", k) and (end := glob.find(":]", k)) > 0:
            names = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "xdigit": "0-9A-Fa-f"}
            out += names.get(glob[k + 2 : end], "")
            k = end + 2
            continue
        if glob[k] == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        elif glob[k] == "-" and k > first and k + 1 < len(glob) and glob[k + 1] != "]":
            out += "-"
        else:
            out += re.escape(glob[k]) if glob[k] != "-" else r"\-"
        k += 1
    if k >= len(glob):
        return None
    return (f"(?!/)[{'^' if negated else ''}{out}]" if out else "(?!)"), k + 1


def expression(pattern: str) -> str | None:
    """The regular expression of a pattern without its marks, over names below its folder; None if it can match nothing."""
    anchored = "/" in pattern.rstrip("/")
    pattern = pattern.removeprefix("/")
    out, k = "" if anchored else "(?:.*/)?", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            run = len(pattern) - len(pattern[k:].lstrip("*")) - k
            before, after = k == 0 or pattern[k - 1] == "/", k + run == len(pattern) or pattern[k + run] == "/"
            if run == 2 and before and after and anchored:
                if k + run == len(pattern):
                    out += ".+"
                else:
                    out += "(?:.*/)?"
                    run += 1  # with the slash
            else:
                out += "[^/]*"
            k += run
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[":
            found = _class(pattern, k)
            if found is None:
                return None
            out, k = out + found[0], found[1]
        elif c == "\\":
            if k + 1 == len(pattern):
                return None
            out, k = out + re.escape(pattern[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return f"(?s)^{out}$"


def compiled(text: str) -> list[dict]:
    """The patterns of a rule file, in order: expression, whether they take back, and whether they are for folders alone."""
    out = []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[negated:]
        folders = pattern.endswith("/") and not pattern.endswith("\\/")
        pattern = pattern[:-1] if folders else pattern
        if pattern and (made := expression(pattern)) is not None:
            out.append({"expression": made, "negated": negated, "folders": folders})
    return out


def rule_files(files: DataFrame) -> DataFrame:
    """repo, folder, patterns of the rule files among files (repo, path, content); a folder's name ends with a slash, the root's is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("expression", pa.string()), ("negated", pa.bool_()), ("folders", pa.bool_())]))
        for batch in batches:
            patterns = pa.array([compiled(t or "") for t in batch.column(2).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), patterns], names=["repo", "folder", "patterns"])

    here = files.where((F.col("path") == RULE_FILE) | F.col("path").endswith(f"/{RULE_FILE}"))
    folder = F.col("path").substr(F.lit(1), F.length("path") - len(RULE_FILE))
    return here.select("repo", folder.alias("folder"), "content").mapInArrow(run, f"repo string, folder string, patterns {PATTERNS}").where(F.size("patterns") > 0)


def _above(path: Column) -> Column:
    """The folders above a path, the root first; each ends with a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))


def with_ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (repo, path, with other columns) with ``ignored``: whether rule files leave them out, tracked or not.

    rules is the table of ``rule_files``, which Spark broadcasts only if it is small. Paths are those of files; null
    paths are not ignored. Paths that occur more than once are looked up once.
    """
    asked = paths.select("repo", "path").where("path IS NOT NULL").distinct()
    steps = asked.withColumn("__step", F.explode(F.concat(F.filter(_above(F.col("path")), lambda x: x != ""), F.array(F.col("path")))))
    name = F.regexp_replace("__step", "/$", "")
    steps = steps.withColumn("__folder", F.explode(_above(name)))
    own = rules.select(F.col("repo").alias("__repo"), F.col("folder").alias("__of"), "patterns")
    met = steps.join(own, F.col("repo").eqNullSafe(F.col("__repo")) & (F.col("__folder") == F.col("__of")))
    below = name.substr(F.length("__of") + 1, F.length(name))
    fits = F.filter("patterns", lambda p: (~p["folders"] | F.col("__step").endswith("/")) & F.call_function("rlike", below, p["expression"]))
    last = F.try_element_at(fits, F.lit(-1))
    told = met.select("repo", "path", "__step", F.length("__of").alias("deep"), last["negated"].alias("negated")).where("negated IS NOT NULL")
    by_step = told.groupBy("repo", "path", "__step").agg(F.max_by("negated", "deep").alias("negated"))
    out = by_step.groupBy(F.col("repo").alias("__r"), F.col("path").alias("__p")).agg(F.bool_or(~F.col("negated")).alias("ignored"))
    joined = paths.join(out, paths["repo"].eqNullSafe(F.col("__r")) & (paths["path"] == F.col("__p")), "left")
    return joined.withColumn("ignored", F.coalesce("ignored", F.lit(False))).drop("__r", "__p")


def left_out(paths: DataFrame, rules: DataFrame, tracked: DataFrame) -> DataFrame:
    """(repo, path) of the paths that rules ignore and that are in no index or baseline; tracked: (repo, path)."""
    known = tracked.select("repo", "path").distinct()
    return with_ignored(paths.select("repo", "path").distinct(), rules).where("ignored").select("repo", "path").join(known, ["repo", "path"], "left_anti")
