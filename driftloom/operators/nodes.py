"""Changed files to the flat tree of their nodes: parsed and matched file by file, with ids, hashes and facts."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from driftloom.functions import text as T
from driftloom.functions.parts import dealt
from driftloom.functions.paths import FAMILIES, SUFFIXES, is_analyzable
from driftloom.sources import syntax
from driftloom.sources.packs import PACKS

from .sequence import diff_nodes

FACTS = "struct<code:string,plain:string,callees:array<string>,conditions:array<string>,guarded:array<string>,guard_clauses:int,tries:int,tried:array<string>,patterns:array<string>,compiled:array<string>,hits:array<string>>"
_COLUMNS = """path string, file_id string, family string, node_id string, parent_id string, parent_name string, depth int, pre_ord int, kind string, name string, signature string, state string,
before array<string>, after array<string>, node_hash string"""
SCHEMA = f"{_COLUMNS}, before_facts {FACTS}, after_facts {FACTS}"
#: Rows of nodes that a task hands on at once, at least.
TOGETHER = 1000
#: Files of which either side has more bytes are listed as skipped and not parsed.
PARSE_CAP = 2 * 1024 * 1024
_COMPILED = {f: re.compile(p.compiles_regex) for f, p in PACKS.items() if p.compiles_regex}


def lang_of(path: str) -> str | None:
    low = path.lower()
    return None if low.endswith(".d.ts") else next((lang for suffix, lang in SUFFIXES.items() if low.endswith(suffix)), None)


def sanitize(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", text)


def facts_of(lines: list[str] | None, family: str) -> dict | None:
    if lines is None:
        return None
    out = syntax.facts("\n".join(lines), family, PACKS[family].exits)
    text = "\n".join(lines)
    plain, code = out["plain"] or text, out["code"] or text
    found = _COMPILED[family].finditer(plain) if family in _COMPILED else ()
    out["compiled"] = [m[1] for m in found if not code[m.start()].isspace()]
    return out


def node_hash(node: dict) -> str:
    """Of what a node is and has become, with its children's hashes, which are worked out first and kept; review marks are no part of it."""
    if "hash" not in node:
        parts = [node["kind"], node["name"], node["signature"], node["state"], node["before"], node["after"], [node_hash(c) for c in node["children"]]]
        node["hash"] = hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
    return node["hash"]


def file_nodes(path: str, before: str | None, after: str | None, facts: bool = True) -> list[dict]:
    """Rows of a changed file's nodes in pre-order, with facts or without; none for files that are not parsed."""
    lang = lang_of(path)
    if lang is None or max(len((t or "").encode("utf-8", "surrogatepass")) for t in (before, after)) > PARSE_CAP:
        return []
    family, file_id, out = FAMILIES[lang], sanitize(path), []
    tree = diff_nodes(*([n.plain() for n in syntax.parse(t, family)] if t else [] for t in (before, after)))

    def walk(nodes: list[dict], parent_path: str, parent: dict | None, depth: int) -> None:
        count, seen = Counter((n["kind"], sanitize(n["name"])[:24]) for n in nodes), Counter()
        for n in nodes:
            slug = sanitize(n["name"])[:24]
            key = (n["kind"], slug)
            tail = f"#{seen[key]}" if count[key] > 1 else ""
            seen[key] += 1
            row = {
                "path": path, "file_id": file_id, "family": family, "node_id": f"{file_id}:{parent_path}:{n['kind']}:{slug}{tail}", "parent_id": parent and parent["node_id"],
                "parent_name": parent and parent["name"], "depth": depth, "pre_ord": len(out), "kind": n["kind"], "name": n["name"], "signature": n["signature"], "state": n["state"],
                "before": n["before"], "after": n["after"], "node_hash": node_hash(n),
            }
            if facts:
                row |= {"before_facts": facts_of(n["before"], family), "after_facts": facts_of(n["after"], family)}
            out.append(row)
            walk(n["children"], f"{parent_path}/{slug}", row, depth + 1)

    walk(tree, "", None, 0)
    return out


def largest_side(before: Column, after: Column) -> Column:
    return F.greatest(F.coalesce(F.octet_length(before), F.lit(0)), F.coalesce(F.octet_length(after), F.lit(0)))


def is_oversized(path: Column, before: Column, after: Column, cap: int = PARSE_CAP) -> Column:
    """Whether a file that would be parsed is too large for it."""
    return is_analyzable(path) & (largest_side(before, after) > cap)


def skipped_files(changed: DataFrame, cap: int = PARSE_CAP) -> DataFrame:
    """path, summary, skip_marker of the files (path, before, after) that are too large to parse.

    The marker names the content of both sides, so that a fingerprint changes with it.
    """
    b, a = F.col("before"), F.col("after")
    mb = lambda n: F.format_number(n / (1024.0 * 1024.0), 1)
    said = F.concat(F.lit("Skipped — file too large to analyze ("), mb(largest_side(b, a)), F.lit(f" MB > {cap // (1024 * 1024)} MB)"))
    marker = F.concat_ws("|", *[F.coalesce(T.blob_oid(c), F.lit("none")) for c in (b, a)])
    return changed.where(is_oversized(F.col("path"), b, a, cap)).select("path", said.alias("summary"), marker.alias("skip_marker"))


def drift_nodes(changed: DataFrame, facts: bool = True) -> DataFrame:
    """The nodes of all changed files (path, before, after), as SCHEMA. One pass over a file, without a shuffle.

    Files of many repositories have a column ``repo``, and so have their nodes then. Without facts, which rules ask for,
    nodes have neither of the two columns.
    """
    repo = "repo" in changed.columns
    columns = ("repo string, " if repo else "") + (SCHEMA if facts else _COLUMNS)
    schema = to_arrow_schema(_parse_datatype_string(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            repos = batch.column(3).to_pylist() if repo else [None] * batch.num_rows
            for path, before, after, of in zip(*(batch.column(k).to_pylist() for k in range(3)), repos, strict=True):
                rows = file_nodes(path, before, after, facts)
                held += [r | {"repo": of} for r in rows] if repo else rows
                if len(held) >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return dealt(changed.select("path", "before", "after", *(["repo"] if repo else []))).mapInArrow(run, columns)
