"""Unified patches of files from the sequence match of their lines, and their application."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from driftloom.functions.parts import dealt

from .sequence import matches

#: Lines around a change that a hunk shows.
CONTEXT = 3
_NO_END = "\\ No newline at end of file"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def lines_of(text: str) -> list[str]:
    """Lines with their line feeds; only the last may have none. Carriage returns are part of a line."""
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def _count(start: int, n: int) -> str:
    """A side's first line, from 1, and its number of lines; an empty side names the line before it."""
    return f"{start + 1 if n else start}" + ("" if n == 1 else f",{n}")


def _hunks(before: list[str], after: list[str], context: int) -> Iterator[list[tuple[str, int, int, str]]]:
    """Runs of (mark, place before, place after, line): changes with the lines around them; runs that touch are one."""
    rows: list[tuple[str, int, int, str]] = []
    i = j = 0
    for b, a in matches(before, after):
        mark = "+" if b is None else "-" if a is None else " "
        rows.append((mark, i, j, after[a] if b is None else before[b]))
        i, j = i + (b is not None), j + (a is not None)
    changed = [k for k, row in enumerate(rows) if row[0] != " "]
    k = 0
    while k < len(changed):
        first = last = changed[k]
        while k < len(changed) and changed[k] - last <= 2 * context + 1:
            last = changed[k]
            k += 1
        yield rows[max(0, first - context) : last + context + 1]


def _quoted(name: str) -> str:
    """A name as it stands in a patch's head: in quotes, with escapes, if it has characters that would end it."""
    if not any(c in '"\\\n\t\r' or ord(c) < 32 for c in name):
        return name
    return '"' + "".join({"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\"}.get(c, c if ord(c) >= 32 else f"\\{ord(c):03o}") for c in name) + '"'


def unified(path: str, before: str | None, after: str | None, context: int = CONTEXT) -> str:
    """The patch that turns before into after; empty if they are equal. None: the side has no such file."""
    if before == after:
        return ""
    old, new = lines_of(before or ""), lines_of(after or "")
    out = [f"diff --git {_quoted('a/' + path)} {_quoted('b/' + path)}"]
    out += ["new file mode 100644"] if before is None else ["deleted file mode 100644"] if after is None else []
    body: list[str] = []
    for rows in _hunks(old, new, context):
        sides = [sum(mark != "+" for mark, *_ in rows), sum(mark != "-" for mark, *_ in rows)]
        body.append(f"@@ -{_count(rows[0][1], sides[0])} +{_count(rows[0][2], sides[1])} @@")
        for mark, _, _, line in rows:
            body.append(mark + line.removesuffix("\n"))
            if not line.endswith("\n"):
                body.append(_NO_END)
    if body:
        out += ["--- " + ("/dev/null" if before is None else _quoted("a/" + path)), "+++ " + ("/dev/null" if after is None else _quoted("b/" + path))]
    return "\n".join([*out, *body]) + "\n"


class Misfit(ValueError):
    """A patch does not fit the text that it is applied to."""


def applied(before: str | None, patch: str) -> str | None:
    """What a patch of one file makes of before: None if it deletes the file. Every line that it shows must be there."""
    if not patch:
        return before
    rows = patch.split("\n")
    if "deleted file mode 100644" in rows[:3]:
        gone = True
    else:
        gone = False
        if "new file mode 100644" in rows[:3] and before is not None:
            raise Misfit("the file is there already")
    old, out, at, k = lines_of(before or ""), [], 0, 0
    while k < len(rows):
        head = _HUNK.match(rows[k])
        k += 1
        if not head:
            continue
        left = [1 if head[g] is None else int(head[g]) for g in (2, 4)]
        start = int(head[1]) - (1 if left[0] else 0)
        if not at <= start <= len(old):
            raise Misfit(f"hunk at line {head[1]}")
        out += old[at:start]
        at = start
        while left[0] or left[1]:
            mark, line = rows[k][:1], rows[k][1:]
            k += 1
            if k < len(rows) and rows[k] == _NO_END:
                k += 1
            else:
                line += "\n"
            if mark in (" ", "-"):
                if at >= len(old) or old[at] != line:
                    raise Misfit(f"line {at + 1}")
                at += 1
                left[0] -= 1
            if mark in (" ", "+"):
                out.append(line)
                left[1] -= 1
    out += old[at:]
    if gone and out:
        raise Misfit("lines are left")
    return None if gone else "".join(out)


def _texts(rows: DataFrame, columns: tuple[str, str, str], column: str, make) -> DataFrame:  # noqa: ANN001
    schema = StructType([*rows.schema.fields, StructField(column, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            out = pa.array([make(*v) for v in zip(*values, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, column])

    return dealt(rows).mapInArrow(run, schema)


def with_patch(files: DataFrame, context: int = CONTEXT, column: str = "patch") -> DataFrame:
    """files (path, before, after) with the patch of each, a file at a time."""
    return _texts(files, ("path", "before", "after"), column, lambda path, before, after: unified(path, before, after, context))


def with_applied(files: DataFrame, column: str = "applied") -> DataFrame:
    """files (path, before, patch) with what the patch makes of before. It is an error if one does not fit."""
    return _texts(files, ("path", "before", "patch"), column, lambda _, before, patch: applied(before, patch))
