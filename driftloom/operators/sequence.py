"""Order-preserving matching of two sequences of siblings, and what it says of trees.

Siblings are matched by a longest common subsequence of their keys. On a tie the walk leaves the *before*
sibling first, and between two matches unmatched befores come before unmatched afters, so a moved node is
a removal and an addition.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.parts import dealt


#: Places of an element from which its mask of bits is kept rather than made anew.
KEPT_MASK = 32


class _Rows:
    """Rows of the table of lengths of longest common subsequences, as whole numbers of one bit a column.

    Row i says of each j whether a common subsequence of before[i:] and after[j:] is longer than one of before[i:] and
    after[j + 1:]; bit 0 stands for the last j, and a zero for yes. A row follows from the one below by an addition.
    Every so many rows one is kept, and the rows between are made again when the walk gets there, so that
    memory grows with the length times its root.
    """

    def __init__(self, before: list[int], after: list[int]) -> None:
        self.b, self.n, self.m = before, len(before), len(after)
        self.all, self.at, self.masks = (1 << self.m) - 1, {}, {}
        for j, x in enumerate(after):
            self.at.setdefault(x, []).append(self.m - 1 - j)
        self.step = max(1, math.isqrt(self.n))
        row, self.kept = self.all, {self.n: self.all}
        for i in range(self.n - 1, -1, -1):
            row = self.above(row, i)
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def mask(self, x: int) -> int:
        places = self.at.get(x, ())
        if len(places) < KEPT_MASK:
            out = 0
            for p in places:
                out |= 1 << p
            return out
        if x not in self.masks:
            bits = bytearray(self.m // 8 + 1)
            for p in places:
                bits[p >> 3] |= 1 << (p & 7)
            self.masks[x] = int.from_bytes(bits, "little")
        return self.masks[x]

    def above(self, row: int, i: int) -> int:
        both = row & self.mask(self.b[i])
        return row if not both else ((row + both) | (row - both)) & self.all

    def row(self, i: int) -> int:
        if i not in self.block:
            top = min(self.n, (i // self.step + 1) * self.step)
            row, self.block = self.kept[top], {top: self.kept[top]}
            for k in range(top - 1, i // self.step * self.step - 1, -1):
                row = self.block[k] = self.above(row, k)
        return self.block[i]

    def length(self, i: int, j: int) -> int:
        columns = self.m - j
        return columns - (self.row(i) & ((1 << columns) - 1)).bit_count()


def matches(before: Sequence, after: Sequence) -> list[tuple[int | None, int | None]]:
    """Pairs of places in order; None on one side for what is only on the other.

    Equal places are matched at once; else the before is left if that loses nothing, and the after if it does. What
    both begin with is matched as it stands. What both end with is set aside: once the walk has used up one side
    before it, the ending is matched with its first occurrence in the other.
    """
    n, m = len(before), len(after)
    codes: dict = {}
    b, a = ([codes.setdefault(x, len(codes)) for x in side] for side in (before, after))
    out: list[tuple[int | None, int | None]] = []
    olds: list[int] = []
    news: list[int] = []

    def flush() -> None:
        out.extend((x, None) for x in olds)
        out.extend((None, x) for x in news)
        olds.clear()
        news.clear()

    head = 0
    while head < n and head < m and b[head] == a[head]:
        out.append((head, head))
        head += 1
    tail = 0
    while tail < min(n, m) - head and b[n - 1 - tail] == a[m - 1 - tail]:
        tail += 1
    n_mid, m_mid = n - tail - head, m - tail - head
    i = j = 0
    if n_mid and m_mid:
        rows = _Rows(b[head : n - tail], a[head : m - tail])
        here, below = rows.length(0, 0), rows.length(1, 0)  # at (i, j) and at (i + 1, j)
        while i < n_mid and j < m_mid:
            column = rows.m - 1 - j
            if b[head + i] == a[head + j]:
                flush()
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
                if i < n_mid and j < m_mid:
                    here, below = rows.length(i, j), rows.length(i + 1, j)
                continue
            right = here - (not rows.row(i) >> column & 1)
            if below >= right:
                olds.append(head + i)
                i += 1
                here, below = below, rows.length(i + 1, j) if i < n_mid else 0
            else:
                news.append(head + j)
                below -= not rows.row(i + 1) >> column & 1
                here, j = right, j + 1
    i, j, left_before = i + head, j + head, i < n_mid
    while i < n and j < m:
        if b[i] == a[j]:
            flush()
            out.append((i, j))
            i, j = i + 1, j + 1
        elif left_before:
            olds.append(i)
            i += 1
        else:
            news.append(j)
            j += 1
    olds += range(i, n)
    news += range(j, m)
    flush()
    return out


def keys_of(nodes: Sequence[dict], other: Sequence[dict]) -> list[tuple]:
    """(kind, name), with the signature where either side has the pair more than once."""
    repeated = {k for side in (nodes, other) for k, n in Counter((x["kind"], x["name"]) for x in side).items() if n > 1}
    return [(x["kind"], x["name"], x.get("signature") or "" if (x["kind"], x["name"]) in repeated else None) for x in nodes]


def _plain(lines: Sequence[str]) -> str:
    return " ".join("\n".join(lines).split())


def diff_nodes(before: list[dict], after: list[dict]) -> list[dict]:
    """Nodes of both sides in one order, each with its state; dicts of kind, name, signature, lines, children."""
    out = []
    for i, j in matches(keys_of(before, after), keys_of(after, before)):
        if i is None or j is None:
            x, state = (after[j], "added") if i is None else (before[i], "removed")
            node = {"state": state, "children": []}
            node |= {"before": None, "after": x["lines"]} if i is None else {"before": x["lines"], "after": None}
        else:
            b, x = before[i], after[j]
            node = _matched(b, x)
        out.append({"kind": x["kind"], "name": x["name"], "signature": x.get("signature")} | node)
    return out


def _matched(b: dict, a: dict) -> dict:
    if b["lines"] == a["lines"] and b.get("signature") == a.get("signature"):  # nothing below differs either
        return {"state": "unchanged", "children": [], "before": None, "after": None}
    same = _plain(b["lines"]) == _plain(a["lines"])
    children: list[dict] = []
    if b.get("children") or a.get("children"):
        children = diff_nodes(b.get("children") or [], a.get("children") or [])
        # only the children's own states count: what changed two levels down is shown by the container's text
        inner = any(c["state"] != "unchanged" for c in children)
        modified = b.get("signature") != a.get("signature") or (not same and not inner)
        children = children if inner else []
    else:
        modified = not same
    lines = {"before": b["lines"], "after": a["lines"]} if modified else {"before": None, "after": None}
    return {"state": "modified" if modified else "unchanged", "children": children} | lines


def sequence_join(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, ord, state, line, b_ord, a_ord: two arrays of strings of each row matched in order."""
    schema = f"{key} {dict(rows.dtypes)[key]}, ord int, state string, line string, b_ord int, a_ord int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, b, a in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                b, a = b or [], a or []
                for o, (i, j) in enumerate(matches(b, a)):
                    state = "added" if i is None else "removed" if j is None else "unchanged"
                    for c, v in zip(out, (k, o, state, a[j] if i is None else b[i], i, j), strict=True):
                        c.append(v)
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[key, "ord", "state", "line", "b_ord", "a_ord"])

    return dealt(rows.select(key, before, after)).mapInArrow(run, schema)


def common_length(before: Sequence, after: Sequence) -> int:
    """The length of the longest common subsequence, in a row of bits for each element of the shorter side."""
    if not before or not after:
        return 0
    if len(after) < len(before):
        before, after = after, before
    codes: dict = {}
    b, a = ([codes.setdefault(x, len(codes)) for x in side] for side in (before, after))
    return _Rows(b, a).length(0, 0)


def lcs_length(before: F.Column, after: F.Column) -> F.Column:
    """The length of the longest common subsequence of two arrays of texts; null without one of them."""

    @F.pandas_udf("int")
    def length(b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else common_length(list(x), list(y)) for x, y in zip(b, a, strict=True)], dtype="Int32")

    return length(before, after)
