"""Comments, strings and patterns of source texts, and views of a text without them.

Views keep length and line ends, so that places in one are places in all. A quote that its line does not
close is no string: this copes with apostrophes in markup and with lifetimes.
"""

from __future__ import annotations

import re
from functools import cache

Span = tuple[str, int, int]

_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_CHAR = r"'(?:\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'"
_TRIPLE = r'"""(?:\\.|[^\\])*?"""'
#: For each family: line comments, whether block comments nest, and patterns of strings, longest forms first.
FAMILIES: dict[str, tuple[str, bool, tuple[str, ...]]] = {
    "jsts": (r"//[^\n]*", False, (_DOUBLE, r"(?<![A-Za-z0-9])" + _SINGLE)),
    "rust": (r"//[^\n]*", True, (r'\bb?r(?P<h>#*)"(?:.|\n)*?"(?P=h)', r'b?"(?:\\(?:.|\n)|[^"\\])*"', _CHAR)),
    "go": (r"//[^\n]*", False, (r"`[^`]*`", _DOUBLE, _CHAR)),
    "python": (r"#[^\n]*", False, (r'(?i:\b[rbuf]{1,2})?(?:"""(?:\\(?:.|\n)|[^\\])*?"""|\'\'\'(?:\\(?:.|\n)|[^\\])*?\'\'\'|"(?:\\(?:.|\n)|[^"\\\n])*"|\'(?:\\(?:.|\n)|[^\'\\\n])*\')',)),
    "java": (r"//[^\n]*", False, (r'"""(?:\\(?:.|\n)|[^\\])*?"""', _DOUBLE, _CHAR)),
    "csharp": (r"//[^\n]*", False, (r'\$*"""(?:.|\n)*?"""', r'(?:\$@|@\$|@)"(?:[^"]|"")*"', r"\$?" + _DOUBLE, _CHAR)),
    "kotlin": (r"//[^\n]*", True, (r'"""(?:.|\n)*?"""', _DOUBLE, _CHAR)),
    "swift": (r"//[^\n]*", True, (r'#"(?:.|\n)*?"#', r'"""(?:\\(?:.|\n)|[^\\])*?"""', _DOUBLE)),
}
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\n]|\b(?:return|typeof|case|in|of|do|else|yield|await))[ \t]*\Z")
_PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


@cache
def _scanner(family: str) -> re.Pattern:
    line, _, strings = FAMILIES[family]
    parts = [f"(?P<line>{line})", f"(?P<string>{'|'.join(strings)})"]
    if family != "python":
        parts.insert(0, r"(?P<block>/\*)")
    if family == "jsts":
        parts += ["(?P<template>`)", "(?P<slash>/)"]
    return re.compile("|".join(parts))


def _block_end(text: str, at: int, nests: bool) -> int:
    depth, i = 1, at + 2
    while depth:
        end = text.find("*/", i)
        if end < 0:
            return len(text)
        inner = text.find("/*", i, end) if nests else -1
        depth, i = (depth + 1, inner + 2) if inner >= 0 else (depth - 1, end + 2)
    return i


_TEMPLATE = re.compile(r"\\.|`|\$\{|[{}]", re.DOTALL)


def _template_end(text: str, at: int) -> int:
    """After the backtick that closes the one at ``at``, with expressions in between that may hold others."""
    open_braces = [0]  # of each template that is open; none: its own text, else an expression in it
    for m in _TEMPLATE.finditer(text, at + 1):
        mark = m[0]
        if mark == "`" and not open_braces[-1]:
            open_braces.pop()
            if not open_braces:
                return m.end()
        elif mark == "`":
            open_braces.append(0)
        elif not open_braces[-1]:
            open_braces[-1] = int(mark == "${")
        elif mark in ("{", "${"):
            open_braces[-1] += 1
        elif mark == "}":
            open_braces[-1] -= 1
    return len(text)


def spans(text: str, family: str) -> list[Span]:
    """(kind, start, end) of comments, strings and pattern literals, in order."""
    out: list[Span] = []
    scan, nests, i = _scanner(family), FAMILIES[family][1], 0
    while m := scan.search(text, i):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if m.group("line") is not None or (family != "python" and m.group("block") is not None):
            end = end if m.group("line") is not None else _block_end(text, start, nests)
            kind = "comment"
        elif m.group("string") is not None:
            kind = "string"
        elif m.group("template") is not None:
            kind, end = "string", _template_end(text, start)
        else:
            p = _PATTERN.match(text, start) if _BEFORE_PATTERN.search(text, max(0, start - 40), start) else None
            if not p:
                i = end
                continue
            kind, end = "pattern", p.end()
        out.append((kind, start, end))
        i = end
    return out


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, found: list[Span], strings: bool) -> str:
    """The text with comments blanked, and with strings the insides of strings too; their first and last characters stay."""
    out, at = [], 0
    for kind, start, end in found:
        if kind == "comment" or (strings and kind == "string"):
            keep = kind == "string"
            out += [text[at : start + keep], _blank(text[start + keep : end - keep])]
            at = max(start + keep, end - keep)
    return "".join(out) + text[at:]
