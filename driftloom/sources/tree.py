"""Expressions of a source text as a tree, and patterns that are looked for in it.

There is one tokenizer for all families and no grammar: names, literals and brackets become operands, and what follows
an operand makes a member, a call, an element, a pair or a generic type of it. Brackets without a partner are passed
over, so malformed texts and pieces of texts have trees too. Tokens are read once and nodes are built once, so time
grows with the text, however long its arguments are. Nothing recurs: brackets may nest as deep as they like.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property
from types import MappingProxyType

from . import lexer

# Words that stand before a bracket without being called.
CONTROL = frozenset("if for while switch catch return typeof else do try throw case in of match when guard repeat foreach await yield".split())
FAMILY_CONTROL = {
    "jsts": frozenset({"function", "import", "new"}),
    "rust": frozenset({"fn", "loop", "as", "pub"}),
    "go": frozenset({"func", "go", "defer", "select", "range", "map", "import", "var", "const", "type"}),
    "python": frozenset("def class lambda not and or elif assert del with from import is print_ except raise".split()),
    "java": frozenset({"synchronized", "super", "this", "new"}),
    "csharp": frozenset({"using", "lock", "fixed", "nameof", "sizeof", "base", "this", "default", "new"}),
    "kotlin": frozenset({"fun", "constructor", "get", "set"}),
    "swift": frozenset({"func", "init", "where"}),
}
#: Words before a name that declare it.
DECLARES = frozenset("function fn func fun def class struct enum interface trait impl record init deinit protocol extension actor".split())
#: Words before a name that are no type of it.
_NO_TYPE = frozenset("return throw await new else yield case in not and or raise assert do try go defer".split())
_MODIFIERS = frozenset("async static get set public private protected".split())
#: Families whose calls do not go on after a line end.
_LINES = frozenset({"go", "kotlin", "swift", "python"})
#: Families in which what stands behind an at sign is not called.
_NOTES = frozenset({"java", "kotlin", "swift"})

_TOKEN = re.compile(r"(?P<name>[^\W\d][\w$]*+|\$[\w$]*+)|(?P<number>\d[\w.]*+)|(?P<mark>\?\.(?!\d)|::|->|=>|[<>=!]=|&&|\|\||[^\s\w])")
_HOLE = {"kotlin": re.compile(r"\$\{"), "swift": re.compile(r"\\\("), "python": re.compile(r"\{\{|\{"), "csharp": re.compile(r"\{\{|\{")}
_HELD = {"kotlin": re.compile(r"[\w\"$]"), "swift": re.compile(r""), "python": re.compile(r"(?i:[rb]?f[rb]?[\"'])"), "csharp": re.compile(r"\$|@\$")}
_DEPTH = re.compile(r"[({\[\])}]")
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
_IN_HOLE = re.compile(r"(?P<skip>\s++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<text>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|(?P<tick>`)|" + _TOKEN.pattern, re.DOTALL)
#: Tokens after which a name is a member or may be a constructor.
_BEFORE_NAMES = frozenset({".", "?.", "::", "new"})
_AFTER_GENERIC = frozenset("( :: . ?. , ; ) ] } > { ? = =>".split())
_IN_GENERIC = frozenset(", . : & ' ? -> | * :: @".split())
_NAMES = {"(": "group", "[": "list", "{": "block", "${": "hole", "<": "types"}


#: What leaves have in place of fields and items of their own.
_NO_FIELDS: Mapping[str, Node] = MappingProxyType({})
_NO_ITEMS: tuple[Node, ...] = ()
_LEAVES = frozenset({"name", "number", "text", "template", "pattern", "member", "call", "new", "index", "note", "declare"})


class Node:
    """A part of a text. value: of names and texts; fields: nodes by their role; items: what brackets hold, in order.

    lead is the number of its first token.
    """

    __slots__ = ("kind", "start", "end", "value", "fields", "items", "lead")

    def __init__(self, kind: str, start: int, end: int, lead: int, value: str | None = None, fields: dict[str, Node] | None = None) -> None:
        self.kind = kind
        self.start = start
        self.end = end
        self.lead = lead
        self.value = value
        self.fields = _NO_FIELDS if fields is None else fields
        self.items = _NO_ITEMS if kind in _LEAVES else []

    def __repr__(self) -> str:
        return f"{self.kind}({self.value or ''}{', '.join(f'{k}={v!r}' for k, v in self.fields.items())}{self.items or ''})"


Token = tuple[str, str, int, int]


def _template(text: str, start: int, end: int) -> Iterator[Token]:
    """The tokens in the holes of a template, and of templates in them; each hole is a pair of marks."""
    yield "template", "", start, end
    at, open_braces = start + 1, [-1]  # of each open template and hole: -1 in a template's own text
    while open_braces and at < end:
        if open_braces[-1] < 0:
            if not (m := _IN_TEMPLATE.search(text, at, end)):
                return
            at = m.end()
            if m[0] == "`":
                open_braces.pop()
            elif m[0] == "${":
                open_braces.append(0)
                yield "mark", "${", m.start(), at
            continue
        m = _IN_HOLE.match(text, at, end)
        if not m:
            at += 1
            continue
        at = m.end()
        if m.lastgroup == "tick":
            open_braces.append(-1)
        elif m[0] == "}" and not open_braces[-1]:
            open_braces.pop()
            yield "mark", "}", m.start(), at
        elif m.lastgroup != "skip":
            open_braces[-1] += (m[0] == "{") - (m[0] == "}")
            yield m.lastgroup, m[0], m.start(), at


def _holes(text: str, family: str, start: int, end: int) -> Iterator[Token]:
    """The tokens in the holes of a string that is put together."""
    if family not in _HOLE or not _HELD[family].match(text, start):
        return
    at, stop = start + 1, end - 1
    while m := _HOLE[family].search(text, at, stop):
        at = m.end()
        if m[0] == "{{":
            continue
        depth, close = 1, at
        while depth and (b := _DEPTH.search(text, close, stop)):
            depth += 1 if b[0] in "({[" else -1
            close = b.end()
        if depth:
            return
        yield "mark", "${", m.start(), at
        for t in _TOKEN.finditer(text, at, close - 1):
            yield t.lastgroup, t[0], t.start(), t.end()
        yield "mark", "}", close - 1, close
        at = close


def tokens(text: str, code: str, family: str, spans: list[lexer.Span]) -> list[Token]:
    """(kind, text, start, end) of the names, numbers, marks and literals of a text; code: the text without comments and insides of strings."""
    out: list[Token] = []
    at = 0
    for kind, start, end in [*spans, ("", len(code), len(code))]:
        out += [(m.lastgroup, m[0], *m.span()) for m in _TOKEN.finditer(code, at, start)]
        at = end
        if kind == "pattern":
            out.append(("pattern", text[start:end], start, end))
        elif kind == "string" and text[start] == "`" and family == "jsts":
            out += _template(text, start, end)
        elif kind == "string":
            out.append(("text", text[start:end], start, end))
            if family in _HOLE:
                out += _holes(text, family, start, end)
    return out


def partners(found: list[Token], family: str) -> dict[int, int]:
    """The numbers of the tokens that close brackets, by those that open them, whatever their kinds; angle brackets
    pair if there is nothing between them that no type holds."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    angles: list[list[int]] = [[]]
    for k, (kind, value, *_) in enumerate(found):
        if kind != "mark":
            if kind != "name" and kind != "number":
                angles[-1].clear()
        elif value in _NAMES and value != "<":
            if value == "{":
                angles[-1].clear()
            waiting.append(k)
            angles.append([])
        elif value in (")", "]", "}"):
            if waiting:
                out[waiting.pop()] = k
                angles.pop()
                if value == "}":
                    angles[-1].clear()
        elif value == "<":
            if family not in ("go", "python") and k and (found[k - 1][0] == "name" or found[k - 1][1] == "::"):
                angles[-1].append(k)
            else:
                angles[-1].clear()
        elif value == ">":
            if angles[-1]:
                opened = angles[-1].pop()
                if k + 1 == len(found) or found[k + 1][0] == "name" or found[k + 1][1] in _AFTER_GENERIC:
                    out[opened] = k
        elif value not in _IN_GENERIC:
            angles[-1].clear()
    return out


class _Frame:
    __slots__ = ("node", "close", "quiet", "last", "first", "plain", "key")

    def __init__(self, node: Node, close: int, quiet: bool) -> None:
        self.node, self.close, self.quiet = node, close, quiet
        self.segment()

    def segment(self) -> None:
        """What follows is a new element. last: the operand that what follows may add to; plain: nothing but one operand so far."""
        self.first, self.plain, self.key, self.last = len(self.node.items), True, None, None


class Tree:
    """The nodes of a text by their kinds, each kind in the order in which its nodes are met."""

    def __init__(self, text: str, code: str, family: str, spans: list[lexer.Span]) -> None:
        self.text, self.code, self.family = text, code, family
        self.by_kind: dict[str, list[Node]] = defaultdict(list)
        self.found = tokens(text, code, family, spans)
        self.closes = partners(self.found, family)
        self.root = Node("root", 0, len(text), 0)
        self._read()

    @cached_property
    def stops(self) -> list[int]:
        return [k for k, t in enumerate(self.found) if t[1] in ("{", "}", ";")]

    def _add(self, node: Node) -> Node:
        self.by_kind[node.kind].append(node)
        return node

    def _before(self, k: int) -> str:
        return self.found[k - 1][1] if k else ""

    def _parted(self, k: int) -> bool:
        """Whether a line ends before a token."""
        return not k or self.code.find("\n", self.found[k - 1][3], self.found[k][2]) >= 0

    def _read(self) -> None:
        names = self.by_kind["name"]
        found, frames = self.found, [_Frame(self.root, len(self.found), False)]
        for k, (kind, value, start, end) in enumerate(found):
            frame = frames[-1]
            if kind == "name" and (not k or found[k - 1][1] not in _BEFORE_NAMES):
                held = frame.node.items
                frame.plain = frame.plain and len(held) == frame.first
                frame.last = node = Node("name", start, end, k, value)
                names.append(node)
                held.append(node)
            elif kind != "mark":
                self._operand(frame, k, kind, value, start, end)
            elif value in _NAMES and (value != "<" or k in self.closes):
                frames.append(self._open(frame, k, value, start))
            elif value in (")", "]", "}") or (value == ">" and frame.close == k):
                while len(frames) > 1 and frames[-1].node.kind == "types" and frames[-1].close != k:
                    self._close(frames, k)
                if len(frames) > 1:
                    self._close(frames, k)
            elif frame.node.kind == "types":
                frame.last = None
            elif value in (",", ";"):
                self._end(frame)
                frame.segment()
            elif value == ":" and frame.key is None and frame.plain and len(frame.node.items) == frame.first + 1 and frame.node.kind in ("block", "group"):
                frame.key, frame.last = frame.node.items.pop(), None
            elif value in (".", "?.", "::") or (value in ("?", "!") and k + 1 < len(found) and found[k + 1][1] in (".", "::") and found[k + 1][2] == end):
                pass  # the operand goes on
            else:
                frame.plain, frame.last = False, None
        while len(frames) > 1:  # brackets that nothing closes
            self._close(frames, len(found) - 1)
        self._end(frames[0])

    def _operand(self, frame: _Frame, k: int, kind: str, value: str, start: int, end: int) -> None:
        items = frame.node.items
        if kind == "name" and k and self.found[k - 1][0] == "mark" and self.found[k - 1][1] in (".", "?.", "::"):
            of = frame.last
            node = Node("member", of.start if of else start, end, of.lead if of else k, None, {"property": Node("name", start, end, k, value)})
            if of:
                node.fields["object"] = items.pop()
        else:
            node = Node(kind, start, end, k, _inside(value) if kind == "text" else value)
            frame.plain = frame.plain and len(items) == frame.first
        items.append(self._add(node))
        frame.last = node
        if kind == "name" and self._before(k) == "new" and (k + 1 == len(self.found) or self.found[k + 1][1] not in ("(", ".", "::", "<")):
            items[-1] = frame.last = self._add(Node("new", start, end, k - 1, None, {"constructor": node}))

    def _open(self, frame: _Frame, k: int, value: str, start: int) -> _Frame:
        """A bracket: what it is to the operand before it is known now, since its partner is."""
        close = self.closes.get(k, len(self.found))
        node = self._add(Node(_NAMES[value], start, self.found[close][3] if close < len(self.found) else len(self.text), k, self._before(k)))
        of = frame.last if value in ("(", "[", "<") and (self.family not in _LINES or not self._parted(k)) else None
        role = None
        if of is not None and value == "<":
            of.fields = {**of.fields, "types": node}
            return _Frame(node, close, frame.quiet)
        if of is not None and value == "(":
            role = self._role(of, close, frame.quiet)
        elif of is not None and value == "[" and of.kind != "block":
            role = "index"
        if role:
            whole = Node(role, of.start, node.end, of.lead - (role == "new"), None, {_OF[role]: frame.node.items.pop(), "arguments": node})
            frame.node.items.append(self._add(whole))
        else:
            frame.plain = frame.plain and len(frame.node.items) == frame.first
            frame.node.items.append(node)
        notes = value == "[" and (self._before(k) in ("#", "!") and self.family == "rust" or self.family == "csharp" and (not k or self._before(k) in (";", "{", "}", "]")))
        return _Frame(node, close, frame.quiet or notes)

    def _role(self, of: Node, close: int, quiet: bool) -> str | None:
        """What round brackets make of an operand: a call, a new object, a declaration or a note; None: nothing."""
        if of.kind not in ("name", "member", "call", "index", "group", "new"):
            return None
        before = self._before(of.lead)
        if of.kind == "name" and (of.value in CONTROL or of.value in FAMILY_CONTROL[self.family]):
            return None
        if before == "new":
            return "new"
        if quiet or (before == "@" and self.family in _NOTES):
            return "note"
        if before in DECLARES or (before == "*" and self._before(of.lead - 1) == "function") or (before == "!" and self._before(of.lead - 1) == "macro_rules"):
            return "declare"
        if self.family == "go" and before == ")" and self._receiver(of):
            return "declare"
        if of.kind == "name" and self.family in ("jsts", "java", "csharp") and self._has_body(close) and self._is_method(of, before):
            return "declare"
        return "call"

    def _receiver(self, of: Node) -> bool:
        k = of.lead - 1
        groups = self.by_kind["group"]
        at = bisect_right(groups, self.found[k][2], key=lambda n: n.start) - 1
        return at >= 0 and groups[at].value == "func" and groups[at].end == self.found[k][3]

    def _is_method(self, of: Node, before: str) -> bool:
        """Whether a name that a body follows stands where methods are declared."""
        bare = not of.lead or before in (";", "{", "}")
        if self.family == "jsts":
            return bare or self._parted(of.lead) or before in _MODIFIERS
        if bare or (self._parted(of.lead) and before not in (".", "=", ",", "(", "&&", "||", "+", "?", ":", "=>", "->")):
            return True
        kind = self.found[of.lead - 1][0]
        return (kind == "name" and before not in _NO_TYPE) or before in (">", "]", "?")

    def _has_body(self, close: int) -> bool:
        """Whether a block follows closing brackets, after a type, what is thrown, or what types are bound to."""
        k, found = close + 1, self.found
        if k >= len(found):
            return False
        if found[k][1] == ":" or found[k][1] == "throws":
            k += 1
            while k < len(found) and (found[k][0] == "name" or found[k][1] in ("<", ">", "[", "]", "|", ",", ".")):
                k += 1
        elif found[k][1] == "where":
            at = bisect_right(self.stops, k)
            k = self.stops[at] if at < len(self.stops) else len(found)
        return k < len(found) and found[k][1] == "{"

    def _close(self, frames: list[_Frame], k: int) -> None:
        frame = frames.pop()
        self._end(frame)
        outer = frames[-1]
        if frame.node.kind in ("hole", "types"):
            if frame.node.kind == "hole":
                outer.last = None
            return
        outer.last = outer.node.items[-1] if outer.node.items else None
        if frame.node.kind == "block" and k + 1 < len(self.found) and self._parted(k + 1):
            self._end(outer)
            outer.segment()

    def _end(self, frame: _Frame) -> None:
        """An element ends: a key has its value, if that is one operand; more than an operand in a list is an expression."""
        items = frame.node.items
        if frame.key is not None:
            rest = items[frame.first :]
            pair = self._add(Node("pair", frame.key.start, rest[-1].end if rest else frame.key.end, frame.key.lead, None, {"key": frame.key}))
            if frame.plain and len(rest) == 1:
                pair.fields["value"] = rest[0]
            pair.items = rest
            items[frame.first :] = [pair]
            frame.key = None
        elif frame.node.kind == "list" and len(items) > frame.first and not frame.plain:
            rest = items[frame.first :]
            whole = Node("expression", rest[0].start, rest[-1].end, rest[0].lead)
            whole.items = rest
            items[frame.first :] = [whole]


_OF = {"call": "function", "new": "constructor", "index": "object", "note": "name", "declare": "name"}


def _inside(literal: str) -> str:
    """What a string says, without its quotes and the letters before them."""
    for quote in ('"""', "'''", '"', "'"):
        at = literal.find(quote)
        if at >= 0 and literal.endswith(quote) and len(literal) >= at + 2 * len(quote) and not literal[:at].strip("rRbBuUfF$@#"):
            return literal[at + len(quote) : len(literal) - len(quote)]
    return literal


# --- patterns ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """What a node is to be: its kind, its value, what its fields are, and one of what its brackets hold.

    ``capture`` names the node. Matching a node takes time in proportion to the pattern and to what the brackets that it
    asks about hold; a search looks at each node of the pattern's kind once.
    """

    kind: str
    value: str | None = None
    fields: tuple[tuple[str, Pattern], ...] = ()
    holds: Pattern | None = None
    capture: str | None = None

    def match(self, node: Node | None, found: dict[str, Node] | None = None) -> dict[str, Node] | None:
        """The captures, or None without a match."""
        if node is None or node.kind != self.kind or (self.value is not None and node.value != self.value):
            return None
        found = {} if found is None else found
        for role, pattern in self.fields:
            of = node.fields.get(role)
            if of is None or of.kind != pattern.kind or pattern.match(of, found) is None:
                return None
        if self.holds is not None and not any(self.holds.match(x, found) is not None for x in node.items):
            return None
        if self.capture:
            found[self.capture] = node
        return found


def pattern(kind: str, says: str | None = None, holds: Pattern | None = None, capture: str | None = None, **fields: Pattern) -> Pattern:
    return Pattern(kind, says, tuple(fields.items()), holds, capture)


def matches(tree: Tree, patterns: tuple[Pattern, ...]) -> Iterator[dict[str, Node]]:
    """The captures of all matches, in the order of the nodes that match."""
    kinds = {p.kind for p in patterns}
    nodes = tree.by_kind[kinds.pop()] if len(kinds) == 1 else sorted((n for kind in kinds for n in tree.by_kind[kind]), key=lambda n: n.start)
    for node in nodes:
        for p in patterns:
            if p.kind == node.kind and (found := p.match(node)) is not None:
                yield found


def hits(tree: Tree, patterns: tuple[Pattern, ...]) -> bool:
    """Whether any of the patterns is anywhere in the text."""
    return next(matches(tree, patterns), None) is not None


def captured(tree: Tree, patterns: tuple[Pattern, ...], name: str) -> list[str]:
    """The texts of the nodes that matches give this name, in order."""
    return [tree.text[m[name].start : m[name].end] for m in matches(tree, patterns) if name in m]


_NAME = pattern("name", capture="callee")
#: What is called: a name, or the last name of a member.
CALLEES = (pattern("call", function=_NAME), pattern("call", function=pattern("member", property=_NAME)))
PATTERN_LITERALS = (pattern("pattern", capture="pattern"),)


def _property(name: str, *values: Pattern) -> tuple[Pattern, ...]:
    return tuple(pattern("pair", key=pattern(kind, name), value=value) for kind in ("name", "text") for value in values)


#: For each family, what rules look for in a tree by the names that facts list.
STRUCTURES: dict[str, dict[str, tuple[Pattern, ...]]] = {
    "jsts": {
        "eval": (pattern("call", function=pattern("name", "eval")), pattern("call", function=pattern("member", property=pattern("name", "eval")))),
        "function-constructor": (pattern("new", constructor=pattern("name", "Function")),),
        "unverified-tls": _property("rejectUnauthorized", pattern("name", "false")),
        "any-origin": _property("origin", pattern("name", "true"), pattern("text", "*"), pattern("list", holds=pattern("text", "*"))),
    },
}
