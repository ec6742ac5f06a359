"""Source texts as ordered trees of statements, and what a piece of source calls, guards and handles.

There is no grammar: statements are cut at brackets, separators and line ends (or indentation), and named by
how they begin. Malformed texts give statements too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cache, cached_property

from . import lexer, tree

@dataclass
class Node:
    kind: str
    name: str
    signature: str | None
    lines: list[str]
    children: list[Node] = field(default_factory=list)

    def plain(self) -> dict:
        return {"kind": self.kind, "name": self.name, "signature": self.signature, "lines": self.lines, "children": [c.plain() for c in self.children]}


_OPEN, _CLOSE = "([{", ")]}"
_BRACKET, _OPENING = re.compile(r"[()\[\]{}]"), re.compile(r"[(\[{]")
_SPACE, _WORD_RUN = re.compile(r"\s*+"), re.compile(r"[\w$]++")
#: Containers within containers that are looked into.
DEEPEST = 100


@dataclass
class Source:
    """A text with its masked views, and where its brackets pair; all is found in one pass each, when first asked for."""

    text: str
    family: str

    def __post_init__(self) -> None:
        self.spans = lexer.spans(self.text, self.family)
        self.code = lexer.masked(self.text, self.spans, strings=True)

    @cached_property
    def plain(self) -> str:
        return lexer.masked(self.text, self.spans, strings=False)

    @cached_property
    def strings(self) -> list[tuple[int, int]]:
        return [(s, e) for k, s, e in self.spans if k == "string"]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Closing places of brackets by opening ones, whatever their kinds."""
        out, waiting = {}, []
        for m in _BRACKET.finditer(self.code):
            if m[0] in _OPEN:
                waiting.append(m.start())
            elif waiting:
                out[waiting.pop()] = m.start()
        return out

    def closing(self, at: int, end: int) -> int:
        """The place of the bracket that closes the one at ``at``, or end."""
        return min(self.pairs.get(at, end), end)

    @cached_property
    def bodies(self) -> tuple[list[int], list[int]]:
        """Places of opening brackets, and for each the first brace from there on that is in no other bracket; -1: none."""
        places = [m.start() for m in _OPENING.finditer(self.code)]
        braces = [-1] * len(places)
        for k in range(len(places) - 1, -1, -1):
            if self.code[places[k]] == "{":
                braces[k] = places[k]
            elif (close := self.pairs.get(places[k])) is not None:
                after = bisect_right(places, close)
                braces[k] = braces[after] if after < len(places) else -1
        return places, braces

    def body(self, start: int, end: int) -> tuple[int, int] | None:
        """The place of a declaration's block: its first brace outside round and square brackets."""
        places, braces = self.bodies
        k = bisect_left(places, start)
        if k == len(places) or not 0 <= braces[k] < end:
            return None
        return braces[k], self.closing(braces[k], end)

    @cached_property
    def ends(self) -> list[int]:
        """Places of semicolons and line ends."""
        return [m.start() for m in re.finditer(r"[;\n]", self.code)]

    def next_end(self, at: int) -> int:
        k = bisect_left(self.ends, at)
        return self.ends[k] if k < len(self.ends) else len(self.code)

    @cached_property
    def tree(self) -> tree.Tree:
        return tree.Tree(self.text, self.code, self.family, self.spans)

    @cached_property
    def calls(self) -> list[tuple[int, str]]:
        """(place, name) of what is called, the last part of a member's name, in order."""
        if "(" not in self.text:
            return []
        return [(m["callee"].start, m["callee"].value) for m in tree.matches(self.tree, tree.CALLEES)]


# --- statements of families with braces -------------------------------------------------------------------

_BLOCK_HEAD = {
    "jsts": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\b|(?:abstract\s+)?class\b|interface\b|(?:const\s+)?enum\b|namespace\b|if\b|for\b|while\b|try\b|switch\b|\{)",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?(?:fn\b|struct\b|enum\b|union\b|trait\b|impl\b|mod\b|if\b|for\b|while\b|loop\b|match\b|unsafe\b|macro_rules!|\{)",
    "go": r"(?:func\b|if\b|for\b|switch\b|select\b|\{)",
    "java": r"",
    "csharp": r"",
    "kotlin": r"",
    "swift": r"",
}
_GENERIC = r"<[^;{}()<>]*+(?:<[^;{}()<>]*+(?:<[^;{}()<>]*+>[^;{}()<>]*+)*+>[^;{}()<>]*+)*+>"
_ANY_BLOCK = re.compile(r"(?:[\w\[\]<>,.?]++[ \t]++)*?(?:class|interface|enum|record|struct|namespace|object|fun|func|init|deinit|protocol|extension|actor|if|for|foreach|while|do|try|switch|when|guard|repeat|using|lock|synchronized|static|companion)\b")
_METHOD = re.compile(r"(?:[\w.]++(?:" + _GENERIC + r")?(?:\[\])*+\??\s++)*[\w]++\s*+(?:" + _GENERIC + r")?\s*+\(")
_CONTINUES = re.compile(r"\s*+(?:else\b|catch\b|finally\b|while\b(?=\s*+\())")
_JOINS_NEXT = re.compile(r"(?:[+\-*/%=<>&|^?:,.(\[{!~]|=>|->|\b(?:return|in|of|extends|implements|where|as|is|throws|async|await|public|private|static|export|default|const|let|var|else|from|import))\Z")
_JOINS_BEFORE = re.compile(r"(?:[.?:)\]},+*/%=<>&|^]|&&|\|\||\{|->|=>|(?:else|catch|finally|where|instanceof|extends|implements|in|as|is|of|from|throws)\b)")
_NO_BRACE_BEFORE = re.compile(r"(?:[.?:)\]},+*/%=<>&|^]|&&|\|\||->|=>|(?:else|catch|finally|where|as|is|in)\b)")


_HEADS = {f: re.compile(p) for f, p in _BLOCK_HEAD.items() if p}
_GAP, _STOPS = re.compile(r"[\s;]*+"), {True: re.compile(r"[()\[\]{};\n]"), False: re.compile(r"[()\[\]{};]")}
_ATTRIBUTE, _DEFAULT_OBJECT = re.compile(r"#!?\["), re.compile(r"export\s++default\s++\{")
_LOOPS, _CHAINS = re.compile(r"(?:do|repeat)\b"), re.compile(r"(?:\w+:\s*)?(?:if|try|do|guard|\}|repeat)\b")


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|readonly|async|unsafe|extern|new|open|data|inline|suspend|lateinit|const|fileprivate|mutating|nonisolated|lazy|weak|required|convenience|default|synchronized|native|volatile|transient|strictfp|inner|value|annotation|tailrec|operator|infix|external|actual|expect|vararg|non-sealed)\s+)*"
_NOTE, _MODIFIERS = re.compile(r"@(?!interface\b)[\w.:]++(?:\s*+(\())?"), re.compile(_MODS)


def _declared(source: Source, start: int, end: int) -> int:
    """Where a statement begins after its annotations and attributes, whatever these hold."""
    code, at = source.code, start
    if source.family not in ("java", "csharp", "kotlin", "swift"):
        return at
    while at < end:
        if m := _NOTE.match(code, at, end):
            at = source.closing(m.start(1), end) + 1 if m[1] else m.end()
        elif code[at] == "[" and source.family == "csharp":
            at = source.closing(at, end) + 1
        else:
            break
        at = _SPACE.match(code, min(at, end), end).end()
    return at


def _is_block(source: Source, start: int, end: int) -> bool:
    """Whether a statement that begins here ends with its block. What a pattern runs over is part of the statement."""
    code, family = source.code, source.family
    if family in _HEADS:
        return _HEADS[family].match(code, start, end) is not None
    start = _declared(source, start, end)
    if _ANY_BLOCK.match(code, _MODIFIERS.match(code, start, end).end(), end):
        return True
    return family in ("java", "csharp") and _METHOD.match(code, start, end) is not None


def statements(source: Source, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the statements between two places outside brackets."""
    code, family, out = source.code, source.family, []
    lines_end = family in ("jsts", "go", "kotlin", "swift")
    stops = _STOPS[lines_end]
    i = start
    while i < end:
        i = _GAP.match(code, i, end).end()
        if i >= end:
            break
        if code[i] in _CLOSE:
            i += 1
            continue
        if family == "rust" and code[i] == "#" and (m := _ATTRIBUTE.match(code, i)):
            i = source.closing(m.end() - 1, end) + 1
            continue
        s, block = i, _is_block(source, i, end)
        if family == "jsts" and block and _DEFAULT_OBJECT.match(code, i):
            block = False
        while i < end:
            m = stops.search(code, i, end)
            if not m:
                i = end
                break
            i, c = m.start(), m[0]
            if c in _OPEN:
                i = source.closing(i, end) + 1
                if c == "{" and block:
                    after = _CONTINUES.match(code, i)
                    word = after and after[0].strip()
                    if word and (word != "while" or _LOOPS.match(code, s, i)) and _CHAINS.match(code, s, i):
                        i = after.end()
                        if word == "while":
                            block = False
                        continue
                    break
                continue
            if c == ";":
                i += 1
                break
            if c in _CLOSE:
                break
            if i > s:
                stop = i
                while stop > s and code[stop - 1] in " \t":
                    stop -= 1
                following = _SPACE.match(code, i).end()
                if family == "go":
                    joins, ahead = code[stop - 1] in "+-*/%=<>&|^,.([{!", None
                else:
                    joins = _JOINS_NEXT.search(code, max(s, stop - 14), stop)
                    ahead = (_JOINS_BEFORE if family == "jsts" or block else _NO_BRACE_BEFORE).match(code, following)
                    if family == "jsts" and ahead and ahead[0] == "{" and not block:
                        ahead = None
                if ahead:
                    i = following
                    continue
                if not joins:
                    break
            i += 1
        stop = min(i, end)
        while stop > s and code[stop - 1].isspace():
            stop -= 1
        if stop > s:
            out.append((s, stop))
        i = max(i, s + 1)
    return out


def node_lines(text: str, start: int, end: int) -> list[str]:
    """Lines of a statement, the later ones without the blanks that its first line stands behind."""
    column = start - (text.rfind("\n", 0, start) + 1)
    first, *rest = text[start:end].split("\n")
    out = [first]
    for line in rest:
        leading = len(line) - len(line.lstrip(" \t"))
        out.append(line[min(leading, column) :])
    return out


def snippet(text: str, start: int, end: int, cap: int) -> str:
    stop = text.find("\n", start, end)
    line = text[start : end if stop < 0 else stop].strip().removesuffix(";")
    return line[:cap] + "…" if len(line) > cap else line


def _first_string(source: Source, start: int, end: int) -> str | None:
    k = bisect_left(source.strings, (start, start))
    if k == len(source.strings) or source.strings[k][1] > end:
        return None
    s, e = source.strings[k]
    return source.text[s:e].strip("\"'`")


@dataclass(frozen=True)
class Shape:
    """A kind of statement: how it begins, and whether its body is looked into."""

    kind: str
    begins: str
    inside: bool = False
    signature: bool = False


SHAPES: dict[str, tuple[Shape, ...]] = {
    "jsts": (
        Shape("ImportDeclaration", r"import\b(?!\s*\()"),
        Shape("ExportDeclaration", r"export\b\s*(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:(?:function\*?|class|const\s+enum|const|let|var|interface|type|enum)\s+)?(?P<name>[\w$]+)?"),
        Shape("FunctionDeclaration", r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)?", inside=True, signature=True),
        Shape("ClassDeclaration", r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        Shape("InterfaceDeclaration", r"interface\s+(?P<name>[\w$]+)"),
        Shape("TypeAliasDeclaration", r"type\s+(?P<name>[\w$]+)\s*(?:<|=)"),
        Shape("VariableDeclaration", r"(?:const|let|var)\s+(?!enum\b)(?P<name>[\w$]+|\{[^}]*\}|\[[^\]]*\])"),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
        Shape("for_statement", r"for\b"),
        Shape("while_statement", r"while\b"),
        Shape("try_statement", r"try\b"),
        Shape("switch_statement", r"switch\b"),
        Shape("throw_statement", r"throw\b"),
        Shape("enum_declaration", r"(?:const\s+)?enum\b"),
    ),
    "rust": (
        Shape("ImportDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<name>[^;]+)"),
        Shape("FunctionDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>\w+)", inside=True, signature=True),
        Shape("VariableDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?(?:static(?:\s+mut)?|const|let(?:\s+mut)?)\s+(?P<name>\w+|\([^)]*\)|[^=:;]+)"),
        Shape("ClassDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|type)\s+(?P<name>\w+)"),
        Shape("InterfaceDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        Shape("ImplBlock", r"(?:unsafe\s+)?impl\b\s*(?P<name>[^{]*)"),
        Shape("ModuleDeclaration", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"),
        Shape("FunctionDeclaration", r"macro_rules!\s*(?P<name>\w+)"),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
    ),
    "go": (
        Shape("PackageDeclaration", r"package\s+(?P<name>\w+)"),
        Shape("ImportDeclaration", r"import\b"),
        Shape("FunctionDeclaration", r"func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)", inside=True, signature=True),
        Shape("VariableDeclaration", r"(?:const|var)\s*\(?\s*(?P<name>\w+)"),
        Shape("VariableDeclaration", r"(?P<name>\w+(?:\s*,\s*\w+)*)\s*:="),
        Shape("ClassDeclaration", r"type\s*\(?\s*(?P<name>\w+)"),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
    ),
    "java": (
        Shape("PackageDeclaration", r"package\s+(?P<name>[\w.]+)"),
        Shape("ImportDeclaration", r"import\s+(?:static\s+)?(?P<name>[\w.*]+)"),
        Shape("InterfaceDeclaration", _MODS + r"@?interface\s+(?P<name>\w+)", inside=True),
        Shape("ClassDeclaration", _MODS + r"(?:class|enum|record)\s+(?P<name>\w+)", inside=True),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
        Shape("try_statement", r"try\b"),
        Shape("for_statement", r"for\b"),
        Shape("while_statement", r"while\b"),
        Shape("throw_statement", r"throw\b"),
        Shape("FunctionDeclaration", _MODS + r"(?:<[^>]*>\s*)?(?P<type>(?!(?:assert|else|yield|case|do|throw|return)\b)[\w.]++(?:" + _GENERIC + r")?(?:\[\])*\s+)?(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws\s++[\w.,\s]++)?+(?(type)(?=\{|;)|(?=\{))", inside=True, signature=True),
        Shape("VariableDeclaration", _MODS + r"[\w.]++(?:" + _GENERIC + r")?(?:\[\])*\s+(?P<name>\w+)\s*(?:=|;|,)"),
    ),
    "csharp": (
        Shape("ImportDeclaration", r"(?:global\s+)?using\s+(?!var\b)(?:static\s+)?(?P<name>[\w.]+)\s*(?:=[^;]*)?;"),
        Shape("PackageDeclaration", r"namespace\s+(?P<name>[\w.]+)"),
        Shape("InterfaceDeclaration", _MODS + r"interface\s+(?P<name>\w+)", inside=True),
        Shape("ClassDeclaration", _MODS + r"(?:class|struct|record(?:\s+struct)?|enum)\s+(?P<name>\w+)", inside=True),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
        Shape("try_statement", r"try\b"),
        Shape("for_statement", r"for(?:each)?\b"),
        Shape("while_statement", r"while\b"),
        Shape("throw_statement", r"throw\b"),
        Shape("FunctionDeclaration", _MODS + r"(?:[\w.]++(?:" + _GENERIC + r")?(?:\[\])*\??\s+)?(?P<name>\w+)\s*(?:<[^>]*>)?\s*\([^;{}]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*|where\s+[^{]*)?(?=\{|=>)", inside=True, signature=True),
        Shape("VariableDeclaration", _MODS + r"(?:using\s+)?[\w.]++(?:" + _GENERIC + r")?(?:\[\])*\??\s+(?P<name>\w+)\s*(?:=|;|,|\{)"),
    ),
    "kotlin": (
        Shape("PackageDeclaration", r"package\s+(?P<name>[\w.]+)"),
        Shape("ImportDeclaration", r"import\s+(?P<name>[\w.*]+)"),
        Shape("ClassDeclaration", _MODS + r"(?:(?:enum\s+|fun\s+)?(?:class|interface)|companion\s+object|object)\b\s*(?P<name>\w+)?", inside=True),
        Shape("FunctionDeclaration", _MODS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)", inside=True, signature=True),
        Shape("VariableDeclaration", _MODS + r"(?:val|var)\s+(?:<[^>]*>\s*)?(?P<name>[\w.]+|\([^)]*\))"),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"return\b"),
    ),
    "swift": (
        Shape("ImportDeclaration", r"(?:@\w+\s+)?import\s+(?:\w+\s+)?(?P<name>[\w.]+)"),
        Shape("ClassDeclaration", _MODS + r"(?:indirect\s+)?(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b)(?P<name>[\w.]+)", inside=True),
        Shape("InterfaceDeclaration", _MODS + r"protocol\s+(?P<name>\w+)", inside=True),
        Shape("FunctionDeclaration", _MODS + r"(?:class\s+)?(?:func\s+(?P<name>[\w+\-*/=<>!&|^~%]+)|(?P<other>init|deinit)\b)", inside=True, signature=True),
        Shape("VariableDeclaration", _MODS + r"(?:class\s+)?(?:let|var)\s+(?P<name>\w+|\([^)]*\))"),
        Shape("IfStatement", r"if\b"),
        Shape("ReturnStatement", r"(?:return|throw|break|continue)\b"),
    ),
}
_SHAPES = {f: [(s, re.compile(s.begins)) for s in shapes] for f, shapes in SHAPES.items()}


def brace_nodes(source: Source, start: int, end: int, depth: int = 0) -> list[Node]:
    out = []
    for s, e in statements(source, start, end):
        shape, name, declared = None, None, _declared(source, s, e)
        for candidate, begins in _SHAPES[source.family]:
            if m := begins.match(source.code, declared, e):
                shape = candidate
                found = m.groupdict()
                key = next((k for k in ("name", "other") if found.get(k)), None)
                name = source.text[m.start(key) : m.end(key)].strip() if key else None
                break
        if shape is None:
            out.append(Node("ExpressionStatement", snippet(source.text, s, e, 48 if source.family == "jsts" else 40), None, node_lines(source.text, s, e)))
            continue
        if shape.kind == "ImportDeclaration" and source.family in ("jsts", "go"):
            name = _first_string(source, s, e) or "import"
        elif shape.kind == "ExportDeclaration":
            name = name or "export"
        elif shape.kind in ("IfStatement", "ReturnStatement") and source.family == "jsts":
            name = "if" if shape.kind == "IfStatement" else "return"
        name = name or snippet(source.text, s, e, 40)
        body = source.body(declared, e) if shape.signature or shape.inside else None
        signature = None
        if shape.signature:
            opened = source.code.find("(", m.end(key) if key else declared, e)
            if opened >= 0:
                signature = source.text[opened : body[0] if body else e].strip() or None
        children = brace_nodes(source, body[0] + 1, body[1], depth + 1) if shape.inside and body and depth < DEEPEST else []
        out.append(Node(shape.kind, name, signature, node_lines(source.text, s, e), children))
    return out


# --- statements by indentation ----------------------------------------------------------------------------


_LOGICAL = re.compile(r"[()\[\]{}\"'\n]")


def _logical_lines(code: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(indentation, start, end) of lines joined over brackets, strings and backslashes; blank ones are left out."""
    out, i = [], start
    while i < end:
        stop, depth, j = end, 0, i
        while m := _LOGICAL.search(code, j, end):
            j, c = m.start(), m[0]
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
            elif c == "\n":
                if depth <= 0 and code[j - 1] != "\\":
                    stop = j
                    break
            else:
                close = code.find(c, j + 1, end)
                j = close if close > 0 else j
            j += 1
        line = code[i:stop]
        if line.strip():
            indent = len(line) - len(line.lstrip())
            out.append((indent, i + indent, i + len(line.rstrip())))
        i = stop + 1
    return out


_PY = (
    ("ImportDeclaration", re.compile(r"(?:import\s+(?P<name>[\w.]+)|from\s+(?P<other>[\w.]+)\s+import\b)")),
    ("FunctionDeclaration", re.compile(r"(?:async\s+)?def\s+(?P<name>\w+)")),
    ("ClassDeclaration", re.compile(r"class\s+(?P<name>\w+)")),
    ("IfStatement", re.compile(r"if\b")),
    ("ReturnStatement", re.compile(r"return\b")),
    ("try_statement", re.compile(r"try\b")),
    ("for_statement", re.compile(r"(?:async\s+)?for\b")),
    ("while_statement", re.compile(r"while\b")),
    ("with_statement", re.compile(r"(?:async\s+)?with\b")),
    ("raise_statement", re.compile(r"raise\b")),
    ("VariableDeclaration", re.compile(r"(?P<name>[\w.\[\]'\",]++(?: ++[\w.\[\]'\",]++)*+)\s*+(?::[^=]++)?+=(?!=)")),
)
_PY_CONTINUES = re.compile(r"(?:elif|else|except|finally)\b")


def python_nodes(source: Source, start: int, end: int, depth: int = 0) -> list[Node]:
    lines, out, i = _logical_lines(source.code, start, end), [], 0
    while i < len(lines):
        indent, s, e = lines[i]
        decorated = s
        while source.code[s] == "@" and i + 1 < len(lines):  # decorators belong to what follows
            i += 1
            indent, s, e = lines[i]
        head_end, j = e, i + 1
        while j < len(lines) and (lines[j][0] > indent or (lines[j][0] == indent and _PY_CONTINUES.match(source.code, lines[j][1]))):
            e = lines[j][2]
            j += 1
        kind, name = "ExpressionStatement", snippet(source.text, s, e, 48)
        for candidate, begins in _PY:
            if m := begins.match(source.code, s, e):
                kind, found = candidate, m.groupdict()
                key = next((k for k in ("name", "other") if found.get(k)), None)
                name = source.text[m.start(key) : m.end(key)].strip() if key else snippet(source.text, s, e, 40)
                break
        signature, children = None, []
        if kind == "FunctionDeclaration":
            opened = source.code.find("(", s, head_end)
            if opened >= 0:
                signature = source.text[opened:head_end].rstrip().removesuffix(":").strip() or None
            if j > i + 1 and depth < DEEPEST:
                children = python_nodes(source, source.code.rfind("\n", 0, lines[i + 1][1]) + 1, e, depth + 1)
        out.append(Node(kind, name, signature, node_lines(source.text, decorated, e), children))
        i = j
    return out


def parse(text: str, family: str) -> list[Node]:
    """The statements of a text; those of functions, and of containers where the language nests them, as children."""
    source = Source(text.replace("\r\n", "\n"), family)
    return python_nodes(source, 0, len(source.text)) if family == "python" else brace_nodes(source, 0, len(source.text))


# --- facts ------------------------------------------------------------------------------------------------

def _depths(calls: list[tuple[int, str]], ranges: list[tuple[int, int]]) -> list[int]:
    """For each call, how many of the ranges hold it."""
    starts, ends = sorted(s for s, _ in ranges), sorted(e for _, e in ranges)
    return [bisect_right(starts, place) - bisect_right(ends, place) for place, _ in calls]


def _guarded(calls: list[tuple[int, str]], ranges: list[tuple[int, int]]) -> list[str]:
    """Names of calls within ranges, once for each range that holds them, but no more often than they are called in all."""
    depths, every = _depths(calls, ranges), Counter(name for _, name in calls)
    out, held = [], Counter()
    for (_, name), depth in zip(calls, depths, strict=True):
        n = min(depth, every[name] - held[name])
        held[name] += n
        out += [name] * n
    return out


_ROUND, _BRACE, _COLON = re.compile(r"\s*+\("), re.compile(r"\s*+\{"), re.compile(r"[()\[\]{}:\n]")
#: Words before an ``if`` that begins an expression; others stand before the condition of an arm.
_RUST_BEFORE_IF = frozenset({"else", "return", "move", "in", "async", "unsafe", "loop", "break"})


def _is_statement(source: Source, k: int) -> bool:
    """Whether the word ``if`` of a token begins a statement or an expression of its own, and is no filter, arm or alternative."""
    kind, value, _, end = source.tree.found[k - 1] if k else ("mark", ";", 0, 0)
    if source.family == "python":
        start = source.tree.found[k][2]
        return not k or value in (";", ":") or source.code.find("\n", end, start) >= 0 and "\\" not in source.code[end:start]
    if source.family == "rust":
        return not (kind in ("number", "text") or value == ")" or (kind == "name" and value not in _RUST_BEFORE_IF))
    return value not in (".", "?.", "::")


def _ifs(source: Source) -> list[tuple[str, int, int]]:
    """(condition, start and end of what it guards) of every ``if``."""
    code, family, out = source.code, source.family, []
    for k, (kind, word, start, at) in enumerate(source.tree.found):
        if kind != "name" or not (word == "if" or (word == "elif" and family == "python")) or not _is_statement(source, k):
            continue
        if family == "python":
            colon = _python_colon(source, at)
            if colon is None:
                continue
            indent = start - (code.rfind("\n", 0, start) + 1)
            out.append((source.text[at:colon].strip(), colon + 1, _indented_end(code, colon, indent)))
            continue
        rest = _ROUND.match(code, at)
        if family in ("jsts", "java", "csharp", "kotlin") and rest:
            close = source.closing(rest.end() - 1, len(code))
            condition, at = source.text[rest.end() : close].strip(), close + 1
        else:
            brace = source.body(at, len(code))
            if brace is None:
                continue
            condition, at = source.text[at : brace[0]].strip(), brace[0]
        opened = _BRACE.match(code, at)
        if opened:
            begin, stop = opened.end() - 1, source.closing(opened.end() - 1, len(code)) + 1
        else:
            begin, stop = at, source.next_end(at)
            if _SPACE.match(code, at, stop).end() == stop:  # the statement is on the next line
                stop = source.next_end(stop + 1)
        out.append((condition, begin, stop))
    return out


def _python_colon(source: Source, at: int) -> int | None:
    """The colon that ends a condition, on its logical line."""
    code = source.code
    while m := _COLON.search(code, at):
        at, c = m.start(), m[0]
        if c in _OPEN:
            close = source.pairs.get(at)
            if close is None:
                return None
            at = close
        elif c in _CLOSE or (c == "\n" and code[at - 1] != "\\"):
            return None
        elif c == ":" and code[at + 1 : at + 2] != "=":
            return at
        at += 1
    return None


_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")


def _indented_end(code: str, at: int, indent: int) -> int:
    """Where the lines that are indented beyond ``indent`` end; a body on the same line ends with it."""
    line_end = code.find("\n", at)
    if line_end < 0:
        return len(code)
    end = line_end
    if code[at + 1 : line_end].strip():
        return end
    for m in _LINE.finditer(code, line_end + 1):
        if m[2].strip() and len(m[1]) <= indent:
            break
        end = m.end()
        if end >= len(code):
            break
    return end


_TRY, _PYTHON_TRY, _SWIFT_TRY, _HANDLES, _EXCEPTS = re.compile(r"\btry\b"), re.compile(r"\btry\b(?=\s*+:)"), re.compile(r"\bdo\b(?=\s*+\{)"), re.compile(r"\s*+(?:catch|finally)\b"), re.compile(r"[ \t]*+(?:except|else|finally)\b")


def _tries(source: Source) -> list[tuple[int, int]]:
    code, family, out = source.code, source.family, []
    if family in ("rust", "go"):
        return out
    for m in {"swift": _SWIFT_TRY, "python": _PYTHON_TRY}.get(family, _TRY).finditer(code):
        if family == "python":
            indent = m.start() - (code.rfind("\n", 0, m.start()) + 1)
            end = _indented_end(code, code.find(":", m.end()), indent)
            while (more := _EXCEPTS.match(code, end)) and more.end() - end:
                colon = code.find(":", more.end())
                end = _indented_end(code, colon if colon >= 0 else end, indent)
            out.append((m.start(), end))
            continue
        body = source.body(m.end(), len(code))
        if not body:
            continue
        first = _SPACE.match(code, m.end()).end()
        if first < body[0] and (family != "java" or code[first] in ";}"):
            continue
        end = body[1] + 1
        while more := _HANDLES.match(code, end):
            nxt = source.body(more.end(), len(code))
            if not nxt:
                break
            end = nxt[1] + 1
        out.append((m.start(), end))
    return out


@cache
def _clause(exits: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\s*+\{?\s*+(?:" + "|".join(re.escape(x) for x in exits) + r")(?![\w])")


def facts(text: str, family: str, exits: tuple[str, ...]) -> dict:
    """What the rules ask of one side of a node. Views that equal the text are left out."""
    source = Source(text, family)
    ifs = _ifs(source) if "if" in source.code else []
    tries = _tries(source) if "try" in source.code or "do" in source.code else []
    calls = source.calls
    clause = _clause(exits)
    return {
        "code": source.code if source.code != text else None,
        "plain": source.plain if source.plain != text else None,
        "callees": [name for _, name in calls],
        "conditions": [c for c, *_ in ifs],
        "guarded": _guarded(calls, [(s, e) for _, s, e in ifs]) if ifs else [],
        "guard_clauses": sum(bool(clause.match(source.code, s, e)) for _, s, e in ifs),
        "tries": len(tries),
        "tried": sorted({name for (_, name), d in zip(calls, _depths(calls, tries), strict=True) if d}) if tries else [],
        "patterns": tree.captured(source.tree, tree.PATTERN_LITERALS, "pattern") if any(k == "pattern" for k, *_ in source.spans) else [],
        "hits": [name for name, looked in tree.STRUCTURES.get(family, {}).items() if tree.hits(source.tree, looked)],
    }
