"""Readers of dependency manifests and lockfiles: texts to rows of sections, names and versions.

Each reader takes a text and gives (section, name, spec, vouch_name) entries or names; ``entries`` and ``locked`` apply
the one that a path asks for to a table of files, file by file.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Entry = tuple[str, str, str, str]
# Sections that name dependencies, and the words for missing versions.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
CARGO_SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")
MANAGED, UNSPECIFIED = "(managed)", "(unspecified)"


def _json(text: str) -> dict:
    try:
        out = json.loads(text)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError):
        return {}


def _table(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def npm_entries(text: str) -> list[Entry]:
    """Dependencies of the four sections, and scripts; values that are no strings are empty."""
    doc = _json(text)
    return [(s, n, v if isinstance(v, str) else "", n) for s in (*NPM_SECTIONS, "scripts") for n, v in _table(doc.get(s)).items()]


def cargo_spec(value: object) -> str:
    if isinstance(value, str):
        return value
    t = _table(value)
    if isinstance(t.get("path"), str):
        return f"path: {t['path']}"
    if t.get("workspace") is True:
        return "workspace"
    if isinstance(t.get("version"), str):
        return t["version"]
    return f"git: {t['git']}" if isinstance(t.get("git"), str) else "(table)"


def cargo_entries(text: str) -> list[Entry]:
    """Three kinds of dependencies with those of all targets (the first wins), the workspace's, and the build script."""
    doc = _toml(text)
    found: dict[tuple[str, str], tuple[str, str]] = {}

    def take(section: str, table: object) -> None:
        for name, value in _table(table).items():
            real = _table(value).get("package")
            found.setdefault((section, name), (cargo_spec(value), real if isinstance(real, str) else name))

    for section in CARGO_SECTIONS:
        take(section, doc.get(section))
        for target in _table(doc.get("target")).values():
            take(section, _table(target).get(section))
    take("workspace.dependencies", _table(doc.get("workspace")).get("dependencies"))
    build = _table(doc.get("package")).get("build")
    out = [(s, n, spec, real) for (s, n), (spec, real) in found.items()]
    return out + ([("package", "build", build, "build")] if isinstance(build, str) else [])


def go_entries(text: str) -> list[Entry]:
    """Required modules, in blocks and on single lines; indirect ones have a section of their own."""
    out, block = [], False
    for raw in text.splitlines():
        line, _, remark = raw.partition("//")
        words = line.split()
        if block and words[:1] == [")"]:
            block = False
            continue
        if words[:1] == ["require"]:
            if words[1:2] == ["("]:
                block = True
                continue
            words = words[1:]
        elif not block:
            continue
        if len(words) >= 2:
            out.append(("indirect" if remark.strip().startswith("indirect") else "require", words[0], words[1], words[0]))
    return out


_NAME_END = re.compile(r"[=<>~! \[;@]")


def requirement(line: str) -> tuple[str, str] | None:
    """(name, spec) of a requirement line; None for blank lines, remarks and options."""
    body = line.split("#", 1)[0].strip()
    if not body or body.startswith("-"):
        return None
    return _NAME_END.split(body, maxsplit=1)[0].strip().lower(), body.split(";", 1)[0].strip()


def requirements_entries(text: str) -> list[Entry]:
    found = dict(filter(None, map(requirement, text.splitlines())))  # the last line of a name wins
    return [("requirements", n, s, n) for n, s in found.items() if n]


def pyproject_entries(text: str) -> list[Entry]:
    doc = _toml(text)
    project, poetry = _table(doc.get("project")), _table(_table(doc.get("tool")).get("poetry"))
    out: dict[tuple[str, str], str] = {}
    for line in project.get("dependencies") or []:
        if isinstance(line, str) and (r := requirement(line)):
            out[("dependencies", r[0])] = r[1]
    for extra in _table(project.get("optional-dependencies")).values():
        for line in extra if isinstance(extra, list) else []:
            if isinstance(line, str) and (r := requirement(line)):
                out.setdefault(("optional-dependencies", r[0]), r[1])
    for name, value in _table(poetry.get("dependencies")).items():
        if name.lower() != "python":
            out[("poetry", name.lower())] = value if isinstance(value, str) else cargo_spec(value)
    return [(s, n, v, n) for (s, n), v in out.items()]


def _tree(text: str) -> ET.Element | None:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None  # entities are not expanded
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def maven_entries(text: str) -> list[Entry]:
    """group:artifact of dependencies at any depth; the last one of a key wins."""
    root, found = _tree(text), {}
    for parent in root.iter() if root is not None else ():
        if _local(parent) == "dependencies":
            for d in parent:
                if _local(d) == "dependency":
                    part = {_local(c): (c.text or "").strip() for c in d}
                    if part.get("groupId") and part.get("artifactId"):
                        found[f"{part['groupId']}:{part['artifactId']}"] = part.get("version") or MANAGED
    return [("dependencies", n, v, n) for n, v in found.items()]


def nuget_entries(text: str) -> list[Entry]:
    root, found = _tree(text), {}
    for e in root.iter() if root is not None else ():
        if _local(e) == "PackageReference" and (name := e.get("Include") or e.get("Update")):
            child = next(((c.text or "").strip() for c in e if _local(c) == "Version"), "")
            found[name] = e.get("Version") or child or UNSPECIFIED
    return [("PackageReference", n, v, n) for n, v in found.items()]


def npm_lock(text: str) -> set[str]:
    doc = _json(text)
    names = {k.rsplit("node_modules/", 1)[1] for k in _table(doc.get("packages")) if "node_modules/" in k}
    return names | set(_table(doc.get("dependencies")))


def _before_version(descriptor: str) -> str:
    """The name before the @ that starts a version: a leading @ belongs to a scope."""
    d = descriptor.strip().strip("\"'")
    at = d.find("@", 1)
    return d[:at] if at > 0 else d


def yarn_lock(text: str) -> set[str]:
    lines = (x for x in text.splitlines() if x and not x[0].isspace() and not x.startswith("#") and x.rstrip().endswith(":"))
    names = {_before_version(d) for x in lines for d in x.rstrip()[:-1].strip("\"").split(",")}
    return names - {"", "__metadata"}


_PNPM_KEY = re.compile(r"^  (['\"]?)(/?)(.+?)\1:\s*(?:\{.*\})?$")


def pnpm_lock(text: str) -> set[str]:
    """Keys below ``packages``, in the three forms that name@version has had."""
    names, inside = set(), False
    for line in text.splitlines():
        if line and not line[0].isspace():
            inside = line.rstrip() == "packages:"
        elif inside and (m := _PNPM_KEY.match(line)):
            key = m[3].split("(", 1)[0]
            at = key.find("@", 1)
            if at > 0 and not (m[2] and "/" in key[at:]):
                names.add(key[:at])
            elif "/" in key:
                names.add(key.rsplit("/", 1)[0])
    return names


def toml_lock(text: str) -> set[str]:
    packages = _toml(text).get("package")
    return {p["name"] for p in packages if isinstance(p, dict) and isinstance(p.get("name"), str)} if isinstance(packages, list) else set()


def go_sum(text: str) -> set[str]:
    return {words[0] for words in map(str.split, text.splitlines()) if words}


def nuget_lock(text: str) -> set[str]:
    return {n for framework in _table(_json(text).get("dependencies")).values() for n in _table(framework)}


MANIFEST_READERS: dict[str, Callable[[str], list[Entry]]] = {
    "package.json": npm_entries,
    "Cargo.toml": cargo_entries,
    "go.mod": go_entries,
    "requirements.txt": requirements_entries,
    "pyproject.toml": pyproject_entries,
    "pom.xml": maven_entries,
}
LOCK_READERS: dict[str, Callable[[str], set[str]]] = {
    "package-lock.json": npm_lock,
    "yarn.lock": yarn_lock,
    "pnpm-lock.yaml": pnpm_lock,
    "Cargo.lock": toml_lock,
    "poetry.lock": lambda t: {n.lower() for n in toml_lock(t)},
    "go.sum": go_sum,
    "packages.lock.json": nuget_lock,
}


def reader_of(path: str) -> Callable[[str], list[Entry]] | None:
    name = path.rsplit("/", 1)[-1]
    return nuget_entries if name.endswith(".csproj") else MANIFEST_READERS.get(name)


def _by_file(files: DataFrame, rows_of: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t is not None for r in rows_of(p, t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def entries(files: DataFrame) -> DataFrame:
    """manifest, section, name, spec, vouch_name of all manifests among files (path, content)."""

    def rows_of(path: str, text: str) -> list[tuple]:
        reader = reader_of(path)
        return [(path, *e) for e in reader(text)] if reader else []

    return _by_file(files, rows_of, "manifest string, section string, name string, spec string, vouch_name string")


#: Lockfiles whose text is searched where no name could be read from them.
LOOSE = ("yarn.lock", "pnpm-lock.yaml")


def loose_texts(files: DataFrame) -> DataFrame:
    """lock_path, lock_text of lockfiles with content from which their reader takes no name."""

    def rows_of(path: str, text: str) -> list[tuple]:
        name = path.rsplit("/", 1)[-1]
        return [(path, text)] if name in LOOSE and text.strip() and not LOCK_READERS[name](text) else []

    return _by_file(files, rows_of, "lock_path string, lock_text string")


def locked(files: DataFrame) -> DataFrame:
    """lock_path, name of all lockfiles among files."""

    def rows_of(path: str, text: str) -> list[tuple]:
        reader = LOCK_READERS.get(path.rsplit("/", 1)[-1])
        return [(path, n) for n in sorted(reader(text))] if reader else []

    return _by_file(files, rows_of, "lock_path string, name string")
