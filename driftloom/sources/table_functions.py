"""Parsers as table functions of SQL: ``SELECT ... FROM files, LATERAL source_statements(path, content)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from driftloom.functions.paths import FAMILIES
from driftloom.operators import nodes
from driftloom.sources import manifests, syntax


def _columns(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


def _texts(arguments: dict[str, AnalyzeArgument], names: tuple[str, ...]) -> None:
    """Raises an error that names the argument that is no text, when a query is analysed."""
    for name, argument in zip(names, arguments, strict=False):
        if argument.dataType.typeName() not in ("string", "void"):
            raise TypeError(f"{name} must be a string, not {argument.dataType.simpleString()}")
    if len(arguments) != len(names):
        raise TypeError(f"wanted: {', '.join(names)}")


class SourceStatements:
    """kind, name, signature, depth, ord, lines of a source's statements, in pre-order; none for files that are not parsed."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _texts(arguments, ("path", "content"))
        return AnalyzeResult(_columns(("kind", StringType()), ("name", StringType()), ("signature", StringType()), ("depth", IntegerType()), ("ord", IntegerType()), ("lines", ArrayType(StringType()))))

    def eval(self, path: str | None, content: str | None) -> Iterator[tuple]:
        lang = nodes.lang_of(path) if path else None
        if lang is None or content is None:
            return
        waiting, order = [(n, 0) for n in reversed(syntax.parse(content, FAMILIES[lang]))], 0
        while waiting:
            node, depth = waiting.pop()
            yield node.kind, node.name, node.signature, depth, order, node.lines
            order += 1
            waiting += [(c, depth + 1) for c in reversed(node.children)]


class DriftNodes:
    """node_id, kind, name, signature, state, depth, ord, before, after of a changed file's nodes."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _texts(arguments, ("path", "before", "after"))
        texts = ArrayType(StringType())
        fields = [(c, StringType()) for c in ("node_id", "kind", "name", "signature", "state")] + [("depth", IntegerType()), ("ord", IntegerType()), ("before", texts), ("after", texts)]
        return AnalyzeResult(_columns(*fields))

    def eval(self, path: str | None, before: str | None, after: str | None) -> Iterator[tuple]:
        for n in nodes.file_nodes(path, before, after) if path else []:
            yield n["node_id"], n["kind"], n["name"], n["signature"], n["state"], n["depth"], n["pre_ord"], n["before"], n["after"]


class ManifestEntries:
    """section, name, spec, vouch_name of a manifest's entries; none for other files."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _texts(arguments, ("path", "content"))
        return AnalyzeResult(_columns(*[(c, StringType()) for c in ("section", "name", "spec", "vouch_name")]))

    def eval(self, path: str | None, content: str | None) -> Iterator[tuple]:
        reader = manifests.reader_of(path) if path else None
        if reader and content is not None:
            yield from reader(content)


class LockedNames:
    """name, loose of a lockfile's packages; loose: whether no name can be read from it, so that its text is to be searched."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        _texts(arguments, ("path", "content"))
        return AnalyzeResult(_columns(("name", StringType()), ("loose", BooleanType())))

    def eval(self, path: str | None, content: str | None) -> Iterator[tuple]:
        base = path.rsplit("/", 1)[-1] if path else ""
        if base not in manifests.LOCK_READERS or content is None:
            return
        names = manifests.LOCK_READERS[base](content)
        for name in sorted(names):
            yield name, False
        if not names and base in manifests.LOOSE and content.strip():
            yield None, True


FUNCTIONS = {"source_statements": SourceStatements, "drift_nodes": DriftNodes, "manifest_entries": ManifestEntries, "locked_names": LockedNames}


def register(spark: SparkSession) -> None:
    """Registers FUNCTIONS under their names."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
