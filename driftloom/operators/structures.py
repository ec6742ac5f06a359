"""Structural search over tables of source texts: patterns of trees, not of characters, one pass over each text."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from driftloom.functions.parts import dealt
from driftloom.sources import lexer
from driftloom.sources.tree import Pattern, Tree, captured
from driftloom.sources.tree import hits as found


def tree_of(text: str, family: str) -> Tree:
    text = text.replace("\r\n", "\n")
    spans = lexer.spans(text, family)
    return Tree(text, lexer.masked(text, spans, strings=True), family, spans)


def _with(rows: DataFrame, column: str, text: str, family: str, look: Callable[[Tree], list[str]]) -> DataFrame:
    """rows with a column of texts that is worked out from the tree of each text; null for null texts and families without a lexer."""
    schema = StructType([*rows.schema.fields, StructField(column, ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees have no cycles, and looking for some takes a fifth of the time
        try:
            yield from looked(batches)
        finally:
            gc.enable()

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(family)).to_pylist(), strict=True)
            out = [look(tree_of(t, f)) if t is not None and f in lexer.FAMILIES else None for t, f in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, column])

    return dealt(rows).mapInArrow(run, schema)


def with_hits(rows: DataFrame, looked: dict[str, tuple[Pattern, ...]], text: str = "text", family: str = "family", column: str = "hits") -> DataFrame:
    """rows with the names of those structures that are anywhere in their text."""
    return _with(rows, column, text, family, lambda tree: [name for name, patterns in looked.items() if found(tree, patterns)])


def with_captures(rows: DataFrame, patterns: tuple[Pattern, ...], name: str, text: str = "text", family: str = "family", column: str = "captured") -> DataFrame:
    """rows with the texts of the nodes that matches give a name, in order and as often as they match."""
    return _with(rows, column, text, family, lambda tree: captured(tree, patterns, name))


def capture_rows(rows: DataFrame, patterns: tuple[Pattern, ...], name: str, text: str = "text", family: str = "family") -> DataFrame:
    """One row for each capture, with its place among those of its text, from 0."""
    out = with_captures(rows, patterns, name, text, family, "__captured")
    return out.select(*rows.columns, F.posexplode("__captured").alias("place", "captured"))
