"""Documents of a stream's batches as a data source: written by tasks, put in place by one commit for each batch.

A task writes its rows to a file of its own, which nobody reads before a commit names it. The commit is a small file
for each batch that lists the files of the tasks that ended well; a batch that is written again replaces its own, and the
files that it named are removed. So there is one document for each batch, whatever fails in between.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "session_documents"
_BATCH = re.compile(r"batch-(\d+)\.json")


def filesystem(path: str):  # noqa: ANN201
    """(file system, folder in it) of a path or address."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Documents:
    """What both writers share. Rows are (repo, document), the document as JSON."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/parts", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{root}/parts/{name}") as out:
            for repo, document in iterator:
                out.write(json.dumps({"repo": repo, "document": document}, ensure_ascii=False).encode() + b"\n")
                rows += 1
        return Written(name, rows)

    def put(self, messages: list, batch: int) -> None:
        files, root = filesystem(self.path)
        kept, name = [m for m in messages if m and m.rows], f"batch-{batch}.json"
        before = _read(files, f"{root}/{name}")
        part = f"{root}/{name}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as out:
            out.write(json.dumps({"batch": batch, "rows": sum(m.rows for m in kept), "parts": sorted(m.name for m in kept)}).encode())
        files.move(part, f"{root}/{name}")
        self.forget([m.name for m in messages if m and not m.rows] + (before or {}).get("parts", []))

    def forget(self, names: list[str]) -> None:
        files, root = filesystem(self.path)
        for name in names:
            try:
                files.delete_file(f"{root}/parts/{name}")
            except FileNotFoundError:
                pass


def _read(files, path: str) -> dict | None:  # noqa: ANN001
    try:
        with files.open_input_stream(path) as f:
            return json.loads(f.read())
    except (FileNotFoundError, ValueError):
        return None


class DocumentWriter(_Documents, DataSourceWriter):
    def __init__(self, path: str, batch: int) -> None:
        _Documents.__init__(self, path)
        self.batch = batch

    def commit(self, messages: list) -> None:
        self.put(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.forget([m.name for m in messages if m])


class DocumentStreamWriter(_Documents, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.put(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.forget([m.name for m in messages if m])


class SessionDocuments(DataSource):
    """``writeStream.format("session_documents").option("path", folder)``; ``write`` needs the option ``batch`` too. Rows: repo, document."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "repo string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DocumentStreamWriter:  # noqa: N802
        return DocumentStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionDocuments)


def batches(path: str) -> dict[int, dict]:
    """What each batch's commit says, by its number."""
    import pyarrow.fs

    files, root = filesystem(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    names = {int(m[1]): x.path for x in found if (m := _BATCH.fullmatch(x.base_name))}
    return {k: _read(files, names[k]) for k in sorted(names)}


def read(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """repo, document of a batch, of the last one if none is named."""
    told = batches(path)
    parts = told[max(told) if batch is None else batch]["parts"] if told else []
    rows = spark.read.schema("repo string, document string").json([f"{path.rstrip('/')}/parts/{p}" for p in parts]) if parts else spark.createDataFrame([], "repo string, document string")
    return rows.select(F.col("repo"), F.col("document"))
