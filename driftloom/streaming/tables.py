"""Tables of a stream's state in versions, with a log that says which files a version has.

A version is one entry of the log, put there under its number by a rename that fails if the number is taken: of two
writers that began at the same version one has to begin anew, and a reader sees a version wholly or not at all. Rows lie
in buckets by the hash of their key; a version names a folder for each bucket, so that a batch writes those buckets that
its keys are in and takes over the others. Folders that no kept version names are removed.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed since the version that a change began at."""


class _Store:
    """The few things that are asked of the file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = path.rstrip("/")
        at = self.path("")
        self.fs = at.getFileSystem(self.conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf)

    def path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, milliseconds of the last change) of what a folder has."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the text is now at a name that nothing was at."""
        part = self.path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.files.rename(part, self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as error:  # noqa: BLE001
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Table:
    schema: str
    key: tuple[str, ...]
    buckets: int = 16


@dataclass(frozen=True)
class Version:
    """epoch: how often all was replaced; applied: the last batch of each stream; folders: of each table's buckets."""

    number: int = 0
    epoch: int = 0
    applied: dict[str, int] = field(default_factory=dict)
    folders: dict[str, dict[int, str]] = field(default_factory=dict)


class VersionedTables:
    """Tables that change together, in a folder that all writers and readers share. The last ``keep`` versions are kept."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], keep: int = 3) -> None:
        self.spark, self.path, self.tables, self.keep = spark, path.rstrip("/"), tables, keep
        self.store = _Store(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name, _ in self.store.names("log") if name.endswith(".json"))

    def at(self, number: int) -> Version:
        entry = json.loads(self.store.text(f"log/{number:020d}.json"))
        return Version(number, entry["epoch"], entry["applied"], {t: {int(b): p for b, p in of.items()} for t, of in entry["folders"].items()})

    def head(self) -> Version:
        """The last version; the empty version 0 before the first commit."""
        while numbers := self.versions():
            try:
                return self.at(numbers[-1])
            except Exception:  # noqa: BLE001  it has been removed meanwhile: there are later ones
                if numbers[-1] in self.versions():
                    raise
        return Version()

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].key), F.lit(self.tables[table].buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of rows' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(table)).distinct().collect())

    def read(self, table: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        folders = (version or self.head()).folders.get(table, {})
        paths = [f"{self.path}/{p}" for b, p in sorted(folders.items()) if buckets is None or b in buckets]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame, buckets: list[int]) -> dict[int, str]:
        """Writes rows as these buckets, and names their folders; nothing has changed before a commit of them."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.tables[table].schema).columns
        keyed = rows.select(*columns, self.bucket(table).alias("__bucket"))
        keyed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        there = {name for name, _ in self.store.names(folder)}
        return {b: f"{folder}/__bucket={b}" if f"__bucket={b}" in there else "" for b in buckets}

    def commit(self, began: Version, folders: dict[str, dict[int, str]], applied: dict[str, int] | None = None, epoch: int | None = None, whole: bool = False) -> Version:
        """The next version: began with these buckets in place of its own, or of all of its own. Conflict if it is not next any more."""
        merged = {} if whole else {t: dict(of) for t, of in began.folders.items()}
        for table, of in folders.items():
            merged.setdefault(table, {}).update(of)
            merged[table] = {b: p for b, p in merged[table].items() if p}
        after = Version(began.number + 1, began.epoch if epoch is None else epoch, {**began.applied, **(applied or {})}, merged)
        entry = {"epoch": after.epoch, "applied": after.applied, "folders": {t: {str(b): p for b, p in of.items()} for t, of in merged.items()}}
        if (began.number and began.number not in self.versions()) or not self.store.put(f"log/{after.number:020d}.json", json.dumps(entry)):
            for of in folders.values():
                for p in of.values():
                    if p:
                        self.store.remove(p)
            raise Conflict(f"version {after.number} is there already")
        self.clean(after.number)
        return after

    def clean(self, last: int) -> None:
        """Removes versions before the kept ones, and folders that none of these names and that are older than all of these."""
        numbers = self.versions()
        kept = [n for n in numbers if n > last - self.keep]
        old = [n for n in numbers if n <= last - self.keep]
        if not old:
            return
        named = {p for n in kept for of in self.at(n).folders.values() for p in of.values()}
        for n in old:
            for of in self.at(n).folders.values():
                for p in of.values():
                    if p not in named:
                        self.store.remove(p)
            self.store.remove(f"log/{n:020d}.json")
        times = dict(self.store.names("log"))
        first = min((times.get(f"{n:020d}.json", 0) for n in kept), default=0)
        for folder, changed in self.store.names("data"):  # what was written for commits that never were
            if changed < first and not any(p.startswith(f"data/{folder}/") for p in named):
                self.store.remove(f"data/{folder}")

    def change(self, make, tries: int = 10) -> Version:  # noqa: ANN001
        """Commits what make(version) gives as arguments of ``commit``, anew from the next version if another writer was first; None: nothing."""
        for k in range(tries):
            began = self.head()
            made = make(began)
            if made is None:
                return began
            try:
                return self.commit(began, **made)
            except Conflict:
                time.sleep(0.05 * k)
        raise Conflict(f"no commit in {tries} tries")


def last_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last")).select(*key, "__last.*")


class KeyedState:
    """A table of the last result of each key, which goes on where another left it.

    A batch that runs again after a failure is known by its number and left out. Rows of another epoch than the
    state's are stale: a full refresh raises the epoch and replaces all rows. Keys that are gone stay as such, so that
    a late event cannot bring them back.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], gone: str, buckets: int = 16, keep: int = 3) -> None:
        self.schema, self.key, self.order, self.gone = schema, key, order, gone
        self.tables = VersionedTables(spark, path, {"state": Table(schema, (key,), buckets)}, keep)

    @property
    def epoch(self) -> int:
        return self.tables.head().epoch

    def rows(self, version: Version | None = None) -> DataFrame:
        return self.tables.read("state", version)

    def merge(self, batch_rows: DataFrame, batch: int, epoch: int | None = None, stream: str = "stream") -> None:
        """The last rows of the state's and the batch's; buckets without a key of the batch are not read."""

        def make(began: Version) -> dict | None:
            if (epoch is not None and epoch != began.epoch) or began.applied.get(stream, -1) >= batch:
                return None
            touched = self.tables.touched("state", batch_rows)
            old = self.tables.read("state", began, touched)
            merged = last_of(old.unionByName(batch_rows.select(*old.columns)), [self.key], self.order)
            return {"folders": {"state": self.tables.write("state", merged, touched)}, "applied": {stream: batch}}

        self.tables.change(make)

    def drop(self, keys: DataFrame) -> None:
        """Takes keys out of the state altogether: paths that are ignored and not tracked leave no trace."""

        def make(began: Version) -> dict | None:
            touched = self.tables.touched("state", keys)
            left = self.tables.read("state", began, touched).join(keys.select(self.key).distinct(), self.key, "left_anti")
            return {"folders": {"state": self.tables.write("state", left, touched)}}

        self.tables.change(make)

    def refresh(self, rows: DataFrame) -> None:
        every = list(range(self.tables.tables["state"].buckets))
        self.tables.change(lambda began: {"folders": {"state": self.tables.write("state", rows, every)}, "epoch": began.epoch + 1, "whole": True})

    def settle(self, changes: int) -> bool:
        """Whether the state was emptied because nothing has changed any more; a batch of the old epoch is stale then."""
        if changes:
            return False
        self.tables.change(lambda began: {"folders": {}, "epoch": began.epoch + 1, "whole": True})
        return True

    def live(self) -> DataFrame:
        return self.rows().where(~F.col(self.gone))
