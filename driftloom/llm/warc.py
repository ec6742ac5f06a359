"""WARC archives: writing a record for each page, and reading archives back by boundary chains.

Readers cut archives into byte ranges. A task reports each place in its range that looks like a record's
start, with where that record would end and the next one begin. Such places also occur inside payloads. Following
the chain of ends from the start of the file tells them apart: within a range a task follows chains itself,
and between ranges pointers are doubled until they reach from the file's start to its end. Only records on
that chain are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_at_exit, may_hold, membership, scratch_path, stored

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes after which a task begins another archive, of a range that a task reads, and of a single read.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 1 << 30, 16 << 20, 1 << 18
#: Tasks that ranges are dealt to at most.
MOST_PARTS = 100_000
#: Bytes of a record that are read first: most records end within them.
FIRST_READ = 1 << 13
#: What a record begins with: a gzip member of its own, or the version line.
MAGIC = {True: b"\x1f\x8b\x08\x00", False: b"WARC/1."}
#: Of a line of a record's headers so much is kept, which holds all fields that are read; lines may be of any length.
LINE_BYTES = 1 << 12
#: HTTP headers longer than this are no record's: they are written without urls.
HEADER_BYTES = 1 << 20
#: Fields of a record that are kept.
KEPT = (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest", b"content-length")
RECORD_SCHEMA = "archive string, range int, start long, next long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, held_digest string"
FIXED_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(binary: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four times 40, and 40 bits are eight characters."""
    digest = F.sha1(binary)

    def eight(k: int) -> list[Column]:
        bits = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        return [F.substring(F.lit(ALPHABET), (F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]

    return F.concat(*[c for k in range(4) for c in eight(k)])


def filesystem(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named() -> Column:
    """A row's name: its page_id and its payload's digest."""
    return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest")


def described(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, n, digest) of all pages, without payloads, and the same with refers_to of those that revisit others."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = stored(pages.select("page_id", "url", F.octet_length(html).cast("long").alias("n"), base32_sha1(html).alias("digest")), "digests")
    last = rows.where(F.col("n") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND last IS NOT NULL")
    out = rows.join(stored(last, "responses"), (F.col("digest") == F.col("of")) & (F.col("n") >= least_bytes)).where(~F.col("last").eqNullSafe(F.col("page_id")))
    return rows, stored(out.select(*rows.columns, F.col("last").alias("refers_to")), "revisits")


def records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, n, digest, record_type, refers_to of every row; html is null for revisits. No response is exchanged.

    Revisits hold no payload, so they come from the table of digests. A filter of their names goes to all tasks, and rows
    that it does not know are responses; those that it mistakes for revisits are looked up, and taken from pages again.
    """
    every, revisits = described(pages, least_bytes)
    names = revisits.select(named().alias("name")).distinct()
    held = membership(names)
    mistaken = may_hold(every.select(named().alias("name")), F.col("name"), held).where("hit").select("name").join(names, "name", "left_anti")
    mistaken = stored(mistaken.distinct(), "mistaken")
    columns = ["page_id", "url", "html", F.octet_length("html").cast("long").alias("n"), "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")]
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    known = may_hold(rows.withColumn("name", named()), F.col("name"), held)
    out = known.where("NOT hit").select(*columns)
    if not mistaken.isEmpty():
        out = out.union(known.where("hit").join(mistaken, "name", "left_semi").select(*columns))
    return out.union(revisits.select("page_id", "url", F.lit(None).cast("binary").alias("html"), "n", "digest", F.lit("revisit").alias("record_type"), "refers_to"))


def record_bytes(page_id: int | None, url: str | None, html: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if record_type == "response" else b"")
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, compress: bool = True, least_bytes: int = 0) -> DataFrame:
    """Writes archives to folder, which all executors share; returns archive, bytes and records of each file.

    Each task writes files of its own, under names that no other attempt uses; only files of the attempts
    that ended well are in the result, so that a lost executor leaves at most files that nobody reads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                html = row["html"] if row["html"] is not None else _Absent(row["n"])
                data = record_bytes(row["page_id"], row["url"], html, row["digest"], row["record_type"], row["refers_to"])
                if compress:
                    # a header without flags and with a fixed time: records of equal content are equal bytes
                    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
                    data = MAGIC[True] + b"\0\0\0\0\0\xff" + packer.compress(data) + packer.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["archive", "bytes", "records"])

    return stored(records(pages, least_bytes).mapInArrow(run, "archive string, bytes long, records long"), "archives")


class _Absent(bytes):
    """A payload of which only the length is known."""

    def __new__(cls, n: int) -> _Absent:
        self = super().__new__(cls)
        self.n = n
        return self

    def __len__(self) -> int:
        return self.n


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.MULTILINE)
_NAME = re.compile(rb"[A-Za-z-]+:")


class Parser:
    """Takes a record's bytes in pieces, keeps the start of each header line it reads, and never the payload."""

    def __init__(self) -> None:
        self.found: dict[bytes, bytes] = {}
        self.line, self.line_size, self.lines, self.head_size = b"", 0, 0, 0
        self.fields, self.left, self.http = None, 0, b""
        self.sha, self.payload, self.in_payload, self.tail, self.bad, self.total = hashlib.sha1(), 0, False, b"", False, 0

    def head(self, data: bytes) -> bytes:
        """Takes header lines; returns what follows the empty line that ends them."""
        at = 0
        while at < len(data):
            end = data.find(b"\n", at)
            stop = len(data) if end < 0 else end
            self.line += data[at : min(stop, at + LINE_BYTES - len(self.line))]
            self.line_size += stop - at
            self.head_size += stop - at + (end >= 0)
            at = stop + 1
            if not self.lines:
                self.bad = self.line_size > 16 or not b"WARC/1."[: len(self.line)] == self.line[:7]
            elif self.line_size >= LINE_BYTES:
                self.bad = not _NAME.match(self.line)
            if self.bad:
                return b""
            if end < 0:
                return b""
            line, whole = self.line.removesuffix(b"\r"), self.line_size == len(self.line)
            if self.lines and not line:
                self.ended()
                return data[at:]
            if self.lines:
                m = _FIELD.fullmatch(line)
                name = m[1].lower() if m else b""
                self.bad = not m or (name in KEPT and not whole)
                if self.bad:
                    return b""
                if name in KEPT:
                    self.found[name] = m[2]
            self.line, self.line_size, self.lines = b"", 0, self.lines + 1
        return b""

    def ended(self) -> None:
        length = self.found.get(b"content-length", b"")
        if not length.isdigit() or b"warc-type" not in self.found:
            self.bad = True
            return
        self.fields, self.left, self.size = self.found, int(length), self.head_size + int(length) + 4

    def feed(self, data: bytes) -> None:
        self.total += len(data)
        if self.fields is None:
            data = self.head(data)
            if self.fields is None:
                return
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.tail += rest
        self.bad |= not b"\r\n\r\n".startswith(self.tail)
        if block and not self.in_payload:
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end >= 0:
                self.in_payload, block = True, self.http[end + 4 :]
                self.http = self.http[:end]
            else:
                self.bad |= len(self.http) > HEADER_BYTES
                block = b""
        if self.in_payload:
            self.sha.update(block)
            self.payload += len(block)

    @property
    def whole(self) -> bool:
        return not self.bad and self.fields is not None and self.left == 0 and self.tail == b"\r\n\r\n"

    def row(self) -> tuple:
        number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x or b"")) else None
        kind = self.fields[b"warc-type"].decode("latin-1")
        stated = dict((k.lower(), v) for k, v in _FIELD.findall(self.http.replace(b"\r\n", b"\n"))).get(b"content-length", b"0")
        size = self.payload if kind == "response" else int(stated) if stated.isdigit() else 0
        held = base64.b32encode(self.sha.digest()).decode() if kind == "response" else None
        return number(self.fields.get(b"warc-record-id")), kind, number(self.fields.get(b"warc-refers-to")), size, self.fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:"), held


def candidates(source, size: int, start: int, end: int, compress: bool) -> Iterator[tuple]:  # noqa: ANN001
    """(start, next, fields...) of all places in [start, end) that read as a whole record."""
    magic = MAGIC[compress]
    for at in range(start, end, READ_BYTES):
        stop = min(at + READ_BYTES, end)
        source.seek(at)
        held = source.read(min(stop + len(magic) - 1, size) - at)
        found = held.find(magic)
        while 0 <= found < stop - at:
            if row := record_at(source, at + found, size, compress):
                yield at + found, *row
            found = held.find(magic, found + 1)


def record_at(source, place: int, size: int, compress: bool) -> tuple | None:  # noqa: ANN001
    parser, position = Parser(), place
    unpack = zlib.decompressobj(31) if compress else None
    source.seek(place)
    step = FIRST_READ
    while position < size:
        data = source.read(min(step, size - position))
        step = READ_BYTES
        if not data:
            return None
        position += len(data)
        if unpack:
            try:
                while data and not unpack.eof:
                    parser.feed(unpack.decompress(data, READ_BYTES))
                    data = unpack.unconsumed_tail
                    if parser.bad:
                        return None
            except zlib.error:
                return None
            if unpack.eof:
                return (position - len(unpack.unused_data), *parser.row()) if parser.whole else None
        else:
            parser.feed(data if parser.fields is None else data[: parser.left + 4 - len(parser.tail)])
            if parser.fields is not None and len(parser.tail) > 4:  # the first piece may hold what follows
                parser.tail, parser.bad = parser.tail[:4], parser.tail[:4] != b"\r\n\r\n"
            if parser.bad:
                return None
            if parser.whole:
                return (place + parser.size, *parser.row())
    return None


def chain(starts: list[int], following: dict[int, int], at: int, end: int) -> list[int]:
    """The records from ``at`` on, each where the one before ends, that start before end."""
    out = []
    while at < end and at in following:
        out.append(at)
        at = following[at]
    return out


def scan(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All candidates of all ranges, as RECORD_SCHEMA; archives: (archive, bytes)."""
    ranges = archives.where("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("bytes") / range_bytes) - 1).cast("int"))).alias("range"))
    # a stated number of parts, which adaptive execution leaves as they are: rows are few, the work behind each is not
    number = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    dealt = ranges.repartition(max(1, min(int(number), MOST_PARTS)), F.col("archive"), F.col("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = filesystem(row["archive"])
                start, size, rows = row["range"] * range_bytes, row["bytes"], []
                with files.open_input_file(path) as source:
                    rows = [(row["archive"], row["range"], *x) for x in candidates(source, size, start, min(start + range_bytes, size), path.endswith(".gz"))]
                columns = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [x.strip().split(" ")[0] for x in RECORD_SCHEMA.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, RECORD_SCHEMA)


def reached(found: DataFrame, archives: DataFrame, range_bytes: int, most_ranges: int) -> DataFrame:
    """archive, range, entry: where the chain from each file's start first enters each range."""

    def exits(key: tuple, rows: pa.Table) -> pa.Table:
        """Of each candidate of a range, where its chain leaves the range."""
        end = (key[1].as_py() + 1) * range_bytes
        starts, following = rows.column("start").to_pylist(), rows.column("next").to_pylist()
        out = {}
        for s, n in sorted(zip(starts, following, strict=True), reverse=True):
            out[s] = out.get(n, n) if n < end else n
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["archive", "start", "exit"])

    heads = archives.where("bytes > 0").select("archive", F.lit(0).cast("long").alias("entry"))
    if most_ranges > 1:
        jumps = found.select("archive", "range", "start", "next").groupBy("archive", "range").applyInArrow(exits, "archive string, start long, exit long")
        jumps = stored(jumps, "jumps")
        entries = jumps.select("archive", F.col("exit").alias("start")).union(heads.select("archive", F.col("entry").alias("start"))).distinct()
        jumps = stored(jumps.join(entries, ["archive", "start"]), "jumps")
        for _ in range((most_ranges - 1).bit_length()):  # each round doubles how far a pointer reaches
            further = heads.withColumnRenamed("entry", "start").join(jumps, ["archive", "start"]).select("archive", F.col("exit").alias("entry"))
            heads = stored(heads.union(further).distinct(), "heads")
            after = jumps.select("archive", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
            jumps = stored(jumps.join(after, ["archive", "exit"], "left").select("archive", "start", F.coalesce("beyond", "exit").alias("exit")), "jumps")
    return heads.select("archive", F.floor(F.col("entry") / range_bytes).cast("int").alias("range"), "entry")


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records on each archive's chain, as RECORD_SCHEMA. Bytes past a broken chain are not records."""
    most = archives.agg(F.max(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    found = stored(scan(archives, range_bytes), "candidates")
    entries = reached(found, archives, range_bytes, int(most))

    def keep(key: tuple, rows: pa.Table, entry: pa.Table) -> pa.Table:
        if not rows.num_rows or not entry.num_rows:
            return rows.slice(0, 0)
        starts = rows.column("start").to_pylist()
        following = dict(zip(starts, rows.column("next").to_pylist(), strict=True))
        end = (key[1].as_py() + 1) * range_bytes
        own = sorted({s for e in entry.column("entry").to_pylist() for s in chain(starts, following, e, end)})
        order = {s: i for i, s in enumerate(starts)}
        return rows.take(pa.array([order[s] for s in own], pa.int64()))

    return found.groupBy("archive", "range").cogroup(entries.groupBy("archive", "range")).applyInArrow(keep, RECORD_SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0, compress: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives.

    A null html is an empty payload, a null url is replaced by a name made of the page_id. Of rows with equal
    payloads the one with the largest page_id is the response; rows of a null page_id are revisits of it, or
    responses among themselves. Rows that repeat a page_id and its payload are written alike. Other columns are
    not read. An empty table gives no archives and no rows. The digest of a response is that of its bytes as read.
    Urls may be of any length. It is an error if other than the written number of records is read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write(pages, folder, compress, least_bytes)
    drop_at_exit(pages.sparkSession, folder)
    back = stored(read(archives, range_bytes), "records")
    written, held = archives.agg(F.sum("records")).first()[0] or 0, back.count()
    if written != held:
        raise RuntimeError(f"{written} records were written, {held} were read back")
    return back.select("page_id", "payload_bytes", F.coalesce("held_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY d) AS last,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(d, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""
