"""Landed responses as a Spark data source: WARC records of HTTP responses, written, read and streamed.

An archive is a folder of ``.warc`` or ``.warc.gz`` files. A record keeps the address, the time and
the response as it came: status line, headers and bytes. The reader decodes a body by the rule of
``html.page_text``, so pages of Chinese servers come out right whatever their headers say. Files are read through Arrow's file
systems (file, hdfs, s3, gs), a record at a time; small files share a task.

    spark.dataSource.register(ResponseArchive)
    spark.read.format("responses").load("hdfs://host/landed")
    spark.readStream.format("responses").load("hdfs://host/landed")
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .html import page_text

SCHEMA = "url string, record_id string, fetched_at timestamp, status int, content_type string, charset string, headers map<string,string>, n_bytes long, html string, file string, at long"
_ARROW = pa.schema([("url", pa.string()), ("record_id", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")), ("status", pa.int32()), ("content_type", pa.string()), ("charset", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("n_bytes", pa.int64()), ("html", pa.string()), ("file", pa.string()), ("at", pa.int64())])
#: Columns that write_responses takes.
WRITTEN = "url string, record_id string, fetched_at timestamp, status int, content_type string, body binary"
#: Bytes of files that one task reads about, of bodies in an Arrow batch, of a file that the writer closes, and of a body once unpacked.
SPLIT_BYTES, BATCH_BYTES, FILE_BYTES, BODY_BYTES = 64 << 20, 8 << 20, 256 << 20, 64 << 20
_HEAD, _LINE = b"WARC/1.0\r\n", re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder within it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path).rstrip("/"))


def _opened(fs: pafs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(fs.open_input_file(path), 1 << 20)


def _headers(lines: bytes) -> dict[str, str]:
    return {m[1].decode("latin-1").strip().lower(): m[2].decode("latin-1").strip() for m in _LINE.finditer(lines)}


class Records:
    """Whole records of an open file from a place on: (place, WARC headers, response). An unfinished one ends them, as does one that is no record; ``at`` is then where the next one would begin."""

    def __init__(self, stream, at: int, size: int | None):
        self.stream, self.at, self.size = stream, at, size

    def _head(self) -> tuple[dict[str, str], int] | None:
        if self.stream.read(len(_HEAD)) != _HEAD:
            return None
        lines = []
        while True:
            line = self.stream.readline()
            if not line.endswith(b"\n"):
                return None
            if line == b"\r\n":
                break
            lines.append(line)
        own = _headers(b"".join(lines))
        length = own.get("content-length", "")
        return (own, len(_HEAD) + sum(map(len, lines)) + 2) if length.isdigit() else None

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        while self.size is None or self.at < self.size:
            found = self._head()
            if found is None:
                return
            own, head = found
            length = int(own["content-length"])
            body = self.stream.read(length)
            if len(body) < length or self.stream.read(4) != b"\r\n\r\n":
                return
            place, self.at = self.at, self.at + head + length + 4
            yield place, own, body

    def skip(self) -> int:
        """Where the last whole record ends, without reading bodies."""
        while self.at < self.size:
            found = self._head()
            if found is None or self.at + found[1] + int(found[0]["content-length"]) + 4 > self.size:
                break
            self.at += found[1] + int(found[0]["content-length"]) + 4
            self.stream.seek(self.at)
        return self.at


def _unpacked(data: bytes, how: str) -> bytes:
    """A gzip or deflate body, up to a bound; the bytes themselves where they are not packed so."""
    if how not in ("gzip", "x-gzip", "deflate"):
        return data
    try:
        return zlib.decompressobj(47).decompress(data, BODY_BYTES)
    except zlib.error:
        return data


def response_row(file: str, place: int, own: dict[str, str], response: bytes) -> tuple | None:
    """A record's row; None for records of other types. A response without a status line has null status and its bytes as body."""
    if own.get("warc-type") != "response":
        return None
    head, cut, body = response.partition(b"\r\n\r\n")
    line = re.match(rb"HTTP/[\d.]+ (\d{3})", head)
    if not (line and cut):
        head, body = b"", response
    headers = _headers(head.partition(b"\r\n")[2])
    body = _unpacked(body, headers.get("content-encoding", "").lower())
    content_type = headers.get("content-type")
    html, charset = page_text(body, content_type)
    try:
        fetched = datetime.strptime(own.get("warc-date", ""), "%Y-%m-%dT%H:%M:%S.%fZ" if "." in own.get("warc-date", "") else "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    except ValueError:
        fetched = None
    return own.get("warc-target-uri"), own.get("warc-record-id"), fetched, int(line[1]) if line and cut else None, content_type, charset, list(headers.items()), len(body), html, file, place


@dataclass
class Span(InputPartition):
    """Parts of files that one task reads: path, first byte, and the byte before which records begin (None: all)."""

    parts: list[tuple[str, int, int | None]]


def _read(folder: str, parts: list[tuple[str, int, int | None]]) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(folder)
    rows, size = [], 0
    for path, lo, hi in parts:
        packed = path.endswith(".gz")
        # a packed file cannot be entered in its middle; it is read as a stream
        stream = gzip.GzipFile(fileobj=_opened(fs, path)) if packed else _opened(fs, path)
        with stream:
            if lo and not packed:
                stream.seek(lo)
            for place, own, response in Records(stream, 0 if packed else lo, hi):
                row = response_row(path, place, own, response)
                if row is not None:
                    rows.append(row)
                    size += len(response)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _files(folder: str) -> list[tuple[str, int]]:
    """Archive files of a folder and their sizes, by name; hidden and temporary ones are left out."""
    fs, base = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and re.search(r"\.warc(\.gz)?$", f.base_name))


def _packed(parts: list[tuple[str, int, int | None]], sizes: dict[str, int], limit: int) -> list[Span]:
    """Parts dealt to tasks of about ``limit`` bytes."""
    out, own, total = [], [], 0
    for path, lo, hi in parts:
        n = (sizes[path] if hi is None else hi) - lo
        if own and total + n > limit:
            out.append(Span(own))
            own, total = [], 0
        own.append((path, lo, hi))
        total += n
    return [*out, Span(own)] if own else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.limit = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        files = _files(self.folder)
        return _packed([(p, 0, None) for p, _ in files], dict(files), self.limit) or [Span([])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.parts)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last file that has landed and the end of its last whole record. Files land in the order of their names and only the last one may still grow; a packed file counts once it is there."""

    def __init__(self, options: dict):
        self.folder, self.limit = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        if not files:
            return self.initialOffset()
        path, size = files[-1]
        if path.endswith(".gz"):
            return {"file": path, "at": size}
        fs, _ = file_system(self.folder)
        with _opened(fs, path) as stream:
            at = self.ends.get(path, 0)
            stream.seek(at)
            end = Records(stream, at, size).skip()
        self.ends = {path: end}
        return {"file": path, "at": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        sizes, parts = dict(_files(self.folder)), []
        for path in sorted(sizes):
            lo = start["at"] if path == start["file"] else 0
            hi = end["at"] if path == end["file"] else sizes[path]
            if start["file"] <= path <= end["file"] and lo < hi:
                parts.append((path, lo, None if path.endswith(".gz") else hi))
        return _packed(parts, sizes, self.limit) or [Span([])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.parts)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offset."""


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Files appear under their names when all tasks are done, so readers never see a half-written one, and what a lost task wrote is never seen."""

    def __init__(self, options: dict):
        self.folder, self.most, self.job = options["path"], int(options.get("filebytes", FILE_BYTES)), f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, base = file_system(self.folder)
        fs.create_dir(f"{base}/_landing-{self.job}", recursive=True)
        files, out, size = [], None, 0
        task = TaskContext.get()
        try:
            for batch in iterator:
                for row in batch.select(["url", "record_id", "fetched_at", "status", "content_type", "body"]).to_pylist():
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        files.append(f"{self.job}-{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId()}.warc")
                        out, size = fs.open_output_stream(f"{base}/_landing-{self.job}/{files[-1]}"), 0
                    record = record_bytes(**row)
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, base = file_system(self.folder)
        for m in messages:
            for f in m.files if m is not None else ():
                fs.move(f"{base}/_landing-{self.job}/{f}", f"{base}/{f}")
        self._clear(fs, base)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/_landing-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_landing-{self.job}")


def record_bytes(url: str | None, record_id: str | None, fetched_at: datetime | None, status: int | None, content_type: str | None, body: bytes | None) -> bytes:
    """One response as a WARC record. Line ends within values become spaces."""
    plain = lambda v: re.sub(r"[\r\n]+", " ", v).encode("utf-8")
    data = body or b""
    head = [f"HTTP/1.1 {200 if status is None else status} -".encode()]
    if content_type is not None:
        head.append(b"Content-Type: " + plain(content_type))
    response = b"\r\n".join([*head, f"Content-Length: {len(data)}".encode()]) + b"\r\n\r\n" + data
    lines = [b"WARC-Type: response", f"Content-Length: {len(response)}".encode()]
    lines += [b"WARC-Target-URI: " + plain(url)] if url is not None else []
    lines += [b"WARC-Record-ID: " + plain(record_id)] if record_id is not None else []
    if fetched_at is not None:
        at = fetched_at if fetched_at.tzinfo else fetched_at.replace(tzinfo=timezone.utc)
        lines.append(f"WARC-Date: {at.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%S.%fZ}".encode())
    return _HEAD + b"\r\n".join(lines) + b"\r\n\r\n" + response + b"\r\n\r\n"


class ResponseArchive(DataSource):
    """Format ``responses``: options path, splitBytes (reading) and fileBytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("the responses source needs a path")
        return options

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._options())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives only grow: write with mode append")
        return _Writer(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResponseArchive)


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("responses").load(folder)


def stream_responses(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("responses").load(folder)


def write_responses(rows: DataFrame, folder: str) -> None:
    """Append rows (the columns of WRITTEN, others ignored) to an archive."""
    register(rows.sparkSession)
    names = [c.split()[0] for c in WRITTEN.split(", ")]
    rows.select(*names).write.format("responses").mode("append").save(folder)
