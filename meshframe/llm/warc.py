"""Legacy archive conversion: ARC files of versions 1 and 2 into WARC, and WARC reading.

An ARC file opens with a filedesc record, whose body names the version and the fields of the header lines that follow.
Each record is a header line and as many bytes as it declares. The reader takes ARC files from storage, plain or gzipped (with a
member for each record or for all), as rows; the converter takes the fields by the version, and makes of each record the
identifier, timestamp, type and digests that a WARC record has. Records with equal payloads become revisits of the one with the
smallest page_id; only digests and ids meet for that. Readers hold one record at a time, not a file unpacked. A file that breaks off
is an error, or is put aside: its whole records count, and a table names the place of the break.

Archives are written by Spark as gzipped files, each a valid file that opens with its filedesc or warcinfo record. A file is closed before
the record that would take it above a number of bytes, so only a record that is larger by itself makes a larger one. Payloads may be any
bytes, of a record up to 1 GB. A file is one gzip member, as Spark's writer makes it; readers take many.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import store

#: Fixed values of the formats.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

LEAST_PAYLOAD = 100
#: Bytes of a written archive before it is compressed, records handled together, and duplicated digests that are sent to all tasks.
FILE_BYTES, TOGETHER, MOST_BROADCAST = 32 << 20, 64, 100_000
#: Files up to this are read by Spark; a task opens larger ones itself and reads them as they come. Bytes of a read, and of a header line at most.
IN_MEMORY, READ_BYTES, LINE_BYTES = 64 << 20, 1 << 20, 1 << 20
#: How hard archives are compressed.
LEVEL = "DEFAULT_COMPRESSION"
#: The protocol header under which pages keep their id in an archive; of a null id it is -.
PAGE = b"X-Page: "


class Record(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    content_type: str
    head: bytes
    payload: bytes


#: What reading a damaged file raises.
DAMAGES = (ValueError, EOFError, zlib.error, gzip.BadGzipFile)


def contents(source: BinaryIO) -> BinaryIO:
    """The bytes of a plain or gzipped file, of all its members, as they are read."""
    gzipped = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    return gzip.GzipFile(fileobj=source) if gzipped else io.BufferedReader(source, READ_BYTES)


def unpacked(raw: bytes) -> bytes:
    """The bytes of a plain or gzipped file, of all its members, at once."""
    try:
        return contents(io.BytesIO(raw)).read()
    except DAMAGES as e:
        raise ValueError(f"a gzip member that is damaged or cut short: {e}") from e


def _taken(source: BinaryIO, size: int) -> bytes:
    """The next bytes, as many as there are; a declared length that isn't true asks for no memory."""
    parts = []
    while size > 0 and (part := source.read(min(size, READ_BYTES))):
        parts.append(part)
        size -= len(part)
    return parts[0] if len(parts) == 1 else b"".join(parts)


def _line(source: BinaryIO, at: int) -> bytes:
    line = source.readline(LINE_BYTES)
    if line.strip(b"\r\n") and not line.endswith(b"\n"):
        raise ValueError(f"a header line without an end at byte {at}")
    return line


def arc_file(version: int, records: list[tuple[str, str, str, str, bytes]], origin: str = "crawl") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, body) records."""
    body = f"{version} 0 {origin}\n{FIELDS[version]}\n\n".encode()
    out = [_arc_line(version, "filedesc://made.arc", "0.0.0.0", "20240101000000", "text/plain", body, 0), body, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, own in records:
        line = _arc_line(version, url, ip, date, kind, own, at)
        out += [line, own, b"\n"]
        at += len(line) + len(own) + 1
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, body: bytes, at: int) -> bytes:
    rest = [ip, date, kind] if version == 1 else [ip, date, kind, "200", "-", "-", str(at), "made.arc"]
    return " ".join([url, *rest, str(len(body))]).encode() + b"\n"


def _length(text: str, at: int) -> int:
    if not text.isdecimal():
        raise ValueError(f"an ARC record of length {text} at byte {at}")
    return int(text)


def _body(source: BinaryIO, length: int, at: int) -> bytes:
    body = _taken(source, length)
    if len(body) != length:
        raise ValueError(f"an ARC record cut short at byte {at}")
    return body


def read_arc(data: bytes | BinaryIO) -> Iterator[Record]:
    """The records of an ARC file by its version's header lines and the declared lengths; filedesc comes as warcinfo."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    at, fields = 0, FIELDS[1].split()
    while raw := _line(source, at):
        own, at = at, at + len(raw)
        line = raw.strip(b"\r\n").decode("utf-8", "replace")
        if not line:
            continue
        opening, body = line.startswith("filedesc://"), b""
        if opening:  # its own line has the fields of version 1 or 2; the declared length is last in both
            body = _body(source, _length(line.rsplit(" ", 1)[-1], own), own)
            head = body.decode("utf-8", "replace").splitlines()
            version = _length(" ".join(head[:1]).partition(" ")[0], own)
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = head[1].split() if len(head) > 1 and head[1].strip() else FIELDS[version].split()
            if not {"URL", "IP-address", "Archive-date", "Content-type", "Archive-length"} <= {*fields}:
                raise ValueError(f"an ARC file with the fields {fields}")
        parts = line.rsplit(" ", len(fields) - 1)  # the URL may hold spaces
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header line of {len(parts)} fields at byte {own}")
        named = dict(zip(fields, parts, strict=True))
        length = _length(named["Archive-length"], own)
        body = body if opening else _body(source, length, own)
        at += length
        d = named["Archive-date"].ljust(14, "0")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        url = named["URL"]
        if opening:
            yield Record(url, named["IP-address"], date, "warcinfo", "application/warc-fields", b"", body)
        elif body.startswith(b"HTTP/") and b"\r\n\r\n" in body:
            cut = body.index(b"\r\n\r\n") + 4
            yield Record(url, named["IP-address"], date, "response", "application/http; msgtype=response", body[:cut], body[cut:])
        else:
            yield Record(url, named["IP-address"], date, "resource", named["Content-type"], b"", body)


def record_id(date: str, key: str, digest: str) -> str:
    """The same for the same page, date and payload, so that a revisit can name it without a look-up."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{date} {key} {digest}')}>"


def warc_record(record: Record, digest: str, key: str, refers_to: str | None = None, of_page: int | None = None) -> bytes:
    """The WARC record, without the last line end. With refers_to it's a revisit: the protocol's head alone, under the full payload's digest."""
    revisit = refers_to is not None
    block = record.head if revisit else record.head + record.payload
    head = {
        "WARC-Type": "revisit" if revisit else record.kind, "WARC-Record-ID": record_id(record.date, key, digest), "WARC-Date": record.date, "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to, "X-Refers-To-Page": str(of_page)} if revisit else {}), "X-Payload-Length": str(len(record.payload)), **({"X-Page": key} if key else {}), "Content-Type": record.content_type, "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n"


def read_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared lengths."""
    source, at = io.BytesIO(data) if isinstance(data, bytes) else data, 0
    while raw := source.readline(LINE_BYTES):
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        own, at, head = at, at + len(raw), {}
        while (raw := _line(source, at)) != b"\r\n":
            name, colon, value = raw.decode("utf-8", "replace").strip("\r\n").partition(": ")
            if not colon:
                raise ValueError(f"a WARC record whose head breaks off at byte {at}")
            head[name], at = value, at + len(raw)
        n = int(head["Content-Length"])
        block = _taken(source, n)
        at += 2 + n + 4
        if len(block) != n or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"a WARC record of another length than it declares at byte {own}")
        yield head, block


def _page_id(record: Record) -> tuple[bool, int | None]:
    """Whether the record names its page, and which."""
    at = record.head.find(b"\r\n" + PAGE)
    if at < 0:
        return False, None
    value = record.head[at + 2 + len(PAGE) : record.head.index(b"\r\n", at + 2)]
    return True, None if value == b"-" else int(value)


class _Contents:
    """The contents of the files of a task, each closed before the record that would make it larger than `most` bytes or `records` records."""

    def __init__(self, line_end: bytes, most: int, records: int | None):
        self.line_end, self.most, self.records = line_end, most, records
        self.held: list[bytes] = []
        self.size = 0

    def full(self, size: int) -> bool:
        """Whether a record of this size needs a new file; one that has but its opening record takes any."""
        return not self.held or (len(self.held) > 1 and (self.size + size + len(self.line_end) > self.most or len(self.held) == self.records))

    def add(self, record: bytes) -> None:
        self.held.append(record)
        self.size += len(record) + len(self.line_end)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The file as one value, without its last line end."""
        if self.held:
            value = self.line_end.join(self.held)
            self.held, self.size = [], 0
            yield pa.record_batch({"value": pa.array([value], pa.binary())})


def _arc_rows(batches: Iterator[pa.RecordBatch], date: str, file_bytes: int, records: int | None) -> Iterator[pa.RecordBatch]:
    """ARC files, a row each; versions take turns by file."""
    files, version = _Contents(b"\n", file_bytes, records), 2
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html")]
        for lo in range(0, batch.num_rows, TOGETHER):
            for page, url, html in zip(*(c.slice(lo, TOGETHER).to_pylist() for c in columns), strict=True):
                raw = html.encode() if isinstance(html, str) else html or b""
                own = b"".join((b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", PAGE, b"-" if page is None else str(page).encode(), b"\r\nContent-Length: ", str(len(raw)).encode(), b"\r\n\r\n", raw))
                name = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
                line = partial(_arc_line, ip="0.0.0.0", date=date, kind="text/html", body=own)
                if files.full(len(own) + len(line(version, name, at=files.size))):
                    yield from files.close()
                    version = 3 - version
                    opening = f"{version} 0 crawl\n{FIELDS[version]}\n\n".encode()
                    files.add(_arc_line(version, "filedesc://made.arc", "0.0.0.0", date, "text/plain", opening, 0) + opening)
                files.add(line(version, name, at=files.size) + own)
    yield from files.close()


_RECORDS = "file string, place long, named boolean, page_id long, url string, ip string, date string, kind string, content_type string, head binary, payload binary"
#: The kind of the row that tells where a file breaks off.
BROKEN = "broken"


def _open(uri: str) -> BinaryIO:
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _found(file: str, content: bytes | None, aside: bool) -> Iterator[tuple]:
    """The rows of an ARC file. With aside, the last one of a damaged file has the kind broken and says why."""
    place = 0
    try:
        with contents(_open(file) if content is None else io.BytesIO(content)) as source:
            for r in read_arc(source):
                yield file, place, *_page_id(r), r.url, r.ip, r.date, r.kind, r.content_type, r.head, r.payload
                place += 1
    except DAMAGES as e:
        if not aside:
            raise ValueError(f"{file}: {e}") from e
        yield file, place, False, None, None, None, None, BROKEN, str(e), None, None


def _arc_records(batches: Iterator[pa.RecordBatch], aside: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    made = lambda rows: pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, size = [], 0
            for row in _found(file.as_py(), content.as_py(), aside):
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) == TOGETHER or size > FILE_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def _opening(date: str) -> bytes:
    body = b"software: arc converter\r\nformat: WARC File Format 1.1\r\n"
    digest = hashlib.sha256(body).hexdigest()
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(date, "warcinfo", digest), "WARC-Date": date, "WARC-Block-Digest": f"sha256:{digest}", "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n"


def _serialised(batches: Iterator[pa.RecordBatch], file_bytes: int, records: int | None) -> Iterator[pa.RecordBatch]:
    """WARC files, a row each."""
    files = _Contents(b"\r\n", file_bytes, records)
    for batch in batches:
        for lo in range(0, batch.num_rows, TOGETHER):
            for row in batch.slice(lo, TOGETHER).to_pylist():
                record = Record(*(row[c] for c in Record._fields))
                first, n = row["first_page"], len(record.payload)
                key = "" if row["page_id"] is None else str(row["page_id"])
                again = n >= LEAST_PAYLOAD and first is not None and first != row["page_id"]
                of = record_id(record.date, str(first), row["digest"]) if again else None
                made = warc_record(record, row["digest"], key, of, first if again else None)
                if files.full(len(made)):
                    yield from files.close()
                    files.add(_opening(record.date))
                files.add(made)
    yield from files.close()


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string"


def _of_archive(file: str, content: bytes | None) -> Iterator[tuple]:
    with contents(_open(file) if content is None else io.BytesIO(content)) as source:
        for head, block in read_warc(source):
            kind = head["WARC-Type"]
            if kind == "warcinfo":
                continue
            digest, length = head["WARC-Payload-Digest"].split(":", 1)[1], int(head["X-Payload-Length"])
            if kind in ("response", "resource"):
                payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else block
                if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't the one that was written")
            yield int(head["X-Page"]) if "X-Page" in head else None, length, digest, kind, int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None, head["WARC-Record-ID"], head["WARC-Target-URI"]


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in _READ.split(", ")]
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            found = _of_archive(file.as_py(), content.as_py())
            while rows := list(itertools.islice(found, 4096)):
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, content) of the files; content is null for those that tasks open themselves."""
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    large = files.filter(F.col("length") > IN_MEMORY).select("path", F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= IN_MEMORY).select("path", "content").union(large)


def read_arcs(spark: SparkSession, path: str, glob: str | None = None, *, aside: bool = False) -> DataFrame:
    """A row for each record of the ARC files under path, of either version, plain or gzipped: where it is and its parts.

    page_id is the id that write_arcs has put into the record (named tells whether there is one). Records of the file itself have
    the kind warcinfo. A file that breaks off, or whose lengths don't hold, is an error; with aside, the records before the break
    are there and a row of the kind broken has the reason as content_type. Empty files have no records.
    """
    return _files(spark, path, glob).mapInArrow(partial(_arc_records, aside=aside), _RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record but warcinfo of the gzipped WARC files under path; files may have many gzip members."""
    return _files(spark, path, "*.gz").mapInArrow(_archived, _READ)


def _written(files: DataFrame, path: str, line_end: str, level: str) -> None:
    """A gzipped file for each binary value: the text writer puts out the bytes of a string as they are."""
    files.select(F.col("value").cast("string")).write.options(compression="gzip", lineSep=line_end, maxRecordsPerFile=1).option("zlib.compress.level", level).text(path)


def write_arcs(pages: DataFrame, path: str, *, date: str = "20240101000000", file_bytes: int = FILE_BYTES, records: int | None = None, level: str = LEVEL) -> None:
    """The rows of pages (page_id, url, html as text or bytes) as records of gzipped ARC files of both versions under path.

    A file has at most file_bytes bytes before it is compressed, or one record, and at most `records` records, its own counted; level is
    that of Hadoop's codec. Null html is an empty payload, a null url urn:none. An empty table makes no records.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _written(pages.mapInArrow(partial(_arc_rows, date=date, file_bytes=file_bytes, records=records), "value binary"), path, "\n", level)


def convert_arcs(spark: SparkSession, arcs: str, path: str, *, glob: str | None = None, broken: str | None = None, file_bytes: int = FILE_BYTES, records: int | None = None, level: str = LEVEL) -> None:
    """WARC files under path from the ARC files under arcs, a record for each but the files' own; their sizes as in write_arcs.

    Of equal payloads of LEAST_PAYLOAD bytes or more the records with the least page_id are as they were and the others revisits
    of it; a null page_id is never the least if there is another. Repeated records of the least page_id all stay. Records of files
    that weren't made by write_arcs get an id by file and place. A damaged file fails the job; with the folder `broken`, its records before
    the damage are converted, and (file, records, error) of each such file, records as many as were whole, its own counted, is written there as Parquet; without any, a table without rows.
    """
    found = read_arcs(spark, arcs, glob, aside=broken is not None).filter("kind != 'warcinfo'")
    own = F.when(F.col("named"), F.col("page_id")).otherwise(F.shiftrightunsigned(F.xxhash64("file", "place"), 1))
    damaged = F.col("kind") == BROKEN
    found = found.select("file", "place", own.alias("page_id"), F.sha2("payload", 256).alias("digest"), *Record._fields)
    # A row for each payload, and one for each damaged file, in one pass.
    failed = F.when(damaged, F.struct("file", "place", F.col("content_type").alias("error"))).alias("failed")
    small = found.select("page_id", "digest", failed, F.length("payload").alias("n"))
    first = small.groupBy("digest", "failed").agg(F.min("page_id").alias("first_page"), F.count("*").alias("places"), F.max("n").alias("n"))
    first = store.stored(first, "payloads")
    if broken is not None:
        first.filter("failed is not null").select("failed.file", F.col("failed.place").alias("records"), "failed.error").write.parquet(broken)
    again = first.filter(F.col("n") >= LEAST_PAYLOAD).filter("places > 1 and first_page is not null").select("digest", "first_page")
    joined = found.filter(~damaged).drop("file", "place").join(store.side(again, MOST_BROADCAST), "digest", "left")
    _written(joined.mapInArrow(partial(_serialised, file_bytes=file_bytes, records=records), "value binary"), path, "\r\n", level)


def archived(pages: DataFrame, **options) -> DataFrame:
    """What reading the archives of pages back gives: pages are written as ARC files to the shared folder, and converted from there."""
    spark = pages.sparkSession
    arcs, path = store.place(spark, "arc"), store.place(spark, "warc")
    write_arcs(pages, arcs, level="BEST_SPEED", **options)  # they are read twice and no more
    convert_arcs(spark, arcs, path, **{k: v for k, v in options.items() if k in ("file_bytes", "records")})
    return read_archives(spark, path)
