"""Legacy ARC archives to WARC.

An ARC file starts with a version block; its second line names the version and
its third the fields of the header lines that follow. Version 1 has five
fields (URL, IP address, date, content type, length), version 2 ten (with
result code, checksum, location, offset and file name). Each record is a
header line and as many bytes as it declares. The converter reads either,
resynchronises on nothing but these lengths, and writes the equivalent WARC
record: a name-based UUID (of the ARC file and the record's place in it, so no
two records share one), an ISO timestamp, a type by the URL's scheme, the SHA-1
of block and payload in base 32.

Of HTTP records with equal payloads, that with the largest page id (an HTTP
header, where there is one), then the last one, is a response, and others are
revisits of it. An index of the archives' records decides that; payloads are
shuffled only if too many of them are repeated for a broadcast.

Archives are gzip files of ``bytes_per_file`` bytes or little more (a larger
record has a file of its own), which is what a task holds at once. They are
written with Spark's own text sink, one row a file, and read with its
binary-file source, so any store that Spark reaches will do.

Rows of ``round_trip``, which stores pages as ARC files, converts these and
reads the WARC files back: null html is an empty payload, a null url is
``unknown:``. Repeated rows of one page and payload are all written; those of
the largest id are all responses. A null page id ranks below any other. Ids are
cast to long. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, materialize, scratch_path

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
END = b"\r\n\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:brindle:warc")


class ArchiveError(ValueError):
    """The bytes aren't an archive of the version that they claim to be."""


@dataclass
class Record:
    """A record of either format. ``fields``: what its header says, by field name."""

    url: str
    date: str
    mime: str
    block: bytes
    ip: str = "0.0.0.0"
    fields: dict[str, str] = field(default_factory=dict)
    place: str = ""  # file name and offset, where the record was read


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[Record], version: int = 1, name: str = "archive.arc") -> bytes:
    """An ARC file of either version."""
    names = V1 if version == 1 else V2
    head = f"{version} {0 if version == 1 else 0} brindle\n{' '.join(names)}\n".encode()
    out = [_arc_line(names, Record(f"filedesc://{name}", "20000101000000", "text/plain", head), 0, name), head, b"\n"]
    at = sum(map(len, out))
    for r in records:
        out += [_arc_line(names, r, at, name), r.block, b"\n"]
        at = sum(map(len, out[-3:])) + at
    return b"".join(out)


def _arc_line(names: tuple[str, ...], r: Record, offset: int, name: str) -> bytes:
    value = {"URL": r.url, "IP-address": r.ip, "Archive-date": r.date, "Content-type": r.mime, "Result-code": r.fields.get("Result-code", "200"), "Checksum": digest(r.block), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(r.block))}
    return (" ".join(value[n] or "-" for n in names) + "\n").encode()


def read_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, its version block first."""
    line_end = data.find(b"\n")
    first = data[:line_end].decode("utf-8", "replace").split(" ")
    if line_end < 0 or not first[0].startswith("filedesc://") or not first[-1].isdigit():
        raise ArchiveError("no version block")
    start = line_end + 1
    block = data[start : start + int(first[-1])]
    lines = block.decode("utf-8", "replace").split("\n")
    version = lines[0].split(" ")[0]
    if version not in ("1", "2") or len(lines) < 2:
        raise ArchiveError(f"version {version!r}")
    names = tuple(lines[1].split(" "))
    if names[0] != "URL" or names[-1] != "Archive-length":
        raise ArchiveError(f"fields {names}")
    name = first[0].removeprefix("filedesc://")
    yield _arc_record(V1 if len(first) == 5 else names, first, block, f"{name}:0")
    at = start + len(block)
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        line_end = data.find(b"\n", at)
        values = data[at : line_end if line_end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if line_end < 0 or len(values) < len(names) or not values[-1].isdigit():
            raise ArchiveError(f"header line at byte {at}")
        # A content type or URL may hold blanks: what is left over belongs to the URL.
        over = len(values) - len(names)
        values = [" ".join(values[: over + 1]), *values[over + 1 :]]
        start, size = line_end + 1, int(values[-1])
        if start + size > len(data):
            raise ArchiveError(f"record at byte {at} is cut short")
        yield _arc_record(names, values, data[start : start + size], f"{name}:{at}")
        at = start + size


def _arc_record(names: tuple[str, ...], values: list[str], block: bytes, place: str) -> Record:
    f = dict(zip(names, values, strict=False))
    return Record(f["URL"], f["Archive-date"], f["Content-type"], block, f["IP-address"], f, place)


def timestamp(arc_date: str) -> str:
    """A date of 8 to 14 digits as WARC writes it; what is missing is the earliest there is."""
    d = arc_date if arc_date.isdigit() else ""
    d = (d + "00000101000000"[len(d) :])[:14] if len(d) >= 4 else "00010101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of an HTTP message; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}, payload


def kind_of(r: Record) -> str:
    """The WARC type of a record that revisits nothing."""
    if r.url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if r.url.startswith(("http:", "https:")) or r.block.startswith(b"HTTP/") else "resource"


def to_warc(r: Record, refers_to: Record | None = None, more: dict[str, str] | None = None) -> bytes:
    """The equivalent WARC record, without the two line ends after it."""
    kind = kind_of(r)
    if kind == "warcinfo":
        mime, block = "application/warc-fields", b"software: brindle\r\nformat: WARC File Format 1.1\r\n"
    elif kind == "response":
        mime, block = "application/http; msgtype=response", r.block
    else:
        mime, block = r.mime if r.mime and r.mime != "-" else "application/octet-stream", r.block
    payload = split_http(r.block)[1] if kind == "response" else block
    sum_ = digest(payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(r, sum_), "WARC-Date": timestamp(r.date), "WARC-Target-URI": r.url, "WARC-IP-Address": r.ip}
    if kind == "warcinfo":
        head = {k: v for k, v in head.items() if k not in ("WARC-Target-URI", "WARC-IP-Address")} | {"WARC-Filename": r.url[len("filedesc://") :]}
    if refers_to is not None and kind == "response":
        block = block[: len(block) - len(payload)]
        head |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, sum_), "WARC-Refers-To-Target-URI": refers_to.url, "WARC-Refers-To-Date": timestamp(refers_to.date)}
    head |= {"WARC-Block-Digest": "sha1:" + digest(block), "WARC-Payload-Digest": "sha1:" + sum_, **(more or {}), "Content-Type": mime, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def record_id(r: Record, payload_digest: str) -> str:
    """The same record always gets the same identifier, and no other record does."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, r.place or f'{r.url} {r.date} {payload_digest}')}>"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by name, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ArchiveError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        start, size = end + 4, int(head["Content-Length"])
        if data[start + size : start + size + 4] != END:
            raise ArchiveError(f"record at byte {at} has another length than it declares")
        yield head, data[start : start + size]
        at = start + size + 4


def arc_to_warc(data: bytes) -> bytes:
    """A whole ARC file as a WARC file."""
    return b"".join(to_warc(r) + END for r in read_arc(data))


def _inflated(raw) -> bytes:
    data = raw.as_buffer().to_pybytes()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _write(files: DataFrame, path: str, end: bytes) -> None:
    """One file a row of ``files`` (value binary), ``end`` after it."""
    rows = files.select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", end.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def write_arcs(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bytes_per_file: int = 16 << 20) -> None:
    """Store pages as an old crawler would have: ARC files of version 1 and 2 by turns."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    label = path.rstrip("/").rpartition("/")[2]

    def run(batches):
        held, size, n, task = [], 0, 0, TaskContext.get().partitionId()

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([write_arc(held, 1 + n % 2, f"{label}-{task:06}-{n:06}.arc")], pa.binary())], ["value"])

        for batch in batches:
            for r in zip(*batch.columns, strict=True):
                held.append(_page_record(*(x.as_py() for x in r)))
                size += len(held[-1].block)
                if size >= bytes_per_file:
                    yield packed()
                    held, size, n = [], 0, n + 1
        if held:
            yield packed()

    _write(rows.mapInArrow(run, "value binary"), path, b"\n")


#: What is read of an ARC record; ``sum``, ``size`` and ``page`` (its id) are null but for HTTP records.
_RECORD = "place string, url string, date string, mime string, ip string, sum string, size long, page long, block binary"


def read_arcs(spark: SparkSession, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the ARC files at ``path``, version blocks included."""

    def run(batches):
        rows, size = [], 0
        names = [c.split()[0] for c in _RECORD.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _RECORD.split(", ")]

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for raw in batch.column(0):
                data = _inflated(raw)
                for r in read_arc(data) if data else ():  # a sink without rows leaves an empty file
                    sum_ = length = page = None
                    if kind_of(r) == "response":
                        headers, payload = split_http(r.block)
                        sum_, length, page = digest(payload), len(payload), headers.get("x-page-id")
                    rows.append((r.place, r.url, r.date, r.mime, r.ip, sum_, length, None if page is None else int(page), r.block))
                    size += len(r.block)
                    if size >= batch_bytes:
                        yield packed()
                        rows, size = [], 0
        if rows:
            yield packed()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, least: int = 0, bytes_per_file: int = 16 << 20) -> None:
    """Convert the ARC files at a path, gzip or not, to WARC files.

    Of HTTP records with equal payloads of at least ``least`` bytes all but one are revisits.
    """
    records = read_arcs(spark, arc_path)
    index = materialize(records.where(F.col("size") >= least).select("sum", "page", "place", "url", "date"), "index")
    lead = index.groupBy("sum").agg(F.max(F.struct("page", "place", "url", "date")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    leads = materialize(lead.select(F.col("sum").alias("key"), "lead"), "leads")
    side = F.broadcast(leads) if is_small(leads, 200_000) else leads
    other = F.when(F.col("page").isNull() & F.col("lead.page").isNull(), F.col("place") != F.col("lead.place")).otherwise(~F.col("page").eqNullSafe(F.col("lead.page")))
    marked = records.join(side, (F.col("sum") == F.col("key")) & (F.col("size") >= least), "left").withColumn("lead", F.when(other, F.col("lead")))
    marked = marked.select("place", "url", "date", "mime", "ip", "size", "page", "block", "lead")

    def run(batches):
        held, size = [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])

        for batch in batches:
            for place, url, date, mime, ip, length, page, block, to in zip(*batch.columns, strict=True):
                record, to = Record(url.as_py(), date.as_py(), mime.as_py(), block.as_py(), ip.as_py(), place=place.as_py()), to.as_py()
                more, target = {}, None
                if length.is_valid:
                    more["X-Payload-Length"] = str(length.as_py())
                if page.is_valid:
                    more["X-Page-Id"] = str(page.as_py())
                if to is not None:
                    target = Record(to["url"], to["date"], "", b"", place=to["place"])
                    more |= {} if to["page"] is None else {"X-Refers-To-Page-Id": str(to["page"])}
                held.append(to_warc(record, target, more))
                size += len(held[-1])
                if size >= bytes_per_file:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    _write(marked.mapInArrow(run, "value binary"), warc_path, END)


def _page_record(page_id: int | None, url: str | None, payload: bytes) -> Record:
    """A page as an old crawler would have stored it: an HTTP message under a URL without blanks."""
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "unknown:")
    extra = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}Content-Length: {len(payload)}\r\n\r\n"
    return Record(clean, "20240101000000", "text/html", head.encode() + payload)


def read_pages(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """One row per response or revisit at ``path``: id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are measured anew and must be what its header says.
    """

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for head, block in read_warc(_inflated(raw)):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    size, said = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response":
                        payload = split_http(block)[1]
                        if (len(payload), digest(payload)) != (size, said):
                            raise ArchiveError(f"payload of {head['WARC-Record-ID']} has changed")
                    page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    rows.append((None if page is None else int(page), size, said, head["WARC-Type"], None if to is None else int(to)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, *, least: int = 0, bytes_per_file: int = 16 << 20, **columns) -> DataFrame:
    """Write the pages to scratch ARC files, convert these to WARC files and read them back."""
    spark = pages.sparkSession
    old, new = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(pages, old, bytes_per_file=bytes_per_file, **columns)
    convert(spark, old, new, least=least, bytes_per_file=bytes_per_file)
    return read_pages(spark, new, columns.get("id_col", "page_id"))
