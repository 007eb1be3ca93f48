"""Legacy archive converter: ARC records to WARC records, and back to rows.

An ARC file starts with a version block, whose second line gives the version and
whose third names the fields of the record lines: version 1 has five (URL, IP
address, date, type, length), version 2 ten (with result code, checksum,
location, offset and file name before the length). The last field is the
declared length of what follows the line. Archives
whose records are gzip members of their own (.arc.gz, .warc.gz) are read as
well; those written here are plain, since the table that holds them is
compressed as a whole.

For each ARC record a WARC record is made up: an identifier (a name-based UUID
of URL, date and digest), an ISO date, a type, a SHA-256 payload digest. Of the
records with equal payloads of at least `least` bytes the one with the smallest
id is a response, the others are revisits that carry no payload but name it.

Archives are rows (name, content), the shape that spark.read.format("binaryFile")
gives, of about ARCHIVE_BYTES each, so any task can read any of them and no
file system but Spark's is needed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_number, hot_limit, join_hot

#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
# Fixed field names of the two versions of ARC record lines.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_ARCHIVES = "name string, content binary"
_ARCHIVES_ARROW = pa.schema([("name", pa.string()), ("content", pa.binary())])


def member(data: bytes) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(content: bytes) -> Iterator[tuple[bytes, str]]:
    """The gzip members of an archive, or the archive itself if it isn't compressed, each with what is wrong with it (mostly '')."""
    if content[:2] != b"\x1f\x8b":
        yield content, ""
        return
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            data = z.decompress(content) + z.flush()
        except zlib.error as e:
            yield content, f"a gzip member can't be read: {e}"
            return
        if not z.eof:
            yield data, "the last gzip member is cut off"
            return
        yield data, ""
        content = z.unused_data


# ---------------------------------------------------------------- ARC


def arc_version_block(name: str, version: int, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 quire\n{ARC_FIELDS[version]}\n".encode()
    tail = f"{date} text/plain " + ("" if version == 1 else "200 - - 0 " + name + " ") + str(len(body))
    return f"filedesc://{name} 0.0.0.0 {tail}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, name: str, offset: int, block: bytes) -> bytes:
    extra = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind} {extra}{len(block)}\n".encode() + block + b"\n"


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, block) of each record after the version block.

    Lines are split from the right, since a URL of an old crawl may hold spaces.
    What can't be read gives a record whose only field is error, with the bytes it
    had; since nothing says where the next record begins, the member (the archive,
    if it isn't compressed) ends there.
    """
    fields: list[str] | None = None
    for data, fault in members(content):
        if fault:
            yield {"error": fault}, data
            continue
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = data.find(b"\n", at)
            if end < 0:
                yield {"error": "an ARC record line has no end"}, data[at:]
                break
            line = data[at:end].decode("utf-8", "replace").rstrip("\r")
            said = line.rpartition(" ")[2]
            if not (said.isascii() and said.isdigit()):
                yield {"error": f"an ARC record line declares no length: {line[:200]}"}, data[at:]
                break
            size = int(said)
            block = data[end + 1 : end + 1 + size]
            if len(block) < size:
                yield {"error": "an ARC record is shorter than it declares"}, data[at:]
                break
            at = end + 1 + size
            if fields is None:
                lines = block.decode("utf-8", "replace").split("\n")
                version = lines[0].split(" ")[0]
                if version not in ("1", "2"):
                    yield {"error": f"unknown ARC version {version[:20]}"}, block
                    fields = []
                else:
                    fields = lines[1].strip().split(" ") if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[int(version)].split(" ")
                continue
            parts = line.rsplit(" ", len(fields) - 1) if fields else []
            found = dict(zip(fields, parts, strict=False))
            if len(parts) != len(fields) or not {"URL", "Archive-date", "Content-type"} <= found.keys() or not re.fullmatch(r"[0-9]{8}|[0-9]{12}|[0-9]{14}", found["Archive-date"]):
                yield {"error": f"an ARC record line doesn't have the fields of its version: {line[:200]}"}, block
                continue
            yield found, block


def http_block(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields (names in lower case) and body; a block without a status line is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


def write_arc(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """Pages as ARC archives, of version 1 and 2 by turns; the payload is the html in UTF-8, null as empty."""

    def run(batches):
        serial, parts, size, made = 0, [], 0, ""
        for b in batches:
            for page, link, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                version = 1 + serial % 2
                if not parts:
                    made = f"quire-{block_number(serial):016d}.arc"
                    parts = [arc_version_block(made, version, date)]
                payload = (text or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + ("" if link is None else f"X-Url: {_one_line(link)}\r\n") + "\r\n"
                parts.append(arc_record(version, _one_line(link or "urn:none").replace(" ", "%20") or "urn:none", date, "text/html", made, size, head.encode() + payload))
                size += len(payload) + 200
                if size >= ARCHIVE_BYTES:
                    yield _archive(made, parts)
                    serial, parts, size = serial + 1, [], 0
        if parts:
            yield _archive(made, parts)

    return pages.select(F.col(id_).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, _ARCHIVES)


def _one_line(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def _archive(name: str, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], schema=_ARCHIVES_ARROW)


# ---------------------------------------------------------------- conversion

_RECORDS = "page_id long, url string, record_id string, date string, content_type string, payload_bytes long, digest string, payload binary, error string"
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def iso_date(d: str) -> str:
    """14 (or 12, 8) digits of an ARC date as a WARC date."""
    d = (d + "19700101000000"[len(d) :]) if len(d) < 14 else d
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of ARC archives (a DataFrame with a binary column content).

    A record that can't be read, and a null or empty archive's rest, is a row with
    an error and its bytes as payload; the other records of the archive stay.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                size = 0
                for fields, block in read_arc(content.as_py() or b""):
                    fault = fields.get("error")
                    head, body = ({}, block) if fault else http_block(block)
                    digest = hashlib.sha256(body).hexdigest()
                    if fault:
                        rows.append((None, None, None, None, None, len(body), digest, body if with_payload else None, fault))
                        continue
                    page = head.get("x-page-id")
                    page = page if page is not None and re.fullmatch(r"-?[0-9]{1,18}", page) else None
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {fields['Archive-date']} {digest} {page}")
                    rows.append((None if page is None else int(page), head.get("x-url"), f"<urn:uuid:{name}>", iso_date(fields["Archive-date"]), fields["Content-type"], len(body), digest, body if with_payload else None, None))
                    size += len(body) * with_payload
                    if size > 2 << 20 or len(rows) > 2000:
                        yield _batch(rows, _RECORDS_ARROW)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _RECORDS_ARROW)

    return archives.select("content").mapInArrow(run, _RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_warc(archives: DataFrame, scratch: Scratch, least: int = 100, most: int = 32 << 20) -> DataFrame:
    """ARC archives to WARC archives with revisits.

    First the digests alone are grouped (counted before the shuffle); only those
    of more than one record are kept. While that table is small it is broadcast to
    the records; beyond `most` bytes the records go to it, with their payloads,
    but those of the most frequent digests, which are broadcast in any case.
    Rows that repeat the smallest id of a payload are responses too; a revisit
    refers to the record of the first of them. Records with an error are left out.
    """
    seen = convert(archives, with_payload=False).where(F.col("error").isNull() & (F.col("payload_bytes") >= least))
    same = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("first"))
    same = same.where("n > 1 and first is not null").select("digest", "n", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"))
    same = scratch.write(same, "equal")
    rows = convert(archives).where(F.col("error").isNull()).drop("error")
    n_same, n_rows = same.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    # a digest, a number and a record id: 200 bytes
    joined = rows.join(F.broadcast(same.drop("n")), "digest", "left") if n_same * 200 <= most else join_hot(rows, same, "digest", "n", hot_limit(n_rows), "left")
    kind = F.when(F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("payload_bytes") >= least), "revisit").otherwise("response")
    out = joined.withColumn("kind", kind).select("page_id", "url", "record_id", "date", "content_type", "payload_bytes", "digest", "kind", "first_page", "first_record", F.when(F.col("kind") == "response", F.col("payload")).alias("payload"))

    def run(batches):
        serial, parts, size, made = 0, [], 0, ""
        for b in batches:
            for page, url, rid, date, mime, n, digest, kind, first, record, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not parts:
                    made = f"quire-{block_number(serial):016d}.warc"
                    parts = [_warc_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, made)}>", date, "application/warc-fields", [], b"software: quire\r\nformat: WARC File Format 1.1\r\n")]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {n}\r\n\r\n".encode()
                more = [("WARC-Target-URI", url or "urn:none"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if page is not None:
                    more.append(("X-Page-Id", str(page)))
                if kind == "revisit":
                    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record), ("X-Refers-To-Page-Id", str(first))]
                parts.append(_warc_record(kind, rid, date, "application/http; msgtype=response", more, head + (payload or b"")))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(made, parts)
                    serial, parts, size = serial + 1, [], 0
        if parts:
            yield _archive(made, parts)

    return out.mapInArrow(run, _ARCHIVES)


def _warc_record(kind: str, rid: str, date: str, content_type: str, more: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in more), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for data, fault in members(content):
        if fault:
            raise ValueError(fault)
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or not data.startswith(b"WARC/", at):
                raise ValueError("a WARC record has no header")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
            size = int(head["content-length"])
            at = end + 4 + size
            if at > len(data):
                raise ValueError("a WARC record is shorter than it declares")
            yield head, data[end + 4 : at]
            at += 4


def read_warc(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, intact) of the records of WARC archives.

    A response's length and digest are taken from the payload read back (intact:
    they equal what its header says), a revisit's from its header.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in read_warc_records(content.as_py()):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, body = http_block(block)
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    said, n = head["warc-payload-digest"].partition(":")[2], int(http["content-length"])
                    digest, size = (hashlib.sha256(body).hexdigest(), len(body)) if kind == "response" else (said, n)
                    url = head["warc-target-uri"]
                    rows.append((None if page is None else int(page), None if url == "urn:none" else url, size, digest, kind, None if to is None else int(to), (digest, size) == (said, n)))
                if rows:
                    yield _batch(rows, schema)

    return archives.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def round_trip(pages: DataFrame, scratch: Scratch, least: int = 100, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to ARC archives, those to WARC archives, and these back to a row for each page.

    Null html is an empty payload; null ids and urls stay null (a null id is
    never the smallest unless all are null, and then nothing is a revisit);
    repeated rows are records of their own; other columns are ignored; no rows
    give no archives and no rows.
    """
    arcs = scratch.write(write_arc(pages, id_, url, html), "arc")
    warcs = scratch.write(write_warc(arcs, scratch, least), "warc")
    return read_warc(warcs)


def whole(intact: Column) -> Column:
    return F.when(intact, F.lit(True)).otherwise(F.raise_error(F.lit("a payload read back differs from its header")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives."""
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "warc"))
    return out.where(whole(F.col("intact"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
