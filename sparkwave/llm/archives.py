"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and readers and writers of both.

ARC header lines are parsed by the version the file declares, contents by their declared lengths.  A WARC record gets
a record id derived from its page and digest, the date of the ARC line, a type (warcinfo, response, resource or
revisit) and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread
from .token_files import _store

FILE_BYTES = 32_000_000  # of contents, before a new file is begun
DATE = "20240101000000"
# The field names of the two versions' header lines.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def arc_line(version: int, url: str, mime: str, status: int, offset: int, filename: str, length: int, ip: str = "0.0.0.0", date: str = DATE) -> bytes:
    value = {"url": url, "ip": ip, "date": date, "mime": mime, "status": status, "checksum": "-", "location": "-", "offset": offset, "filename": filename, "length": length}
    return (" ".join(str(value[f]) for f in FIELDS[version]) + "\n").encode()


NO_ID = "none"  # of pages without page_id


def http_message(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    return (head + f"X-Page-Id: {NO_ID if page_id is None else page_id}\r\n\r\n").encode() + payload


def _plain_url(url: str | None, page_id: int | None) -> str:
    """A header line is split at spaces, so white space and control characters in the URL are escaped."""
    text = url or f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def read_arc(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, content) of each record after the file's own description."""
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records are set apart by a line break
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(line[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError("the archive ends inside a record")
        if line[0].startswith("filedesc://"):
            version = int(content.split(b" ", 1)[0])
        else:
            if len(line) != len(FIELDS[version]):
                raise ValueError(f"a header line of version {version} has {len(line)} fields")
            yield at, dict(zip(FIELDS[version], line, strict=True)), content
        at = end + 1 + length


def _http(content: bytes) -> tuple[bytes | None, bytes, dict[str, str]]:
    """Head (None if the content is no HTTP response), payload, head fields."""
    if not content.startswith(b"HTTP/"):
        return None, content, {}
    head, _, payload = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + b"\r\n\r\n", payload, {k.lower(): v for k, v in fields.items()}


def _place(name: str, offset: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{name} {offset}".encode()).digest()[:8], "big") >> 1


def record_key(fields: dict[str, str], name: str, offset: int) -> int | None:
    """The page's id (None if it has none), or for foreign archives a stable number of the place."""
    known = fields.get("x-page-id")
    return None if known == NO_ID else _place(name, offset) if known is None else int(known)


def record_id(key: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{payload_digest}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or f"sha1:{digest(block)}" != fields["warc-block-digest"]:
            raise ValueError("a block doesn't have its declared length and digest")
        yield fields, block
        at = end + 4 + size + 4


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_arc(pages: DataFrame, out: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as ARC files, versions 1 and 2 by turns; returns the table of files (name).

    Each task writes files with names of its own; only those of finished tasks are in the table.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, root = _store(out)
        fs.create_dir(root, recursive=True)
        stream, size, number, name, version = None, 0, 0, "", 1
        for pdf in batches:
            for page_id, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                page_id = None if page_id is None else int(page_id)
                if stream is None:
                    version = 1 + (TaskContext.get().partitionId() + number) % 2
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    about = f"{version} 0 sparkwave\n{' '.join(FIELDS[version])}\n\n".encode()
                    stream.write(_member(arc_line(version, f"filedesc://{name}", "text/plain", 200, 0, name, len(about)) + about))
                    size, number = 0, number + 1
                content = http_message(page_id, (page or "").encode("utf-8", "surrogatepass"))
                stream.write(_member(arc_line(version, _plain_url(url, page_id), "text/html", 200, size, name, len(content)) + content + b"\n"))
                size += len(content)
                if size >= file_bytes:
                    stream.close()
                    stream = None
                    yield pd.DataFrame({"name": [name]})
        if stream is not None:
            stream.close()
            yield pd.DataFrame({"name": [name]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return _written(rows.mapInPandas(write, "name string"), f"{out}-files")


def inflate(data: bytes, step: int = 8192) -> bytes:
    """The contents of all gzip members; other files as they are.

    Members are found in small steps, so that the time grows with the file only; `gzip.decompress` copies the rest of
    the file for every member, and each record is a member.
    """
    if not data.startswith(b"\x1f\x8b"):
        return data
    at, parts = 0, []
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            piece = data[at : at + step]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        while data[at : at + 1] == b"\0":  # padding
            at += 1
    return b"".join(parts)


def _read(root_uri: str, name: str) -> bytes:
    fs, root = _store(root_uri)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
        return inflate(f.read())


def convert(files: DataFrame, source: str, out: str, least_bytes: int = 0) -> DataFrame:
    """Convert ARC files to WARC files one by one; returns the table of WARC files.

    Of records with equal payloads of at least `least_bytes`, the one with the smallest key is a response and
    the others revisit it: digests are aggregated over all files, and each file gets the list of its own revisits.
    Records without a key revisit like others, but are never revisited.  Payloads are never shuffled.
    """
    n_files = files.count()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["name"]:
                rows = []
                for offset, _, content in read_arc(_read(source, name)):
                    _, payload, fields = _http(content)
                    key = record_key(fields, name, offset)
                    rows.append((name, offset, None if key is None else str(key), len(payload), hashlib.sha256(payload).digest()))
                yield pd.DataFrame(rows, columns=["name", "offset", "key", "size", "sha"])

    found = _written(spread(files, n_files).mapInPandas(digests, "name string, offset long, key string, size long, sha binary").withColumn("key", F.col("key").cast("long")), f"{out}-digests")
    owners = found.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1")
    revisits = found.join(owners.drop("n"), ["sha", "size"]).where("owner is not null and not key <=> owner")
    lists = revisits.groupBy("name").agg(F.collect_list(F.struct("offset", "owner")).alias("revisits"))
    tasks = spread(files.join(lists, "name", "left"), n_files)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _store(out)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            for name, listed in zip(pdf["name"], pdf["revisits"], strict=True):
                owner = {x["offset"]: x["owner"] for x in listed} if listed is not None else {}
                made = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_output_stream(f"{root}/{made}", compression=None) as stream:
                    stream.write(_member(warc_record("warcinfo", [
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, made)}>"), ("WARC-Date", iso(DATE)),
                        ("WARC-Filename", made), ("Content-Type", "application/warc-fields")], f"software: sparkwave\r\nconverted-from: {name}\r\n".encode())))
                    for offset, line, content in read_arc(_read(source, name)):
                        stream.write(_member(_converted(name, offset, line, content, owner.get(offset))))
                yield pd.DataFrame({"name": [made]})

    return _written(tasks.mapInPandas(write, "name string"), f"{out}-files")


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _converted(name: str, offset: int, line: dict, content: bytes, owner: int | None) -> bytes:
    head, payload, fields = _http(content)
    key, payload_digest = record_key(fields, name, offset), digest(payload)
    common = [
        ("WARC-Record-ID", record_id(_place(name, offset) if key is None else key, payload_digest)), ("WARC-Date", iso(line["date"])), ("WARC-Target-URI", line["url"]),
        ("WARC-IP-Address", line["ip"]), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Page-Id", NO_ID if key is None else str(key)), ("X-Payload-Length", str(len(payload))),
    ]
    if owner is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(owner, payload_digest)), ("X-Refers-To-Page-Id", str(owner)), ("Content-Type", "application/http; msgtype=response")]
        return warc_record("revisit", common + more, head or b"")
    if head is None:
        return warc_record("resource", [*common, ("Content-Type", line["mime"])], content)
    return warc_record("response", [*common, ("Content-Type", "application/http; msgtype=response")], content)


def read_records(files: DataFrame, source: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, verified on reading."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["name"]:
                rows = []
                for fields, block in read_warc(_read(source, name)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    size, stated = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] != "revisit":
                        payload = _http(block)[1]
                        if (len(payload), digest(payload)) != (size, stated):
                            raise ValueError("a payload doesn't have its declared length and digest")
                    key = fields["x-page-id"]
                    rows.append((None if key == NO_ID else key, fields["warc-target-uri"], size, stated, fields["warc-type"], fields.get("x-refers-to-page-id")))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = spread(files, files.count()).mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_round_trip(spark: SparkSession, pages: DataFrame, work: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back: one row per page.

    Null html is an empty payload; empty payloads are equal to each other.  A page without id keeps its null: it revisits a
    page with an id that has its payload, or else is a response; no page revisits it.  Repeated rows with one page_id
    each give a record, all of the same type.  A null url becomes urn:page:<id>.  Pages of any length are written whole.
    An empty table gives no archive and an empty result; extra columns are ignored.
    """
    arc = write_arc(pages, f"{work}/arc")
    return read_records(convert(arc, f"{work}/arc", f"{work}/warc"), f"{work}/warc")
