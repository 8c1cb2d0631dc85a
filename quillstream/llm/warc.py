"""Legacy archive converter: ARC version 1 and 2 to WARC 1.1, and the reading of both.

An ARC file begins with a version block: its header line declares how long it is, its first line the version, its second the
fields of the header lines that follow. Every record is such a line and the declared number of bytes. A row is a key and an ARC
file, of one record or more. Defined results: a null payload is an empty one; a null url becomes ``urn:none``; rows with
equal payloads are one response (the largest id) and revisits of it; a row without an id is the response only if no row of
that payload has one, and has no id when it is read back; repeated rows of one id stay separate records of the
same kind; a file without a version block, a header line with other fields and a record shorter than declared raise
ValueError; an empty table gives an empty archive. Archives hold about PACK bytes before compression, or one longer record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parts, shared_dir, small_batches

#: Fields of the ARC header lines, by version, as version blocks name them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EPOCH = "20000101000000"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PACK = 32 << 20
#: What closes a WARC record.
END = b"\r\n\r\n"


def arc_record(url: str | None, payload: bytes, date: str = EPOCH, mime: str = "text/html", version: int = 1, file: str = "-") -> bytes:
    """One ARC record; spaces in the URL are escaped since the header line is split at spaces."""
    u = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none") or "urn:none"
    middle = f"{mime} " if version == 1 else f"{mime} 200 - - 0 {file} "
    return f"{u} 0.0.0.0 {date} {middle}{len(payload)}\n".encode() + payload + b"\n"


def arc_block(version: int = 1, file: str = "-") -> bytes:
    """The version block with which an ARC file begins."""
    return arc_record(f"filedesc://{file}", f"{version} 0 none\n{ARC_FIELDS[version]}\n".encode(), mime="text/plain", version=version, file=file)


def read_arc(file):
    """Yields the records of an ARC file, a binary file object, as dicts: its fields, version, offset, length and payload."""

    def declared(line: bytes) -> tuple[list[str], bytes]:
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if not parts[-1].isdecimal():
            raise ValueError("an ARC header line without a length")
        body = file.read(int(parts[-1]))
        if len(body) != int(parts[-1]):
            raise ValueError("an ARC record shorter than declared")
        return parts, body

    line = file.readline()
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file without a version block")
    lines = declared(line)[1].decode("utf-8", "surrogateescape").split("\n")
    version = int(lines[0].split(" ")[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    names = (lines[1].strip() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version]).split(" ")
    while True:
        at = file.tell()
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        parts, body = declared(line)
        if len(parts) != len(names):
            raise ValueError(f"an ARC header line with {len(parts)} fields, not {len(names)}")
        yield dict(zip(names, parts, strict=True)) | {"version": version, "offset": at, "length": len(body), "payload": body}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_warc(arc: dict, key: int | None, refers_to: int | None, name: str = "page") -> bytes:
    """The WARC record that corresponds to an ARC record, without the two closing line ends.

    The identifier is a name-based UUID of the key (of the payload's digest where there is none), so that reruns agree; a
    revisit holds no payload but the digest and length of the full one.
    """
    ident = lambda k: f"<urn:uuid:{uuid.uuid5(SPACE, f'{name}:{k}')}>"
    date = arc["Archive-date"]
    d = date[:14] + "00010101000000"[len(date) :]
    digest = sha1_base32(arc["payload"])
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ident(f'sha1:{digest}' if key is None else key)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(arc['payload'])}",
    ]
    if key is not None:
        head.append(f"X-Key: {key}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {ident(refers_to)}",
            f"X-Refers-To-Key: {refers_to}",
        ]
    body = b"" if revisit else arc["payload"]
    head += [f"Content-Type: {arc['Content-type']}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + body


def parse_warc(file):
    """Yields (headers, block) of every record of a binary file object, by the declared lengths."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record at the declared place")
        head = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            head[name] = value
        n = int(head["Content-Length"])
        block = file.read(n)
        if len(block) != n or file.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record does not end as declared")
        yield head, block


def arc_records(pages: DataFrame, version: int = 1) -> DataFrame:
    """pages (page_id, url, html) as ARC files of one record each: (key, arc binary)."""
    block = arc_block(version)

    def run(batches):
        for b in parts(batches):
            ids, urls, html = (b.column(i) for i in range(3))
            raw = [block + arc_record(u, h or b"", version=version) for u, h in zip(urls.to_pylist(), html.cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary())], ["key", "arc"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "key long, arc binary")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """Files of ARC records at path, gzip or plain, as ARC files of one record each: (key: a hash of file and offset, arc binary)."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = io.BytesIO(data.as_buffer())
                for r in read_arc(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw):
                    line = " ".join(r[f] for f in ARC_FIELDS[r["version"]].split(" "))
                    one = arc_block(r["version"]) + line.encode("utf-8", "surrogateescape") + b"\n" + r["payload"] + b"\n"
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r["offset"]]), pa.array([one], pa.binary())], ["path", "offset", "arc"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, arc binary").select(F.xxhash64("path", "offset").alias("key"), "arc")


def convert(arcs: DataFrame, pack: int = 0) -> DataFrame:
    """ARC files (key, arc) to WARC records (warc binary), or to archives of about `pack` bytes of records each.

    The payload's digest decides type: of equal payloads the largest key is the response. One shuffle
    brings each record to its digest's largest key; the aggregate combines before it, and the join's
    large partitions can be split by adaptive execution.
    """

    def digests(batches):
        for b in parts(batches):
            key, digest, arc = [], [], []
            for k, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                many = list(read_arc(io.BytesIO(a)))
                for r in many:
                    key.append(k)
                    digest.append(hashlib.sha1(r["payload"]).digest())
                    arc.append(a if len(many) == 1 else arc_block(r["version"]) + a[r["offset"] : a.index(b"\n", r["offset"]) + 1] + r["payload"] + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(arc, pa.binary())], ["key", "digest", "arc"])

    keyed = arcs.select("key", "arc").mapInArrow(digests, "key long, digest binary, arc binary")
    top = keyed.groupBy("digest").agg(F.max("key").alias("top"))
    both = keyed.join(top, "digest").select("key", "top", "arc")

    def run(batches):
        held, size = [], 0
        for b in parts(batches):
            out = []
            for k, t, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held.append(to_warc(next(read_arc(io.BytesIO(a))), k, None if k == t else t))
                size += len(held[-1])
                if size >= pack:
                    out.append(END.join(held))
                    held, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["warc"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["warc"])

    return both.mapInArrow(run, "warc binary")


def write_warc(archives: DataFrame, path: str) -> None:
    """Rows of archives or of records, each into a gzip file through Spark's own writer, so that any store it knows will do."""
    archives.select(F.col("warc").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files at path: key, payload_bytes, payload_digest, record_type, refers_to, url, date, payload.

    A response's digest and length are computed from its block and must equal what its header says.
    """

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for data in b.column(0):
                for head, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(data.as_buffer()))):
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (sha1_base32(block) != digest or len(block) != n):
                        raise ValueError("a payload differs from its digest")
                    key, back = head.get("X-Key"), head.get("X-Refers-To-Key")
                    rows.append((key and int(key), n, digest, head["WARC-Type"], back and int(back), head["WARC-Target-URI"], head["WARC-Date"], block))
                    size += len(block)
                    if len(rows) == 500 or size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, payload binary")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(convert(arc_records(pages), PACK), path)
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
