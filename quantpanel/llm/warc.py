"""WARC archives as a Spark data source, written with revisit records for repeated payloads.

Every record written is a gzip member of its own whose extra field ``sl`` holds the member's compressed and plain lengths; ``_manifest``
lists the committed files with places where they can be split.
The reader plans one partition per split, parses the header lines of a record first, tests the
pushed-down predicates on them, and inflates a payload only if the record passes and the payload is asked for;
otherwise it seeks to the next member. Archives of other origin (``.warc.gz`` without skip lengths, plain ``.warc``, folders without a
manifest) are read from begin to end, one partition a file, passing over unwanted blocks without keeping them.

Defined cases: null html is an empty payload; a null url leaves out the target header; a null page_id is written as ``urn:x-page:null`` and read as null;
control characters in headers are percent-encoded; payloads below ``min_bytes`` are always written in full; equal payloads with equal ids
repeat as responses of their own; writing into a folder again adds to it; a truncated or foreign file raises an error; header names are read in any
case and folded lines are joined; payloads may be of any length, one at a time in memory; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path

MIN_BYTES = 1000
SPLIT_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
PLAIN = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def member(head: bytes, body: bytes, level: int = 3) -> bytes:
    """A gzip member with the skip lengths; the header part is flushed apart, so it inflates alone."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    first = packer.compress(head) + packer.flush(zlib.Z_FULL_FLUSH)
    rest = packer.compress(body) + packer.flush()
    plain = head + body
    size = 12 + 12 + len(first) + len(rest) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(plain))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + first + rest + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, record_type: str, uri: str | None, digest: str, payload_bytes: int, refers_to: str | None, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http + (payload if record_type == "response" else b"")
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return member(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + http, body[len(http) :] + b"\r\n\r\n")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _head(fields: dict[str, str]) -> dict:
    bare = lambda v: None if v is None else v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v
    return {
        "record_id": bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": bare(fields.get("warc-target-uri")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": bare(fields.get("warc-refers-to")),
    }


def _length(http: bytes) -> int:
    found = re.search(rb"(?i)(?:^|\n)content-length:[ \t]*(\d+)", http)
    return int(found[1]) if found else 0


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").lower().startswith("application/http")


def records(plain, wanted, need_payload: bool) -> Iterator[dict]:
    """Records of a plain stream of any origin, one after another; a block that is not wanted is passed over."""
    while line := plain.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = []
        while (line := plain.readline()).strip():
            lines.append(line)
        fields = _fields(lines)
        left = int(fields["content-length"])
        head, http = _head(fields), b""
        if _is_http(fields):
            while left and (line := plain.readline(left)):
                http += line
                left -= len(line)
                if not line.strip():
                    break
        head["payload_bytes"] = _length(http) if head["record_type"] == "revisit" else left
        keep = wanted(head)
        block = io.BytesIO()
        while left:
            some = plain.read(min(left, 1 << 20))
            if not some:
                raise ValueError("truncated archive")
            left -= len(some)
            if keep and need_payload:
                block.write(some)
        if keep:
            if need_payload:
                head["payload"] = None if head["record_type"] == "revisit" else block.getvalue()
            yield head


def scan(stream, wanted, need_payload: bool, begin: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records of an open, seekable archive that pass ``wanted(head)``; begin and end are places of members with skip lengths."""
    at, size_all = begin, stream.size()
    end = size_all if end is None else end
    while at < end:
        stream.seek(at)
        raw = stream.read(4096)
        skips = raw[:2] == b"\x1f\x8b" and len(raw) >= 24 and raw[3] & 4 and raw[12:14] == b"sl"
        if not skips:
            stream.seek(at)
            plain = io.BufferedReader(stream) if raw[:2] != b"\x1f\x8b" else gzip.GzipFile(fileobj=stream)
            try:
                yield from records(plain, wanted, need_payload)
            except EOFError as e:
                raise ValueError("truncated archive") from e
            return
        extra, size = struct.unpack("<H", raw[10:12])[0], struct.unpack("<HII", raw[14:24])[1]
        if at + size > size_all:
            raise ValueError("truncated archive")
        unpacker = zlib.decompressobj(-15)
        got = unpacker.decompress(raw[12 + extra : size - 8])
        while got.count(b"\r\n\r\n") < 2 and len(raw) < size:
            more = stream.read(4096)
            if not more:
                raise ValueError("truncated archive")
            raw += more
            got += unpacker.decompress(more)
        lines, _, rest = got.partition(b"\r\n\r\n")
        http = rest.partition(b"\r\n\r\n")[0]
        head = _head(_fields(lines.split(b"\r\n")[1:])) | {"payload_bytes": _length(http)}
        if wanted(head):
            if need_payload:
                stream.seek(at)
                whole = zlib.decompress(stream.read(size), 31)
                first = whole.index(b"\r\n\r\n", whole.index(b"\r\n\r\n") + 4) + 4
                head["payload"] = whole[first:-4] if head["record_type"] == "response" else None
            yield head
        at += size


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    splits: list[int]


class _Part(InputPartition):
    def __init__(self, file: str, begin: int = 0, end: int | None = None):
        self.file, self.begin, self.end = file, begin, end


def _listed(files, root: str) -> list[dict] | None:
    """The manifest's entries; None if the folder has none."""
    from pyarrow import fs

    if files.get_file_info(f"{root}/_manifest").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/_manifest") as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        files, root = _file_system(folder)
        files.create_dir(root)

    def write(self, iterator):
        files, root = _file_system(self.folder)
        name, out, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                raw = record(row["record_id"], row["record_type"], row["target_uri"], row["payload_digest"], row["payload_bytes"], row["refers_to"], row["payload"] or b"")
                out.write(raw)
                at += len(raw)
        if out is not None:
            out.close()
        return _Written(name if out is not None else None, splits)

    def commit(self, messages):
        files, root = _file_system(self.folder)
        before = [] if self.overwrite else _listed(files, root) or []
        with files.open_output_stream(f"{root}/_manifest") as out:
            out.write(json.dumps(before + [{"file": m.file, "splits": m.splits} for m in messages if m and m.file]).encode())

    def abort(self, messages):
        files, root = _file_system(self.folder)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{root}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in PLAIN:
                self.tests.append(f)
            else:
                yield f

    def wanted(self, head: dict) -> bool:
        for f in self.tests:
            value = head[f.attribute[0]]
            if value is None or isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        files, root = _file_system(self.folder)
        listed = _listed(files, root)
        if listed is None:
            found = files.get_file_info(fs.FileSelector(root))
            return [_Part(x.base_name) for x in found if x.base_name.endswith((".warc", ".warc.gz"))] or [_Part("")]
        return [_Part(x["file"], b, e) for x in listed for b, e in zip(x["splits"], [*x["splits"][1:], None])] or [_Part("")]

    def read(self, partition):
        if not partition.file:
            return
        files, root = _file_system(self.folder)
        with files.open_input_file(f"{root}/{partition.file}") as f:
            for r in scan(f, self.wanted, self.payload, partition.begin, partition.end):
                yield (r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r.get("payload"))


class WarcSource(DataSource):
    """``spark.read.format("warc_gz").option("payload", "false").load(folder)``; payload defaults to true."""

    @classmethod
    def name(cls):
        return "warc_gz"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """pages: page_id, url, html. Of equal payloads of at least ``min_bytes`` bytes, the largest page_id is the response."""
    pages.sparkSession.dataSource.register(WarcSource)
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = (F.col("payload_bytes") >= min_bytes) & (F.col("first") != F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    rows = rows.join(first, "payload_digest", "left").select(
        name(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", "payload_bytes",
        F.when(again, name(F.col("first"))).alias("refers_to"), F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )
    rows.write.format("warc_gz").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc_gz").option("payload", str(payload).lower()).load(folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = read_warc(spark, folder)
    page = lambda c: F.substring(c, 12, 99).try_cast("long")
    return back.select(
        page(F.col("record_id")).alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""
