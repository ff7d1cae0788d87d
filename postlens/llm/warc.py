"""WARC archives: one gzip member per record, written and read on the executors.

Writing: duplicates are found on narrow rows (digest, id); each row then becomes
one gzip member in its task, and Spark's text sink writes the members to part
files on any storage Spark can reach. The sink needs a separator between rows;
an empty gzip member serves, so that every part file is a valid multi-member
gzip file that unpacks to plain WARC/1.1.

Reading: a file is read front to back through an incremental inflater that never
holds more than one record. Blocks are framed by Content-Length and checked
against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import Query, stage, table, whole
from postlens.session import scratch_path

MIN_REVISIT_BYTES = 1000
#: Records per part file; a reader task takes one file at a time.
RECORDS_PER_FILE = 5000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
#: Rows of an output batch are cut at so many bytes.
BATCH_BYTES = 8 << 20

RECORD_SCHEMA = ("file string, place long, record_id string, record_type string, target_uri string, refers_to string, "
                 "payload_bytes long, payload_digest string, payload binary")


def gzip_member(data: bytes, level: int = 5) -> bytes:
    """A gzip member of ``data`` with a fixed header (no time, no name), so that reruns agree."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


EMPTY_MEMBER = gzip_member(b"")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record ``refers_to`` (headers only, the payload left out)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{quote(record_id)}>"),
            ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{quote(refers_to)}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write every row of ``pages`` as one record below ``path``.

    The payload is the html in UTF-8, a null is the empty payload. Of rows with
    equal payloads of at least ``min_bytes`` bytes the one with the largest id is
    the response, the others are revisits of it; rows that repeat that id are
    responses too. A null id is the smallest. A null url has no target URI. An
    empty table writes no record. Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), whole(F.col(html_col)).alias("_html")).select(
        "*", F.sha1(F.col("_html").cast("binary")).alias("_digest"))
    groups = rows.where(F.octet_length("_html") >= min_bytes).groupBy("_digest").agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(stage(groups, "payloads"), "_digest", "left")
    again = (F.octet_length("_html") >= min_bytes) & F.col("_keep").isNotNull() & ~F.col("_keep").eqNullSafe(F.col("_id"))
    framed = joined.select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("id"), F.col("_url").alias("url"),
        F.col("_html").alias("html"), F.when(again, F.col("_keep").cast("string")).alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for record_id, url, html, refers in zip(*batch.columns, strict=True):
                member = gzip_member(make_record(record_id.as_py(), url.as_py(), html.as_py().encode(), refers.as_py()))
                out.append(member)
                held += len(member)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = framed.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value"))
    (members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", records_per_file).text(path))


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def inflate(data: memoryview) -> Iterator[Iterator[bytes]]:
    """The gzip members of ``data`` in order, each as an iterator of its unpacked pieces.

    A member must be read to its end before the next is asked for.
    """
    at = 0

    def pieces():
        nonlocal at
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            piece = data[at:at + READ_BYTES]
            if not len(piece):
                raise ValueError("a gzip member is cut off")
            at += len(piece)
            yield unpack.decompress(piece)
        at -= len(unpack.unused_data)

    while at < len(data):
        yield pieces()


def read_record(pieces: Iterator[bytes]) -> Record | None:
    """One record from a member's pieces, framed by its Content-Length; None for an empty member."""
    held = bytearray()
    end = -1
    for piece in pieces:
        held += piece
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            break
    if end < 0:
        if held:
            raise ValueError("a record has no end of headers")
        return None
    version, *lines = held[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    del held[:end + 4]
    for piece in pieces:
        held += piece
        if len(held) > length + 4:
            break
    if bytes(held[length:]) != b"\r\n\r\n":
        raise ValueError(f"a block does not match its length {length}")
    return Record(headers, bytes(held[:length]))


def digest_holds(stated: str | None, data: bytes) -> bool:
    """Whether a SHA-1 digest, in base 32 or hex, is that of ``data``; none, and one of another kind, is not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return True
    found = hashlib.sha1(data)
    return value.upper() == base64.b32encode(found.digest()).decode() or value.lower() == found.hexdigest()


def open_record(record: Record) -> tuple:
    """(record_id, type, uri, refers_to, payload_bytes, hex digest, payload) of a record whose digests hold.

    Records of any type and origin are read. The payload is what follows the
    HTTP headers, if the block has any, else the block. Without a payload digest
    of its own a record gets that of its payload. A revisit has no payload; its
    size is the length its HTTP headers tell, else unknown.
    """
    head = record.headers
    if not digest_holds(head.get("warc-block-digest"), record.block):
        raise ValueError(f"block digest of {head.get('warc-record-id')} does not hold")
    kind, stated = head.get("warc-type", "unknown"), head.get("warc-payload-digest")
    http, payload = b"", record.block
    if payload.startswith(b"HTTP/") or "application/http" in head.get("content-type", "").lower():
        http, _, payload = record.block.partition(b"\r\n\r\n")
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        lines = (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])
        told = {name.strip().lower(): value.strip() for name, _, value in lines}.get("content-length", "")
        size, payload, digest = int(told) if told.isdigit() else None, None, None
        value = (stated or "").partition(":")[2]
        if len(value) == 32:
            digest = base64.b32decode(value.upper()).hex()
        elif len(value) == 40:
            digest = value.lower()
    elif not digest_holds(stated, payload):
        raise ValueError(f"payload digest of {head.get('warc-record-id')} does not hold")

    def page(name):
        value = head.get(name)
        return None if value is None else unquote(value.strip("<>").removeprefix("urn:page:")) or None

    return page("warc-record-id"), kind, head.get("warc-target-uri"), page("warc-refers-to"), size, digest, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``, one row each (see ``RECORD_SCHEMA``).

    ``place`` is the record's number in its file; a revisit has no payload. A
    damaged record (cut off, wrong length or digest) raises an error that names
    it. A folder without records gives an empty table. Every file is one task's
    unit of work and must fit in its memory; ``write_archives`` keeps them small.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = RECORD_SCHEMA

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows, held, place = [], 0, 0
                for member in inflate(memoryview(content.as_buffer())):
                    record = read_record(member)
                    for _ in member:  # the rest of the member, at most its end mark
                        pass
                    if record is None:
                        continue
                    row = open_record(record)
                    rows.append((name.as_py(), place, *(row if with_payload else (*row[:-1], None))))
                    place += 1
                    held += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(unpack, schema)


def _run(spark, folder):
    pages = table(spark, folder, "pages")
    path = scratch_path(spark, "llm-archives")
    write_archives(pages, path)
    read = read_archives(spark, path, with_payload=False)
    kind = pages.schema["page_id"].dataType
    return read.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))


QUERIES = {
    "op1_warc": Query(_run, f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                     CASE WHEN strlen(h) >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h) END AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to FROM r"""),
}
