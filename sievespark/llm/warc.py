"""WARC archives: writer with revisit records, and a sequential reader.

Archives are rows ``(archive, content)`` of a table in the shared folder, so
that they can lie in any store Spark writes to; ``binaryFile`` rows of
``.warc.gz`` files, renamed to these columns, can be read as well. Each record
is a gzip member of its own. The reader decompresses step by step, frames
records by Content-Length and verifies their digests.

Null html: an empty payload. Equal payloads of at least ``min_revisit`` bytes:
the largest page_id is the response (each row that has it, if rows repeat), the
others revisit it. Null page_id: counts as less than any other; a payload that only
null ids have is a response. Empty tables give no archives.

Records of any type and of any writer are read: digests that they don't state
are worked out, members may hold several records or parts of one, and archives
need not be compressed. A record that is cut short, isn't framed by its
Content-Length or fails its digest raises ``ValueError``; with
``damaged="report"`` it becomes a row of type ``damaged`` with the reason in
``target_uri``, and reading goes on with the next member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import attach, bound_batches, materialize, slices

MIN_REVISIT = 1000
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 4 << 20
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    b32 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": b32(payload),
        "WARC-Block-Digest": b32(block),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``(archive, content)`` with a record for each row of ``pages`` (page_id, url, html), in the shared folder."""
    bound_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.unhex(F.sha2("payload", 256))))
    groups = materialize(keyed.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("response")).where("copies > 1"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    rows = attach(keyed.select("page_id", "url", "digest", "payload"), groups, ["digest"], "copies", total)
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(made)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for part in slices(batch, 256):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made.append(packer.compress(_record(*row)) + packer.flush())
                    size += len(made[-1])
                    if size >= archive_bytes:
                        yield close()
                        made, size, number = [], 0, number + 1
        if made:
            yield close()

    return materialize(rows.mapInArrow(run, "archive string, content binary"))


def inflated(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Decompressed chunks of an archive and the place of the gzip member that each is of; an archive without compression is one member."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield from ((0, bytes(view[k : k + CHUNK])) for k in range(0, len(view), CHUNK))
        return
    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b" and not bytes(view[at:]).strip(b"\0"):
            return  # padding
        start, inflate = at, zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(view):
                raise Damaged("a gzip member ends early", None)
            try:
                chunk = inflate.decompress(view[at : at + CHUNK])
            except zlib.error as error:
                raise Damaged(f"a gzip member can't be read: {error}", _next_member(content, start)) from error
            at += min(CHUNK, len(view) - at) - len(inflate.unused_data)
            if chunk:
                yield start, chunk


class Damaged(ValueError):
    """``resume``: place of the next gzip member, null at the end of the archive."""

    def __init__(self, reason: str, resume: int | None) -> None:
        super().__init__(reason)
        self.resume = resume


def _next_member(content: bytes, start: int) -> int | None:
    at = content.find(b"\x1f\x8b\x08", start + 2)
    return at if at >= 0 else None


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, after framing and digests are verified; raises :class:`Damaged`."""
    held, member = bytearray(), 0
    chunks = inflated(content)
    done = False

    def more() -> bool:
        nonlocal member, done
        try:
            step = next(chunks, None)
        except Damaged as error:
            raise damaged(str(error)) if held else error from None
        if step is None:
            done = True
            return False
        if not held:
            member = step[0]
        held.extend(step[1])
        return True

    def damaged(reason: str) -> Damaged:
        return Damaged(reason, _next_member(content, member) if content[:2] == b"\x1f\x8b" else None)

    while True:
        while not bytes(held[:4]).strip(b"\r\n") and (len(held) < 4 or held[:1] in b"\r\n"):
            while held[:1] in (b"\r", b"\n"):  # blank lines between records
                del held[:1]
            if len(held) < 4 and not more():
                if held:
                    raise damaged("a record ends early")
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not bytes(held[:5]).startswith(b"WARC/"[: len(held)]):
                raise damaged("not a WARC record")
            if not more():
                raise damaged("a record ends early")
        version, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise damaged("not a WARC record")
        fields = {}
        name = ""
        for line in lines:
            if line[:1] in (" ", "\t") and name:  # a folded line goes on
                fields[name] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
            raise damaged("no Content-Length or no WARC-Type")
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop + 4 and more():
            pass
        if len(held) < stop or bytes(held[stop : stop + 4]) != b"\r\n\r\n":
            raise damaged("Content-Length doesn't frame the record")
        block = bytes(held[end + 4 : stop])
        del held[: stop + 4]
        try:
            verify(fields.get("warc-block-digest"), block)
            if fields["warc-type"] == "response" and _is_http(fields):
                verify(fields.get("warc-payload-digest"), payload_of(block)[1])
        except ValueError as error:
            raise damaged(str(error)) from error
        yield fields, block


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")


def digest_hex(digest: str) -> str:
    """Lower-case hex of ``sha1:`` and base 32 or hex."""
    value = digest.partition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def verify(digest: str | None, data: bytes) -> None:
    if digest and digest.lower().startswith("sha1:") and digest_hex(digest) != hashlib.sha1(data).hexdigest():
        raise ValueError("a digest doesn't match")


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length that the HTTP header states, and the payload in the block."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(payload))
    return length, payload


def _row(fields: dict[str, str], block: bytes) -> tuple:
    revisit = fields["warc-type"] == "revisit"
    length, payload = payload_of(block) if _is_http(fields) else (len(block), block)
    stated = fields.get("warc-payload-digest", "")
    digest = digest_hex(stated) if stated.lower().startswith("sha1:") else None if revisit else hashlib.sha1(payload).hexdigest()
    refers_to = fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None
    return (fields.get("warc-record-id", "").strip("<>") or None, fields["warc-type"], fields.get("warc-target-uri"), length, digest, refers_to, None if revisit else payload)


def read_archives(archives: DataFrame, damaged: str = "raise") -> DataFrame:
    """A row for each record: ``record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload``.

    ``payload`` is null in revisits, whose ``payload_bytes`` the HTTP header
    states, and so is a digest that they don't state; records without HTTP have
    their whole block as payload. ``damaged``: raise or report.
    """
    schema = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    bound_batches(archives.sparkSession)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def every(content: bytes) -> Iterator[tuple]:
        at: int | None = 0
        while at is not None:
            part, at = (content[at:], at) if at else (content, 0)
            try:
                for fields, block in records(part):
                    yield _row(fields, block)
                at = None
            except Damaged as error:
                if damaged != "report":
                    raise
                yield (None, "damaged", str(error), None, None, None, None)
                at = None if error.resume is None else at + error.resume

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for content in batch.column(0):
                for row in every(content.as_py() or b""):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return archives.select("content").mapInArrow(run, schema)


def page_of(uri: str):
    """The page id in a record id that :func:`write_archives` made."""
    return F.nullif(F.regexp_extract(uri, "^urn:x-page:(-?[0-9]*)$", 1), F.lit("")).cast("long")
