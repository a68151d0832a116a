"""WARC archives written and read as a table of chunks.

A payload is never one value on its way into or out of an archive.  It is rows
(record, chunk number, bytes) of at most ``CHUNK`` bytes: cut from the page by
the scan, exchanged and ordered by record and chunk, streamed into one gzip
member a record.  Reading streams the members back into chunk rows that carry
the length and SHA-1 of the payload up to and with the chunk; the last chunk's
are those of the whole payload.

Payloads that occur more than once are stored once: of the records with equal
payloads (of ``least_bytes`` or more) the one with the largest id is the
response, the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

CHUNK = 1 << 18
READ = 1 << 18
RECORD_ID = "urn:tessella:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Dates are fixed, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    filesystem, path = pafs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1))
    return filesystem, path


def _payload() -> Column:
    """The page's payload in UTF-8; a null one is empty."""
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, bytes, sha1, refers_to`` for each row: what its record says of the payload."""
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(_payload()).cast("long").alias("bytes"), F.sha1(_payload()).alias("sha1"))
    holders = digests.groupBy("sha1", "bytes").agg(F.max("page_id").alias("holder"))
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    # the holder of a payload is one row, so only the other side can be skewed
    return digests.join(holders, ["sha1", "bytes"]).select("page_id", "bytes", "sha1", refers.alias("refers_to"))


def _header(kind: str, row: dict) -> bytes:
    page = "" if row["page_id"] is None else row["page_id"]
    digest = base32_sha1(bytes.fromhex(row["sha1"]))
    url = "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in row["url"] or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    size = len(http) + (row["bytes"] if kind == "response" else 0)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_ID}{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{row['refers_to']}>"]
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]).encode() + http


def _writer(folder: str) -> Callable:
    """One archive a task.  It gets its name when it is whole, so a task that is lost leaves none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _open(folder)
        part = TaskContext.get().partitionId()
        name, temporary = f"part-{part:06d}.warc.gz", f".part-{part:06d}-{uuid.uuid4().hex}"
        filesystem.create_dir(path, recursive=True)
        records = 0
        with filesystem.open_output_stream(f"{path}/{temporary}", compression=None) as out:
            packer = sha = row = None

            def close() -> None:
                if row["refers_to"] is None and sha.hexdigest() != row["sha1"]:
                    raise OSError(f"page {row['page_id']}: the payload written is not the one digested")
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())

            for batch in batches:
                for piece in batch.to_pylist():
                    if piece["chunk_no"] == 0:
                        if packer:
                            close()
                        row, sha, packer = piece, hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(packer.compress(_header("response" if row["refers_to"] is None else "revisit", row)))
                        records += 1
                    if row["refers_to"] is None:
                        sha.update(piece["chunk"])
                        out.write(packer.compress(piece["chunk"]))
            if packer:
                close()
        filesystem.move(f"{path}/{temporary}", f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write pages (``page_id, url, html``) to WARC files; returns the manifest ``archive, records``.

    folder: a URI that all executors can write to.  Rows are dealt by page_id
    and payload and ordered in each task, so a task that runs again writes the
    same records.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    plan = plan_records(pages, least_bytes).withColumn("key", key).select("key", "sha1", "bytes", "refers_to").dropDuplicates(["key", "sha1"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("body"))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("body") - 1) / chunk)).cast("int")
    # copy tells repeated rows apart; digested before the cut into chunks, so once a payload
    rows = rows.withColumns({"key": key, "sha1": F.sha1("body"), "copy": F.monotonically_increasing_id()})
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    cut = rows.select("key", "sha1", "page_id", "copy", "chunk_no", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"), F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})").alias("chunk"))
    placed = cut.repartition(n, "key", "sha1").join(plan, ["key", "sha1"]).sortWithinPartitions("key", "sha1", "copy", "chunk_no")
    return placed.select("page_id", "url", "sha1", "bytes", "refers_to", "chunk_no", "chunk").mapInArrow(_writer(folder), "archive string, records long")


def _members(stream: pa.NativeFile) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as blocks of at most READ bytes."""
    rest = stream.read(READ)

    def blocks() -> Iterator[bytes]:
        nonlocal rest
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            out = unpacker.decompress(rest, READ)
            rest = unpacker.unconsumed_tail or unpacker.unused_data
            if out:
                yield out
            if not unpacker.eof and not rest:
                rest = stream.read(READ)
                if not rest:
                    raise OSError("the archive ends inside a record")

    while rest:
        member = blocks()
        yield member
        for _ in member:  # whatever the reader left
            pass
        rest = rest or stream.read(READ)


def _until_blank(held: bytes, blocks: Iterator[bytes]) -> tuple[bytes, bytes]:
    """Up to the first empty line, and what follows it."""
    while (at := held.find(b"\r\n\r\n")) < 0:
        held += next(blocks)
    return held[:at], held[at + 4 :]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(identifier: str | None) -> int | None:
    number = (identifier or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


def _chunk_rows(blocks: Iterator[bytes], chunk: int) -> Iterator[dict]:
    """The rows of one record."""
    head, held = _until_blank(b"", blocks)
    fields = _fields(head)
    http, held_after = _until_blank(held, blocks)
    left = int(fields["content-length"]) - len(http) - 4
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    row = {"page_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to"))}
    if fields["warc-type"] == "revisit":
        yield row | {"chunk_no": 0, "payload_bytes": int(_fields(http)["content-length"]), "payload_digest": digest, "last": True, "chunk": None}
        return
    held, number, total, sha = held_after, 0, 0, hashlib.sha1()
    while True:
        size = min(chunk, left)
        parts, have = [held], len(held)
        while have < size:
            parts.append(next(blocks))
            have += len(parts[-1])
        held = b"".join(parts)
        piece, held = held[:size], held[size:]
        left -= size
        total += size
        sha.update(piece)
        so_far = base32_sha1(sha.digest())
        if not left and so_far != digest:
            raise OSError(f"page {row['page_id']}: the payload read does not have the digest of its header")
        yield row | {"chunk_no": number, "payload_bytes": total, "payload_digest": so_far, "last": not left, "chunk": piece}
        number += 1
        if not left:
            return


_ROW = pa.schema(
    [("archive", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary())]
)


def _reader(with_chunks: bool, chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                filesystem, path = _open(archive)
                rows, held = [], 0
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for member in _members(stream):
                        for row in _chunk_rows(member, chunk):
                            rows.append(row | {"archive": archive} if with_chunks else row | {"archive": archive, "chunk": None})
                            held += len(rows[-1]["chunk"] or b"")
                            if len(rows) >= 4096 or held > 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, _ROW)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


def read_archives(manifest: DataFrame, with_chunks: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in ``manifest``.

    ``archive, page_id, record_type, refers_to, chunk_no, payload_bytes,
    payload_digest, last, chunk``: the length and bare base32 SHA-1 are of the
    payload up to and with the chunk, so those of the row with ``last`` are the
    whole payload's.  A revisit record is one row without a chunk, with the
    length and digest of the payload that it stands for.  Digests are checked
    against the headers.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "archive string, page_id long, record_type string, refers_to long, chunk_no int, payload_bytes long, payload_digest string, last boolean, chunk binary"
    return manifest.select("archive").repartition(n).mapInArrow(_reader(with_chunks, chunk), kinds)


def warc_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read them back: a row for each record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    Defined cases: a null payload is empty; a null url is about:blank; a null
    page_id is written without a number, and is a response unless a page with
    an id has its payload; repeated rows with the largest page_id of their
    payload are all responses; an empty table gives no record.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.cut(write_archives(pages, folder or f"{scratch.folder}/archives", least_bytes), "manifest")
    return read_archives(manifest, with_chunks=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
