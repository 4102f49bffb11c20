"""WARC archives as chunked record tables.

Writing: each task streams its rows into one compressed archive, a member per
record, in pieces of CHUNK bytes. Equal payloads of some size are stored once;
the others refer to them. Reading: each archive is read in blocks; a record
comes out as rows of (record_id, chunk_no), each carrying the bytes so far and,
on the last row, the digest that was updated piece by piece. No step holds more
of a payload than a chunk besides the row it was given.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of
from barloom.session import _shared_folder, staged

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"  # fixed value: archives are reproducible
MIN_SHARED_BYTES = 100


def write_archives(pages: DataFrame, folder: str, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """Write every page as a record; the written manifest: archive, records.

    Columns page_id, url, html; others are not read. Null html is an empty
    payload, a null url an empty one. Of equal payloads of ``min_shared`` bytes
    or more the smallest page_id is the response; rows that repeat that page_id
    are responses too, and a payload whose rows have no page_id is never shared.
    An empty table gives no archive. A task that is run again writes a new
    archive; the manifest lists only those of the tasks that counted.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    shared = rows.where(F.octet_length("html") >= min_shared).groupBy("digest")
    shared = shared.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    rows = rows.join(staged(shared.select("digest", "first_id")), "digest", "left")
    # null-safe: a row without page_id refers to one that has it
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"), "digest", F.octet_length("html").alias("size"))
    return staged(arrow_map(rows, _write, "archive string, records long", folder=folder))


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table: record_id, chunk_no, last, target, record_type, refers_to, declared, bytes_so_far, digest, data.

    ``digest`` stands on a record's last chunk. A record without payload has one
    chunk without data. ``declared`` is the payload digest in the record's head.
    """
    schema = "record_id long, chunk_no long, last boolean, target string, record_type string, refers_to long, "
    schema += "declared string, declared_bytes long, bytes_so_far long, digest string" + ", data binary" * with_data
    # a task per archive: by the size of the manifest's rows alone Spark would put all into one
    apart = manifest.select("archive").repartition(max(1, manifest.count()))
    return arrow_map(apart, _read, schema, with_data=with_data)


def round_trip(pages: DataFrame, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from written archives."""
    folder = f"{_shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    ends = read_archives(write_archives(pages, folder, min_shared), with_data=False).where("last")
    response = F.col("record_type") == "response"
    return ends.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


# --- writing ------------------------------------------------------------------


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def head_of(page_id, url: str, refers_to, digest: str, size: int) -> bytes:
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _name(refers_to)))
    fields.append(("Content-Type", "text/html"))
    fields.append(("Content-Length", str(size if refers_to is None else 0)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    archive = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    records, out = 0, None
    for batch in batches:
        payloads = batch.column("html").cast(pa.binary())
        meta = batch.drop_columns(["html"]).to_pylist()
        for i, row in enumerate(meta):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{archive}", compression=None)
            member = zlib.compressobj(4, zlib.DEFLATED, 31)
            out.write(member.compress(head_of(row["page_id"], row["url"], row["refers_to"], row["digest"], row["size"])))
            payload = memoryview(payloads[i].as_buffer()) if payloads[i].is_valid else memoryview(b"")
            for at in range(0, len(payload), CHUNK):
                out.write(member.compress(payload[at : at + CHUNK]))
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            records += 1
    if out is not None:
        out.close()
        schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])
        yield batch_of(schema, [f"{folder}/{archive}"], [records])


# --- reading ------------------------------------------------------------------


class MemberStream:
    """Bytes of an archive, members one after the other, decompressed by the block."""

    def __init__(self, raw):
        self.raw, self.member, self.held = raw, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                left = self.member.unused_data
                self.member = zlib.decompressobj(31)
            else:
                left = self.member.unconsumed_tail
            left = left or self.raw.read(CHUNK)
            if not left:
                return False
            if got := self.member.decompress(left, CHUNK):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("the archive ends inside a record")
        found, self.held = self.held[:most], self.held[most:]
        return found


def _record_name(text: str | None) -> int | None:
    value = text.removeprefix("<urn:page:").removesuffix(">") if text else "none"
    return None if value == "none" else int(value)


def read_records(raw) -> Iterator[tuple[dict[str, str], int, bool, int, str | None, bytes]]:
    """(head, chunk number, last, bytes so far, digest if last, bytes) of every chunk."""
    stream = MemberStream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length, seen, number, digest = int(fields["Content-Length"]), 0, 0, hashlib.sha256()
        while True:
            data = stream.take(min(CHUNK, length - seen)) if seen < length else b""
            digest.update(data)
            seen += len(data)
            last = seen == length
            yield fields, number, last, seen, digest.hexdigest() if last else None, data
            number += 1
            if last:
                break
        if stream.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record does not end after its length")


READ = pa.schema(
    [("record_id", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("target", pa.string()), ("record_type", pa.string())]
    + [("refers_to", pa.int64()), ("declared", pa.string()), ("declared_bytes", pa.int64()), ("bytes_so_far", pa.int64())]
    + [("digest", pa.string()), ("data", pa.binary())]
)


def _read(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    schema = READ if with_data else pa.schema(list(READ)[:-1])
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            store, path = _store(archive)
            rows, held = [], 0
            with store.open_input_stream(path, compression=None) as raw:
                for fields, number, last, seen, digest, data in read_records(raw):
                    row = (
                        _record_name(fields["WARC-Record-ID"]), number, last, fields["WARC-Target-URI"], fields["WARC-Type"],
                        _record_name(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        int(fields["X-Payload-Length"]), seen, digest, data,
                    )
                    rows.append(row[: len(schema)])
                    held += len(data) * with_data + 200
                    if held > 4 << 20:
                        yield batch_of(schema, *zip(*rows))
                        rows, held = [], 0
            if rows:
                yield batch_of(schema, *zip(*rows))
