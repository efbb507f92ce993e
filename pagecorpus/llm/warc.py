"""Web archives: gzip-per-record WARC files, and a reader that splits them by byte range.

Writing tasks put files below one folder and report them in a manifest, which Spark
commits; files of failed attempts are in no manifest and so are never read. A reading task
scans its byte range for the gzip magic, accepts a candidate only if it decodes to its end
with a right checksum, starts with a WARC version line and is followed by another member or
the end of the file, and owns the records that start inside its range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.session import freeze, work_path

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads under this many bytes are always written in full.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 20
FILE_BYTES = 512 << 20

_MANIFEST = "path string, bytes bigint, records bigint"
_RECORDS = (
    "path string, position bigint, page_id bigint, record_type string, url string, "
    "refers_to bigint, digest string, payload binary"
)
_RECORDS_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("position", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit without the payload."""
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "urn:x-page:unknown")
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
        block = f"{http}\r\n".encode()
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def decode_record(data: bytes) -> dict:
    """Type, page, target, reference, digest and payload of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "surrogatepass")
    block = rest[: int(fields.get(b"content-length", "0"))]
    kind = fields.get(b"warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
    return {
        "page_id": _page_of(fields.get(b"warc-record-id")),
        "record_type": kind,
        "url": fields.get(b"warc-target-uri"),
        "refers_to": _page_of(fields.get(b"warc-refers-to")),
        "digest": fields.get(b"warc-payload-digest", "").rpartition(":")[2],
        "payload": payload,
    }


class _Window:
    """Bytes of a file by absolute position, a few blocks at a time."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.at, self.data = read_at, size, 0, b""

    def get(self, start: int, length: int) -> bytes:
        end = min(start + length, self.size)
        if start >= end:
            return b""
        if not (self.at <= start and end <= self.at + len(self.data)):
            self.at, self.data = start, self.read_at(start, min(max(length, READ), self.size - start))
        return self.data[start - self.at : end - self.at]

    def find_magic(self, start: int, end: int) -> int | None:
        """The first magic that begins in ``[start, end)``."""
        while start < end:
            part = self.get(start, min(READ, end - start) + len(MAGIC) - 1)
            found = part.find(MAGIC)
            if found >= 0:
                return start + found
            start += max(1, len(part) - len(MAGIC) + 1)
        return None


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The unpacked member at ``start`` and where it ends; None if there is none."""
    unpack, parts, at, head = zlib.decompressobj(31), [], start, b""
    while not unpack.eof:
        chunk = window.get(at, READ // 16)
        if not chunk:
            return None
        try:
            part = unpack.decompress(chunk)
        except zlib.error:
            return None
        at += len(chunk)
        parts.append(part)
        if len(head) < len(VERSION):
            head += part[: len(VERSION)]
            if not (head.startswith(b"WARC/") or b"WARC/".startswith(head)):
                return None
    end = at - len(unpack.unused_data)
    follows = window.get(end, len(MAGIC))
    if not head.startswith(b"WARC/") or (follows != MAGIC and end != window.size):
        return None
    return b"".join(parts), end


def records_in(read_at: Callable[[int, int], bytes], size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(position, unpacked record)`` of all records that start in ``[start, end)``."""
    window, at = _Window(read_at, size), start
    while (at := window.find_magic(at, min(end, size))) is not None:
        if found := _member(window, at):
            yield at, found[0]
            at = found[1]
        else:
            at += 1


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: what each page's record holds."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
    first = shared.agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = freeze(first.select("digest", "_first"))  # its size lets the planner choose the join
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of :func:`planned`; the manifest ``(path, bytes, records)``.

    The manifest is computed once and kept on shared storage: use it, not a listing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, local = _filesystem(folder)
        files.create_dir(local, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{local}/{name}", compression=None)
                data = encode_record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["digest"])
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        paths, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([f"{folder}/{p}" for p in paths], pa.string()),
                "bytes": pa.array(sizes, pa.int64()),
                "records": pa.array(counts, pa.int64()),
            }
        )

    return freeze(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, _MANIFEST))


def read_archives(manifest: DataFrame, split_bytes: int = 16 << 20, tasks: int = 10_000) -> DataFrame:
    """All records of the files of a manifest, in ranges of ``split_bytes``, over ``tasks`` tasks at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for split in batch.to_pylist():
                files, local = _filesystem(split["path"])
                with files.open_input_file(local) as source:

                    def read_at(at: int, length: int) -> bytes:
                        source.seek(at)
                        return source.read(length)

                    for at, data in records_in(read_at, split["bytes"], split["start"], split["start"] + split_bytes):
                        rows.append({"path": split["path"], "position": at} | decode_record(data))
                        held += len(rows[-1]["payload"])
                        if held >= 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    splits = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    n = min(tasks, max(1, splits.count()))
    return splits.repartition(n, "path", "start").mapInArrow(read, _RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Digest and size of every record's full payload; a revisit takes them from its response.

    Both come from the payload that was read, not from headers; only the link between a
    revisit and its response uses them.
    """
    read = records.select(
        "page_id",
        "record_type",
        "refers_to",
        "digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    read = freeze(read)
    responses = read.where("record_type = 'response'").drop("refers_to", "digest")
    sources = responses.where(F.col("payload_bytes") >= LEAST_SHARED).select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest"
    )
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    followed = revisits.join(sources.distinct(), ["refers_to", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(columns).unionByName(followed.select(columns))


def archive_round_trip(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None
) -> DataFrame:
    """Write all pages below ``folder`` (default: the shared working folder) and read them back.

    One row per row of ``pages``: ``(page_id, payload_bytes, payload_digest, record_type,
    refers_to)``. Of records with equal payloads of at least 100 bytes the one with the
    smallest identifier is a response and the others revisit it. A null page is an empty
    payload. Repeated identifiers: each row that carries the smallest one is a response. A
    null identifier is never referred to: with equal payloads under null identifiers only,
    all are responses. A null address becomes ``urn:x-page:unknown``; blanks and control
    characters in an address are percent-encoded. Other columns are not looked at. An empty
    table gives no rows.
    """
    folder = folder or work_path(pages.sparkSession, "warc")
    return resolved(read_archives(write_archives(planned(pages, page_id, url, html), folder)))


def payload_digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
