"""Web archive (WARC) files: writing with deduplication and segmentation, reading with reassembly.

A record is an HTTP response whose body uses chunked transfer framing. A record
block longer than the segment size is cut: the first segment carries the
record's own type, the others are ``continuation`` records that name the first
one. Reading groups the continuations by their origin, orders them by segment
number, checks the total length and takes the chunk framing off.

Every archive file is written by one task to the shared folder under a name of
its own, and the task returns that name. Only the names of tasks that ended
well are read, so a task that runs again leaves no doubled record.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import work_path, written
from .text import slices

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_BYTES = 64 << 20
MIN_DUPLICATE_BYTES = 100
# Page, file and place in the file: a page's number alone may be repeated.
RECORD_ID = "<urn:x-page:%s:%s>"
NO_ID = "none"
FILES = "file string, n_records long"
RECORDS = "origin string, segment int, total long, type string, refers string, digest string, url string, block binary"
PAGES = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def plan_records(pages: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """Add the payload and ``first_id``: the smallest page_id with the same payload.

    Digests are counted with map-side combine; the join back is salted, so one
    payload that fills a third of the pages is dealt over many tasks.
    """
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = rows.where(F.length("payload") >= min_bytes)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = first.where("first_id is not null").drop("n")
    return salted_join(rows, known, ["digest"], ["page_id", "url"], "left")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = io.BytesIO()
    for start in range(0, len(payload), size):
        piece = payload[start : start + size]
        out.write(b"%x\r\n%s\r\n" % (len(piece), piece))
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; a broken frame raises an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        at = end + 2 + size
        if len(piece) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        out.append(piece)
        at += 2


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}"]
    head += [f"WARC-{name.replace('_', '-')}: {value}" for name, value in fields.items()]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    # One gzip member for each record, as archives have it: a reader may start at any of them.
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + press.flush()


def _records(
    page_id: int | None, url: str, payload: bytes, digest: str, first_id: int | None, segment: int, place: str
) -> Iterator[bytes]:
    page = NO_ID if page_id is None else page_id
    name = RECORD_ID % (page, place)
    common = {"Page_ID": page, "Target_URI": " ".join((url or "").split()), "Payload_Digest": f"sha256:{digest}"}
    if first_id is not None and first_id != page_id:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield _record("revisit", name, head, Refers_To_Page_ID=first_id, **common)
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record("response", name, block, **common)
        return
    parts = [block[start : start + segment] for start in range(0, len(block), segment)]
    yield _record("response", name, parts[0], Segment_Number=1, **common)
    for number, part in enumerate(parts[1:], 2):
        last = {"Segment_Total_Length": len(block)} if number == len(parts) else {}
        own = RECORD_ID % (page, f"{place}:{number}")
        yield _record("continuation", own, part, Segment_Origin_ID=name, Segment_Number=number, **last, **common)


def write_archives(planned: DataFrame, folder: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the planned records below ``folder``; returns the written files, one row each."""
    digest_of = hashlib.sha256

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        for batch in slices(batches, 512):
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["payload"]
                digest = row["digest"] or digest_of(payload).hexdigest()
                for data in _records(row["page_id"], row["url"], payload, digest, row["first_id"], segment, f"{name[:32]}-{count}"):
                    out.write(data)
                    size += len(data)
                    count += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": [count]})

    return planned.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(write, FILES)


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    press, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            break
        parts.append(press.decompress(data))
        if press.eof:
            yield b"".join(parts)
            rest, press, parts = press.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the last record of an archive is cut off")


def _parse(record: bytes) -> dict:
    split = record.index(b"\r\n\r\n")
    version, *lines = record[:split].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]}")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(field["Content-Length"])
    block = record[split + 4 : split + 4 + length]
    if len(block) != length:
        raise ValueError("a record is shorter than its Content-Length")
    total = field.get("WARC-Segment-Total-Length")
    number = field.get("WARC-Segment-Number")
    return {
        "origin": field.get("WARC-Segment-Origin-ID", field["WARC-Record-ID"]),
        "segment": int(number) if number else 0,
        "total": int(total) if total else None,
        "type": field["WARC-Type"],
        "refers": field.get("WARC-Refers-To-Page-ID"),
        "digest": field.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
        "url": field.get("WARC-Target-URI"),
        "block": block,
    }


RECORD_ARROW = pa.schema(
    [
        ("origin", pa.string()),
        ("segment", pa.int32()),
        ("total", pa.int64()),
        ("type", pa.string()),
        ("refers", pa.string()),
        ("digest", pa.string()),
        ("url", pa.string()),
        ("block", pa.binary()),
    ]
)


def read_records(files: DataFrame) -> DataFrame:
    """The records of the named archive files; segment 0 is a record in one piece."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for record in _members(stream):
                        rows.append(_parse(record))
                        size += len(rows[-1]["block"])
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    return files.select("file").mapInArrow(read, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each record: whole records as they are, segments put together.

    Only segmented records are shuffled. The group of a record is as large as
    the record itself. A missing or doubled segment, or a length other than the
    stated one, raises an error that names the record.
    """
    single = records.where("segment = 0").drop("segment", "total")
    parts = records.where("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.max("refers").alias("refers"),
        F.max("digest").alias("digest"),
        F.max("url").alias("url"),
    )
    block = F.expr("unhex(array_join(transform(parts, p -> hex(p.block)), ''))")
    numbers_fit = F.expr("transform(parts, p -> p.segment) = sequence(1, size(parts))")
    joined = parts.withColumn("block", block)
    fits = numbers_fit & (F.length("block") == F.col("total")) & F.col("type").isNotNull()
    problem = F.raise_error(F.concat(F.lit("segments do not fit: "), F.col("origin"))).cast("binary")
    whole = joined.withColumn("block", F.when(F.coalesce(fits, F.lit(False)), F.col("block")).otherwise(problem))
    return single.unionByName(whole.select(*single.columns))


PAGE_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _page_number(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return None if page == NO_ID else int(page)


def decode_pages(whole: DataFrame) -> DataFrame:
    """Pages from whole records. A revisit has no payload, but its length and digest."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = []
            for row in batch.to_pylist():
                head, _, body = row["block"].partition(b"\r\n\r\n")
                field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                page = {"page_id": _page_number(row["origin"]), "url": row["url"], "record_type": row["type"]}
                if row["type"] == "revisit":
                    page |= {
                        "payload_bytes": int(field["Content-Length"]),
                        "payload_digest": row["digest"],
                        "refers_to": int(row["refers"]),
                    }
                else:
                    payload = unchunked(body) if field.get("Transfer-Encoding") == "chunked" else body
                    page |= {
                        "payload": payload,
                        "payload_bytes": len(payload),
                        "payload_digest": hashlib.sha256(payload).hexdigest(),
                    }
                rows.append(page)
            yield pa.RecordBatch.from_pylist(rows, PAGE_ARROW)

    return whole.mapInArrow(decode, PAGES)


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back.

    Of the pages with equal payloads of at least 100 bytes, that with the
    smallest page_id is a ``response``, the others are ``revisit`` records;
    rows that repeat the smallest page_id are responses too, each a record with
    an id of its own. A revisit names the page, not one of its records. Null html is an
    empty payload. A row without page_id is a record too and comes back with a null
    page_id: it revisits the page with the smallest id of its payload, or is a
    response if no row of that payload has an id.
    The archives are deleted when the application ends.
    """
    spark: SparkSession = pages.sparkSession
    folder = work_path(spark, "warc")
    files = written(write_archives(plan_records(pages), folder, segment), "warc-files")
    # As many partitions as files, so that each file is a task's own work.
    return decode_pages(reassemble(read_records(files.repartition(max(1, files.count())))))
