"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Archives are files of gzip members, one record each. Nothing in such a file says
where members begin, so a task that gets a range of bytes looks for gzip's magic,
and takes a position for a member if it inflates to the header of a WARC record whose
Content-Length fits. A task owns the records that begin in its range, and reads
beyond the range's end to finish the last one.

Archives lie in a file system that pyarrow can open by URI (file, hdfs, s3, ...).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import likely_in, settle, shared_dir

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch time
#: Ranges are dealt to at most so many tasks.
TASKS = 100_000
_CHUNK, _FIRST = 1 << 18, 1 << 14
RECORDS = "page_id long, record_type string, uri string, refers_to long, digest string, payload binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _page_id(record_id: str | None) -> int | None:
    kind, _, number = (record_id or "").strip("<>").rpartition(":")
    return int(number) if kind == "urn:page" else None


def _line(value: str) -> str:
    """A header's value: line breaks would end it, so they are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed. With refers_to it is a revisit and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] * (refers_to is not None)
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, least: int = 100, level: int = 6) -> list[tuple[str, int]]:
    """Write pages (page_id, url, html) as archives into a new folder; returns (file, bytes).

    A null html is an empty payload. Of pages with equal payloads of at least `least`
    bytes the one with the smallest page_id is a response (rows that repeat that
    page_id, too), and the others are revisits of it. Rows without page_id are
    responses. A null url leaves out the target. Other columns are ignored.

    Each task writes a file of its own under another name and renames it at the end,
    so an attempt that dies or runs twice leaves nothing half-written.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= least)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    firsts = settle(firsts, shared_dir(pages.sparkSession))
    maybe = likely_in(firsts, "digest")(F.col("digest"))  # only payloads that are likely repeated go through the join
    met = rows.where(maybe).join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
    rows = met.unionByName(rows.where(~maybe).withColumn("refers_to", F.lit(None).cast("long")))
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        n = 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(own) as out:
            for b in batches:
                for k in range(b.num_rows):
                    page_id, uri, body, digest, refers = (c[k].as_py() for c in b.columns)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    n += out.write(packer.compress(record(page_id, uri, body, digest, refers)) + packer.flush())
        if n:
            fs.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [n]})
        else:
            fs.delete_file(own)

    # One row for each file, as any listing of them would be.
    return [(r["file"], r["bytes"]) for r in rows.mapInArrow(work, "file string, bytes long").collect()]


def members(f, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records (headers, block) whose gzip members begin in [start, end) of an open file."""
    pos, window, base = start, b"", start
    end = min(end, size)
    while pos < end:
        if not base <= pos < base + len(window) - len(MAGIC):
            f.seek(pos)
            window, base = f.read(min(_CHUNK, size - pos)), pos
        at = window.find(MAGIC, pos - base)
        if at < 0:
            pos = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= size:
                return
            continue
        pos = base + at
        if pos >= end:
            return
        found = _member(f, size, pos, window[at : at + _FIRST])
        if found:
            used, head, block = found
            yield head, block
            pos += used
        else:
            pos += 1


def _member(f, size: int, pos: int, data: bytes) -> tuple[int, dict[str, str], bytes] | None:
    """(bytes used, headers, block) if a WARC record's member begins at pos."""
    inflate, text, fed = zlib.decompressobj(31), bytearray(), 0
    try:
        while True:
            text += inflate.decompress(data)
            fed += len(data)
            if not text.startswith(b"WARC/"[: len(text)]):
                return None
            if inflate.eof or pos + fed >= size:
                break
            f.seek(pos + fed)
            data = f.read(min(_CHUNK, size - pos - fed))
    except zlib.error:
        return None
    text = bytes(text)
    head, gap, rest = text.partition(b"\r\n\r\n")
    if not inflate.eof or not gap or not head.startswith(b"WARC/"):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return None
    return fed - len(inflate.unused_data), headers, rest[: int(length)]


def read_warc(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = 16 << 20) -> DataFrame:
    """The records of archives, as page_id, record_type, uri, refers_to, digest, payload.

    files: (URI, size). Ranges of range_bytes are dealt to tasks. The payload is the
    HTTP body (null for revisits), digest the declared one. Bytes that are not a
    member of a WARC record are passed over. No files give an empty result.
    """
    n = sum(-(-size // range_bytes) for _, size in files)
    listed = spark.createDataFrame(files, "file string, size long").where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    table = listed.select("file", "size", starts.alias("at")).repartition(max(1, min(n, TASKS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = _open(name)
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for head, block in members(f, size, at, at + range_bytes):
                        kind, uri = head.get("warc-type"), head.get("warc-target-uri")
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        rows.append((_page_id(head.get("warc-record-id")), kind, None if uri is None else _unline(uri), _page_id(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha256:"), body))
                        held += len(block)
                        if held >= _CHUNK * 8:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return table.mapInArrow(work, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def digests(records: DataFrame, folder: str) -> DataFrame:
    """What archives hold of every page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are those of the payloads as read; a revisit has those of the
    response that it refers to. A response whose declared digest differs is an error.
    """
    own = F.sha2("payload", 256)
    sound = F.when(own == F.col("digest"), own).otherwise(F.raise_error(F.lit("payload and digest differ")))
    read = settle(records.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.col("record_type") == "response", sound).otherwise(F.col("digest")).alias("digest")), folder)
    full = read.where("record_type = 'response'").select(F.col("page_id").alias("r"), F.col("digest").alias("d"), F.col("bytes").alias("full_bytes")).where("r is not null").distinct()
    return read.join(full, F.expr("refers_to = r and digest = d"), "left").select("page_id", F.coalesce("bytes", "full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")

