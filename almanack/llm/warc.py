"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or, if its payload is that of another
capture, a revisit of it) and a metadata record; the first and the last name the
second in WARC-Concurrent-To.  Records may lie anywhere in the archives:
``assemble`` joins them by that identifier and emits one nested row per capture.
Archives are gzip files with a member for each record, rolled at ``ROLL`` bytes,
in a folder that all machines see.

Edge cases: a null html is an empty payload, a null url an empty target; of
equal payloads those with the largest page_id are responses (also rows that
repeat it), a null page_id is below any other; rows that repeat an identifier
are matched by their order; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb
from almanack.llm.shared import open_at

ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, position long, record_id string, type string, concurrent_to string, refers_to string, target_uri string, content_type string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def _member(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def capture(page_id: int | None, url: str, payload: bytes, digest: str, keep: int | None) -> Iterator[bytes]:
    """The three records of a capture; ``keep`` is the page whose payload stands for this one's."""
    uri = url.replace("\r", "").replace("\n", "")
    me, of = _urn("response", page_id, digest), "sha1:" + digest
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", of)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    yield _member("request", _urn("request", page_id, digest), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode())
    http = ("Content-Type", "application/http; msgtype=response")
    if page_id == keep:
        yield _member("response", me, [*common, http], head + payload)
    else:
        yield _member("revisit", me, [*common, http, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("response", keep, digest))], head)
    yield _member("metadata", _urn("metadata", page_id, digest), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields")], f"payload-length: {len(payload)}\r\n{'' if page_id is None else f'page-id: {page_id}'}\r\n".encode())


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) below ``folder``; returns the archives' paths, a table."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    keep = rows.groupBy("digest").agg(F.max("page_id").alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, sub = TaskContext.get().partitionId(), io.BytesIO(), 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out, size, sub
            path = f"{folder}/part-{part:06d}-{sub:04d}-{uuid.uuid4().hex}.warc.gz"
            fs, at = open_at(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as f:
                f.write(out.getvalue())
            out, size, sub = io.BytesIO(), 0, sub + 1
            return pa.RecordBatch.from_pylist([{"path": path}])

        for block in tb.blocks(batches, "payload"):
            for page_id, url, body, digest, kept in zip(*(block.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keep"))):
                for member in capture(page_id, url, body, base64.b32encode(bytes.fromhex(digest)).decode(), kept):
                    out.write(member)
                size += len(body)
                if size >= ROLL:
                    yield close()
        if out.tell():
            yield close()

    return shared.table(rows.join(keep, "digest").mapInArrow(run, "path string"), "warc-paths")


def records_of(f) -> Iterator[dict]:
    """The records of an open archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
    position = 0
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        kind, payload, fields = head["warc-type"], None, {}
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
        elif head.get("content-type") == "application/warc-fields":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().splitlines() if x.strip())}
        digest = head.get("warc-payload-digest")
        if payload is not None and digest not in (None, mine := "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()):
            raise ValueError(f"payload digest {mine} differs from {digest}")
        yield {"position": position, "record_id": head["warc-record-id"], "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "content_type": head.get("content-type"), "payload_digest": digest and digest.partition(":")[2], "payload_bytes": None if payload is None else len(payload), "payload": payload, "fields": list(fields.items())}
        position += 1


def read(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``paths``; without ``payloads`` their bytes are checked and left behind."""
    kinds = pa.schema([("path", pa.string()), ("position", pa.int64()), *((c, pa.string()) for c in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "content_type", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = open_at(path)
                part, size = [], 0
                with fs.open_input_file(at) as f:
                    for record in records_of(f):
                        if not payloads:
                            record["payload"] = None
                        part.append(record | {"path": path})
                        size += 500 + len(record["payload"] or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(part, kinds)
                            part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, kinds)

    files = shared.tasks_of_files(paths)
    return paths.repartition(files, "path").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id and the structs response (or revisit), request and metadata; the last two may be null. The records are settled in a table first, as three sides read them."""
    records = shared.table(records, "warc-records")
    whole = F.struct(*records.columns)

    def side(kinds: tuple[str, ...], key: str, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(key).orderBy("path", "position"))
        return records.filter(F.col("type").isin(*kinds)).select(F.col(key).alias("capture_id"), nth.alias("nth"), whole.alias(name))

    on = ["capture_id", "nth"]
    answers = side(("response", "revisit"), "record_id", "response")
    return answers.join(side(("request",), "concurrent_to", "request"), on, "left").join(side(("metadata",), "concurrent_to", "metadata"), on, "left").drop("nth")


def digests(captures: DataFrame) -> DataFrame:
    page = F.col("metadata.fields")["page-id"].cast("long")
    rows = captures.select("capture_id", page.alias("page_id"), F.col("metadata.fields")["payload-length"].cast("long").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"))
    named = rows.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("target")).agg(F.max("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first, again = rows.filter("target IS NULL").withColumn("refers_to", F.lit(None).cast("long")), rows.filter("target IS NOT NULL").join(named, "target", "left")
    return first.select(*columns).unionByName(again.select(*columns))
