"""WARC archives with an index first.

Writing: each task writes archives of its own (one gzip member per record) into a shared folder and returns an index row
per record: file, offset, length, URL, digest. Reading: index rows are sorted by file and offset, near ranges are
coalesced into one read, and the records are cut out of it. Nothing scans an archive to find a record.

Of the pages with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the others
are revisits that refer to it; smaller payloads are all responses.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, shared_path, tidy

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def with_references(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (binary, null: empty), digest, refers_to: null for responses.

    Rows that tie on the smallest page_id of a payload are all responses. Digests of one page only, or below `least`
    bytes, take no part in the join (their key is their own), so they don't meet in one task; a digest shared by a third
    of all pages is one row on the small side, and the large side may be split.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("large", F.octet_length("html") >= least)
    many = rows.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    key = F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(many.withColumnRenamed("digest", "key"), "key", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    """The same on every run, so a revisit can name the record that it refers to; its payload has the same digest."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}").urn


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The record, not yet compressed."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=';/?:@&=+$,-_.!~*()#%[]')}"] * (url is not None)
    head += [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of an uncompressed record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    refers = fields.get("WARC-Refers-To-Page-ID")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    ok = kind == "revisit" or (len(payload) == said and hashlib.sha256(payload).hexdigest() == digest)
    return {"page_id": int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": said, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers), "digest_ok": ok, "payload": payload}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write_archives(pages: DataFrame, path: str | None = None, least: int = 100, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes one record per row and returns the index, itself saved as a table.

    Null html is an empty payload; a null url leaves its header out; a null page_id is kept as null; an empty table
    gives an empty index; further columns are ignored. A task that is run again writes new files, and the index names
    only the files of the runs that counted.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, html, digest, refers)) + packer.flush()
                    out.write(member)
                    index.append((page_id, url, digest, "response" if refers is None else "revisit", refers, f"{path}/{name}", at, len(member)))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return saved(with_references(pages, least).mapInArrow(tidy(run), INDEX), "warc-index")


def coalesced(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) rows as reads: first row, row after the last, offset, length."""
    first = 0
    for i in range(1, len(rows) + 1):
        end = rows[i - 1][0] + rows[i - 1][1]
        if i == len(rows) or rows[i][0] - end > gap or rows[i][0] + rows[i][1] - rows[first][0] > most:
            yield first, i, rows[first][0], end - rows[first][0]
            first = i


def read_records(index: DataFrame, payload: bool = False, gap: int = 64 << 10, most: int = 16 << 20) -> DataFrame:
    """Reads the records that the index rows name (all, or a selection) and returns their fields, and the payload if asked.

    Stretches of `most` bytes of the archives are dealt out to about one task for each of them that the selection fills,
    not by the index's own bytes; within a task the ranges come sorted. An empty selection reads nothing.
    """
    asked = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-asked // most))
    rows = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * payload
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                by_file.setdefault(name, []).append((offset, length))
            for name, ranges in by_file.items():
                fs, root = opened(name)
                with fs.open_input_file(root) as f:
                    for first, last, offset, length in coalesced(ranges, gap, most):
                        raw = f.read_at(length, offset)
                        found = [parse_record(zlib.decompress(raw[o - offset : o - offset + n], 31)) for o, n in ranges[first:last]]
                        yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in found], schema)

    return rows.mapInArrow(tidy(run), RECORD + ", payload binary" * payload)
