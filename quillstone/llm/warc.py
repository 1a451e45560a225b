"""WARC archives with an index made while they are written, and coalesced range reads of them.

Writing: of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
page_id becomes a response, the others become revisits that refer to it; all other records are
responses. Repeated digests are found on digests and ids alone; up to ``send`` of them are sent to all tasks,
so that no page moves before it is written, and a page that fills a third of the table is no hot key.
Each task writes its share into archive files: a warcinfo record, then one
gzip member per record (WARC/1.1; responses hold an HTTP head and the payload), and returns
file, offset, length, URL, digest and identity of every record it wrote. Only files of tasks that
Spark counts as done are in the index: what a lost or repeated task leaves behind is never read.

Reading: index rows of the wanted records are grouped into ranges, runs of one file of bounded
size; a task reads the sorted byte ranges of one group, joined over small gaps, and parses them.

Cases: null html is an empty payload; null url an empty one; null page_ids are never the smallest,
and records of null id are responses unless a record with an id has their payload; records that
share both the smallest id and the payload are all responses. Repeated rows are written once each.
Other columns are not read. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, saved

_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(head: list[str], body: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def _named(kind: str, name: str, at: int) -> list[str]:
    """The head's first lines; a record is named by its place, so repeated rows have names of their own."""
    return ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}>", f"WARC-Date: {_DATE}"]


def file_head(name: str) -> bytes:
    """The warcinfo record that opens a file."""
    return _member([*_named("warcinfo", name, 0), f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: quillstone\r\nformat: WARC File Format 1.1\r\n")


def _uri(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "").encode()).encode("latin-1").decode(errors="replace")


def record_bytes(name: str, at: int, page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, refers_url: str | None, kind: str) -> bytes:
    """One record as a gzip member."""
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    head = [*_named(kind, name, at), f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"Quillstone-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"Quillstone-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {_DATE}", f"Quillstone-Refers-To-Page: {refers_to}"]
    return _member([*head, "Content-Type: application/http;msgtype=response"], http + (payload if kind == "response" else b""))


def parse_record(data: bytes) -> tuple[tuple, int]:
    """The record at the start of data, as columns of _RECORD, and the compressed bytes it took."""
    inflate = zlib.decompressobj(31)
    raw = inflate.decompress(data)
    if not inflate.eof:
        raise ValueError("a record is cut short")
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:20]!r}")
    h = dict(f.split(": ", 1) for f in fields)
    _, _, body = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    page, refers = h.get("Quillstone-Page-ID"), h.get("Quillstone-Refers-To-Page")
    return (page and int(page), h["WARC-Target-URI"], h["WARC-Type"], refers and int(refers), int(h["Quillstone-Payload-Length"]), digest, body), len(data) - len(inflate.unused_data)


def write_archives(pages: DataFrame, path: str | None = None, *, min_bytes: int = 100, file_bytes: int = 64 << 20, send: int = 200_000) -> DataFrame:
    """Write all pages under path (shared storage, a URI) and return the index."""
    c = F.col
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(c("html").cast("string"), F.lit(""))
    full = pages.select(c("page_id").cast("long"), c("url").cast("string"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = full.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min(F.when(c("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where(c("n") > 1)
    first = saved(first.select("digest", c("first.page_id").alias("first"), c("first.url").alias("first_url")), "warc-repeated")
    few = first.limit(send + 1).count() <= send
    again = c("first").isNotNull() & ~c("page_id").eqNullSafe(c("first"))
    typed = full.join(F.broadcast(first) if few else first, "digest", "left").select("page_id", "url", "html", "digest", F.when(again, c("first")).alias("refers_to"), F.when(again, c("first_url")).alias("refers_url"), F.when(again, "revisit").otherwise("response").alias("kind"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(path)
        store.create_dir(root, recursive=True)
        sink, name, at, rows = None, "", 0, []
        for batch in batches:
            for page_id, url, text, digest, refers, refers_url, kind in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "refers_url", "kind")), strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = file_head(name)
                    sink.write(info)
                    at = len(info)
                data = record_bytes(name, at, page_id, url, text, digest, refers, refers_url, kind)
                sink.write(data)
                rows.append((name, at, len(data), url, digest, page_id, kind))
                at += len(data)
                if at >= file_bytes:
                    sink.close()
                    sink = None
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
                rows = []
        if sink is not None:
            sink.close()

    # the index is written at once: the archives exist, and are written once, before anything reads them
    return saved(typed.mapInArrow(write, _INDEX).withColumn("path", F.lit(path)), "warc-index", 1000)


def read_records(index: DataFrame, *, range_bytes: int = 8 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """The records of the given index rows, read in sorted, coalesced byte ranges."""
    c = F.col
    ranged = index.select("path", "file", "offset", "length", F.floor(c("offset") / range_bytes).alias("range"))
    # tasks by the bytes they will read: index rows are far too small to tell
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // (4 * range_bytes)))
    dealt = ranged.repartition(tasks, "path", "file", "range").sortWithinPartitions("path", "file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("path", "file", "offset", "length")), strict=True):
                last = run[-1] if run else None
                if last and (row[:2] != last[:2] or row[2] > last[2] + last[3] + gap_bytes or row[2] + row[3] - run[0][2] > 2 * range_bytes):
                    yield _read_run(run)
                    run = []
                run.append(row)
            if run:
                yield _read_run(run)

    return dealt.mapInArrow(read, _RECORD)


def _read_run(run: list[tuple]) -> pa.RecordBatch:
    store, root = _filesystem(run[0][0])
    begin = run[0][2]
    until = max(o + n for _, _, o, n in run)
    with store.open_input_file(f"{root}/{run[0][1]}") as f:
        f.seek(begin)
        data = f.read(until - begin)
    rows = []
    for _, _, offset, length in run:
        row, used = parse_record(data[offset - begin : offset - begin + length])
        if used != length:
            raise ValueError("index and archive disagree")
        rows.append(row)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _RECORD.split(", ")])
