"""WARC archives: index first, then coalesced byte-range reads.

write() gives each page a record, a gzip member of its own, in one archive per partition; of records with
equal payloads the one of largest page_id is the response and the others are revisit records without payload. The index
(archive, offset, length, URL, digest, ...) is what a task returns, so an archive that a lost or repeated
task leaves behind is never read. read() sorts selected index rows by archive and offset, joins neighbouring
ranges up to a gap and parses the records.

Null html is an empty payload. Rows that repeat a page_id and its payload have the same type; a null page_id
is the response only where all of its payload's are null. A null URL is written as an empty target. Other columns
are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_BYTES, byte_size, materialize, small

#: Tasks that a payload's pages are dealt to where the responses are too many to broadcast.
SALTS = 64
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record of page {fields['X-Page-Id']} does not end where its header says")
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["WARC-Payload-Length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of page {fields['X-Page-Id']} does not match its digest")
    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
    return int(page) if page else None, fields["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None


def write(pages: DataFrame, folder: str, *, min_payload: int = 0, level: int = 1) -> DataFrame:
    """Write archives of pages(page_id, url, html) under folder; the index, as a table in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= min_payload).groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first, key = materialize(first, "responses"), ["sha"]
    if byte_size(first) > BROADCAST_BYTES:  # pages of one common payload go to SALTS tasks, not to one
        first, key = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sha", "salt"]
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(small(first), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = _open(folder)
        target.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at = 0
        with target.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                index = []
                for page, url, payload, sha, response in zip(*(batch.column(i) for i in range(5))):
                    page, url, payload, response = page.as_py(), url.as_py(), payload.as_py(), response.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    revisit = response is not None and page != response
                    data = gzip.compress(_record(page, url, payload, digest, response, revisit), level, mtime=0)
                    out.write(data)
                    index.append((page, f"{folder}/{name}", at, len(data), url, digest, "revisit" if revisit else "response"))
                    at += len(data)
                columns = list(zip(*index)) or [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "archive", "offset", "length", "url", "digest", "record_type"])

    return materialize(rows.select("page_id", "url", "payload", "sha", "response_id").mapInArrow(run, INDEX), "cdx")


def read(selected: DataFrame, *, gap: int = 64 << 10, block: int = 4 << 20, task_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """Records (RECORD) of the selected index rows. Ranges of an archive that lie at most gap bytes apart are read
    at once, up to about block bytes. Tasks get stretches of task_bytes of an archive, by the records' bytes, not the index's."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    stretch = F.floor(F.col("offset") / task_bytes)
    order = selected.select("archive", "offset", "length").repartition(max(1, -(-total // task_bytes)), "archive", stretch).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict = {}

        def fetch(ranges: list[tuple[str, int, int]]) -> pa.RecordBatch:
            archive, begin = ranges[0][:2]
            if archive not in handles:
                for h in handles.values():
                    h.close()
                handles.clear()
                target, path = _open(archive)
                handles[archive] = target.open_input_file(path)
            data = handles[archive].read_at(ranges[-1][1] + ranges[-1][2] - begin, begin)
            rows = [_parse(zlib.decompress(data[a - begin : a - begin + n], 31)) for _, a, n in ranges]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows))
            if not payloads:
                columns[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (x[0] != held[-1][0] or x[1] - held[-1][1] - held[-1][2] > gap or x[1] + x[2] - held[0][1] > block):
                    yield fetch(held)
                    held = []
                held.append(x)
        if held:
            yield fetch(held)

    return order.mapInArrow(run, RECORD)
