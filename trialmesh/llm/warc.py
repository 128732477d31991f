"""Web archives: one gzip member per record, written and read sequentially inside Spark tasks.

The reader feeds one member at a time through an incremental decompressor, frames records by Content-Length and checks
the digests of block and payload, so a damaged or cut archive fails loudly. Neither side holds more than one record
and one read buffer.

Payloads that occur again are archived once: the response is the row with the largest id, the others become revisit
records that name it. Which rows those are is found from (digest, id) pairs alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, session_setting
from .files import new_file, partition_number, stream

# Payloads shorter than this are archived each time.
REVISIT_BYTES = 1000
# Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """One id per page and payload: pages of one id with different payloads are different records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record with the payload behind an HTTP header, or a revisit record with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", _DATE)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    return encode_record(headers, block)


class _Member:
    """One gzip member, decompressed as it is read."""

    def __init__(self, source, ahead: bytes):
        self.source, self.ahead = source, ahead
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.ahead or self.source.read(READ_BYTES)
        self.ahead = b""
        if not data:
            raise ValueError("the archive ends inside a record")
        self.held += self.inflate.decompress(data)
        if self.inflate.eof:
            self.ahead = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                raise ValueError("a record's header doesn't end")
        found = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return found

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found

    def finish(self) -> bytes:
        """Bytes that follow the member."""
        while self._more():
            pass
        if bytes(self.held) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        return self.ahead


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, digests verified."""
    ahead = b""
    while True:
        ahead = ahead or source.read(READ_BYTES)
        if not ahead:
            return
        member = _Member(source, ahead)
        first, *lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        block = member.exactly(int(headers["content-length"]))
        ahead = member.finish()
        _verify(headers.get("warc-block-digest"), block)
        if headers.get("warc-type") == "response":
            _verify(headers.get("warc-payload-digest"), payload_of(block))
        yield headers, block


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2]


def _verify(digest: str | None, data: bytes) -> None:
    if digest and digest.partition(":")[2] != hashlib.sha1(data).hexdigest():
        raise ValueError(f"digest {digest} doesn't match")


def archive_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``digest, size, response_id`` of payloads of at least ``REVISIT_BYTES`` that occur more than once; null ids come last."""
    slim = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("size") >= REVISIT_BYTES)
    counted = slim.groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    return scratch.table(counted.filter((F.col("n") > 1) & F.col("response_id").isNotNull()).drop("n"), "roles")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write a record per row to archives below ``folder``; returns the written manifest ``path, n_records, n_bytes``.

    A null payload is empty. Rows that repeat the largest id with the same payload are all responses, as are rows
    of a payload that has no id at all; a row with a null id revisits the response. An empty table gives no archive.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    text = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    taken = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), text.alias("payload"))
    roles = archive_roles(taken, scratch)
    # Few payloads repeat, so this is mostly a join with a small table; a large one is shuffled and its hot keys split.
    rows = taken.withColumn("digest", F.sha1("payload")).join(roles, "digest", "left").select("page_id", "url", "payload", "digest", "response_id")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (row for batch in batches for row in batch.to_pylist())
        row = next(records, None)
        count = 0
        while row is not None:
            path, n, size = f"{folder}/part-{partition_number():06d}-{count:04d}.warc.gz", 0, 0
            with new_file(path) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    revisit = row["response_id"] is not None and row["response_id"] != row["page_id"]
                    record = page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["response_id"], revisit)
                    out.write(record)
                    n, size = n + 1, size + len(record)
                    row = next(records, None)
            count += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    with session_setting(pages.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="500"):
        return scratch.table(rows.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"), "archives")


RECORD_SCHEMA = "path string, page_id bigint, url string, record_type string, record_id string, refers_to_record string, refers_to bigint, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest`` (column ``path``); each archive is read by one task, as a stream.

    A revisit's payload is null and its digest is that of the payload it stands for. Without ``payloads`` the verified
    payload is replaced by its length as text-free ``payload_bytes``.
    """
    n_files = max(1, manifest.count())
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.replace("payload binary", "payload_bytes bigint")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary() if payloads else pa.int64()]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

        for path in (x for b in batches for x in b.column(0).to_pylist()):
            rows: list[tuple] = []
            held = 0
            with stream(path) as source:
                for headers, block in read_records(source):
                    response = headers.get("warc-type") == "response"
                    payload = payload_of(block) if response else None
                    own = payload if payloads else None if payload is None else len(payload)
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    digest = headers.get("warc-payload-digest", "").partition(":")[2]
                    rows.append((path, page and int(page), headers.get("warc-target-uri"), headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-refers-to"), refers and int(refers), digest, own))
                    held += len(block) if payloads else 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return manifest.select("path").repartition(n_files).mapInArrow(read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give every revisit in a written table of records the payload length of the response it names."""
    responses = records.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
    lengths = responses.select(F.col("record_id").alias("refers_to_record"), "payload_digest", "payload_bytes").distinct()
    revisits = records.filter(F.col("record_type") == "revisit").drop("payload_bytes")
    # A revisit whose response is missing or has another digest keeps a null length.
    found = revisits.join(lengths, ["refers_to_record", "payload_digest"], "left")
    return records.filter(F.col("record_type") != "revisit").unionByName(found)


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives, read them back, and list what the records say."""
    scratch = Scratch(spark)
    manifest = write_archives(pages, scratch.path("archives"), scratch=scratch)
    records = scratch.table(read_archives(manifest, payloads=False), "records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
