"""Token files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending document order:

    magic, block size
    blocks      minimum, count, width, bytes per high part, number of exceptions, packed low bits of (id - minimum),
                positions and high bits of the exceptions, crc32
    documents   flags for null document ids, document ids, end of each document in ids
    index       start of each block in bytes
    footer      counts, section starts, crc32 of documents and index, magic

The width is the number of bits that holds a percentile of a block's differences, of several percentiles the one that
makes the block smallest; larger differences keep their low bits in place and their high bits in the exception list. Blocks are found by the index, so any document is read by decoding
only the blocks it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, session_setting
from .files import new_file, partition_number, random_access
from .tokens import with_tokens

MAGIC = b"PFORTOK1"
BLOCK = 8192
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.98, 1.0)
# Text bytes per file; a file is written by one task, streaming.
FILE_TEXT_BYTES = 32 << 20
_HEAD = struct.Struct("<IIBBI")
_FOOT = struct.Struct("<QQQQQI8s")


def pack_block(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> bytes:
    low = int(ids.min())
    rest = (ids.astype(np.uint32) - np.uint32(low)).astype("<u4")
    lengths = np.frexp(rest.astype(float))[1]
    # How many differences need at most so many bits.
    upto = np.cumsum(np.bincount(lengths, minlength=33))
    longest = int(np.flatnonzero(upto == len(rest))[0])
    sizes = {}
    for share in percentiles:
        width = int(np.searchsorted(upto, share * len(rest)))
        sizes[width] = (len(rest) * width + 7) // 8 + int(len(rest) - upto[width]) * (4 + _bytes(longest - width))
    width = min(sizes, key=lambda w: (sizes[w], w))
    high_bytes = _bytes(longest - width)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    positions = np.flatnonzero(lengths > width)
    body = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    high = (rest[positions].astype("<u8") >> np.uint64(width)).astype("<u4") if len(positions) else np.empty(0, "<u4")
    body += positions.astype("<u4").tobytes() + high.astype(f"<u{high_bytes}").tobytes()
    block = _HEAD.pack(low, len(rest), width, high_bytes, len(positions)) + body
    return block + struct.pack("<I", zlib.crc32(block))


def _bytes(bits: int) -> int:
    return 1 if bits <= 8 else 2 if bits <= 16 else 4


def unpack_block(block: bytes) -> np.ndarray:
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged token block")
    low, n, width, high_bytes, n_exceptions = _HEAD.unpack_from(block)
    at = _HEAD.size
    size = (n * width + 7) // 8
    values = np.zeros((n, 4), np.uint8)
    if width:
        bits = np.unpackbits(np.frombuffer(block, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        own = np.packbits(bits, axis=1, bitorder="little")
        values[:, : own.shape[1]] = own
    values = values.view("<u4").reshape(-1)
    if n_exceptions:
        positions = np.frombuffer(block, "<u4", n_exceptions, at + size)
        high = np.frombuffer(block, f"<u{high_bytes}", n_exceptions, at + size + 4 * n_exceptions)
        values[positions] |= high.astype(np.uint32) << np.uint32(width)
    return values + np.uint32(low)


class TokenFileWriter:
    def __init__(self, out, block: int = BLOCK, percentiles: tuple[float, ...] = PERCENTILES):
        self.out, self.block, self.percentiles = out, block, percentiles
        self.at = out.write(MAGIC + struct.pack("<I", block)) or len(MAGIC) + 4
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.n_ids = 0
        self._held: list[np.ndarray] = []
        self._n_held = 0

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        for doc_id, own in zip(doc_ids, ids):
            self.n_ids += len(own)
            self.doc_ids.append(doc_id)
            self.ends.append(self.n_ids)
        self._held += ids
        self._n_held += sum(map(len, ids))
        if self._n_held >= self.block:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        held = np.concatenate(self._held) if self._held else np.empty(0, np.uint32)
        whole = len(held) if final else len(held) // self.block * self.block
        for start in range(0, whole, self.block):
            packed = pack_block(held[start : min(whole, start + self.block)], self.percentiles)
            self.starts.append(self.at)
            self.out.write(packed)
            self.at += len(packed)
        self._held = [held[whole:]]
        self._n_held = len(held) - whole

    def close(self) -> None:
        self._write(final=True)
        nulls = np.packbits(np.array([x is None for x in self.doc_ids], bool), bitorder="little").tobytes()
        docs = nulls + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes()
        index = np.array(self.starts, "<u8").tobytes()
        self.out.write(docs + index)
        self.out.write(_FOOT.pack(len(self.starts), len(self.doc_ids), self.n_ids, self.at, self.at + len(docs), zlib.crc32(docs + index), MAGIC))


class TokenFile:
    """Random access to one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        (self.block,) = struct.unpack("<I", source.read(4))
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOT.size)
        n_blocks, n_docs, self.n_ids, docs_at, index_at, check, magic = _FOOT.unpack(source.read(_FOOT.size))
        source.seek(docs_at)
        held = source.read(end - _FOOT.size - docs_at)
        if magic != MAGIC or zlib.crc32(held) != check:
            raise ValueError("damaged token file")
        flags = (n_docs + 7) // 8
        nulls = np.unpackbits(np.frombuffer(held, np.uint8, flags), count=n_docs, bitorder="little").astype(bool)
        ids = np.frombuffer(held, "<i8", n_docs, flags)
        self.doc_ids = [None if null else int(x) for null, x in zip(nulls, ids)]
        self.ends = np.frombuffer(held, "<u8", n_docs, flags + 8 * n_docs).astype(np.int64)
        self.starts = np.concatenate([np.frombuffer(held, "<u8", n_blocks, index_at - docs_at).astype(np.int64), [docs_at]])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` up to ``end`` of the file."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.starts[first]))
        data = self.source.read(int(self.starts[last + 1] - self.starts[first]))
        cuts = self.starts[first : last + 2] - self.starts[first]
        found = np.concatenate([unpack_block(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        return found[start - first * self.block : end - first * self.block]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[list[int | None], list[int], list[np.ndarray]]]:
        """Document ids, starts and ids of consecutive documents, about ``ids_at_once`` ids at a time."""
        begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        at = 0
        while at < len(self.ends):
            to = max(at + 1, int(np.searchsorted(self.ends, begins[at] + ids_at_once, "right")))
            ids = self.ids(int(begins[at]), int(self.ends[to - 1]))
            base = int(begins[at])
            yield self.doc_ids[at:to], begins[at:to].tolist(), [ids[int(a) - base : int(b) - base] for a, b in zip(begins[at:to], self.ends[at:to])]
            at = to


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Encode every whole text and write the ids to files below ``folder``, ascending by document id.

    Returns the written manifest: ``file_number, path, n_docs, n_ids``. Texts are dealt by ranges of (id, text hash),
    so ids that repeat or are null do not gather in one task. Null ids come first; rows with one id are ordered by
    their text's hash, then their text. Null and empty texts hold the end id alone. An empty table gives no file.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    taken = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = taken.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-size // FILE_TEXT_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = taken.repartitionByRange(n_files, *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        number = partition_number()
        path = f"{folder}/tokens-{number:06d}.pfor"
        with new_file(path) as out:
            writer = TokenFileWriter(out)
            while first is not None:
                writer.add(first.column(0).to_pylist(), [np.frombuffer(x.as_buffer(), "<u2") for x in first.column(1)])
                first = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"file_number": [number], "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="1000"):
        return scratch.table(with_tokens(dealt, ["doc_id"], tokenizer, end).mapInArrow(write, "file_number bigint, path string, n_docs bigint, n_ids bigint"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start`` (ids of all documents before it), ``ids`` (binary, unsigned 32-bit little-endian).

    ``manifest`` has a few dozen bytes per file; its running sum gives each file's first position.
    """
    n_files = max(1, manifest.count())
    before = F.sum("n_ids").over(Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(n_files)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with random_access(path) as source:
                    for doc_ids, starts, ids in TokenFile(source).documents():
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": doc_ids, "start": [base + x for x in starts], "ids": [x.astype("<u4").tobytes() for x in ids]},
                            schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]),
                        )

    return files.mapInArrow(read, "doc_id bigint, start bigint, ids binary")
