"""Packing token sequences into windows by minimum bin slack.

A document of more than one window fills whole windows alone; its remainder competes with others. For each window the
largest remainder is placed, then a subset-sum over the counts of the remaining lengths, held in one integer as a bit
set, finds the multiset that comes closest to the free space; walking back over the bit sets gives how many of each
length it takes, and the same multiset is used as often as the counts allow. Where no multiset fills a window, the
next remainder is cut to fit. A group's last ids are cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import partition_number
from .tokens import with_tokens

WINDOW = 2048
# Text bytes per group; a group is packed by one task, which holds its ids.
GROUP_TEXT_BYTES = 16 << 20


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near ``capacity`` as possible, and not above it."""
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity or not counts[length]:
            continue
        steps.append((length, reached))
        for _ in range(min(counts[length], capacity // length)):
            wider = (reached | reached << length) & mask
            if wider == reached:
                break
            reached = wider
        if reached >> capacity & 1:
            break
    total = reached.bit_length() - 1
    taken = {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length). Every id of every item lies in exactly one piece."""
    sequences: list[list[tuple[int, int, int]]] = []
    held: dict[int, list[tuple[int, int]]] = {}
    for item, n in enumerate(lengths):
        whole = n // window
        sequences += [[(item, k * window, window)] for k in range(whole)]
        if n % window:
            held.setdefault(n % window, []).append((item, whole * window))
    counts = {n: len(own) for n, own in held.items()}

    def take(n: int) -> tuple[int, int, int]:
        item, start = held[n].pop()
        counts[n] -= 1
        if not counts[n]:
            del counts[n], held[n]
        return item, start, n

    while counts:
        largest = max(counts)
        counts[largest] -= 1
        fill = closest_fill(counts, window - largest)
        counts[largest] += 1
        fill[largest] = fill.get(largest, 0) + 1
        total = sum(n * k for n, k in fill.items())
        if total == window:
            for _ in range(min(counts[n] // k for n, k in fill.items())):
                sequences.append([take(n) for n, k in fill.items() for _ in range(k)])
            continue
        pieces = [take(n) for n, k in fill.items() for _ in range(k)]
        if counts:
            # Everything left is longer than the space: cut the longest to fit.
            item, start, n = take(max(counts))
            pieces.append((item, start, window - total))
            rest = n - (window - total)
            held.setdefault(rest, []).append((item, start + window - total))
            counts[rest] = counts.get(rest, 0) + 1
            sequences.append(pieces)
        else:
            sequences += _powers_of_two(pieces)
    return sequences


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    left = sum(n for _, _, n in pieces)
    sequences, pieces = [], pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        own = []
        while size:
            item, start, n = pieces.pop()
            own.append((item, start, min(n, size)))
            if n > size:
                pieces.append((item, start + size, n - size))
            size -= own[-1][2]
        sequences.append(own)
    return sequences


def pack(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit little-endian).

    Documents are dealt evenly into groups of about ``GROUP_TEXT_BYTES`` of text, whatever their ids or sources, and
    each group is packed alone. Null and empty texts hold the end id alone; rows with equal or null ids are packed as
    separate documents. An empty table gives an empty result; further columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // GROUP_TEXT_BYTES))
    schema = docs.select(id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    columns = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def pack_group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if not rows:
            return
        # The order in which rows arrive doesn't matter.
        rows.sort(key=lambda x: (x[0] is not None, x[0], x[1]) if x[0] is not None else (False, 0, x[1]))
        first = partition_number() << 32
        out: list[tuple] = []
        held = 0
        for number, sequence in enumerate(pack_lengths([len(x) // 2 for _, x in rows], window)):
            offset = 0
            for item, start, n in sequence:
                doc_id, ids = rows[item]
                own = np.frombuffer(ids, "<u2", n, 2 * start).astype("<u4").tobytes()
                out.append((doc_id, start, n, len(ids) // 2, first + number, offset, own))
                offset += n
                held += len(own)
            if held > 4 << 20:
                yield _batch(out, columns, kind)
                out, held = [], 0
        if out:
            yield _batch(out, columns, kind)

    tokens = with_tokens(docs.select(id_col, text_col).repartition(groups), [id_col], tokenizer, end, text_col)
    return tokens.mapInArrow(pack_group, f"{schema}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def _batch(rows: list[tuple], columns: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)
