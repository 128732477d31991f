"""Substring deduplication by recompression.

Every text is parsed in rounds that name pairs of neighbouring symbols, and short runs of one symbol, by hashes that are
the same everywhere. Whether two symbols join depends on them alone, so equal passages get equal symbols except near
their ends. Rounds have a length limit: symbols longer than it take no part, so a passage loses at most that many
words on each side, and with ``ROUNDS`` every window of ``WINDOW`` words keeps the symbol over its middle word.

A window can repeat only if the middle symbol's phrase, the symbol with ``MARGIN`` words on both sides, repeats.
Phrases are grouped by name across the corpus; only windows around repeated phrases are then named themselves (96 bits)
and grouped. Both groupings stream over sorted rows, so a passage that very many documents share needs no memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, fits_broadcast, session_setting
from .ngram_join import _WordHash, mix
from .text import words_of
from .tokens import slices

WINDOW = 35
# (step, limit): the limits sum to less than half a window.
ROUNDS = (("pair", 1), ("pair", 1), ("run", 2), ("pair", 2), ("pair", 2), ("pair", 4), ("pair", 4))
LONGEST = 8
MIDDLE = WINDOW // 2
MARGIN = MIDDLE - (LONGEST - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SECOND = np.uint64(0xD1B54A32D192ED03)
# Texts are parsed together up to this size.
SLICE_BYTES = 1 << 20
# What identifies a row between passes.
KEY = ["_row", "_tie"]


class _Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
        return self.up, self.down


def spans_hashed(w: np.ndarray, low: np.ndarray, high: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of the words ``low`` up to ``high`` that doesn't depend on where they stand."""
    up, down = powers.upto(len(w) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
    return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))


def parse(w: np.ndarray, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes in words of the symbols after all rounds; those at ``fixed`` never join."""
    name, size = w, np.ones(len(w), np.int64)
    if fixed is not None:
        size[fixed] = LONGEST + 1
    start = np.arange(len(w))
    for number, (step, limit) in enumerate(ROUNDS):
        if len(name) < 2:
            break
        if step == "pair":
            left = (mix(name + np.uint64(number)) & np.uint64(1)).astype(bool)
            small = size <= limit
            joins = left[:-1] & ~left[1:] & small[:-1] & small[1:]
            at = np.flatnonzero(joins)
            name, size = name.copy(), size.copy()
            name[at] = mix(name[at] * _BASE + name[at + 1])
            size[at] += size[at + 1]
            keep = np.ones(len(name), bool)
            keep[at + 1] = False
        else:
            keep = np.concatenate([[True], name[1:] != name[:-1]])
            first = np.flatnonzero(keep)
            count = np.diff(np.append(first, len(name)))
            short = (count > 1) & (count * size[first] <= limit)
            # Longer runs stay as they are.
            keep |= np.repeat(~short, count)
            name, size = name.copy(), size.copy()
            at = first[short]
            name[at] = mix(name[at] * _SECOND + count[short].astype(np.uint64))
            size[at] *= count[short]
        name, size, start = name[keep], size[keep], start[keep]
    return start, size


def hashed_words(texts: list[str | None], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts one after another, each text with the empty word behind it; where texts begin and end."""
    words, begin, end = [], [], []
    for text in texts:
        begin.append(len(words))
        words += words_of(text)
        end.append(len(words))
        words.append(b"")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.array(begin, np.int64), np.array(end, np.int64)


def phrases(docs: DataFrame, text_col: str) -> DataFrame:
    """``phrase, _row, _tie, place`` (start * 16 + size of the symbol) per symbol with its margins inside the document.

    The texts of a slice are parsed together; the empty words between them join with nothing.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = _WordHash(), _Powers()
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                w, begin, end = hashed_words(part.column(2).to_pylist(), known)
                start, size = parse(w, end)
                doc = np.repeat(np.arange(len(end)), np.diff(np.searchsorted(start, np.append(begin, len(w)))))
                inside = (start - MARGIN >= begin[doc]) & (start + size + MARGIN <= end[doc])
                start, size, doc = start[inside], size[inside], doc[inside]
                if len(start):
                    named = spans_hashed(w, start - MARGIN, start + size + MARGIN, powers).view(np.int64)
                    place = ((start - begin[doc]) * 16 + size).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(named), *(part.column(i).take(pa.array(doc)) for i in (0, 1)), pa.array(place)], names=["phrase", *KEY, "place"])

    return docs.select(*KEY, text_col).mapInArrow(build, "phrase bigint, _row bigint, _tie int, place bigint")


def repeated(rows: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """``others`` of the rows whose key occurs more than once; one row of a group at most is held back at a time."""
    k = len(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_out = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(i).to_numpy() for i in range(k)])
            same = (key[1:] == key[:-1]).all(axis=1)
            joined = last is not None and bool((key[0] == last).all())
            again = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
            found = batch.select(others).filter(pa.array(again))
            if joined and not held_out:
                yield held
            if found.num_rows:
                yield found
            last, held, held_out = key[-1], batch.select(others).slice(batch.num_rows - 1), bool(again[-1])

    return rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _joined(docs: DataFrame, per_row: DataFrame, how: str) -> DataFrame:
    """Documents with a written table of at most one row for each; broadcast if it is small, else both are shuffled."""
    return docs.join(F.broadcast(per_row) if fits_broadcast(per_row, max_rows=1_000_000) else per_row, KEY, how)


def windows(docs: DataFrame, text_col: str) -> DataFrame:
    """``h, g, _row, _tie, start`` of each window whose middle symbol is among ``places``."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = _WordHash(), _Powers()
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                w, begin, end = hashed_words(part.column(2).to_pylist(), known)
                counts, places = pc.list_value_length(part.column(3)).to_numpy(), part.column(3).flatten().to_numpy()
                low, high = np.repeat(begin, counts), np.repeat(end, counts)
                first, size = low + places // 16 - MIDDLE, places % 16
                wanted = np.zeros(len(w), bool)
                for k in range(LONGEST):
                    at = first + k
                    wanted[at[(k < size) & (at >= low) & (at + WINDOW <= high)]] = True
                at = np.flatnonzero(wanted)
                doc = np.searchsorted(begin, at, side="right") - 1
                h = spans_hashed(w, at, at + WINDOW, powers)
                g = spans_hashed(mix(w ^ _SECOND), at, at + WINDOW, powers)
                columns = [pa.array(h.view(np.int64)), pa.array((g >> np.uint64(33)).astype(np.int32)), *(part.column(i).take(pa.array(doc)) for i in (0, 1)), pa.array((at - begin[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "g", *KEY, "start"])

    return docs.select(*KEY, text_col, "places").mapInArrow(build, "h bigint, g int, _row bigint, _tie int, start int")


def covers(starts: DataFrame) -> DataFrame:
    """Per document the ranges of words under its repeated windows: ``_row, _tie, ranges`` (low, high, low, high, ...)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2):
                at = np.sort(own.values.to_numpy())
                new = np.concatenate([[True], at[1:] > at[:-1] + WINDOW])
                end = np.concatenate([at[:-1][new[1:]], at[-1:]]) + WINDOW
                out.append(np.column_stack([at[new], end]).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=[*KEY, "ranges"])

    return starts.groupBy(*KEY).agg(F.collect_set("start").alias("starts")).mapInArrow(build, "_row bigint, _tie int, ranges array<int>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``id_col, n_words, n_removed, kept_text``.

    Words under a window of 35 words that also starts anywhere else, in this or another document, are removed; the
    others are joined by one space. Windows are judged on the input. Null, empty and shorter texts lose nothing.
    Rows with equal or null ids are separate documents. An empty table gives an empty result; further columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # Each of the three passes over the texts must find a row again, so rows go by their content (96 bits). Equal rows
    # share that and count as often as they occur.
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_row"), F.hash(id_col, text_col).alias("_tie"))
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="1000"):
        places = scratch.table(repeated(phrases(taken, "_text"), ["phrase"], [*KEY, "place"]), "places")
        marked = scratch.table(places.groupBy(*KEY).agg(F.collect_set("place").alias("places")), "marked")
        named = windows(_joined(taken, marked, "inner"), "_text")
        starts = scratch.table(repeated(named, ["h", "g"], [*KEY, "start"]), "starts")
        ranges = scratch.table(covers(starts), "ranges")
        scratch.drop(places, starts)
    joined = _joined(taken, ranges, "left").select("_id", "_text", "ranges")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counts, removed, kept = [], [], []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = words_of(text)
                    counts.append(len(words))
                    for low, high in reversed(list(zip(own[::2], own[1::2])) if own else []):
                        del words[low:high]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, f"_id {id_type}, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("_id", id_col)


