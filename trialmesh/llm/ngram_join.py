"""Jaccard join of word n-gram sets with signature trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets of Jaccard similarity s share a token
among the first ``n - ceil(s n) + 1`` of each in any common order, so sets meet in buckets by those tokens; frequent
tokens come last in the order, which keeps buckets small, and a pair needs a look only where its first common token may
be: with i and j tokens before it, the overlap is at most the smaller of ``n - i`` and ``m - j``. Within a bucket a signature tree is built: leaves hold a few
sets ordered by size, nodes the OR of their token bitmaps and their range of sizes, and a dual traversal drops pairs of
nodes whose largest possible overlap is too small. What it leaves is verified on the whole sets.

A first round links each set to its most similar neighbour in two min-hash buckets, and in large ones also to the set in
their middle, so near copies already form components, and buckets that lie in one component need no second look. The second round is exact: every pair of
different components that shares a bucket is searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, fits_broadcast, session_setting
from .components import components
from .tokens import slices

WORDS = 5
# Similarity as a fraction of whole numbers, so that the comparison is exact.
SIMILAR = (80, 100)
# Buckets go by the upper 48 bits of a token, which keeps the order; the sets themselves hold whole tokens.
BUCKET_SHIFT = np.uint64(16)
# Tokens known to be frequent only set the order of tokens, never whether a pair is found.
FREQUENT_TOKENS = 200_000
FREQUENT_TIMES = 4
COUNTED_AT_ONCE = 4_000_000
SLICE_BYTES = 1 << 20
# Larger min-hash buckets are cut into groups; larger token buckets are split into pairs of blocks.
GROUP_SETS = 256
BLOCK_SETS = 1024
LEAF = 16
BRANCH = 4
MIN_BITS = 1 << 10
MAX_BITS = 1 << 17
# Words of bitmaps compared at once.
COMPARED_WORDS = 1 << 21
_CACHE_WORDS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], known: dict) -> list[np.ndarray]:
    """Sorted tokens of each text's distinct shingles; A-Z in lower case. A shorter text's whole sequence is one token."""
    tokens, bounds = shingles(texts, known)
    return [np.unique(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def shingles(texts: list[str | None], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all shingles of the texts, repeats included, and the bounds of each text's own."""
    words, ends = [], [0]
    for text in texts:
        # ``bytes.lower`` changes A-Z alone.
        words += text.encode("utf-8", "surrogatepass").lower().split() if text else []
        ends.append(len(words))
    ends = np.array(ends, np.int64)
    counts = np.diff(ends)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    rolled = np.full(len(w), WORDS, np.uint64)
    full = max(len(w) - WORDS + 1, 0)
    for k in range(WORDS if full else 0):
        rolled[:full] = rolled[:full] * _ODD + w[k : k + full]
    # A word starts a shingle if enough words of its text follow; the first word of a short text starts its only one.
    ahead = np.repeat(ends[1:], counts) - np.arange(len(w))
    starts = ahead >= WORDS
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
        value = np.full(1, counts[i], np.uint64)
        for x in w[ends[i] : ends[i + 1]]:
            value = value * _ODD + x
        rolled[ends[i]], starts[ends[i]] = value[0], True
    return mix(rolled[starts]), np.concatenate([[0], np.cumsum(starts)])[ends]


def shingle_set(text: str | None, known: dict) -> np.ndarray:
    return shingle_sets([text], known)[0]


def prefix_length(n: int) -> int:
    return n + 1 - -(-n * SIMILAR[0] // SIMILAR[1])


def bitmap_bits(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (2 * max(n, 1) - 1).bit_length()))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap of a power-of-two size; folding its halves gives the bitmap of half the size."""
    bits = bitmap_bits(len(tokens))
    flags = np.zeros(bits, np.uint8)
    flags[(mix(tokens) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _ones(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps).sum(axis=-1, dtype=np.int64)


def needed(na, nb):
    """Least overlap of two sets of these sizes: J >= s means overlap >= s / (1 + s) * (na + nb)."""
    return -(-(na + nb) * SIMILAR[0] // (SIMILAR[0] + SIMILAR[1]))


class SignatureTree:
    """Levels of nodes over sets ordered by size; level 0 holds the sets, a node at level k covers ``LEAF * BRANCH**(k-1)`` of them."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.maps, self.sizes = maps[self.order], sizes[self.order]
        self.levels = []
        low, high, ored, lost = self.sizes, self.sizes, self.maps, self.sizes - _ones(self.maps)
        step = LEAF
        while len(low) > 1 or not self.levels:
            cuts = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            ored, lost = np.bitwise_or.reduceat(ored, cuts, axis=0), np.maximum.reduceat(lost, cuts)
            self.levels.append((low, high, ored, lost))
            step = BRANCH


def dual_traversal(left: SignatureTree, right: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions in the inputs) that may be similar enough; blocks of pairs of leaves.

    A set's tokens that share a bit with another of its tokens (``lost``) may all be in the overlap, so a pair of nodes
    can overlap in at most the common bits and the larger number of lost tokens on either side.
    """
    level = max(len(left.levels), len(right.levels)) - 1
    heights = [min(level, len(t.levels) - 1) for t in (left, right)]
    a, b = np.meshgrid(np.arange(len(left.levels[heights[0]][0])), np.arange(len(right.levels[heights[1]][0])), indexing="ij")
    pairs = np.column_stack([a.ravel(), b.ravel()])
    for level in range(level, -1, -1):
        la, lb = left.levels[min(level, heights[0])], right.levels[min(level, heights[1])]
        kept = []
        step = max(1, COMPARED_WORDS // left.maps.shape[1])
        for at in range(0, len(pairs), step):
            part = pairs[at : at + step]
            x, y = part[:, 0], part[:, 1]
            fits = (la[1][x] * SIMILAR[1] >= lb[0][y] * SIMILAR[0]) & (lb[1][y] * SIMILAR[1] >= la[0][x] * SIMILAR[0])
            x, y = x[fits], y[fits]
            most = _ones(la[2][x] & lb[2][y]) + np.minimum(la[3][x], lb[3][y])
            fits = most >= needed(la[0][x], lb[0][y])
            kept.append(np.column_stack([x[fits], y[fits]]))
        pairs = np.concatenate(kept) if kept else pairs[:0]
        if level and len(pairs):
            pairs = _descend(pairs, 0, level <= heights[0], len(left.levels[min(level - 1, heights[0])][0]))
            pairs = _descend(pairs, 1, level <= heights[1], len(right.levels[min(level - 1, heights[1])][0]))
    for x, y in pairs:
        ia, ib = np.arange(x * LEAF, min((x + 1) * LEAF, len(left.sizes))), np.arange(y * LEAF, min((y + 1) * LEAF, len(right.sizes)))
        na, nb = left.sizes[ia][:, None], right.sizes[ib][None, :]
        ma, mb = left.maps[ia][:, None, :], right.maps[ib][None, :, :]
        most = np.minimum(na - _ones(ma & ~mb), nb - _ones(mb & ~ma))
        fa, fb = np.nonzero(most >= needed(na, nb))
        if len(fa):
            yield left.order[ia[fa]], right.order[ib[fb]]


def _descend(pairs: np.ndarray, side: int, split: bool, count: int) -> np.ndarray:
    if not split:
        return pairs
    grown = np.repeat(pairs, BRANCH, axis=0)
    grown[:, side] = grown[:, side] * BRANCH + np.tile(np.arange(BRANCH), len(pairs))
    return grown[grown[:, side] < count]


def similar_candidates(maps: list[np.ndarray], sizes: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of different groups that may be similar, from trees over the sets of each bitmap size."""
    widths = np.array([len(m) for m in maps])
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        tree = SignatureTree(np.stack([maps[i] for i in own]), sizes[own])
        for a, b in dual_traversal(tree, tree):
            a, b = own[a], own[b]
            fits = (a < b) & (group[a] != group[b])
            yield a[fits], b[fits]
        # Sizes within a factor of 1.25 differ by at most one doubling of the bitmap.
        wider = np.flatnonzero(widths == 2 * w)
        if len(wider):
            folded = SignatureTree(fold(np.stack([maps[i] for i in wider]), w), sizes[wider])
            for a, b in dual_traversal(tree, folded):
                a, b = own[a], wider[b]
                fits = group[a] != group[b]
                yield a[fits], b[fits]


def frequent_tokens(docs: DataFrame, text_col: str) -> np.ndarray:
    """Up to ``FREQUENT_TOKENS`` tokens that occur several times among a few million neighbours, counted over all documents (without their lowest bits)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _WordHash(), [], 0

        def often() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts >= FREQUENT_TIMES
            return pa.RecordBatch.from_pydict({"token": tokens[more].astype(np.int64), "n": counts[more].astype(np.int64)})

        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                held.append(shingles(part.column(0).to_pylist(), known)[0] >> BUCKET_SHIFT)
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    counts = docs.select(text_col).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token").collect()], np.uint64))


def shingle_table(docs: DataFrame, text_col: str, frequent: np.ndarray, scratch: Scratch) -> DataFrame:
    """``_row, doc_id, n, digest, prefix`` (upper 48 bits of tokens), ``bits`` and two min-hashes ``k0, k1`` per row of ``docs (_row, doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    salt = np.uint64(0xA0761D6478BD642F)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = _WordHash(), held.value
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                out = {k: [] for k in ("n", "digest", "prefix", "bits", "k0", "k1")}
                for own in shingle_sets(part.column(2).to_pylist(), known):
                    n, places = len(own), own >> BUCKET_SHIFT
                    out["n"].append(n)
                    if not n:
                        for k in ("digest", "prefix", "bits", "k0", "k1"):
                            out[k].append(None)
                        continue
                    late = np.searchsorted(often, places)
                    late[late == len(often)] = 0
                    is_late = often[late] == places if len(often) else np.zeros(n, bool)
                    out["digest"].append(xxhash.xxh3_128_digest(own.tobytes()))
                    out["prefix"].append(np.concatenate([places[~is_late], places[is_late]])[: prefix_length(n)].tobytes())
                    out["bits"].append(bitmap(own).tobytes())
                    out["k0"].append(int(mix(own).min() >> np.uint64(1)))
                    out["k1"].append(int(mix(own ^ salt).min() >> np.uint64(1)))
                columns = [pa.array(out["n"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("digest", "prefix", "bits")], *[pa.array(out[k], pa.int64()) for k in ("k0", "k1")]]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["_row", "doc_id", *out])

    return scratch.table(docs.select("_row", "doc_id", text_col).mapInArrow(build, f"_row bigint, doc_id {id_type}, n bigint, digest binary, prefix binary, bits binary, k0 bigint, k1 bigint"), "shingles")


def _by_group(rows: DataFrame, keys: list[str], handle, schema: str) -> DataFrame:
    """``handle(columns)`` for the rows of each key, in partitions sorted by key."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    k = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(ids[a])
                if key != last:
                    if held:
                        yield from handle(pa.Table.from_batches(held))
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        if held:
            yield from handle(pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(run, schema)


def _maps(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def nearest_pairs(rows: DataFrame, key: str) -> DataFrame:
    """For each set of a min-hash bucket the earlier set of similar size with the most common bits: at most one pair per row."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        ids, sizes, maps = table["_row"].to_numpy(), table["n"].to_numpy(), _maps(table["bits"])
        widths = np.array([len(m) for m in maps])
        out_a, out_b = [], []
        for w in np.unique(widths):
            own = np.flatnonzero((widths == w) | (widths == 2 * w))
            own = own[np.lexsort((ids[own], sizes[own]))]
            if len(own) < 2:
                continue
            all_maps = np.stack([fold(maps[i][None, :], w)[0] for i in own])
            # Neighbours in size: blocks that overlap by half.
            for at in range(0, len(own), 256):
                part, low = own[at : at + 256], max(0, at - 256)
                before = own[low : at + len(part)]
                step = max(1, COMPARED_WORDS // (int(w) * len(before)))
                common = np.concatenate([_ones(all_maps[k : min(k + step, at + len(part))][:, None, :] & all_maps[low : at + len(part)][None, :, :]) for k in range(at, at + len(part), step)])
                na, nb = sizes[part][:, None], sizes[before][None, :]
                earlier = np.arange(low, low + len(before))[None, :] < np.arange(at, at + len(part))[:, None]
                fits = earlier & (nb * SIMILAR[1] >= na * SIMILAR[0])
                score = np.where(fits, common / np.maximum(na, nb), -1.0)
                best = score.argmax(axis=1)
                found = score[np.arange(len(part)), best] >= 0
                out_a += ids[part[found]].tolist()
                out_b += ids[before[best[found]]].tolist()
        if out_a:
            yield pa.RecordBatch.from_pydict({"a": np.minimum(out_a, out_b), "b": np.maximum(out_a, out_b)})

    return _by_group(rows.select(key, "group", "_row", "n", "bits"), [key, "group"], handle, "a bigint, b bigint")


def medoids(rows: DataFrame, key: str) -> DataFrame:
    """The set of each group that has most bits in common with the others: ``key, _row, score``."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        maps = _maps(table["bits"])
        width = min(len(m) for m in maps)
        flags = np.unpackbits(np.stack([fold(m[None, :], width)[0] for m in maps]).view(np.uint8), axis=1).astype(np.float32)
        score = (flags @ flags.sum(axis=0)) / table["n"].to_numpy()
        best = int(score.argmax())
        yield pa.RecordBatch.from_pydict({key: [table[key][0].as_py()], "_row": [table["_row"][best].as_py()], "score": [float(score[best])]})

    return _by_group(rows.select(key, "group", "_row", "n", "bits"), [key, "group"], handle, f"{key} bigint, _row bigint, score double")


def small_candidates(maps: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``similar_candidates`` of many sorted buckets of a leaf's size at once: trees of one leaf each."""
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    before = np.arange(len(bucket)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    a = np.repeat(np.arange(len(bucket)), before)
    b = a - 1 - (np.arange(len(a)) - np.repeat(np.cumsum(before) - before, before))
    fits = (group[a] != group[b]) & (np.minimum(sizes[a], sizes[b]) * SIMILAR[1] >= np.maximum(sizes[a], sizes[b]) * SIMILAR[0])
    a, b = a[fits], b[fits]
    widths = np.array([len(m) for m in maps])
    a, b = np.where(widths[a] <= widths[b], a, b), np.where(widths[a] <= widths[b], b, a)
    for w in np.unique(widths[a]):
        own = np.flatnonzero(widths[a] == w)
        step = max(1, COMPARED_WORDS // int(w))
        for at in range(0, len(own), step):
            x, y = a[own[at : at + step]], b[own[at : at + step]]
            ma = np.stack([maps[i] for i in x])
            mb = np.stack([m if len(m) == w else fold(m[None, :], w)[0] for m in (maps[i] for i in y)])
            most = np.minimum(sizes[x] - _ones(ma & ~mb), sizes[y] - _ones(mb & ~ma))
            fits = most >= needed(sizes[x], sizes[y])
            yield x[fits], y[fits]


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs between components from rows ``token, x, y, _row, n, place, bits, component``.

    ``x`` and ``y`` number the blocks of a large bucket; ``place`` is the token's place in the set's order.
    """

    def candidates(table: pa.Table, bucket: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        ids, sizes, place, group = (table[c].to_numpy() for c in ("_row", "n", "place", "component"))
        maps = _maps(table["bits"])
        for a, b in similar_candidates(maps, sizes, group) if bucket is None else small_candidates(maps, sizes, group, bucket):
            # What the overlap can be if this is the first token in common.
            fits = np.minimum(sizes[a] - place[a], sizes[b] - place[b]) >= needed(sizes[a], sizes[b])
            a, b = ids[a[fits]], ids[b[fits]]
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.column_stack([table[c].to_numpy() for c in ("token", "x", "y")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            counts = np.diff(cuts)
            number = np.repeat(np.arange(len(counts)), counts)
            small = (counts > 1) & (counts <= LEAF)
            taken = np.flatnonzero(small[number])
            if len(taken):
                yield from candidates(table.take(pa.array(taken)), number[taken])
            for i in np.flatnonzero(counts > LEAF).tolist():
                yield from candidates(table.slice(cuts[i], counts[i]), None)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            # The batch's last bucket may go on in the next one.
            own = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(own[-1]) + 1 if len(own) else 0
            if held and (cut or last != tuple(keys[-1])):
                yield from finished(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from finished(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = tuple(keys[-1])
        if held:
            yield from finished(pa.Table.from_batches(held))

    keys = ["token", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """The pairs of a written table whose whole sets are similar enough; sets are built from the texts of the rows concerned."""
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "concerned")
    few = fits_broadcast(ids, max_rows=1_000_000)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                sets = [own.tobytes() for own in shingle_sets(part.column(1).to_pylist(), known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["_row", "tokens"])

    taken = docs.select("_row", text_col).join(F.broadcast(ids) if few else ids, "_row", "left_semi")
    sets = scratch.table(taken.mapInArrow(build, "_row bigint, tokens binary"), "sets")
    joined = pairs.join(sets.select(F.col("_row").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("_row").alias("b"), F.col("tokens").alias("tb")), "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                found.append(common >= needed(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return scratch.table(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint"), "links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``id_col, _row, n_shingles, component_id, component_row``.

    Documents link when 100 * |intersection| >= 80 * |union| of their sets; the component is the smallest id reachable
    (null ids count as larger than any; a component of null ids has a null id), and ``component_row`` the row that
    has it. Null, empty and white-space texts have an empty set and link with nothing. Rows with equal sets always
    link. An empty table gives an empty result; further columns are ignored. ``row_col`` may name a column of unique
    numbers that stay the same when ``docs`` is read again.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # Texts are read again for verification, so rows go by their content where they have no number; equal rows share it.
    row = F.col(row_col) if row_col else F.xxhash64(id_col, text_col)
    taken = docs.select(row.alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="1000"):
        slim = shingle_table(taken, "_text", frequent_tokens(taken, "_text"), scratch)
        # Equal sets are one class, represented by its first row.
        classes = scratch.table(slim.filter("n > 0").groupBy("digest").agg(F.min("_row").alias("class")), "classes")
        members = scratch.table(slim.select("_row", "doc_id", "n", "digest").join(classes, "digest", "left").select("_row", "doc_id", "n", F.coalesce("class", "_row").alias("class")), "members")
        first = slim.join(classes.select(F.col("class").alias("_row")), "_row", "left_semi")
        first = scratch.table(first, "first")
        scratch.drop(slim)

        near = None
        for k in ("k0", "k1"):
            crowded = scratch.table(first.groupBy(k).agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).alias("groups"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").drop("sets"), "crowded")
            grouped = first.join(crowded, k).withColumn("group", F.pmod(F.xxhash64(F.lit(k), "_row"), F.col("groups")))
            pairs = nearest_pairs(grouped, k)
            # In a large bucket all sets are also compared with the one in its middle.
            large = grouped.filter("groups > 1")
            middle = scratch.table(medoids(large, k).groupBy(k).agg(F.max_by("_row", "score").alias("hub")), "middle")
            pairs = pairs.union(large.join(middle, k).filter("_row <> hub").select(F.least("_row", "hub").alias("a"), F.greatest("_row", "hub").alias("b")))
            near = pairs if near is None else near.union(pairs)
        near = scratch.table(near.distinct(), "near")
        links = verified(near, taken, "_text", scratch)
        known = scratch.table(components(links, scratch), "known")

        placed = scratch.table(first.select("_row", "n", "bits", "prefix").join(known.withColumnRenamed("node", "_row"), "_row", "left").withColumn("component", F.coalesce("component", "_row")), "placed")
        scratch.drop(first)
        tokens = explode_prefix(placed.select("_row", "component", "prefix"))
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        shared = scratch.table(shared.select("token", F.ceil(F.col("sets") / BLOCK_SETS).alias("blocks")), "shared")
        few = fits_broadcast(shared, max_rows=1_000_000)
        meeting = scratch.table(tokens.join(F.broadcast(shared) if few else shared, "token").select("token", "blocks", "_row", "place"), "meeting")
        block = F.pmod(F.xxhash64("_row"), F.col("blocks"))
        blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda other: F.struct(F.least(other, block).alias("x"), F.greatest(other, block).alias("y")))
        rows = meeting.withColumn("_xy", F.explode(blocks)).select("token", "_xy.x", "_xy.y", "_row", "place").join(placed.select("_row", "n", "bits", "component"), "_row")
        with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="4000"):
            pairs = scratch.table(bucket_pairs(rows.select("token", "x", "y", "_row", "n", "place", "bits", "component")), "pairs")
        scratch.drop(meeting, placed)
        more = verified(pairs, taken, "_text", scratch)
        found = scratch.table(components(links.union(more), scratch), "components")

    rooted = members.join(found.withColumnRenamed("node", "class"), "class", "left").select("_row", "doc_id", "n", F.coalesce("component", "class").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row")))
    roots = scratch.table(rooted.groupBy("root").agg(least.alias("first")), "roots")
    return rooted.join(roots, "root").select(F.col("doc_id").alias(id_col), "_row", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row"))


def explode_prefix(rows: DataFrame) -> DataFrame:
    """``_row, component, token, place`` for each token of a prefix."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            if not tokens:
                continue
            sizes = np.array([len(x) for x in tokens])
            columns = [np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)]
            place = np.concatenate([np.arange(n) for n in sizes])
            yield pa.RecordBatch.from_pydict({"_row": columns[0], "component": columns[1], "token": np.concatenate(tokens), "place": place})

    return rows.mapInArrow(explode, "_row bigint, component bigint, token bigint, place bigint")
