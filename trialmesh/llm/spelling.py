"""Spelling variants: words one edit apart, found by dense comparison of code-point matrices.

Of two words one edit apart, the longer of length ``m``, the common prefix and the common suffix together reach ``m - 1``. So
they share either their first ``m // 2`` code points or, failing that, their last ``m - m // 2``. Words meet under these two
keys, once per possible ``m`` (their own length and one more). The words of a key, or of several small keys together, form a tile:
two padded matrices of code points, from the left and from the right, whose common prefixes and suffixes are counted
column by column for all pairs at once. A key of many words is cut into blocks and every pair of blocks is a tile. A tile returns one
row per word, its number of near words and the best of them, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, session_setting

# Fixed values of the words.
WORD = "[A-Za-zÀ-ÿ]+"
CAPITALS = {c: c + 32 for c in range(65, 91)}
MIN_LENGTH = 5
MIN_COUNT = 3
# A word follows a near word at least this many times as frequent.
FORM_RATIO = 2

# Small keys share a tile of about this many words; a key of more than a block of words is cut.
TILE_WORDS = 256
BLOCK_WORDS = 2048
# Distinct words a task holds before it passes their counts on.
HELD_WORDS = 200_000


def without_drawn_letter(doc_id, word: str, every: int = 97) -> str:
    """``word``, less one code point where the checksum of document and word is divisible by ``every``; a null id is an empty string."""
    drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if drawn % every:
        return word
    at = drawn % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spelled: Callable[[object, str], str] | None = None
) -> DataFrame:
    """``word, n``: how often each lower-cased run of letters occurs in all texts; ``spelled`` may change a word by its document.

    A task adds up the words of its texts, so what is shuffled is about the vocabulary and not the text.
    """
    runs = re.compile(WORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                own = Counter(runs.findall(text.as_py().translate(CAPITALS)))
                if spelled is None:
                    held.update(own)
                else:
                    for word, n in own.items():
                        held[spelled(doc_id, word)] += n
                if len(held) >= HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n bigint")
    return counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def keyed(words: DataFrame) -> DataFrame:
    """``m, side, part, word, n``: the four keys under which a word can meet a near word; ``m`` is the longer length of the pair."""
    length = F.char_length("word")
    keys = []
    for m in (length, length + 1):
        half = F.floor(m / 2).cast("int")
        keys += [
            F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")),
            F.struct(m.alias("m"), F.lit(1).alias("side"), F.right("word", m - half).alias("part")),
        ]
    return words.select(F.explode(F.array(*keys)).alias("k"), "word", "n").select("k.*", "word", "n")


def dealt(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries of keys that several words have, with the block pair ``x <= y`` they belong to and the block they are of."""
    sizes = entries.groupBy("m", "side", "part").agg(F.count(F.lit(1)).alias("size"))
    sizes = scratch.table(sizes.filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK_WORDS)), "sizes")
    found = entries.join(sizes.drop("size"), ["m", "side", "part"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")),
    )
    return found.withColumn("p", F.explode(pairs)).select("m", "side", "part", "p.x", "p.y", (F.col("block") == F.col("p.x")).alias("left"), "word", "n")


def near_in_tile(words: list[str], m: int, side: int, left: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near pairs, the first of each having ``m`` code points; ``cross``: only pairs of a left and another word.

    ``side`` 0 takes pairs with a common prefix of at least ``m // 2``, side 1 the others, so no pair comes from both.
    """
    width = m + 1
    code = np.full((2, len(words), width), -1, np.int32)
    lengths = np.array([len(w) for w in words])
    for i, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
        code[0, i, : len(w)] = points
        code[1, i, : len(w)] = points[::-1]
    long = np.flatnonzero(lengths == m)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(long), TILE_WORDS):
        rows = long[start : start + TILE_WORDS]
        counts = []
        for matrix in code:
            common = np.zeros((len(rows), len(words)), np.int16)
            same = np.ones(common.shape, bool)
            for k in range(m):
                # Behind the end of the longer word nothing counts; the shorter one's padding equals no code point of it.
                same &= matrix[rows, k][:, None] == matrix[:, k][None, :]
                if not same.any():
                    break
                common += same
            counts.append(common)
        prefix, suffix = counts
        near = (prefix + suffix >= m - 1) & ((prefix >= m // 2) if side == 0 else (prefix < m // 2))
        # Words of equal length are seen from both sides; a word isn't near itself.
        near &= (prefix < m) & ((lengths < m)[None, :] | (rows[:, None] < np.arange(len(words))[None, :]))
        if cross:
            near &= left[rows][:, None] != left[None, :]
        a, b = np.nonzero(near)
        found.append((rows[a], b))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, n_near, best``: for each word with near words their number and the best, as ``(-n, word)``."""
    keys = ["m", "side", "part", "x", "y"]
    entries = dealt(keyed(words), scratch).select(*keys, "left", "word", "n")
    ordered = entries.repartition(*keys).sortWithinPartitions(*keys)

    def compared(held: list[tuple], m: int, side: int, cross: bool) -> pa.RecordBatch | None:
        words = [h[0] for h in held]
        counts = np.array([h[1] for h in held], np.int64)
        a, b = near_in_tile(words, m, side, np.array([h[2] for h in held]), cross)
        if not len(a):
            return None
        one, other = np.concatenate([a, b]), np.concatenate([b, a])
        # Best first: the most frequent, then the smallest in code-point order.
        text_order = np.empty(len(words), int)
        text_order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        rank = np.lexsort((text_order[other], -counts[other], one))
        one, other = one[rank], other[rank]
        owner, first, n_near = np.unique(one, return_index=True, return_counts=True)
        best = other[first]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in owner]), pa.array(n_near, pa.int64()), pa.array(counts[best]), pa.array([words[i] for i in best])],
            names=["word", "n_near", "form_n", "form"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tile = last = None
        for batch in batches:
            for key, row in zip(zip(*(batch.column(i).to_pylist() for i in range(5))), zip(*(batch.column(i).to_pylist() for i in (6, 7, 5)))):
                if key != last:
                    # Small keys of one length and side go together; pairs of different keys don't reach m - 1.
                    apart = last is not None and (key[:2] != last[:2] or key[3:] != (0, 0) or last[3:] != (0, 0))
                    if held and (apart or len(held) >= TILE_WORDS):
                        found = compared(held, *tile)
                        if found is not None:
                            yield found
                        held = []
                    last, tile = key, (key[0], key[1], key[3] != key[4])
                held.append(row)
        if held:
            found = compared(held, *tile)
            if found is not None:
                yield found

    partial = ordered.mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for the words that have a form: the end of the chain of forms.

    Counts grow along a chain, so it has no circle; every round doubles the distance that is known.
    """
    known = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = scratch.table(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(known)
        known = joined.drop("moved")
        if not joined.filter("moved").limit(1).count():
            return known
        known = scratch.table(known, "roots")
        scratch.drop(joined)


def spelling_variants(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``words`` (``word, n``, each word once): ``word, form, root, n, n_near, form_n``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is the most frequent of
    its near words (ties: the smallest in code-point order) if that is at least ``FORM_RATIO`` times as frequent as the word.
    ``root`` is the end of the chain of forms, the word itself if it has none. Null words and counts are left out, words
    of fewer than two code points have no near words; an empty table gives an empty result; further columns are ignored.
    """
    scratch = scratch or Scratch(words.sparkSession)
    words = scratch.table(words.filter("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = near_words(words.filter(F.char_length("word") > 1), scratch)
    judged = words.join(near, "word", "left")
    follows = -F.col("best.n") >= FORM_RATIO * F.col("n")
    judged = scratch.table(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.n")).alias("form_n"),
    ), "forms")
    ends = roots(judged.filter("form IS NOT NULL"), scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    spelled: Callable[[object, str], str] | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Spelling variants among the words of all texts, of at least ``min_length`` code points and ``min_count`` occurrences.

    Whole texts count, however long; a null text has no words. Repeated rows count as often as they occur. Tables without such words
    give an empty result. Other columns of ``docs``, whatever their names, are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    with session_setting(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="500"):
        words = scratch.table(word_counts(slim, "_id", "_body", spelled).filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count)), "vocabulary")
    return spelling_variants(words, scratch)
