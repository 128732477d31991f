"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Lines within ``EDITS`` edits of each other are near copies. A line is cut into ``EDITS + 1`` even segments; a near copy of
the same length or up to ``EDITS`` longer must contain one of them unchanged, and only near its old place. So each line
enters an index under (length, segment number, segment) and probes it with the substrings that can match, a dozen at
two edits, whatever its length. Lines that meet are a pair only if their counts of single characters allow it: an edit
takes away one character at most and adds one at most. That is part of the join's condition, so a crowd of lines that share
segments but differ by words makes few rows. Pairs are verified by banded bit-parallel edit distance: one small bit mask
per number of errors, one bit per diagonal, a few shifts and ORs per character.

Lines are identified by 64-bit hashes; equal lines are one entry of the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, fits_broadcast
from .components import components
from .text import WORD_PATTERN, text_or_empty

EDITS = 2
# Two edits say little about shorter lines: they are near copies of equal lines only, if they are compared at all.
MIN_CHARS = 20
KEY = ["_row", "_tie"]
# Characters counted for a line, eight sets to a 64-bit number; no character is in two sets.
COUNTED = (("e", "t", "a", "o", "i", "n", "s", "r"), ("h", "l", "d", "u", "c", "m", "p", "g"), ("bf", "wy", "vk", "01", "23", "45", "67", "89"))
COUNTS = [f"c{i}" for i in range(len(COUNTED))]


def _segment(length: Column, number: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment: even lengths, the last ones one longer."""
    parts = EDITS + 1
    base, longer = F.floor(length / parts), length % parts
    # Segments 1 .. parts - longer have ``base`` characters.
    short = F.lit(parts) - longer
    start = (number - 1) * base + F.greatest(number - 1 - short, F.lit(0)) + 1
    return start.cast("int"), (base + F.when(number > short, 1).otherwise(0)).cast("int")


def entry_kinds() -> list[tuple[int, int, int, bool]]:
    """``shift, number, move, indexed`` of a line's entries: its own segments, then the substrings where a line that is ``shift`` shorter may have its segment.

    With more than ``i - 1`` edits before segment i, an earlier segment matches, and with more than ``EDITS + 1 - i``
    after it a later one does; so only starts that neither side rules out are tried.
    """
    found = [(0, i, 0, True) for i in range(1, EDITS + 2)]
    for shift in range(EDITS + 1):
        for i in range(1, EDITS + 2):
            low, high = max(-(i - 1), shift - (EDITS + 1 - i)), min(i - 1, shift + EDITS + 1 - i)
            found += [(shift, i, move, False) for move in range(low, high + 1)]
    return found


def index_entries(lines: DataFrame) -> DataFrame:
    """``key, indexed, h`` of every entry of ``line, n, h``. One short expression over exploded kinds: a key per column makes a method too long to be compiled."""
    kinds = F.array(*[F.struct(F.lit(shift).alias("shift"), F.lit(i).alias("i"), F.lit(move).alias("move"), F.lit(indexed).alias("indexed")) for shift, i, move, indexed in entry_kinds()])
    each = lines.select("h", "line", "n", F.inline(kinds))
    length = (F.col("n") - F.col("shift")).cast("int")
    start, size = _segment(length, F.col("i"))
    at = start + F.col("move")
    key = F.xxhash64(length, "i", F.substring("line", at, size))
    return each.filter((at >= 1) & (at + size - 1 <= F.col("n"))).select(key.alias("key"), "indexed", "h")


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters two strings have in common at the start, by bisection (strings below 2**20 characters)."""

    def halve(known: Column, step: Column) -> Column:
        tried = known + F.element_at(F.array(*[F.lit(1 << k) for k in range(19, -1, -1)]), step)
        fits = (tried <= F.least(F.char_length(a), F.char_length(b))) & (F.substring(a, F.lit(1), tried) == F.substring(b, F.lit(1), tried))
        return F.when(fits, tried).otherwise(known)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), halve)


def banded_distance(a: Column, b: Column) -> Column:
    """Edit distance of two strings if at most ``EDITS``, else null.

    ``b`` is read character by character. Bit ``EDITS + d`` of mask e says that, with at most e errors, the characters read
    so far match the first ``read + d`` characters of ``a``. A new character keeps the bits where it equals the next
    character of ``a``; an error replaces it (same bit), skips it (a bit down) or skips one of ``a`` (a bit up).
    """
    x, y = F.split(a, ""), F.split(b, "")
    m, n = F.char_length(a), F.char_length(b)
    begin = F.struct(*[F.lit(sum(1 << (EDITS + d) for d in range(e + 1))).alias(f"e{e}") for e in range(EDITS + 1)])

    def read(state: Column, j: Column) -> Column:
        # Element j of y is read (from 1); bit EDITS + d is about character j + d of a.
        char = F.get(y, j - 1)
        equal = sum((F.when(F.get(x, F.greatest(j + d - 1, F.lit(-1))) == char, F.lit(1 << (EDITS + d))).otherwise(F.lit(0)) for d in range(-EDITS, EDITS + 1)), F.lit(0))
        # Prefixes of a longer than a are no states.
        inside = sum((F.when((j + d >= 0) & (j + d <= m), F.lit(1 << (EDITS + d))).otherwise(F.lit(0)) for d in range(-EDITS, EDITS + 1)), F.lit(0))
        masks = []
        for e in range(EDITS + 1):
            now = state[f"e{e}"].bitwiseAND(equal)
            if e:
                below = state[f"e{e - 1}"]
                now = now.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(masks[-1], 1)).bitwiseAND(inside)
            masks.append(now)
        following = F.struct(*[v.alias(f"e{e}") for e, v in enumerate(masks)])
        return F.when(state[f"e{EDITS}"] == 0, state).otherwise(following)

    end = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), begin, read)).otherwise(begin)
    bit = F.when(F.abs(m - n) <= EDITS, F.element_at(F.array(*[F.lit(1 << (EDITS + d)) for d in range(-EDITS, EDITS + 1)]), (m - n + EDITS + 1).cast("int")))
    return F.transform(F.array(end), lambda s: F.coalesce(*[F.when(s[f"e{e}"].bitwiseAND(bit) != 0, e) for e in range(EDITS + 1)]))[0]


def distance(a: Column, b: Column) -> Column:
    """``banded_distance`` of what is left without the common start and end."""
    head = F.struct(a.alias("a"), b.alias("b"), shared_prefix(a, b).alias("n"))
    rest = F.transform(F.array(head), lambda s: F.struct(s["a"].substr(s["n"] + 1, F.char_length(s["a"])).alias("a"), s["b"].substr(s["n"] + 1, F.char_length(s["b"])).alias("b")))
    back = F.transform(rest, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), shared_prefix(F.reverse(s["a"]), F.reverse(s["b"])).alias("n")))
    cut = F.transform(back, lambda s: F.struct(s["a"].substr(F.lit(1), F.char_length(s["a"]) - s["n"]).alias("a"), s["b"].substr(F.lit(1), F.char_length(s["b"]) - s["n"]).alias("b")))
    return F.transform(cut, lambda s: banded_distance(s["a"], s["b"]))[0]


def character_counts(line: Column) -> list[Column]:
    """How often the characters of each set in ``COUNTED`` occur, 127 at most, as bytes of one number per eight sets."""

    def count(characters: str) -> Column:
        return F.least(sum((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in characters), F.lit(0)), F.lit(127)).cast("bigint")

    return [sum((F.shiftleft(count(own), 8 * i) for i, own in enumerate(sets)), F.lit(0).cast("bigint")) for sets in COUNTED]


def may_be_near(a: list[Column], b: list[Column]) -> Column:
    """Whether lines with these ``character_counts`` can be within ``EDITS`` edits: neither has over ``EDITS`` characters that the other lacks."""
    differences = [(F.shiftright(x, 8 * i).bitwiseAND(127) - F.shiftright(y, 8 * i).bitwiseAND(127)).cast("int") for x, y in zip(a, b) for i in range(8)]
    over = sum((F.greatest(d, F.lit(0)) for d in differences), F.lit(0))
    under = sum((F.greatest(-d, F.lit(0)) for d in differences), F.lit(0))
    return (over <= EDITS) & (under <= EDITS)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _lines_at(text: Column, places: Column) -> Column:
    """The lines at ``places``; the text is split once, not once per place."""
    return F.transform(F.array(_lines(text)), lambda own: F.transform(places, lambda p: F.get(own, p)))[0]


def edit_links(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b`` (line hashes, a < b) of lines within ``EDITS`` edits, from rows ``line, n, h`` that may repeat a line."""
    entries = index_entries(lines).repartition("key")
    of_key = Window.partitionBy("key")
    # Entries of one line alone meet nothing; what a line repeats goes once few are left.
    meeting = entries.withColumns({"low": F.min("h").over(of_key), "high": F.max("h").over(of_key)}).filter("low < high").select("key", "indexed", "h").distinct()
    meeting = scratch.table(meeting, "meeting")
    wanted = scratch.table(meeting.select("h").distinct(), "wanted")
    found = lines.select("h", "line").join(F.broadcast(wanted) if fits_broadcast(wanted, max_rows=1_000_000) else wanted, "h", "left_semi").dropDuplicates(["h"])
    texts = scratch.table(found.select("h", "line", *[c.alias(name) for c, name in zip(character_counts(F.col("line")), COUNTS)]), "texts")
    counts = texts.select("h", *COUNTS)
    counted = meeting.join(F.broadcast(counts) if fits_broadcast(counts, max_rows=1_000_000) else counts, "h")
    held = counted.filter("indexed").select("key", F.col("h").alias("x"), *[F.col(c).alias(f"x{c}") for c in COUNTS])
    asked = counted.filter("NOT indexed").select("key", F.col("h").alias("y"), *[F.col(c).alias(f"y{c}") for c in COUNTS])
    near = may_be_near([F.col(f"x{c}") for c in COUNTS], [F.col(f"y{c}") for c in COUNTS])
    pairs = held.join(asked, (held["key"] == asked["key"]) & (F.col("x") != F.col("y")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    return scratch.table(both.filter(distance(F.col("la"), F.col("lb")).isNotNull()).select("a", "b"), "links")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, short: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_lines, n_removed, kept_text``.

    Lines end at line feeds. A class holds the lines that reach each other by steps of at most two edits; its first line
    by (id, line number) stays and the others go. Null ids come after all others. With ``short``, a line of
    fewer than ``MIN_CHARS`` characters is in a class with its exact copies; without, it stays. Empty lines and lines of
    white space alone always stay. A null or empty text is one empty line. Rows equal in id and text are
    one document to this operator and lose the same lines. An empty table gives an empty result; further columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_row"), F.hash(id_col, text_col).alias("_tie"))
    split = taken.select(*KEY, "_id", F.posexplode(_lines(F.col("_text"))).alias("place", "line")).withColumn("n", F.char_length("line"))
    indexed = F.col("n") >= MIN_CHARS
    compared = (F.lit(short) | indexed) & F.col("line").rlike(WORD_PATTERN)
    occurrences = scratch.table(split.filter(compared).select(*KEY, "_id", "place", F.xxhash64("line").alias("h"), indexed.alias("indexed")), "occurrences")
    order = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_tie").alias("tie"), F.col("place").alias("place"))

    # The index needs each line once: from the document and place where it first occurs.
    firsts = occurrences.filter("indexed").groupBy("h").agg(F.min(order).alias("first"))
    places = scratch.table(firsts.groupBy(F.col("first.row").alias("_row"), F.col("first.tie").alias("_tie")).agg(F.collect_set("first.place").alias("places")), "firsts")
    owners = taken.join(_side(places), KEY)
    lines = owners.select(F.explode(_lines_at(F.col("_text"), F.col("places"))).alias("line")).select("line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h"))
    reached = components(edit_links(lines, scratch), scratch)

    classes = scratch.table(reached.withColumnRenamed("node", "h"), "classes")
    rooted = scratch.table(occurrences.join(classes, "h", "left").withColumn("root", F.coalesce("component", "h")).drop("component", "h", "indexed"), "rooted")
    crowded = scratch.table(rooted.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("lines")).filter("lines > 1").drop("lines"), "crowded")
    gone = rooted.join(crowded, "root").filter((F.col("_row") != F.col("first.row")) | (F.col("_tie") != F.col("first.tie")) | (F.col("place") != F.col("first.place")))
    removed = scratch.table(gone.groupBy(*KEY).agg(F.collect_set("place").alias("gone")), "removed")

    kept = F.filter(_lines(F.col("_text")), lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    cut = taken.join(_side(removed), KEY, "left")
    return cut.select(
        F.col("_id").alias(id_col),
        F.size(_lines(F.col("_text"))).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def _side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, max_rows=1_000_000, max_bytes=64 << 20) else table
