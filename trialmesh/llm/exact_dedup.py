"""Exact deduplication by digest with a heavy-hitter split.

Texts are equal when they are identical without white space. Each row is reduced to (digest, length, id). Misra-Gries
summaries, one per partition and then added up, name every digest that may hold a large share of the rows; their
winners are computed exactly by a partially aggregated group-by and broadcast (at most ``counters + 1`` rows), so rows
of frequent digests are decided where they lie. All other digests are rare by that bound and meet in a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .text import SPACE_PATTERN, text_or_empty

COUNTERS = 1000


def misra_gries(counts: dict, more: dict, counters: int) -> dict:
    """Add ``more`` to a summary and shrink it to ``counters`` entries; no count falls by more than n / (counters + 1)."""
    merged = dict(counts)
    for key, n in more.items():
        merged[key] = merged.get(key, 0) + n
    if len(merged) > counters:
        cut = sorted(merged.values(), reverse=True)[counters]
        merged = {key: n - cut for key, n in merged.items() if n > cut}
    return merged


def frequent_candidates(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Keys that may hold at least 2 / (counters + 1) of the rows: every such key, and at most counters + 1 in all.

    A partition's summary undercounts a key by at most its rows / (counters + 1); so the sum over partitions falls
    short by at most n / (counters + 1), and only counters + 1 keys can have a sum of n / (counters + 1) or more.
    """

    def summarize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            counts = misra_gries(counts, Counter(x for x in batch.column(0).to_pylist() if x is not None), counters)
        yield pa.RecordBatch.from_pydict({"candidate": [*counts, None], "n": [*counts.values(), rows]}, schema=pa.schema([("candidate", pa.string()), ("n", pa.int64())]))

    sums = df.select(key).mapInArrow(summarize, "candidate string, n bigint").groupBy("candidate").agg(F.sum("n").alias("n"))
    # The null key carries the number of rows.
    total = sums.filter(F.col("candidate").isNull()).select(F.col("n").alias("total"))
    return sums.filter(F.col("candidate").isNotNull()).join(F.broadcast(total), F.col("n") * (counters + 1) >= F.col("total")).select(F.col("candidate").alias(key))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One slim row per document: id, row number, digest of the text without white space, code points of the original text."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"),
        F.sha2(F.regexp_replace(text, SPACE_PATTERN, "").cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).cast("bigint").alias("n_points"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, row_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``id_col, _row, keep_id, group_size, kept, text_sha256``.

    The row with the most code points stays, then the one with the smallest id; null ids come last, and of rows alike
    in both exactly one stays. Null and empty texts are equal to each other and to texts of white space alone. An
    empty table gives an empty result; further columns are ignored. ``_row`` tells rows
    with one id apart; ``row_col`` may name a column of unique numbers for it.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    slim = scratch.table(digests(docs, id_col, text_col, row_col), "digests")
    order = F.struct((-F.col("n_points")).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col("_row").alias("d"))

    candidates = scratch.table(frequent_candidates(slim, "text_sha256", counters), "candidates")
    winners = scratch.table(
        slim.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "winners"
    )
    decided = slim.join(F.broadcast(winners), "text_sha256")
    others = slim.join(F.broadcast(candidates), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    others = others.withColumns({"first": F.min(order).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return decided.unionByName(others, allowMissingColumns=True).select(
        id_col, "_row", F.col("first.c").alias("keep_id"), "group_size", (F.col("_row") == F.col("first.d")).alias("kept"), "text_sha256"
    )
