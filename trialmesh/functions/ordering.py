"""Ranks, positions, quantiles and top-k cuts without single-task windows.

An unpartitioned window, or a window over a group that holds a third of the rows, sorts all of it in one task.
Here the value range is cut into cells of about equal size first. Counts per cell give every cell its offset,
so a window only ever orders the rows of one cell. A value so frequent that it fills cells by itself gets a
cell of its own, spread over 256 sub-cells by the hash of the tie-break key.

Inputs are read more than once, so they must give the same rows each time: pass a plain table scan or the
result of ``materialize`` with ``stable=True``, otherwise the function writes the input first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import join_dimension, local_table, materialize
from .draws import key_hash, leading_number

ROWS_PER_CELL = 250_000
# Searches order only the cells they hit, so finer cells leave fewer rows to order.
ROWS_PER_SEARCH_CELL = 20_000
MAX_CELLS = 20_000
# Counts and cuts up to this many rows are held as local tables; beyond it they stay distributed.
SMALL_TABLE = 20_000
_SUB_CELLS = 256


def _value_edges(df: DataFrame, column: str, rows_per_cell: int) -> tuple[list[float], set[float]]:
    """Cut points between cells and the values that need a cell of their own."""
    n = df.count()
    n_cells = min(MAX_CELLS, math.ceil(n / max(1, rows_per_cell)))
    if n_cells <= 1:
        return [], set()
    sampled = df.select(column)
    keep = 100.0 * n_cells / n
    if keep < 0.5:
        sampled = sampled.sample(fraction=min(1.0, max(keep, 100_000.0 / n)), seed=17)
    steps = [i / n_cells for i in range(1, n_cells)]
    row = sampled.agg(F.percentile_approx(column, steps, max(10_000, 20 * n_cells)).alias("cuts")).first()
    cuts = row["cuts"] or []
    heavy = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    edges = set(cuts) | {math.nextafter(v, math.inf) for v in heavy}
    return sorted(e for e in edges if math.isfinite(e)), heavy


def _with_cells(df: DataFrame, value: Column, tie: Column | None, rows_per_cell: int) -> DataFrame:
    """Add ``_v`` (ordering value), ``_cell`` (ordered cell number) and ``_own`` (cell of one single value)."""
    return _in_cells(df, value, tie, *_edges_of(df, value, rows_per_cell))


def _with_value(df: DataFrame, value: Column) -> DataFrame:
    df = df.withColumn("_v", value.cast("double") + F.lit(0.0))
    return df.withColumn("_v", F.when(F.isnan("_v"), F.lit(None)).otherwise(F.col("_v")))


def _edges_of(df: DataFrame, value: Column, rows_per_cell: int) -> tuple[list[float], set[float]]:
    return _value_edges(_with_value(df, value).where(F.col("_v").isNotNull()), "_v", rows_per_cell)


def _in_cells(df: DataFrame, value: Column, tie: Column | None, edges: list[float], heavy: set[float]) -> DataFrame:
    df = _with_value(df, value)
    if edges:
        cutter = Bucketizer(
            splits=[-math.inf, *edges, math.inf], inputCol="_v", outputCol="_bucket", handleInvalid="keep"
        )
        df = cutter.transform(df)
    else:
        df = df.withColumn("_bucket", F.lit(0.0))
    own = F.col("_v").isNull()
    if heavy:
        own = own | F.col("_v").isin(sorted(heavy))
    bucket = F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("bigint"))
    sub = F.lit(0) if tie is None else F.when(own, leading_number(tie, 2)).otherwise(F.lit(0))
    return (
        df.withColumn("_own", own)
        .withColumn("_cell", (bucket * F.lit(_SUB_CELLS) + sub).cast("bigint"))
        .drop("_bucket")
    )


def _with_hash_cells(df: DataFrame, order_hash: Column, rows_per_cell: int) -> DataFrame:
    """Cells for an md5 order: equal slices of the hash range, no statistics needed."""
    n_cells = min(MAX_CELLS, max(1, math.ceil(df.count() / max(1, rows_per_cell))))
    return df.withColumn("_h", order_hash).withColumn(
        "_cell", F.floor(leading_number(F.col("_h")) * F.lit(n_cells) / F.lit(4294967296.0)).cast("bigint")
    )


def _offsets(df: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Per cell: weight before it, weight before its bucket, bucket weight and group total."""
    cells = df.groupBy(*by, "_cell").agg(F.sum(weight).alias("_w"))
    # The windows below run over cells, at most a fixed number per group, not over rows.
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bucket = F.floor(F.col("_cell") / F.lit(_SUB_CELLS))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    per_bucket = Window.partitionBy(*by, bucket)
    return (
        cells.withColumn("_bucket_before", F.min("_before").over(per_bucket))
        .withColumn("_bucket_w", F.sum("_w").over(per_bucket))
        .withColumn("_total", F.sum(F.when(F.col("_cell") >= 0, F.col("_w"))).over(Window.partitionBy(*by)))
        .withColumn(
            "_null_w",
            F.coalesce(F.sum(F.when(F.col("_cell") < 0, F.col("_w"))).over(Window.partitionBy(*by)), F.lit(0)),
        )
        .drop("_w")
    )


def _grouped(df: DataFrame, by: Sequence[str], value: Column) -> tuple[DataFrame, list[str], list[str]]:
    """Give an ungrouped input one group key that the optimizer keeps as an ordinary join key."""
    if by:
        return df, list(by), []
    return df.withColumn("_all", F.pmod(F.xxhash64(value), F.lit(1))), ["_all"], ["_all"]


def average_rank(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str] = (),
    *,
    tie: Column | str,
    weight: Column | str | None = None,
    out: str = "avg_rank",
    total: str | None = None,
    stable: bool = False,
    source: DataFrame | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add the 1-based average rank of ``value`` inside each group; NULL values get a NULL rank.

    With ``weight`` a row counts as that many copies. ``total`` names a column for the group size. ``source`` may be a written
    table with the same rows; cells and counts then come from it, and ``df`` may be the result of other steps.
    """
    value = F.col(value) if isinstance(value, str) else value
    tie = F.col(tie) if isinstance(tie, str) else tie
    if not stable:
        df = materialize(df)
    kept = df.columns
    base, _, _ = _grouped(df if source is None else source, by, tie)
    df, keys, extra = _grouped(df, by, tie)
    edges, heavy = _edges_of(base, value, rows_per_cell)
    cells = _in_cells(df, value, key_hash(tie), edges, heavy)
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    offsets = _offsets(_in_cells(base, value, key_hash(tie), edges, heavy), keys, w)
    ordered = Window.partitionBy(*keys, "_cell").orderBy("_v")
    upto = F.sum(w).over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum(w).over(ordered.rangeBetween(0, 0))
    ranked = cells.withColumn("_upto", upto).withColumn("_same", same)
    # Rows are already partitioned by group and cell, so only the offsets move for this join.
    joined = ranked.join(offsets, on=[*keys, "_cell"], how="left") if source is None else join_dimension(ranked, offsets, [*keys, "_cell"], how="left")
    inside = F.col("_before") + F.col("_upto") - (F.col("_same") - 1) / F.lit(2.0)
    alone = F.col("_bucket_before") + (F.col("_bucket_w") + 1) / F.lit(2.0)
    rank = F.when(F.col("_own"), alone).otherwise(inside) - F.col("_null_w")
    rank = F.when(F.col("_v").isNotNull(), rank).cast("double")
    columns = [F.col(c) for c in kept] + [rank.alias(out)]
    if total:
        columns.append(F.col("_total").cast("bigint").alias(total))
    return joined.select(*columns)


def value_ranks(df: DataFrame, value: str, by: Sequence[str], out: str, total: str) -> DataFrame:
    """Average rank of each distinct value per group and the group's number of values, from the values' counts."""
    counted = _with_value(df, F.col(value)).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
    # Windows over distinct values, not over rows.
    before = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_w").over(before), F.lit(0)) + (F.col("_w") + 1) / F.lit(2.0)
    return counted.select(*by, "_v", rank.cast("double").alias(out), F.sum("_w").over(Window.partitionBy(*by)).alias(total))


def rank_columns(
    df: DataFrame, ranks: dict[str, str], by: Sequence[str] = (), *, tie: str, share: bool = False, rows_per_cell: int = ROWS_PER_CELL, small: int = SMALL_TABLE
) -> DataFrame:
    """Add average ranks of several columns of a written table: ``ranks`` names the result of each column.

    A column with few distinct values (found in one pass) is ranked by its counted values, which are broadcast, so no row moves
    for it. Each other column moves the rows once. With ``share`` a rank is divided by the group's number of values.
    """
    distinct = df.agg(*[F.approx_count_distinct(F.struct(*by, F.col(c))).alias(c) for c in ranks]).first()
    ranked = df
    # Ranks that need no move come last, so that the others do not carry them.
    for column, out in sorted(ranks.items(), key=lambda item: distinct[item[0]] <= small // 2):
        kept = ranked.columns
        if distinct[column] <= small // 2:
            own, keys, _ = _grouped(df.select(*by, tie, column), by, F.col(tie))
            values = value_ranks(own, column, keys, "_rank", "_total")
            ranked, keys, _ = _grouped(_with_value(ranked, F.col(column)), by, F.col(tie))
            ranked = join_dimension(ranked, values, [*keys, "_v"], how="left")
        else:
            ranked = average_rank(ranked, column, by, tie=tie, out="_rank", total="_total", stable=True, source=df, rows_per_cell=rows_per_cell)
        rank = F.col("_rank") / F.col("_total") if share else F.col("_rank")
        ranked = ranked.select(*kept, rank.alias(out))
    return ranked.select(*df.columns, *ranks.values())


def running_position(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str] = (),
    *,
    tie: Column | str,
    descending: bool = False,
    weight: Column | str | None = None,
    out: str = "position",
    total: str | None = None,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add the position of each row ordered by ``value``, then by the md5 of ``tie``.

    With ``weight`` the position is the running weight up to and including the row. Rows without a value are dropped.
    """
    value = F.col(value) if isinstance(value, str) else value
    tie = F.col(tie) if isinstance(tie, str) else tie
    if not stable:
        df = materialize(df)
    kept = df.columns
    df, keys, _ = _grouped(df.where(value.isNotNull() & ~F.isnan(value.cast("double"))), by, tie)
    df = df.withColumn("_t", key_hash(tie))
    cells = _with_cells(df, -value if descending else value, F.col("_t"), rows_per_cell)
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    offsets = _offsets(cells, keys, w)
    ordered = Window.partitionBy(*keys, "_cell").orderBy("_v", "_t").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_upto", F.sum(w).over(ordered)).join(offsets, on=[*keys, "_cell"], how="left")
    position = F.col("_before") + F.col("_upto")
    if weight is None:
        position = position.cast("bigint")
    columns = [F.col(c) for c in kept] + [position.alias(out)]
    if total:
        columns.append(F.col("_total").alias(total))
    return placed.select(*columns)


def hash_position(
    df: DataFrame,
    order_hash: Column,
    by: Sequence[str] = (),
    *,
    out: str = "position",
    total: str | None = None,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add the position of each row inside its group in md5 order (a seeded random permutation)."""
    if not stable:
        df = materialize(df)
    kept = df.columns
    df, keys, _ = _grouped(df, by, order_hash)
    cells = _with_hash_cells(df, order_hash, rows_per_cell)
    offsets = _offsets(cells, keys, F.lit(1))
    ordered = Window.partitionBy(*keys, "_cell").orderBy("_h")
    placed = cells.withColumn("_rn", F.row_number().over(ordered)).join(offsets, on=[*keys, "_cell"], how="left")
    columns = [F.col(c) for c in kept] + [(F.col("_before") + F.col("_rn")).cast("bigint").alias(out)]
    if total:
        columns.append(F.col("_total").cast("bigint").alias(total))
    return placed.select(*columns)


def _pick(cells: DataFrame, keys: list[str], order: list[str], targets_of) -> tuple[DataFrame, DataFrame, bool]:
    """Rows at wanted positions, the group sizes, and whether both are small local tables.

    ``targets_of`` turns the sizes (keys, ``n``) into wanted positions (keys, ``tag``, ``pos``). Only the cells that
    contain a wanted position are ordered; every other row is just counted.
    """
    spark = cells.sparkSession
    extremes = [F.min("_v").alias("_low"), F.max("_v").alias("_high")] if order == ["_v"] else []
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_w"), *extremes)
    few = counts.limit(SMALL_TABLE + 1).collect()
    rows = cells.select(*keys, "_cell", *order)
    ordered = Window.partitionBy(*keys, "_cell").orderBy(*order)
    if len(few) <= SMALL_TABLE:
        sizes, hits, known = _local_hits(spark, counts, few, keys, targets_of)
        numbered = rows.join(F.broadcast(hits.select(*keys, "_cell").distinct()), on=[*keys, "_cell"])
        numbered = numbered.withColumn("_rn", F.row_number().over(ordered))
        picked = numbered.join(F.broadcast(hits), on=[*keys, "_cell", "_rn"]).select(*keys, "tag", *order)
        found = picked.collect() if not hits.isEmpty() else []
        return local_table(spark, [*known, *map(tuple, found)], picked.schema), sizes, True
    counts = materialize(counts)
    sizes = counts.groupBy(*keys).agg(F.sum("_w").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    hits = counts.join(targets_of(sizes), on=keys)
    hits = hits.where((F.col("pos") > F.col("_before")) & (F.col("pos") <= F.col("_before") + F.col("_w")))
    hits = materialize(hits.select(*keys, "_cell", "tag", (F.col("pos") - F.col("_before")).cast("int").alias("_rn")))
    numbered = join_dimension(rows, hits.select(*keys, "_cell").distinct(), [*keys, "_cell"])
    numbered = numbered.withColumn("_rn", F.row_number().over(ordered))
    return numbered.join(hits, on=[*keys, "_cell", "_rn"]).select(*keys, "tag", *order), sizes, False


def _local_hits(spark, counts: DataFrame, few, keys: list[str], targets_of) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """The same search over a short list of counts. Hits in a cell of one value are already answered."""
    ends: dict[tuple, list[tuple]] = {}
    for row in sorted(few, key=lambda r: r["_cell"]):
        places = ends.setdefault(tuple(row[c] for c in keys), [])
        single = row["_low"] if "_low" in counts.columns and row["_low"] == row["_high"] else None
        places.append((row["_cell"], (places[-1][1] if places else 0) + row["_w"], single))
    fields = [counts.schema[c] for c in keys]
    whole = T.StructField("n", T.LongType())
    sizes = local_table(spark, [(*group, places[-1][1]) for group, places in ends.items()], T.StructType([*fields, whole]))
    found, known = [], []
    for row in targets_of(sizes).collect():
        group = tuple(row[c] for c in keys)
        start = 0
        for cell, end, single in ends[group]:
            if row["pos"] <= end:
                if single is None:
                    found.append((*group, cell, row["tag"], row["pos"] - start))
                else:
                    known.append((*group, row["tag"], single))
                break
            start = end
    tail = [T.StructField("_cell", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("_rn", T.IntegerType())]
    return sizes, local_table(spark, found, T.StructType([*fields, *tail])), known


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    tie: Column | str,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_SEARCH_CELL,
) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group and probability (``prob``, ``value``, ``n``)."""
    value = F.col(value) if isinstance(value, str) else value
    tie = F.col(tie) if isinstance(tie, str) else tie
    narrow = df.select(*by, value.cast("double").alias("_x"), tie.alias("_tie"))
    narrow = narrow.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not stable:
        narrow = materialize(narrow)
    narrow, keys, extra = _grouped(narrow, by, F.col("_tie"))
    cells = _with_cells(narrow, F.col("_x"), None, rows_per_cell)
    place = (F.col("n") - 1) * F.col("prob")

    def with_probabilities(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))

    def targets_of(sizes: DataFrame) -> DataFrame:
        ends = F.array_distinct(F.array(F.floor(place) + 1, F.ceil(place) + 1))
        return with_probabilities(sizes).select(*keys, F.explode(ends).alias("pos")).distinct().withColumn("tag", F.col("pos"))

    picked, sizes, small = _pick(cells, keys, ["_v"], targets_of)
    if not small:
        picked = materialize(picked)
    low = picked.select(*keys, F.col("tag").alias("_lo"), F.col("_v").alias("_vlo"))
    high = picked.select(*keys, F.col("tag").alias("_hi"), F.col("_v").alias("_vhi"))
    out = with_probabilities(sizes).withColumns({"_lo": F.floor(place) + 1, "_hi": F.ceil(place) + 1})
    out = out.join(low, on=[*keys, "_lo"]).join(high, on=[*keys, "_hi"])
    interpolated = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (place - F.floor(place))
    return out.select(*[k for k in keys if k not in extra], "prob", interpolated.alias("value"), "n")


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *, tie: Column | str, **kw) -> dict:
    """Quantiles of several columns as a dictionary ``{column: {probability: value}}`` (a few numbers)."""
    tie = F.col(tie) if isinstance(tie, str) else tie
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(tie.alias("_tie0"), F.explode(pairs).alias("p")).select("_tie0", "p.name", "p.x")
    found: dict = {c: {} for c in columns}
    for row in exact_quantiles(long, "x", probabilities, ["name"], tie="_tie0", **kw).collect():
        found[row["name"]][row["prob"]] = row["value"]
    return found


def cut_after(
    df: DataFrame,
    k: Column,
    by: Sequence[str] = (),
    *,
    value: Column | str | None = None,
    tie: Column | str,
    descending: bool = True,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_SEARCH_CELL,
) -> tuple[DataFrame, bool]:
    """The ``k``-th row of each group as a cut (keys, ``cut_value``, ``cut_hash``, ``k``, ``n``).

    ``k`` is an expression over the group size ``n``. Rows are ordered by ``value`` then by the md5 of ``tie``,
    or by that md5 alone when ``value`` is None. Comparing rows with the cut selects exactly ``k`` of them
    without moving any; see :func:`inside_cut`. The second value tells whether the cuts are a small local table.
    """
    tie = F.col(tie) if isinstance(tie, str) else tie
    if isinstance(value, str):
        value = F.col(value)
    narrow = df.select(*by, tie.alias("_tie"), *([value.cast("double").alias("_x")] if value is not None else []))
    if value is not None:
        narrow = narrow.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not stable:
        narrow = materialize(narrow)
    narrow, keys, extra = _grouped(narrow, by, F.col("_tie"))
    narrow = narrow.withColumn("_h", key_hash(F.col("_tie")))
    if value is None:
        cells = _with_hash_cells(narrow, F.col("_h"), rows_per_cell)
        order = ["_h"]
    else:
        cells = _with_cells(narrow, -F.col("_x") if descending else F.col("_x"), F.col("_h"), rows_per_cell)
        order = ["_v", "_h"]
    wanted = k.cast("bigint")

    def targets_of(sizes: DataFrame) -> DataFrame:
        place = F.least(wanted, F.col("n"))
        return sizes.select(*keys, F.lit(0).cast("bigint").alias("tag"), place.alias("pos")).where(F.col("pos") > 0)

    picked, sizes, small = _pick(cells, keys, order, targets_of)
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    cut_value = (F.col("_v") * sign + F.lit(0.0)) if value is not None else F.lit(None).cast("double")
    picked = picked.select(*keys, cut_value.alias("cut_value"), F.col("_h").alias("cut_hash"))
    cuts = sizes.withColumn("k", wanted).join(picked, on=keys, how="left")
    return cuts.select(*[c for c in keys if c not in extra], "cut_value", "cut_hash", "k", "n"), small


def hash_order_cuts(
    keys: DataFrame,
    order_hash: Column,
    positions: Column,
    by: Sequence[str] = (),
    *,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """The md5 texts at several positions of the md5 order: one row per group and wanted position (``tag``).

    ``positions`` is an array expression over the group size ``n``.
    """
    narrow = keys.select(*by, order_hash.alias("_o"))
    if not stable:
        narrow = materialize(narrow)
    narrow, names, extra = _grouped(narrow, by, F.col("_o"))
    cells = _with_hash_cells(narrow, F.col("_o"), rows_per_cell)

    def targets_of(sizes: DataFrame) -> DataFrame:
        wanted = F.explode(F.array_distinct(positions.cast("array<bigint>"))).alias("pos")
        return sizes.select(*names, wanted).withColumn("tag", F.col("pos"))

    picked, _, _ = _pick(cells, names, ["_h"], targets_of)
    return picked.select(*[c for c in names if c not in extra], "tag", F.col("_h").alias("cut_hash"))


def inside_cut(value: Column | None, tie: Column, cut_value: Column, cut_hash: Column, descending: bool = True) -> Column:
    """True for the rows at or before the cut."""
    hashed = key_hash(tie)
    if value is None:
        flag = hashed <= cut_hash
    else:
        number = value.cast("double") + F.lit(0.0)
        better = number > cut_value if descending else number < cut_value
        flag = better | ((number == cut_value) & (hashed <= cut_hash))
    return F.coalesce(flag, F.lit(False))


def take_first(
    df: DataFrame,
    k: int,
    *,
    value: Column | str | None = None,
    tie: Column | str,
    descending: bool = True,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_SEARCH_CELL,
) -> Column:
    """Expression that is true for the first ``k`` rows of ``df``; the cut is a single row held as literals."""
    tie_column = F.col(tie) if isinstance(tie, str) else tie
    value_column = F.col(value) if isinstance(value, str) else value
    if k <= 0:
        return F.lit(False)
    cuts, _ = cut_after(
        df, F.lit(k), value=value, tie=tie, descending=descending, stable=stable, rows_per_cell=rows_per_cell
    )
    cut = cuts.first()
    if cut is None or cut["cut_hash"] is None:
        return F.lit(False)
    return inside_cut(value_column, tie_column, F.lit(cut["cut_value"]), F.lit(cut["cut_hash"]), descending)


def dense_ids(keys: DataFrame, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Number distinct rows 0, 1, 2 … in the order of ``order`` (any sortable type).

    Rows are range-partitioned and sorted, written once, and every partition adds the size of those before it.
    """
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    written = written.withColumn("_part", part).withColumn("_local", F.col("_row") - F.shiftleft(part, 33))
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so this window is small whatever the data size.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = join_dimension(written, sizes, ["_part"])
    return numbered.select(*keys.columns, (F.col("_start") + F.col("_local") + start).cast("bigint").alias(out))
