"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words: its weight's share of all words, but at most ``MAX_EPOCHS`` times its size, the
excess going to the others by weight. A source is taken whole as often as its target allows; the fractional rest is a
weighted sample without replacement: each document draws an exponential key divided by its quality weight, documents
are ordered by key within the source, and a prefix sum of their words fills the budget. The document on the budget's
edge gives its first words only, so every source meets its target to the word.

The prefix sum is two-stage: a source's n keys fall into about sqrt(n) cells, cell totals are summed in order, and only
the one cell that holds the edge is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..runtime import Scratch
from .text import SPACE_PATTERN, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Weights repeat along the sources' code-point order, null last. The targets are ``weight * level`` capped at
    ``max_epochs * size``: ordered by cap / weight, the capped sources come first, and the level follows from what
    they leave to the rest.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumns({"level": left / open_weight, "position": F.row_number().over(order)})
    # The first source whose cap is above its share of what is left settles the level; sources before it are capped.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("position", "level"))).over(every)["level"]
    return levels.withColumn("final", level).select("source", "source_size", F.least(F.col("final") * F.col("weight"), F.col("cap")).alias("target"))


def draw_key(weight: Column, *identity: Column) -> Column:
    """Exponential draw with rate ``weight``; equal identities draw alike, whatever the partitioning."""
    return -F.log(F.greatest(uniform(*identity), F.lit(2.0**-33))) / weight


def slim_documents(docs: DataFrame, id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """Each document's id, source and size in words, without its text."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("_row"), "source", word_count().alias("size"))


def mix(
    slim: DataFrame,
    weight: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``slim_documents``: ``doc_id, _row, size, source_size, target, taken``; ``taken`` counts words, repeats included.

    ``weight`` is the document's positive quality weight (null: 1). Null sources form a source of their own. Null and
    empty texts have size 0 and are taken as nothing. Rows with equal or null ids draw alike and are told apart by
    size, source and ``_row``. Sources of size 0 have target 0. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(slim.sparkSession)
    quality = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    key = draw_key(quality, F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = scratch.table(slim.select("doc_id", "_row", "source", "size", key.alias("key")), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = scratch.table(totals, "sources")
    targets = scratch.table(
        source_targets(totals.select("source", "source_size"), weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("bigint"))
        .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .join(totals.select(F.col("source").alias("s"), F.ceil(F.sqrt("n")).alias("cells")), F.expr("source <=> s"))
        .drop("s"),
        "targets",
    )
    # exp(-key) falls as the key grows, so the cells follow the key order.
    dealt = slim.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    dealt = dealt.withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * F.col("cells")))
    cells = dealt.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edges = scratch.table(
        cells.filter((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
        .select(F.col("source").alias("s"), F.col("cell").alias("edge"), "before"),
        "edges",
    )
    placed = dealt.join(edges, F.expr("source <=> s"), "left").drop("s")
    inside = F.when(F.col("edge").isNotNull() & (F.col("cell") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    on_edge = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    edge_rows = placed.filter(on_edge).withColumn("fraction", F.greatest(F.least(F.col("size"), F.col("budget") - ahead), F.lit(0)))
    rest = placed.filter(~on_edge).withColumn("fraction", inside)
    return edge_rows.unionByName(rest).select(
        "doc_id", "_row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("fraction")).cast("bigint").alias("taken")
    )


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, joined by one space."""
    words = F.filter(F.split(text, SPACE_PATTERN + "+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def mixed_rows(numbered: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix as documents, from ``numbered`` (``doc`` struct and ``_row``): each as often as it is taken, a cut document's part last.

    Documents without words, and those not drawn, are left out.
    """
    counts = taken.filter(F.col("taken") > 0).select("_row", "size", "taken")
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - whole * F.col("size")
    parts = F.concat(F.array_repeat(F.lit(0).cast("bigint"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = numbered.join(counts, "_row").withColumn("_part", F.explode(parts))
    cut = first_words(F.col("doc.text"), F.col("_part"))
    doc = F.col("doc").withField("text", F.when(F.col("_part") > 0, cut).otherwise(F.col("doc.text")))
    if "n_chars" in numbered.schema["doc"].dataType.names:
        kind = numbered.schema["doc"].dataType["n_chars"].dataType
        doc = doc.withField("n_chars", F.when(F.col("_part") > 0, F.char_length(cut).cast(kind)).otherwise(F.col("doc.n_chars")))
    return rows.select(doc.alias("doc")).select("doc.*")
