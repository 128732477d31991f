"""Near-duplicate vectors by inverted lists of pivots, without loss.

Vectors that may link (one label, one size) form a group. A group of more than a block has pivots, drawn by hash; every
vector is at home in the list of its nearest pivot and visits the list of each lower-numbered pivot to which a linked
partner may be nearest: a partner at home there lies beyond the plane between the two pivots, and the angle to that
plane is at most the angle of ``cosine``. So every linked pair meets, in the list of its smaller home pivot and only
there, however many pivots lie in a crowd of like vectors. A smaller group is one list.

Lists are searched in blocks of bounded size with exact cosines in double precision. A block returns each vector's
number of links and a spanning tree of them, so a crowd of like vectors never becomes a list of pairs. Where pivots
tell vectors apart badly (many dimensions, no clusters) nearly every list is visited, and the search is that of all
pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch, fits_broadcast, session_setting
from .components import components
from .ngram_join import _by_group

COSINE = 0.93
MAX_PIVOTS = 16_384
# Pivots are as many as leave each about this many vectors; larger lists are cut.
BLOCK_VECTORS = 2048
# For rounding; lists may only be visited needlessly.
SLACK = 1e-9


def unit(vector) -> np.ndarray | None:
    """The vector at length one; None if it is null, empty, zero or not finite throughout."""
    if vector is None or len(vector) == 0:
        return None
    v = np.array(vector, dtype=float)
    largest = np.abs(v).max() if np.isfinite(v).all() else 0.0
    if not largest > 0:
        return None
    v /= largest
    return v / math.sqrt(float(v @ v))


def described(vectors: DataFrame, columns: list[str], vector_col: str) -> DataFrame:
    """``columns`` with the unit vector as bytes, its size and a digest of the original components; null for vectors that link with nothing."""
    at = len(columns)
    kept = [T.StructField(f.name, f.dataType) for f in vectors.select(*columns).schema]
    schema = T.StructType([*kept, T.StructField("v", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(x) for x in batch.column(at).to_pylist()]
            data = [None if u is None else u.tobytes() for u in units]
            extra = [pa.array(data, pa.binary()), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([d and xxhash.xxh3_128_digest(d) for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *extra], names=[*columns, "v", "dim", "digest"])

    return vectors.select(*columns, vector_col).mapInArrow(describe, schema)


def visited_lists(x: np.ndarray, pivots: np.ndarray, cosine: float) -> list[list[int]]:
    """For each unit vector the number of its nearest pivot, then the lower numbers of the lists it must visit."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    reach = math.sqrt(1 - cosine * cosine) if cosine > 0 else math.inf
    found = []
    for own, h in zip(near, home.tolist()):
        apart = np.sqrt(((pivots[:h] - pivots[h]) ** 2).sum(axis=1)) if reach < math.inf else np.ones(h)
        found.append([h, *np.flatnonzero(own[h] - own[:h] <= reach * apart + SLACK).tolist()])
    return found


def with_lists(rows: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``rows`` (with ``group`` and ``v``) with ``lists``: see ``visited_lists``; list 0 alone where a group has no pivots."""
    schema = rows.withColumn("lists", F.array().cast("array<int>")).schema
    at = [rows.columns.index(c) for c in ("group", "v")]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(at[0]).to_numpy()
            lists: list[list[int]] = [[0]] * batch.num_rows
            for group in np.unique(groups):
                if int(group) in pivots:
                    own = np.flatnonzero(groups == group)
                    x = np.stack([np.frombuffer(batch.column(at[1])[int(i)].as_buffer(), float) for i in own])
                    for i, found in zip(own, visited_lists(x, pivots[int(group)], cosine)):
                        lists[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(place, schema)


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest position reachable in a symmetric matrix of links; every row is read once."""
    root = np.arange(len(linked))
    ahead = linked.any(axis=1)
    for i in np.flatnonzero(ahead).tolist():
        front = np.array([i] if ahead[i] else [], int)
        while len(front):
            root[front] = i
            ahead[front] = False
            front = np.flatnonzero(linked[front].any(axis=0) & ahead)
    return root


def search_block(v: np.ndarray, copies: np.ndarray, left: np.ndarray, cross: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector (copies counted) and the block's components. ``cross``: only pairs of a left and another vector."""
    linked = np.zeros((len(v), len(v)), bool)
    if cross:
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        linked[np.ix_(a, b)] = v[a] @ v[b].T >= cosine
    else:
        linked[:] = np.tril(v @ v.T >= cosine, -1)
    n, root = np.zeros(len(v), np.int64), np.arange(len(v))
    linked |= linked.T
    hit = np.flatnonzero(linked.any(axis=1))
    if len(hit):
        inner = linked[np.ix_(hit, hit)]
        n[hit], root[hit] = inner @ copies[hit], hit[_components(inner)]
    return n, root


def list_links(entries: DataFrame, cosine: float) -> DataFrame:
    """``class, n, root`` per vector and block with links, from ``group, list, x, y, class, copies, v, left``."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        x, y = (table[c][0].as_py() for c in ("x", "y"))
        v = np.stack([np.frombuffer(b, float) for b in table["v"].to_pylist()])
        number = table["class"].to_numpy()
        n, root = search_block(v, table["copies"].to_numpy(), table["left"].to_numpy(), x != y, cosine)
        hit = n > 0
        if hit.any():
            yield pa.RecordBatch.from_pydict({"class": number[hit], "n": n[hit], "root": number[root[hit]]})

    keys = ["group", "list", "x", "y"]
    return _by_group(entries.select(*keys, "class", "copies", "v", "left"), keys, handle, "class bigint, n bigint, root bigint")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table) else table


def group_pivots(entries: DataFrame, scratch: Scratch) -> dict[int, np.ndarray]:
    """Pivots of each group of more than ``BLOCK_VECTORS`` entries, about one for so many; at most about ``MAX_PIVOTS`` in all.

    The digest draws them, independent of the order of rows. Results don't depend on the draw.
    """
    sizes = entries.groupBy("group").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK_VECTORS)
    large = scratch.table(sizes.withColumn("wanted", F.ceil(F.col("size") / BLOCK_VECTORS)), "large")
    total = large.agg(F.sum("wanted")).first()[0]
    if not total:
        return {}
    wanted = F.ceil(F.col("wanted") * min(1.0, MAX_PIVOTS / total))
    drawn = entries.join(_small(large), "group").filter(F.pmod(F.xxhash64("digest"), F.col("size")) < wanted)
    pivots: dict[int, list] = {}
    for r in sorted(drawn.select("group", "digest", "v").collect(), key=lambda r: bytes(r["digest"])):
        pivots.setdefault(r["group"], []).append(np.frombuffer(r["v"], float))
    return {group: np.stack(own) for group, own in pivots.items()}


def dealt_blocks(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows for ``list_links``: block x of those at home in a list meets block y >= x of them, or block -1 - y of the visitors."""
    met = placed.select("group", "class", F.posexplode("lists").alias("place", "list"))
    share = lambda home: F.ceil(F.count(F.when(home, 1)) / BLOCK_VECTORS)
    blocks = met.groupBy("group", "list").agg(share(F.col("place") == 0).alias("homes"), share(F.col("place") > 0).alias("visits"), F.count(F.lit(1)).alias("size"))
    blocks = scratch.table(blocks.filter("homes > 0 AND size > 1").drop("size"), "blocks")
    dealt = placed.select("group", "class", "copies", "v", F.posexplode("lists").alias("place", "list")).join(_small(blocks), ["group", "list"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("place") == 0, F.col("homes")).otherwise(F.col("visits"))))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(n)), lambda k: k < F.col(n))
    meeting = lambda x, y, left: F.struct(x.alias("x"), y.alias("y"), left.alias("left"))
    block = F.col("block")
    at_home = F.concat(
        F.transform(upto("homes"), lambda k: meeting(F.least(k, block), F.greatest(k, block), block <= k)),
        F.transform(upto("visits"), lambda k: meeting(block, -k - 1, F.lit(True))),
    )
    visiting = F.transform(upto("homes"), lambda k: meeting(k, -block - 1, F.lit(False)))
    dealt = dealt.withColumn("_m", F.explode(F.when(F.col("place") == 0, at_home).otherwise(visiting)))
    return dealt.select("group", F.col("list").cast("bigint"), "_m.x", "_m.y", "class", "copies", "v", "_m.left")


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    cosine: float = COSINE, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their sizes are equal and their cosine is at least
    ``cosine``. Vectors that are null, empty, zero or not finite throughout link with nothing. Equal vectors are one
    entry of the lists and count as links of each other. Rows with one id are separate vectors; null ids come last
    in a component. An empty table gives an empty result; further columns are ignored.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    with session_setting(vectors.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="2000"):
        taken = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_vector"))
        rows = scratch.table(described(taken, ["_row", "id", "label"], "_vector"), "vectors")
        usable = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull())
        same = F.xxhash64("label", "dim")
        classes = scratch.table(usable.groupBy("label", "digest").agg(F.min("_row").alias("class"), F.count(F.lit(1)).alias("copies")), "classes")
        entries = usable.select(F.col("_row").alias("class"), same.alias("group"), "v", "digest").join(classes.select("class", "copies"), "class")
        entries = scratch.table(entries.select("class", "copies", "group", "v", "digest"), "entries")
        placed = scratch.table(with_lists(entries.drop("digest"), group_pivots(entries, scratch), cosine), "placed")
        found = scratch.table(list_links(dealt_blocks(placed, scratch), cosine), "found")
        reached = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), scratch)
        linked = scratch.table(found.groupBy("class").agg(F.sum("n").alias("n")), "linked")

    decided = classes.join(linked, "class", "left").join(reached.withColumnRenamed("node", "class"), "class", "left")
    decided = scratch.table(decided.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("root")), "decided")
    rooted = scratch.table(rows.select("_row", "id", "label", "digest").join(decided, ["label", "digest"], "left").select("_row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "_row").alias("root")), "rooted")
    least = scratch.table(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"))).alias("first")), "least")
    return rooted.join(least, "root").select(F.col("id").alias(id_col), "n_links", F.col("first.id").alias("component_id"), F.col("id").eqNullSafe(F.col("first.id")).alias("kept"))
