"""Mixture-shaped views over the provided tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..operators.models import group_mean_columns, long_predictions
from ..operators.splits import grouped_kfold
from ..runtime import materialize, release
from ..sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def formulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mixture per line item: two active components, three other parts, a round and a response."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    sample = F.md5(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_shipdate").cast("date").cast("string"),
        )
    )
    dual = F.col("l_linenumber") > 2
    label = F.concat(F.lit("R"), (F.year("l_shipdate") - 1994).cast("string"))
    repeated = F.concat(
        F.lit(" (R"), ((F.col("l_linenumber") + F.col("l_suppkey")) % 7 + 1).cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit(")")
    )
    view = joined.select(
        sample.alias("sample_id"),
        F.col("l_orderkey").alias("order_key"),
        F.concat(label, F.lit("-"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 3, repeated).otherwise("")).alias("candidate_id"),
        label.alias("Round"),
        F.col("p_brand").alias("IL1"),
        F.when(dual, F.concat(F.lit("Brand#"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 25 + 1).cast("string"))).alias("IL2"),
        F.col("l_quantity").alias("IL1_molpct"),
        F.when(dual, F.round(F.col("l_discount") * 100, 2)).otherwise(0.0).alias("IL2_molpct"),
        F.col("l_returnflag").alias("Phospholipid"),
        (F.round(F.col("l_tax") * 100, 2) + 5.0).alias("HL_molpct"),
        (F.lit(75.0) - F.col("l_quantity") + F.lit(10.0) * (F.col("l_linenumber") - 4)).alias("CHOL_molpct"),
        F.col("l_linestatus").alias("PEG"),
        (F.lit(1.0) + F.lit(0.25) * (F.col("l_suppkey") % 13)).alias("PEG_molpct"),
        F.when(F.col("p_size") % 10 != 0, (F.col("p_size") % 7 + 3).cast("double")).alias("NP_ratio"),
        F.when(F.col("l_suppkey") % 97 != 0, F.col("l_discount")).alias("PDI"),
        F.col("p_size").cast("double").alias("particle_size"),
        F.col("l_extendedprice").alias("price"),
    )
    response = F.lit(0.6) * F.col("IL1_molpct") / 50.0 + F.lit(0.3) * F.col("particle_size") / 50.0
    return view.withColumn("TE", response + F.lit(0.1) * uniform(F.col("sample_id"), "te"))


FORMULATIONS = """base AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS sample_id,
         l_orderkey AS order_key,
         'R' || (year(l_shipdate) - 1994) || '-' || l_orderkey ||
           CASE WHEN l_linenumber = 3 THEN ' (R' || ((l_linenumber + l_suppkey) % 7 + 1) || '-' || l_partkey || ')' ELSE '' END AS candidate_id,
         'R' || (year(l_shipdate) - 1994) AS Round,
         p_brand AS IL1,
         CASE WHEN l_linenumber > 2 THEN 'Brand#' || ((l_suppkey + l_orderkey) % 25 + 1) END AS IL2,
         l_quantity AS IL1_molpct,
         CASE WHEN l_linenumber > 2 THEN round(l_discount * 100, 2) ELSE 0.0::DOUBLE END AS IL2_molpct,
         l_returnflag AS Phospholipid,
         round(l_tax * 100, 2) + 5.0::DOUBLE AS HL_molpct,
         75.0::DOUBLE - l_quantity + 10.0::DOUBLE * (l_linenumber - 4) AS CHOL_molpct,
         l_linestatus AS PEG,
         1.0::DOUBLE + 0.25::DOUBLE * (l_suppkey % 13) AS PEG_molpct,
         CASE WHEN p_size % 10 <> 0 THEN CAST(p_size % 7 + 3 AS DOUBLE) END AS NP_ratio,
         CASE WHEN l_suppkey % 97 <> 0 THEN l_discount END AS PDI,
         CAST(p_size AS DOUBLE) AS particle_size,
         l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (
  SELECT *, 0.6::DOUBLE * IL1_molpct / 50.0::DOUBLE + 0.3::DOUBLE * particle_size / 50.0::DOUBLE
            + 0.1::DOUBLE * (('0x' || substr(md5(sample_id || '|te'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS TE
  FROM base)"""


def hashed(text: str, digits: int = 8) -> str:
    """SQL for the leading digits of an md5 as a number."""
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def uniform_sql(text: str) -> str:
    return f"({hashed(text)} / 4294967296.0::DOUBLE)"


def slices(k: int) -> list[str]:
    return [f"{(4294967296 * fold) // k:08x}" for fold in range(1, k)]


def fold_sql(hash_sql: str, k: int) -> str:
    return "1 + " + " + ".join(f"({hash_sql} > '{edge}')::INT" for edge in slices(k))


BASELINES = {"by_percent": ["IL1_molpct"], "by_size": ["particle_size"], "by_component": ["IL1", "Phospholipid"]}
FOLDS = 5


def folded(spark: SparkSession, sf_dir: str, repeats: int = 1, group: str = "order_key", k: int = FOLDS) -> DataFrame:
    """Formulations with folds from slices of the group hash: no pass over the data."""
    return grouped_kfold(formulations(spark, sf_dir), group, k=k, repeats=repeats, seed=42, exact=False)


def folded_sql(repeats: int = 1, group: str = "order_key", k: int = FOLDS) -> str:
    return f"""{FORMULATIONS},
folded AS (
  SELECT f.*, r.repeat_id::INT AS repeat_id, {fold_sql(f"md5({group} || '|42|' || r.repeat_id)", k)} AS fold_id
  FROM f, (SELECT unnest(range(1, {repeats + 1})) AS repeat_id) r)"""


def baseline_columns(spark: SparkSession, sf_dir: str, repeats: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-fold predictions of three group-mean baselines, a column each, written once because several metrics read them."""
    base, names = _baseline_rows(spark, sf_dir, keep)
    rows = grouped_kfold(base, "order_key", k=FOLDS, repeats=repeats, seed=42, exact=False).select("sample_id", *keep, "repeat_id", "fold_id", "TE", *names)
    wide = group_mean_columns(rows, BASELINES, "TE")
    written = materialize(wide.select("sample_id", *keep, "repeat_id", "fold_id", F.col("TE").alias("actual"), *[F.round(m, 9).alias(m) for m in BASELINES]))
    release(base)
    return written


def _baseline_rows(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """What the baselines read, written once whatever the number of repeats: folds follow from the key where they are read."""
    names = sorted({c for keys in BASELINES.values() for c in keys})
    return materialize(formulations(spark, sf_dir).select(*dict.fromkeys(["sample_id", *keep, "order_key", "TE", *names]))), names


def repeat_columns(spark: SparkSession, sf_dir: str, repeats: int) -> tuple[DataFrame, dict[str, list[str]]]:
    """Out-of-fold predictions of the baselines, a column per model and repeat, and the columns of each model: a formulation's repeats lie in one row."""
    base, _ = _baseline_rows(spark, sf_dir)
    wide = base
    for r in range(1, repeats + 1):
        rows = grouped_kfold(wide, "order_key", k=FOLDS, repeats=repeats, seed=42, exact=False).where(F.col("repeat_id") == r)
        wide = group_mean_columns(rows, BASELINES, "TE").select(*wide.columns, *[F.round(m, 9).alias(f"{m}_{r}") for m in BASELINES])
    columns = {m: [f"{m}_{r}" for r in range(1, repeats + 1)] for m in BASELINES}
    written = materialize(wide.select("sample_id", F.col("TE").alias("actual"), *[c for own in columns.values() for c in own]))
    release(base)
    return written, columns


def baseline_predictions(spark: SparkSession, sf_dir: str, repeats: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same, one row per model; only the table with a column per model is written."""
    return long_predictions(baseline_columns(spark, sf_dir, repeats, keep), ["sample_id", *keep, "repeat_id", "fold_id", "actual"], BASELINES)


def baseline_sql(repeats: int = 1) -> str:
    """Common table expressions from the base view to ``oof``."""
    return f"{folded_sql(repeats)},\n{oof_sql()}"


def oof_sql(columns: str = "t.sample_id, t.order_key, t.candidate_id, t.Round, t.repeat_id, t.fold_id") -> str:
    """Group-mean predictions of the rows in ``folded``."""
    parts = []
    for name, keys in BASELINES.items():
        cols = ", ".join(keys)
        parts.append(
            f"""SELECT '{name}' AS model, {columns}, t.TE AS actual,
       round(coalesce((a.s - c.s) / nullif(a.n - c.n, 0), o.m), 9) AS predicted
FROM folded t
JOIN (SELECT repeat_id, fold_id, {cols}, sum(TE) AS s, count(TE) AS n FROM folded GROUP BY ALL) c USING (repeat_id, fold_id, {cols})
JOIN (SELECT repeat_id, {cols}, sum(TE) AS s, count(TE) AS n FROM folded GROUP BY ALL) a USING (repeat_id, {cols})
JOIN overall o USING (repeat_id, fold_id)"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""overall AS (
  SELECT repeat_id, fold_id, (sum(s) OVER (PARTITION BY repeat_id) - s) / (sum(n) OVER (PARTITION BY repeat_id) - n) AS m
  FROM (SELECT repeat_id, fold_id, sum(TE) AS s, count(TE) AS n FROM folded GROUP BY ALL)),
oof AS ({union})"""


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two synthetic models over the event values, grouped by user."""
    value = F.col("value")
    pairs = F.array(
        F.struct(F.lit("close").alias("model"), (value * 0.8 + 20.0 * uniform(F.col("event_id"), "close")).alias("predicted")),
        F.struct(F.lit("rough").alias("model"), (value * 0.4 + 60.0 * uniform(F.col("event_id"), "rough")).alias("predicted")),
    )
    # Unrounded on purpose: means of short decimals often end exactly on a rounding edge.
    return table(spark, sf_dir, "events").select("event_id", "user_id", value.alias("actual"), F.inline(pairs))


EVENT_PREDICTIONS = f"""preds AS (
  SELECT 'close' AS model, event_id, user_id, value AS actual,
         value * 0.8::DOUBLE + 20.0::DOUBLE * {uniform_sql("event_id || '|close'")} AS predicted FROM events
  UNION ALL
  SELECT 'rough', event_id, user_id, value,
         value * 0.4::DOUBLE + 60.0::DOUBLE * {uniform_sql("event_id || '|rough'")} FROM events)"""
