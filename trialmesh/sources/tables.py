"""Read source tables, write result tables and fingerprint their content."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read any Spark source; the format follows the extension.

    CSV needs no schema (columns stay text and are converted by name later). With a schema, bad lines are kept in
    ``_corrupt_record``. A byte-order mark before the first header is removed.
    """
    if format is None:
        name = re.sub(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", "", path.rstrip("/").lower())
        format = next((f for f in ("parquet", "csv", "json", "orc") if name.endswith(f)), "parquet")
    reader = spark.read.format(format)
    if format == "csv":
        options = {"header": True, "multiLine": False, "mode": "PERMISSIVE"} | options
        if schema is not None:
            parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            schema = T.StructType(list(parsed.fields)).add("_corrupt_record", T.StringType())
            options["columnNameOfCorruptRecord"] = "_corrupt_record"
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path)
    clean = [c.lstrip("﻿").strip() if i == 0 else c for i, c in enumerate(df.columns)]
    return df if clean == df.columns else df.toDF(*clean)


def write_tables(tables: Mapping[str, DataFrame], path: str, run_id: str, info: Mapping[str, object] | None = None, format: str = "parquet") -> None:
    """Write each result table to its own directory, partitioned by run, and a key/value table about the run.

    A run replaces what an earlier attempt with its id has written, and leaves other runs as they are.
    """
    spark = next(iter(tables.values())).sparkSession
    everything = dict(tables)
    if info is not None:
        rows = [(str(k), None if v is None else str(v)) for k, v in info.items()]
        everything["run_info"] = spark.createDataFrame(rows, "key string, value string")
    for name, table in everything.items():
        writer = table.write.mode("overwrite").format(format)
        if format == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path.rstrip('/')}/{name}/run_id={quote(run_id, safe='')}")


def read_result(spark: SparkSession, path: str, name: str, run_id: str, format: str = "parquet") -> DataFrame:
    """One run of a result table; the run is a partition, so other runs are not read."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{path.rstrip('/')}/{name}/run_id={quote(run_id, safe='')}")


def row_digest(df: DataFrame):
    """SHA-256 of a row over its columns in name order; each value comes with its length, so different rows have different texts."""

    def part(column: str):
        text = F.col(f"`{column}`").cast("string")
        return F.when(text.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.char_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in sorted(df.columns)]), 256)


def content_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-independent fingerprint of a table of any size: row count and the sums of the four 64-bit slices of each row's SHA-256.

    Sums of exact integers do not depend on partitioning, and repeated rows count as often as they occur.
    """
    digest = row_digest(df.select(*columns) if columns else df)

    def slice_sum(start: int):
        part = F.conv(F.substring("d", start, 16), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(part).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string")

    digests = (df.select(*columns) if columns else df).select(digest.alias("d"))
    return digests.agg(F.count(F.lit(1)).alias("n_rows"), *[slice_sum(16 * i + 1).alias(f"digest_{i + 1}") for i in range(4)])
