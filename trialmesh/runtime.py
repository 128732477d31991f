"""Session helpers: written intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# A dimension is broadcast only when it was written and found to have at most this many rows and bytes.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
# Row groups of this size let many tasks read back what few tasks wrote.
ROW_GROUP_BYTES = 8 * 1024 * 1024

# Folder of a local session that names none, by application id.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, removed when the process ends; a cluster must
    name a folder that the driver and all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return "file://" + os.path.abspath(_own_folders[app])


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one run in a folder of their own below the shared folder.

    ``drop`` removes what later steps no longer read. The rest is removed when the process ends, since a returned
    DataFrame is lazy and may still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._quietly_close)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` once and return the written table; it survives lost executors and prunes columns."""
        path = self.path(name)
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(written)] = (written, path)
        return written

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _remove(self.spark, self._paths.pop(id(table))[1])

    def close(self) -> None:
        """Remove everything; call it only when no lazy result reads these tables."""
        _remove(self.spark, self.folder)
        self._paths.clear()

    def _quietly_close(self) -> None:
        # At the end of the process the session may already be gone.
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.folder)


_scratch: dict[str, Scratch] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The result is computed once, survives lost executors, reads only the columns asked for and is bitwise
    stable: operators that scan their input several times (ranks, quantiles) depend on that. The application's
    tables lie in one folder that is removed when the process ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = Scratch(spark)
    return _scratch[app].table(df)


def release(table: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more."""
    _scratch[table.sparkSession.sparkContext.applicationId].drop(table)


@contextlib.contextmanager
def session_setting(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (underscores for dots) that hold for the actions run inside the block."""
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small table held by the driver; the optimizer knows its size and folds projections of it."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrays = [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a written table is small by rows and by the bytes of its values."""
    wide = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    arrays = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    per_row = 16 * len(table.columns)
    size = F.lit(per_row)
    for name in wide:
        size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    for name in arrays:
        size = size + F.greatest(F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)), F.lit(0)) * 16
    found = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("b")).first()
    return found["n"] <= max_rows and found["b"] <= max_bytes


def join_dimension(
    df: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    checked: bool = False,
) -> DataFrame:
    """Join a dimension that is usually small.

    The dimension is written and measured first. Within ``max_rows`` and the byte bound it is broadcast, so a hot
    key costs nothing; above that the join shuffles both sides and adaptive execution splits skewed keys.
    ``checked`` says that the caller has already found it small.
    """
    if not checked:
        dimension = materialize(dimension)
        checked = fits_broadcast(dimension, max_rows)
    return df.join(F.broadcast(dimension) if checked else dimension, on=list(on), how=how)
