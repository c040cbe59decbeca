"""Parquet tables: typed publishing, append and replace, listing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.schemas import label_of, width_of
from episode_mart.sources.versions import Snapshot, commit, snapshot, write_part

# Legacy names of replacing.
REPLACE = {"replace", "delete", "truncate"}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used in local mode only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="episode_mart_")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile has its shuffle files deleted at its end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write(df: DataFrame, path: str, mode: str = "append") -> Snapshot:
    """Append to, or replace, the versioned table at ``path``; read it with ``versions.read_table``.

    The rows are visible once the version is committed: a failed job leaves the version before.
    """
    if mode != "append" and mode not in REPLACE:
        raise ValueError(f"unknown write mode {mode!r}")
    seen = snapshot(df.sparkSession, path)
    part = write_part(df, path)
    return commit(df.sparkSession, path, seen, {**(seen.parts if mode == "append" else {}), part: part})


def _narrowed(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`").cast(field.dataType)
    width = width_of(field)
    if width is None:
        return c
    message = F.lit(f"{label_of(field)}: value is longer than {width} characters")
    return F.when(F.length(c) > width, F.raise_error(message)).otherwise(c)


def publish(df: DataFrame, schema: T.StructType, labels: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the schema, cast; a text over its width raises.

    ``labels`` names the columns by their reporting headers instead of the engine's names; ``keep`` rides along.
    """
    return df.select(*[
        _narrowed(f).alias(label_of(f) if labels else f.name, metadata=f.metadata) for f in schema
    ], *keep)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session's current database, in order."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def table_schema(spark: SparkSession, table: str) -> DataFrame:
    """Position, name, type and declared width of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), width_of(f))
            for i, f in enumerate(spark.table(table).schema, start=1)]
    return spark.createDataFrame(
        rows, "position int, column_name string, data_type string, width int")
