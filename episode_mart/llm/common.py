"""Helpers of the operators: tables, written intermediate results, column maps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.sources.tables import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends, lost executors cost nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediate tables of one run, deleted together once no result needs them any more."""

    def __init__(self):
        self.paths: list[str] = []
        self.spark: SparkSession | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        self.spark, path = df.sparkSession, scratch_dir(df.sparkSession)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()


def held_out(doc_id="doc_id"):
    """True for the quarter of documents that a learner must not see; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def chosen(df: DataFrame, share) -> Column:
    """True for about ``share`` of the rows, by the hash of all their values: copies with other ids differ."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    space = 1 << 30
    return F.pmod(F.xxhash64(*plain), F.lit(space)) < share * space


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name, dots included."""
    inner = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inner.names)

    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(renamed, inner).toDF(*schema.names)


def with_columns(df: DataFrame, column: str, fields: list[tuple[str, str]],
                 compute: Callable[[], Callable[[pa.Array], list[list]]]) -> DataFrame:
    """Columns computed from ``column`` in Arrow batches; equally named columns of ``df`` are replaced.

    ``compute`` runs once per task and returns the function from a batch's column to value lists.
    """
    new = {name for name, _ in fields}
    if column in new:
        raise ValueError(f"{column} is both read and written")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*kept.schema.fields, *added.fields])
    at = kept.columns.index(column)
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compute()
        for batch in batches:
            values = of(batch.column(at))
            arrays = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    return map_batches(kept, run, schema)
