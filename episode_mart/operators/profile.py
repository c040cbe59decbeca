"""Data profile of a file: one aggregation, whatever the number of columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a column with a larger share of nulls is sparse.
SPARSE_SHARE = 0.8


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def column_profiles(df: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """One row per column: rows, empty rows, nulls, sparse flag, values over their width."""
    widths = widths or {}
    names = df.columns
    empty = reduce(and_, [_column(n).isNull() for n in names])
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(empty).alias("empty_rows"),
        *[F.count_if(_column(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count_if(F.length(_column(n)) > widths[n]).alias(f"w{i}")
          for i, n in enumerate(names) if n in widths],
    )
    per_column = F.array(*[
        F.struct(
            F.lit(n).alias("column_name"),
            F.col(f"n{i}").alias("nulls"),
            (F.col(f"w{i}") if n in widths else F.lit(0).cast("long")).alias("over_width"),
        )
        for i, n in enumerate(names)
    ])
    return (
        counts.select("rows", "empty_rows", F.explode(per_column).alias("c"))
        .select(
            "c.column_name", "rows", "empty_rows", "c.nulls",
            # Without rows the share is null, and the column is not called sparse.
            F.coalesce(F.try_divide("c.nulls", "rows") > SPARSE_SHARE, F.lit(False)).alias("is_sparse"),
            "c.over_width",
        )
    )


def sample_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in the given order: a top-n, no full sort."""
    return df.orderBy(*order).limit(n)
