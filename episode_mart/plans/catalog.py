"""What the engine holds under a base folder: its tables, their versions and columns, by their logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.plans import ingest, refresh
from episode_mart.schemas import label_of, width_of
from episode_mart.sources import versions

TABLES = "layer string, table_name string, version int, loads int, columns int"


def _held(spark: SparkSession, base: str) -> dict[tuple[str, str], versions.Snapshot]:
    """(layer, table) to its newest version, of all tables that have one."""
    places = [("raw", t, ingest.raw_path(base, t)) for t in refresh.RAW_TABLES]
    places += [("stage", t, f"{base}/stage/{t}") for t in refresh.STAGE_TABLES]
    places += [("mart", t, f"{base}/marts/{t}") for t in refresh.MART_TABLES]
    found = {(layer, t): versions.snapshot(spark, path) for layer, t, path in places}
    return {k: s for k, s in found.items() if s.version}


def _schema(layer: str, table: str, now: versions.Snapshot) -> T.StructType:
    return ingest.raw_schema(table) if layer == "raw" else T.StructType.fromJson(now.facts["schema"])


def frame(spark: SparkSession, base: str, layer: str, table: str) -> DataFrame:
    """The newest version of a table."""
    if layer == "raw":
        return ingest.raw_table(spark, base, table)
    return (refresh.read_stage if layer == "stage" else refresh.read_mart)(spark, base, table)


def list_tables(spark: SparkSession, base: str, rows: bool = False) -> DataFrame:
    """All tables in order of layer and name, with version, number of loads (raw) and of columns; ``rows`` counts them too."""
    held = _held(spark, base)
    listed = [(layer, t, s.version, len(s.parts) if layer == "raw" else None, len(_schema(layer, t, s)))
              for (layer, t), s in held.items()]
    df = spark.createDataFrame(listed, TABLES)
    if rows and held:  # counted from the files' footers
        counts = [frame(spark, base, *k).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(k[0]).alias("layer"), F.lit(k[1]).alias("table_name"), "rows") for k in held]
        df = df.join(reduce(DataFrame.unionAll, counts), ["layer", "table_name"])
    return df.orderBy("layer", "table_name")


def columns(spark: SparkSession, base: str, layer: str, table: str) -> DataFrame:
    """Position, name, reporting label, type and declared width of a table's columns."""
    held = _held(spark, base)
    if (layer, table) not in held:
        raise ValueError(f"no {layer} table {table}")
    fields = _schema(layer, table, held[layer, table])
    return spark.createDataFrame(
        [(i, f.name, label_of(f), f.dataType.simpleString(), width_of(f)) for i, f in enumerate(fields, start=1)],
        "position int, column_name string, label string, data_type string, width int")


def register(spark: SparkSession, base: str, prefix: str = "") -> list[str]:
    """Views ``<prefix><layer>_<table>`` of the newest versions, for SQL in this session; returns their names."""
    names = []
    for layer, table in _held(spark, base):
        names.append(f"{prefix}{layer}_{table}")
        frame(spark, base, layer, table).createOrReplaceTempView(names[-1])
    return sorted(names)
