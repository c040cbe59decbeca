"""Text to typed value; whatever does not parse becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.functions.text import plain_id
from episode_mart.schemas import width_of

# Accepted spellings and date layouts.
TRUE_WORDS = ["1", "true", "yes", "y", "t", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "f", "off"]
SLASHED = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a"]
COMPACT = "yyyyMMdd"
NAMED_MONTH = "d-MMM-yyyy"
FIRST_DATETIME = "1753-01-01"

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coercion_of(data_type: T.DataType) -> str:
    """Coercion class of a column type; anything unlisted is text."""
    return {
        T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int",
        T.DecimalType: "money", T.DoubleType: "float", T.FloatType: "float",
        T.BooleanType: "bool", T.DateType: "date",
        T.TimestampType: "datetime", T.TimestampNTZType: "datetime",
    }.get(type(data_type), "str")


def _number(c: Column, data_type: str) -> Column:
    # The pattern keeps out spellings a cast accepts but a spreadsheet number never has ("1d", "NaN").
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast(data_type))


def to_int(c: Column, data_type: str = "int") -> Column:
    n = _number(c, "double")
    return F.when(n == F.floor(n), n.try_cast(data_type))


def to_bool(c: Column) -> Column:
    word = F.regexp_replace(F.lower(F.trim(c)), r"^([01])\.0*$", "$1")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def _timestamp(c: Column) -> Column:
    c = F.trim(c)
    slashed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in SLASHED])
    return (
        F.when(c.rlike(r"^\d{4}-\d"), c.try_cast("timestamp_ntz"))
        .when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), slashed.cast("timestamp_ntz"))
        .when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit(COMPACT)).cast("timestamp_ntz"))
        .when(c.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
              F.try_to_timestamp(c, F.lit(NAMED_MONTH)).cast("timestamp_ntz"))
    )


def to_datetime(c: Column) -> Column:
    """Timestamps before 1753 or after 9999 do not fit a datetime column."""
    ts = _timestamp(c)
    return F.when(
        (ts >= F.lit(FIRST_DATETIME).cast("timestamp_ntz")) & (F.year(ts) <= 9999), ts
    )


def to_date(c: Column) -> Column:
    day = _timestamp(c).cast("date")
    return F.when(F.year(day).between(1, 9999), day)


def to_text(c: Column, width: int | None) -> Column:
    return F.substring(c, 1, width) if width else c


def coerce(c: Column, field: T.StructField) -> Column:
    """A text column as the type (and width) of the field."""
    kind = coercion_of(field.dataType)
    if kind == "int":
        return to_int(c, field.dataType.simpleString())
    if kind in ("float", "money"):
        return _number(c, field.dataType.simpleString())
    if kind == "bool":
        return to_bool(c)
    if kind == "date":
        return to_date(c)
    if kind == "datetime":
        return to_datetime(c)
    if field.metadata.get("is_id"):
        c = plain_id(c)
    return to_text(c, width_of(field))
