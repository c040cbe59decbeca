"""Header matching, alignment to a target schema, header reports.

Matching compares a file's header with the registry: names only, on the driver. Its result is
one ``select`` that renames, coerces, adds, drops and orders the columns.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.functions.coerce import coerce, coercion_of
from episode_mart.operators.profile import column_profiles
from episode_mart.schemas import RAW, label_of, raw_schema, table_name

# A fuzzy match must be strictly above these.
LOAD_THRESHOLD = 0.85
VALIDATE_THRESHOLD = 0.65
DETECT_SCORE = 0.5


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def match_headers(actual: list[str], expected: list[str],
                  threshold: float = LOAD_THRESHOLD) -> dict[str, tuple[str, float]]:
    """Expected name -> (actual name, ratio), one to one: exact names first, then best ratio."""
    free = {a.strip().lower(): a for a in reversed(actual)}
    matches = {}
    for e in expected:
        if e.strip().lower() in free:
            matches[e] = (free.pop(e.strip().lower()), 1.0)
    taken = {a for a, _ in matches.values()}
    ratios = [
        (SequenceMatcher(None, e.lower(), a.strip().lower()).ratio(), e, a)
        for e in expected if e not in matches
        for a in actual if a not in taken
    ]
    for ratio, e, a in sorted(ratios, key=lambda r: -r[0]):
        if ratio > threshold and e not in matches and a not in taken:
            matches[e] = (a, ratio)
            taken.add(a)
    return matches


def align(df: DataFrame, schema: T.StructType, threshold: float = LOAD_THRESHOLD,
          lost: Observation | None = None) -> DataFrame:
    """Text columns of a file as the typed columns of the target, in the target's order.

    Missing columns become typed nulls, unexpected ones are not selected. ``lost`` counts, per typed column, the
    texts that became null because they do not parse, in the job that writes the rows.
    """
    matches = match_headers(df.columns, [label_of(f) for f in schema], threshold)

    def column(field: T.StructField) -> Column:
        match = matches.get(label_of(field))
        if match is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return coerce(quoted(match[0]), field).alias(field.name)

    columns = [column(f) for f in schema]
    if lost is None:
        return df.select(*columns)
    typed = [f for f in schema if label_of(f) in matches and coercion_of(f.dataType) != "str"]
    texts = {f.name: f"_text_{i}" for i, f in enumerate(typed)}
    both = df.select(*columns, *[quoted(matches[label_of(f)][0]).alias(texts[f.name]) for f in typed])
    counts = [F.count_if(F.col(t).isNotNull() & F.col(name).isNull()).alias(name) for name, t in texts.items()]
    return both.observe(lost, F.count(F.lit(1)).alias("_rows"), *counts).select(*schema.names)


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = (), absent: bool = True) -> DataFrame:
    """Typed columns by engine name, with typed nulls for absent ones; ``keep`` rides along.

    Without ``absent`` those are left out, for rows that are written and read back by the schema.
    """
    present = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in schema if absent or f.name in present],
        *keep,
    )


def detect_table(headers: list[str]) -> tuple[str | None, float]:
    """Table the header belongs to, and the share of its expected columns found.

    Only tables with at least half of their columns qualify. Among them the best total match
    wins: by share alone, a table of two common columns would beat any large one.
    """
    found = {}
    for table, schema in RAW.items():
        expected = [label_of(f) for f in schema]
        ratios = [r for _, r in match_headers(headers, expected, VALIDATE_THRESHOLD).values()]
        found[table] = (sum(ratios), len(ratios) / len(expected))
    qualified = [t for t in RAW if found[t][1] >= DETECT_SCORE]
    if not qualified:
        return None, max(score for _, score in found.values())
    best = max(qualified, key=lambda t: found[t][0])
    return best, found[best][1]


def header_report(headers: list[str], table: str,
                  threshold: float = VALIDATE_THRESHOLD) -> dict:
    """Mapping, missing, extra and fuzzy names; valid when nothing is missing or extra."""
    expected = [label_of(f) for f in raw_schema(table)]
    matches = match_headers(headers, expected, threshold)
    used = {a for a, _ in matches.values()}
    missing = [e for e in expected if e not in matches]
    extra = [a for a in headers if a not in used]
    return {
        "table": table_name(table),
        "mapping": {a: e for e, (a, _) in matches.items()},
        "fuzzy": {a: r for a, r in matches.values() if r < 1.0},
        "missing": missing,
        "extra": extra,
        "valid": not missing and not extra,
    }


def validate(df: DataFrame, table: str | None = None) -> DataFrame:
    """Report with one row per column of the file and per missing column.

    The table is detected from the header when not given. The data checks (rows, empty rows,
    nulls, sparse columns, over-width texts) come from one aggregation over the file.
    """
    table = table or detect_table(df.columns)[0]
    if table is None:
        raise ValueError("the columns match no registered table")
    report = header_report(df.columns, table)
    widths = {label_of(f): f.metadata.get("width") for f in raw_schema(table)}
    of_file = [(a, report["mapping"].get(a), report["fuzzy"].get(a)) for a in df.columns]
    profile = column_profiles(df, {a: widths[e] for a, e, _ in of_file if e and widths[e]})

    def pick(values: dict[str, str | None]) -> Column:
        pairs = [F.lit(x) for kv in values.items() if kv[1] is not None for x in kv]
        if not pairs:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*pairs), F.col("column_name"))

    status = {a: "extra" if e is None else ("fuzzy" if f else "exact") for a, e, f in of_file}
    found = profile.select(
        "column_name",
        pick({a: e for a, e, _ in of_file}).alias("expected_name"),
        pick(status).alias("status"),
        "rows", "empty_rows", "nulls", "is_sparse", "over_width",
    )
    if report["missing"]:
        first = found.columns[0]
        missing = df.sparkSession.createDataFrame(
            [(e, "missing") for e in report["missing"]], "expected_name string, status string")
        found = found.unionByName(missing, allowMissingColumns=True).select(first, *found.columns[1:])
    return found.withColumn("file_is_valid", F.lit(report["valid"]))
