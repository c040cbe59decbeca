"""Embedding whitening along the leading components of the vectors' covariance.

A vector's entries c become the whole numbers x = floor(256 c). The fit list holds every different
x-vector once, so copies have no weight. Three aggregates over it, each summed in the tasks first: count
and sums; the products of centred entries (the covariance); the products of whitened entries, which show
how far their covariance is from the identity. The eigenpairs come from ``spectrum`` (spectrum slicing).
What reaches the driver is d * (d + 1) / 2 numbers for d entries, whatever the number of vectors.

Odd rows: a vector that is null or empty, or holds null or non-finite entries, goes. Vectors of another
length are another space: each length is fitted by itself. Numbers x are held to ±2^62. Components whose
eigenvalue is not above rounding (a list of one vector, too few vectors) cannot be whitened and are left
out, so such rows get fewer or none. A deviation beyond a long is null. Repeated rows each get their result;
columns of ``df`` that are called like a result are replaced, others pass through.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.common import Scratch, with_columns
from episode_mart.llm.spectrum import Slicer

SCALE, COMPONENTS = 256, 4
LIMIT = 2.0 ** 62


class Space(NamedTuple):
    """What the fit list of one length gives; ``axes`` holds a unit vector per column."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def whitener(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def finite(vector: Column) -> Column:
    """True for a vector with entries, all of them finite."""
    bound = F.lit(float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound)), F.lit(False))


def whole(column: pa.Array, scale: float = SCALE) -> list[np.ndarray]:
    """Each vector of an Arrow list column as whole numbers."""
    flat = np.asarray(column.flatten(), "float64")
    x = np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype("int64")
    ends = np.cumsum(np.asarray(pc.list_value_length(column)))
    return np.split(x, ends[:-1]) if len(ends) else []


def packed(x: np.ndarray) -> bytes:
    """The shortest form that holds all entries; equal vectors give equal bytes."""
    for kind in ("<i1", "<i2", "<i4"):
        y = x.astype(kind)
        if np.array_equal(y, x):
            return kind.encode() + y.tobytes()
    return b"<i8" + x.astype("<i8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, b[:3].decode(), offset=3).astype("int64")


def by_length(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (places, matrix with a row for each place)."""
    lengths = np.array([len(v) for v in vectors])
    return {int(d): (at := np.flatnonzero(lengths == d), np.stack([vectors[i] for i in at])) for d in np.unique(lengths)}


def _fit_list(df: DataFrame, vector: str, scale: float) -> DataFrame:
    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packed(x) for x in whole(batch.column(0), scale)], pa.binary())], ["x"])

    valid = df.select(F.col(f"`{vector}`").alias("v")).where(finite(F.col("v")))
    return valid.mapInArrow(pack, "x binary").distinct()


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length to number of vectors and sums by place, exact."""
    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for d, (at, x) in by_length([unpacked(b) for b in batch.column(0).to_pylist()]).items():
                small = np.abs(x).max() < 2 ** 40
                s = [int(v) for v in (x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
                n, before = total.get(d, (0, [0] * d))
                total[d] = n + len(at), [a + b for a, b in zip(before, s, strict=True)]
        rows = [(d, i, n, Decimal(v)) for d, (n, s) in total.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            zip(*rows) if rows else ([],) * 4, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38)), strict=True)],
            ["d", "i", "n", "s"])

    rows = (fit.mapInArrow(add, "d int, i int, n long, s decimal(38,0)")
            .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _covariance(fit: DataFrame, n: dict[int, int], mean: dict[int, np.ndarray],
                matrix: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Length to the covariance of x, or of x through the length's matrix, divisor n; other lengths are passed by."""
    def multiply(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, (_, x) in by_length([unpacked(b) for b in batch.column(0).to_pylist()]).items():
                if matrix is None or d in matrix:
                    y = x - mean[d] if matrix is None else (x - mean[d]) @ matrix[d]
                    total[d] = total.get(d, 0) + y.T @ y
        parts = [(np.full(len(i), d), i, j, c[i, j]) for d, c in total.items() for i, j in [np.triu_indices(len(c))]]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            (columns[0].astype("int32"), columns[1].astype("int32"), columns[2].astype("int32"), columns[3]),
            (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["d", "i", "j", "v"])

    rows = (fit.mapInArrow(multiply, "d int, i int, j int, v double")
            .groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow().to_pydict())
    d, i, j, v = (np.array(rows[k]) for k in ("d", "i", "j", "v"))
    out = {}
    for length in np.unique(d):
        own = d == length
        m = np.zeros((i[own].max() + 1,) * 2)
        m[i[own], j[own]] = m[j[own], i[own]] = v[own] / n[int(length)]
        out[int(length)] = m
    return out


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> dict[int, Space]:
    """Length of vectors to its space; empty without a usable vector."""
    scratch = Scratch()
    try:
        listed = scratch.keep(_fit_list(df, vector, scale))
        sums = _sums(listed)
        n = {d: c for d, (c, _) in sums.items()}
        mean = {d: np.array([s / c for s in t]) for d, (c, t) in sums.items()}
        covariance = _covariance(listed, n, mean)
        spaces = {}
        for d, v in covariance.items():
            values, axes = Slicer(v).leading(components)
            spaces[d] = Space(n[d], sums[d][1], float(np.trace(v)), values, axes, 0.0)
        whitener = {d: s.whitener for d, s in spaces.items() if len(s.values)}
        whitened = _covariance(listed, n, mean, whitener) if whitener else {}
        return spaces | {d: spaces[d]._replace(identity_error=float(np.abs(c - np.eye(len(c))).max()))
                         for d, c in whitened.items()}
    finally:
        scratch.clear()


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over places of (n x - S)², exact; None beyond a long."""
    most = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if len(sums) * most * most < 2 ** 63:
        off = n * x - np.array(sums, "int64")
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2 ** 63 else None for v in (off * off).sum(axis=1)]


def whiten(df: DataFrame, spaces: dict[int, Space], vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """The rows of ``df`` with a usable vector, with ``n``, ``deviation``, ``whitened``, ``explained`` (both by
    component) and ``identity_error``; all null where the vector's length was not fitted."""
    def compute():
        def of(column):
            vectors = whole(column, scale)
            out = [[None] * len(vectors) for _ in range(5)]
            for d, (at, x) in by_length(vectors).items():
                if (s := spaces.get(d)) is None:
                    continue
                y = ((x - s.mean) @ s.whitener).tolist()
                explained = (s.values / s.trace).tolist()
                for i, v, w in zip(at, _deviations(x, s.n, s.sums), y, strict=True):
                    for c, value in zip(out, (s.n, v, w, explained, s.identity_error), strict=True):
                        c[i] = value
            return out
        return of

    return with_columns(df.where(finite(F.col(f"`{vector}`"))), vector, [
        ("n", "bigint"), ("deviation", "bigint"), ("whitened", "array<double>"), ("explained", "array<double>"),
        ("identity_error", "double")], compute)
