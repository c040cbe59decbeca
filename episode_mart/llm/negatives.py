"""Hard negatives: rows of another label that score almost as high against an anchor as a row of its own.

A score is the inner product of whole-number vectors x = floor(scale * c). Candidates are never brought together:
each task reads its own part of the table in blocks, and keeps for every block one list of its rows per
dimension, sorted by that entry (Fagin's threshold algorithm). For an anchor the lists are read from the end that its
entry's sign points to, all to the same depth; rows met for the first time are scored by random access, and the
threshold, the score of a row that had in each dimension the entry last read, bounds all rows not met. A search ends
once the threshold lies strictly below the kth score of every window (or below the window itself); strictly, since ties go
to smaller ids. What a task has found in earlier blocks counts, so later blocks end sooner. The few rows that tasks keep
per window are merged by a window function.

Two rounds: positives (same label, window without bounds), then, with their scores, negatives (other labels, scores
from ``low`` to ``high`` percent of the positive's). Anchors are sent to the tasks in blocks of about
``ANCHOR_ENTRIES`` entries, whatever their number, one pass over the candidates each; results are written pass by pass.
Of equal vectors of one label only the smallest ids can be among the first k, so a block drops the others: a
vector that a third of all rows hold costs no more than another, and no result changes.

Odd rows: a row without id, label or usable vector (null, empty, null or non-finite entries) takes no part. Vectors of
different lengths do not meet. Candidates that agree in id and score count once; of several anchors with one id the one with
the smallest label, then vector, is taken, and a candidate with the anchor's id is not its positive. Entries are held to
±2^62, scores to what a long holds. An empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episode_mart.llm.common import Scratch, keep
from episode_mart.llm.whitening import LIMIT, SCALE, by_length, finite, whole

K, POSITIVES, LOW, HIGH = 5, 5, 80, 100
ANCHOR_ENTRIES, BLOCK_ROWS, FIRST_DEPTH = 1 << 20, 4_096, 32
_MOST = 2 ** 63 - 1


class Lists:
    """A block's rows of one vector length, with their sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int):
        # of equal (label, vector) the k + 1 smallest ids: k, and one more as the anchor itself may be among them
        _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((ids, labels, same))
        ids, labels, same = ids[order], labels[order], same[order]
        fresh = np.r_[True, (np.diff(same) != 0) | (np.diff(labels) != 0)]
        new = fresh | np.r_[True, np.diff(ids) != 0]  # repeated rows count once
        place = np.cumsum(new)
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        kept = new & (place - first <= k)
        self.ids, self.labels, self.x = ids[kept], labels[kept], x[order][kept]
        self.exact = float(np.abs(self.x).max())
        self.real = self.x.astype("float64")
        self._sort()

    def _sort(self) -> None:
        self.order = np.argsort(self.x, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)

    def rows(self, of: np.ndarray) -> Lists:
        part = object.__new__(Lists)
        part.ids, part.labels, part.x, part.exact, part.real = self.ids[of], self.labels[of], self.x[of], self.exact, self.real[of]
        part._sort()
        return part

    def search(self, anchor: np.ndarray, found: Windows) -> None:
        """Offer rows to ``found`` until no row that is left can enter it."""
        real = anchor.astype("float64")
        exact = len(anchor) * self.exact * float(np.abs(real).max(initial=0.0)) < 2 ** 53
        rising, falling = np.flatnonzero(real < 0), np.flatnonzero(real > 0)
        n, depth, step = len(self.ids), 0, FIRST_DEPTH
        seen = np.zeros(n, bool)
        while depth < n:
            to = min(n, depth + step)
            met = seen.copy()
            met[self.order[rising, depth:to].ravel()] = True
            met[self.order[falling, n - to:n - depth].ravel()] = True
            if to == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            if exact:
                scores = (self.real[new] @ real).astype("int64")
                threshold = float(self.sorted[rising, to - 1] @ real[rising] + self.sorted[falling, n - to] @ real[falling])
            else:
                own = anchor.astype(object)
                scores = np.array([min(max(s, -_MOST), _MOST) for s in self.x[new].astype(object) @ own], "int64")
                last = [int(self.sorted[i, to - 1]) * own[i] for i in rising] + [int(self.sorted[i, n - to]) * own[i] for i in falling]
                threshold = min(max(sum(last), -_MOST), _MOST)
            found.offer(scores, self.ids[new], self.labels[new])
            if found.closed(threshold):
                return
            seen, depth, step = met, to, step * 2


class Windows:
    """The best k rows of each window of scores of one anchor, by falling score, then rising id."""

    def __init__(self, bounds: list[tuple[int, int]], k: int, own_id: int, label: int, same_label: bool):
        self.bounds, self.k, self.own_id, self.label, self.same_label = bounds, k, own_id, label, same_label
        self.best: list[list[tuple[int, int]]] = [[] for _ in bounds]  # (-score, id)
        self.floors = [low for low, _ in bounds]  # below these nothing can enter

    def offer(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = scores >= min(self.floors)
        fits &= (labels == self.label) & (ids != self.own_id) if self.same_label else labels != self.label
        if not fits.any():
            return
        scores, ids = scores[fits], ids[fits]
        for w, (_, high) in enumerate(self.bounds):
            inside = (scores >= self.floors[w]) & (scores <= high)
            if not inside.any():
                continue
            s, i = -scores[inside], ids[inside]
            order = np.lexsort((i, s))
            s, i = s[order], i[order]
            first = np.flatnonzero(np.r_[True, (np.diff(s) != 0) | (np.diff(i) != 0)])[:self.k]
            self.best[w] = sorted({*self.best[w], *zip(s[first].tolist(), i[first].tolist(), strict=True)})[:self.k]
            if len(self.best[w]) == self.k:
                self.floors[w] = -self.best[w][-1][0]

    def closed(self, threshold: float) -> bool:
        return all(threshold < floor for floor in self.floors)


def _tasks(rows: DataFrame, shared, scale: float, k: int, same_label: bool) -> DataFrame:
    """Each task's best rows of every window of the shared anchors: anchor_id, low, high, score, id."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        ids, labels, x = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            x += whole(batch.column(2), scale)
            while len(ids) >= BLOCK_ROWS:
                yield np.array(ids[:BLOCK_ROWS]), np.array(labels[:BLOCK_ROWS]), x[:BLOCK_ROWS]
                ids, labels, x = ids[BLOCK_ROWS:], labels[BLOCK_ROWS:], x[BLOCK_ROWS:]
        if ids:
            yield np.array(ids), np.array(labels), x

    def run(batches):
        found = [(np.frombuffer(vector, "<i8"), Windows(bounds, k, own, label, same_label))
                 for own, label, vector, bounds in shared.value]
        for ids, labels, vectors in blocks(batches):
            for d, (at, x) in by_length(vectors).items():
                lists = Lists(ids[at], labels[at], x, k)
                part = {label: lists.rows(lists.labels == label) for label in np.unique(lists.labels)} if same_label else {}
                for anchor, windows in found:
                    where = part.get(windows.label) if same_label else lists
                    if len(anchor) == d and where is not None:
                        where.search(anchor, windows)
        for windows in (w for _, w in found):
            flat = [(windows.own_id, *b, -s, i) for b, best in zip(windows.bounds, windows.best, strict=True) for s, i in best]
            if flat:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*flat)], ["anchor_id", "low", "high", "score", "id"])

    return rows.select("id", "label", "v").mapInArrow(run, "anchor_id long, low long, high long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window over all tasks, with their rank."""
    window = ["anchor_id", "low", "high"]
    order = Window.partitionBy(*window).orderBy(F.desc("score"), "id")
    return found.repartition(*window).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(rows: DataFrame, anchors: DataFrame, scratch: Scratch, scale: float, k: int, same_label: bool) -> DataFrame:
    """``_best`` over all anchors, a block of them at a time; ``anchors`` has id, label, x and bounds."""
    context, parts = rows.sparkSession.sparkContext, []
    blocks = -(-(anchors.agg(F.sum(F.size("x"))).first()[0] or 1) // ANCHOR_ENTRIES)
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow().to_pydict()
        listed = [(i, label, np.asarray(x, "<i8").tobytes(),
                   [(w["low"], w["high"]) for w in bounds])
                  for i, label, x, bounds in zip(own["id"], own["label"], own["x"], own["bounds"], strict=True)]
        shared = context.broadcast(listed)
        parts.append(scratch.keep(_tasks(rows, shared, scale, k, same_label)))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return scratch.keep(_best(out, k))


def mine(df: DataFrame, anchor: Column, row_id: str = "vec_id", label: str = "label", vector: str = "embedding",
         k: int = K, positives: int = POSITIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """For the rows where ``anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    scratch = Scratch()
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                     F.col(f"`{vector}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    numbers = F.transform("v", lambda c: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(c.cast("double") * scale).cast("double"))).cast("long"))
    try:
        chosen = scratch.keep(rows.where("anchor").select("id", "label", numbers.alias("x")).groupBy("id").agg(
            F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x"))
        every = F.array(F.struct(F.lit(-_MOST).alias("low"), F.lit(_MOST).alias("high")))
        first = _passes(rows, chosen.withColumn("bounds", every), scratch, scale, positives, True)
        pairs = first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        # low * p <= 100 * s <= high * p in whole numbers; decimals, as a score may fill a long
        p = F.col("positive_score").cast("decimal(30,0)")
        bound = lambda c: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c)).cast("long")
        pairs = pairs.withColumns({"low": bound(F.ceil(p * low / 100)), "high": bound(F.floor(p * high / 100))}).where("low <= high")
        windows = pairs.select("anchor_id", "low", "high").distinct().groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("low", "high")).alias("bounds"))
        second = _passes(rows, chosen.join(windows, "id"), scratch, scale, k, False)
        return keep(pairs.join(second, ["anchor_id", "low", "high"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    finally:
        scratch.clear()
