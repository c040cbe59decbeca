"""Quality rules: counts per document, and the divergence of its histograms from language references.

References cover all documents of a language: a histogram of character classes, and one of the
common words, which are those that make up at least ``COMMON`` of the language's words. These are found
exactly in two passes with bounded memory: words are first counted in ``BUCKETS`` hash buckets; a
common word can only lie in a bucket that holds that share, so the second pass counts the words of
those few buckets. A document is dropped when the Jensen-Shannon distance (base 2, 0 to 1) of either
histogram exceeds its threshold. Below ``STEADY_WORDS`` words sampling noise widens the distance of words, whose
threshold rises with it; documents below ``MIN_WORDS`` words fail the base rule and are not compared.

A document is compared with the other documents of its language: its own counts are taken out of the reference.
A reference holds if at least ``LEAST_REFERENCE`` words remain in it. A document of a language without one is compared
with the nearest reference, by its classes alone, as its words are none of that language's.

Defined cases: null and empty texts have no words and fail the base rule. A document whose language is null is
compared with the nearest reference by both histograms; without references none is. References must cover the
documents that are judged; a document they do not hold is taken out as far as they go. Columns named like an
output are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episode_mart.llm.common import map_batches, texts

COMMON = 0.002
BUCKETS = 1 << 14
MIN_WORDS = 50
STEADY_WORDS = 100
# Between the largest distance of good labelled documents of 100 words or more (0.23, 0.34; 0.29 of classes from 50
# words on) and that of most poor ones.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.36
# The squared distance grows by so much a 1/word: the least whole number that keeps all but one of 312 good labelled
# documents of 50 to 99 words of sf0.1.
NOISE = 5
LEAST_REFERENCE = 1_000
HELD = 200_000

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
LOWER, UPPER, DIGIT, SPACE, SYMBOL, POINT, WIDE, REST = range(8)
_CLASS = np.full(256, POINT, np.uint8)
for _kind, _bytes in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, _SPACES),
                      (SYMBOL, _SYMBOLS), (WIDE, range(192, 256)), (REST, range(128, 192))):
    _CLASS[list(_bytes)] = _kind


def classes_of(body: bytes) -> np.ndarray:
    """Code points of each class; the last entry counts the further bytes of code points."""
    return np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=8)


def plain(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()").lower()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words])
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 2_000_000:  # the code of a window would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:n] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    found = counts[inverse] > 1
    if not found.any():
        return 0
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + n] |= found
    return int(covered.sum())


def repeated_lines(body: bytes) -> int:
    lines = [line for line in body.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of any total; 0 if one is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang",
               common: float = COMMON) -> dict[str, tuple[np.ndarray, dict[bytes, int], int]]:
    """By language: class histogram, counts of common words, count of all words."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def bucketed(batches):
        buckets, classes, held = defaultdict(lambda: np.zeros(BUCKETS, np.int64)), defaultdict(lambda: 0), {}

        def flush():
            for one, counts in held.items():
                into = buckets[one]
                for word, n in counts.items():
                    into[zlib.crc32(word) % BUCKETS] += n
            held.clear()

        for batch in batches:
            for one, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                counts = held.setdefault(one, Counter())
                counts.update(map(plain, body.split()))
                classes[one] = classes[one] + classes_of(body)
                if len(counts) > HELD:
                    flush()
        flush()
        for one, counts in buckets.items():
            at = counts.nonzero()[0]
            n = [*counts[at], *classes[one]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * len(n)), pa.array([*at, *range(-8, 0)], pa.int64()), pa.array(n, pa.int64())],
                ["lang", "bucket", "n"])

    sums = rows.mapInArrow(bucketed, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    words = F.col("bucket") >= 0
    totals = F.sum(F.when(words, F.col("n"))).over(_by_language())
    heavy = sums.withColumn("total", totals).where(~words | (F.col("n") >= common * F.col("total"))).collect()
    classes, total, wanted = defaultdict(lambda: np.zeros(8)), {}, defaultdict(set)
    for r in heavy:
        total[r["lang"]] = r["total"]
        if r["bucket"] < 0:
            classes[r["lang"]][r["bucket"]] = r["n"]
        else:
            wanted[r["lang"]].add(r["bucket"])
    wanted = dict(wanted)

    def counted(batches):
        held, n_held = {}, 0
        for batch in batches:
            for one, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                into = held.setdefault(one, Counter())
                at = wanted.get(one, ())
                for word, n in Counter(map(plain, body.split())).items():
                    if zlib.crc32(word) % BUCKETS in at:
                        into[word] += n
            n_held = sum(map(len, held.values()))
            if n_held > HELD:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    def rows_of(held):
        for one, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    found = defaultdict(dict)
    least = F.create_map(*[F.lit(v) for k, n in total.items() for v in (k, common * (n or 0))]) if total else None
    if least is not None:
        exact = rows.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(
            F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")])
        for r in exact.collect():
            found[r["lang"]][bytes(r["word"])] = r["n"]
    return {k: (classes[k], dict(sorted(found[k].items())), total[k] or 0) for k in sorted(total)}


def _by_language():
    from pyspark.sql import Window
    return Window.partitionBy("lang")


def word_threshold(n: int, at_most: float = MAX_WORD_DISTANCE) -> float:
    """The word threshold for a document of ``n`` words."""
    return (at_most ** 2 + NOISE * max(0.0, 1 / max(n, 1) - 1 / STEADY_WORDS)) ** 0.5


class Rules:
    """References as arrays, and the verdict on one document."""

    def __init__(self, found: dict):
        self.of = {}
        for one, (classes, common, total) in found.items():
            counts = np.array([*common.values(), total - sum(common.values())], float)
            self.of[one] = (classes[:REST], {w: i for i, w in enumerate(common)}, counts)

    def distances(self, lang: str | None, classes: np.ndarray, words: dict[bytes, int],
                  n: int) -> tuple[float | None, float | None]:
        """Distance of classes and of words; null where there is nothing to compare with."""
        own = self.of.get(lang)
        if own is not None and own[2].sum() - n >= LEAST_REFERENCE:
            return self._distances(own, classes, words, n, 1)
        # of a language without a reference (or of none): the nearest of all references
        others = [r for k, r in self.of.items() if k != lang and r[2].sum() >= LEAST_REFERENCE]
        found = [self._distances(r, classes, words, n, 0) for r in others]
        if lang is None:
            return min(found, key=sum, default=(None, None))
        return min((f[0] for f in found), default=None), None

    @staticmethod
    def _distances(ref, classes, words, n, own: int) -> tuple[float, float]:
        """Distances from a reference, without the document's own counts if it is one of it."""
        ref_classes, index, ref_words = ref
        counts = np.zeros(len(ref_words))
        for word, at in index.items():
            counts[at] = words.get(word, 0)
        counts[-1] = n - counts.sum()
        classes = classes[:REST]
        return (distance(classes, np.maximum(ref_classes - own * classes, 0)),
                distance(counts, np.maximum(ref_words - own * counts, 0)))


def judge(docs: DataFrame, found: dict, text: str = "text", lang: str = "lang",
          max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
          min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the counts, both distances (null when too short or without a reference), base_failed and kept."""
    fields = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
              ("n_repeat_words", "long"), ("class_distance", "double"), ("word_distance", "double"),
              ("base_failed", "boolean"), ("kept", "boolean")]
    names = {n for n, _ in fields}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    at_text, at_lang = kept.columns.index(text), kept.columns.index(lang)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [arrow[t] for _, t in fields]

    def one(rules: Rules, lang: str | None, body: bytes):
        words = body.split()
        n, classes = len(words), classes_of(body)
        chars = int(classes[:REST].sum() - classes[SPACE])
        repeats = repeated_words(words)
        failed = n < 50 or 100 * repeats > 50 * n
        by_class = by_word = None
        if n >= min_words:
            by_class, by_word = rules.distances(lang, classes, Counter(map(plain, words)), n)
        far = ((by_class is not None and by_class > max_class_distance)
               or (by_word is not None and by_word > word_threshold(n, max_word_distance)))
        return (n, chars, int(classes[SYMBOL]), repeated_lines(body), repeats, by_class, by_word, failed,
                not failed and not far)

    def run(batches):
        rules = Rules(shared.value)
        for batch in batches:
            rows = [one(rules, k, b) for k, b in
                    zip(batch.column(at_lang).to_pylist(), texts(batch.column(at_text)), strict=True)]
            values = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(list(v), t) for v, t in zip(values, types, strict=True)]], schema.names)

    return map_batches(kept, run, schema)
