"""Language identification by word-first backoff.

A known word is scored by its log frequency in every language. An unseen word falls back to its
character n-grams, longest first: the first length at which any n-gram is known decides, and below
one character nothing is added. Model size is bounded by ``sample_docs``, the number of labelled
documents (all languages together, evenly split, chosen by hash) that it is fitted on.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text
when nothing could be learned. Equal scores go to the alphabetically first language. Repeated rows
get equal results. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.common import chosen, with_columns

UNDETERMINED = "und"
SAMPLE_DOCS = 8_000
MIN_COUNT = 2
LONGEST = 5
SMOOTHING = 0.1
CACHED = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f"\x02{word}\x03"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class LanguageModel:
    """Log frequencies of words, and of n-grams of each length, for every language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        words = defaultdict(lambda: np.zeros(len(at)))
        grams = [defaultdict(lambda: np.zeros(len(at))) for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            words[word][at[lang]] += n
            for size in range(1, LONGEST + 1):
                for gram in grams_of(word, size):
                    grams[size][gram][at[lang]] += n
        self.words, self.word_logs = self._logs(words)
        self.grams = [self._logs(g) for g in grams]

    def _logs(self, counts: dict) -> tuple[dict[str, int], np.ndarray]:
        table = np.array(list(counts.values())).reshape(len(counts), len(self.languages))
        total = table.sum(axis=0) + SMOOTHING * max(1, len(counts))
        return {k: i for i, k in enumerate(counts)}, np.log((table + SMOOTHING) / total).astype("float32")

    def backed_off(self, word: str) -> np.ndarray:
        for size in range(LONGEST, 0, -1):
            index, logs = self.grams[size]
            known = [index[g] for g in grams_of(word, size) if g in index]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.languages), "float32")

    def identify(self, text: str | None, cache: dict) -> tuple[str, float]:
        found = words_of(text or "")
        if not self.languages or not any(c.isalpha() for w in found for c in w):
            return UNDETERMINED, 0.0
        known, counts, total = [], [], np.zeros(len(self.languages))
        for word, n in found.items():
            row = self.words.get(word)
            if row is not None:
                known.append(row)
                counts.append(n)
                continue
            vector = cache.get(word)
            if vector is None:
                if len(cache) >= CACHED:
                    cache.clear()
                vector = cache[word] = self.backed_off(word)
            total += n * vector
        if known:
            total += np.asarray(counts, "float64") @ self.word_logs[known]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on at most about ``sample_docs`` of the rows that have a text and a language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = {r["lang"]: r["count"] for r in labelled.groupBy(F.col(lang).alias("lang")).count().collect()}
    if not rows:
        return LanguageModel([])
    each = sample_docs / len(rows)
    share = F.create_map(*[F.lit(v) for k, n in rows.items() for v in (k, min(1.0, each / n))])
    sample = labelled.where(chosen(labelled, share[F.col(lang)])).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            found = defaultdict(Counter)
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[one].update(words_of(body))
            flat = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*flat) if flat else ([], [], []),
                                                      (pa.string(), pa.string(), pa.int64()), strict=True)],
                ["lang", "word", "n"])

    counts = (sample.mapInArrow(count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))
    return LanguageModel(sorted((r["lang"], r["word"], r["n"]) for r in counts.collect()))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        model, cache = shared.value, {}

        def of(column):
            found = [model.identify(t, cache) for t in column.to_pylist()]
            return [[f[0] for f in found], [f[1] for f in found]]
        return of

    return with_columns(docs, text, [("lang_pred", "string"), ("score", "double")], compute)
