"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits in lower case; in scripts without spaces every letter is a word. A mask
selects 6 of 8 neighbouring words; the hash of the selected words is a seed, so words at the ignored
positions may differ. Seeds of all windows of the documents meet those of the benchmark, and around every
hit the two texts are laid side by side: of the up to 18 benchmark words from 5 before to 5 behind the
window, at least 13 (or four fifths of a shorter item) must agree. The masks' ignored positions lie 1 to 5
apart but for 2, so that words replaced at any fixed step from 4 on leave a hit.

An item of fewer than 8 words has one seed of all its words and must occur whole. Below ``LEAST_CHARS``
letters and digits such an item ("yes", "option b") is no evidence and is not sought.

The documents' side is never shuffled: windows are generated, hashed and looked up in one generated
stage. The benchmark's seeds are broadcast in blocks of at most ``BLOCK`` rows of bounded width, one pass
over the documents for each block.

Defined cases: null and empty texts have no windows. Repeated benchmark rows count once. Rows with equal
keys are reported together; a null key is reported as null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("11101101", "11011011", "10110111", "11011101", "11100111", "10111101")
SPAN = 8
AROUND = 5
AGREE = 13
SHARE = 0.8
LEAST_CHARS = 12
BLOCK = 100_000

_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[\p{{L}}\p{{N}}&&[{_SINGLE}]]|[\p{{L}}\p{{N}}&&[^{_SINGLE}]]+"


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0))


def _whole(size: Column | int) -> Column:
    """Hash of the ``size`` words that begin at ``at``, as the seed of an item of that many words."""
    return F.xxhash64(F.lit("whole"), F.slice("hashes", F.col("at") + 1, size))


def _seeds(whole: tuple[int, ...] = ()) -> Column:
    """One hash per mask of the window that begins at ``at``, from the words' hashes, and those of ``whole`` words.

    Null where the words end before the window.
    """
    masked = [F.xxhash64(F.lit(n), *[F.get("hashes", F.col("at") + i) for i, m in enumerate(mask) if m == "1"])
              for n, mask in enumerate(MASKS)]
    if not whole:
        return F.array(*masked)
    behind = F.size("hashes") - F.col("at")
    return F.array(*[F.when(behind >= SPAN, seed) for seed in masked],
                   *[F.when(behind >= size, _whole(size)) for size in whole])


def _windows(df: DataFrame, *keep: str, least: int = SPAN) -> DataFrame:
    """(keep, words, hashes, at) for every window of ``least`` words of a table with a ``words`` array."""
    # not a filter, which would split the text a second time
    starts = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - least)).otherwise(
        F.array().cast("array<int>"))
    hashed = df.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*keep, "words", "hashes", F.explode(starts).alias("at"))


def benchmark_seeds(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(seed, item_id, item_at, before, around, needed) of every window and mask of every item, or of a short item."""
    items = benchmark.select(F.col(item).alias("item_id"), words_of(text).alias("words")).distinct()
    first = F.greatest(F.col("at") - AROUND, F.lit(0))
    short = (items.where((F.size("words") < SPAN) & (F.length(F.array_join("words", "")) >= LEAST_CHARS))
             .select("item_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.lit(0).alias("at"))
             .select("item_id", _whole(F.size("words")).alias("seed"), F.lit(0).alias("item_at"), F.lit(0).alias("before"),
                     F.col("words").alias("around"), F.size("words").alias("needed")))
    return (_windows(items, "item_id")
            .select("item_id", F.explode(_seeds()).alias("seed"),
                    F.col("at").alias("item_at"), (F.col("at") - first).alias("before"),
                    F.slice("words", first + 1, F.col("at") + SPAN + AROUND - first).alias("around"),
                    F.least(F.lit(AGREE), F.ceil(SHARE * F.size("words")).cast("int")).alias("needed"))
            .unionByName(short).distinct())


def find(docs: DataFrame, benchmark: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text",
         item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per key and benchmark item that overlap: n_hits, n_agree (best), first_word, first_item_word."""
    seeds = benchmark_seeds(benchmark, item, item_text)
    by_size = {r["size"]: r["count"] for r in seeds.groupBy(F.least(F.size("around"), F.lit(SPAN)).alias("size")).count().collect()}
    blocks = max(1, math.ceil(sum(by_size.values()) / block))
    whole = tuple(sorted(size for size in by_size if size < SPAN))  # at most seven lengths
    windows = (_windows(docs.select(*key, words_of(text).alias("words")), *key, least=min((*whole, SPAN)))
               .select(*key, "words", "at", F.explode(_seeds(whole)).alias("seed")))
    begin = F.col("at") - F.col("before")
    own = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.size("around") + F.least(begin, F.lit(0)))
    side = F.struct(own.alias("own"), F.greatest(-begin, F.lit(0)).alias("shift"), "around", "needed")
    agree = F.size(F.filter(F.sequence(F.lit(0), F.size("side.around") - 1), lambda i: F.get(
        "side.own", i - F.col("side.shift")) == F.get("side.around", i)))
    passes = []
    for n in range(blocks):
        part = seeds.where(F.pmod(F.col("seed"), F.lit(blocks)) == n)
        # hits leave the generated stage as small rows; the generator keeps their check out of that stage
        hits = windows.join(F.broadcast(part), "seed").select(
            *key, "item_id", "at", "item_at", F.explode(F.array(side)).alias("side"))
        passes.append(hits.withColumn("agree", agree).where("agree >= side.needed").drop("side"))
    hits = reduce(DataFrame.unionAll, passes)
    return hits.groupBy(*key, "item_id").agg(
        F.count("*").alias("n_hits"), F.max("agree").cast("long").alias("n_agree"),
        F.min("at").cast("long").alias("first_word"), F.min("item_at").cast("long").alias("first_item_word"))
