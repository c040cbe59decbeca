"""A training corpus from documents: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``; all but the last return the columns of documents. Columns beyond those pass
through the stages that keep rows. An empty table gives an empty table of the same columns.

1. language: documents without a letter, or whose language is decided with a score below
   ``LEAST_SCORE``, go; the model is learned from the labelled documents of the stage's own input.
2. near duplicates: of the documents that link by shingles of five words at a similarity of 0.8, one stays:
   the one with the smallest id (and text hash, for equal ids); repeated rows leave one row.
3. decontamination: documents that overlap a benchmark item go.
4. secrets: secrets are replaced in the texts; n_chars follows. All documents stay.
5. tokens: the texts as token ids of the vocabulary file ``VOCABULARY``, the texts that these decode to, and their count.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episode_mart.llm import bpe, contamination, language, neardup, secrets
from episode_mart.llm.common import keep, table

LEAST_SCORE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
REMEMBERED = 50_000  # words; the workers of the last stage share an executor with a heap that has grown by then


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs)
    found = language.identify(docs.select(F.struct("*").alias("row"), F.col("text").alias("_text")), model, "_text")
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct("*").alias("doc"), row.alias("_row"))
    bad = contamination.find(docs.select(row.alias("_row"), "text"), table(spark, sf_dir, "benchmark"), key=("_row",))
    bad = keep(bad.select("_row").distinct())
    doubtful = neardup.within(rows, bad, "_row").join(bad, "_row", "left_anti")
    return neardup.beyond(rows, bad, "_row").select("doc.*").unionAll(doubtful.select("doc.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, VOCABULARY, remembered=REMEMBERED).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokenize),
]
# No SQL states the language model, the components or the tokens; tests hold a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
