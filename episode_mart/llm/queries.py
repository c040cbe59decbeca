"""One query per operator over its whole table, with production parameters, and SQL where it can be said."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from episode_mart.llm import (
    bpe, chats, contamination, language, licenses, neardup, negatives, privacy, quality, secrets, urls, webpages, whitening)
from episode_mart.llm.common import held_out, table
from episode_mart.llm.oracles import ORACLES as SQL
from episode_mart.llm.spans import let, running


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out() & docs["doc_id"].isNotNull()))
    found = language.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return webpages.extract(pages, webpages.learn(pages)).drop("html")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs)).drop("text")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path or public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(privacy.scan(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7, 0, 'user', '{says}'), (-7, 1, 'assistant', '{says}') as v(conv_id, turn, role, text)")
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    events = rows.unionAll(extra).select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    done = chats.render(events)
    # under the mask: the entries of ``loss`` at odd places, each behind all entries before it
    learned = let(running(F.transform("loss", lambda n: n.cast("long"))), lambda at: F.array_join(F.transform(
        F.filter(F.transform("loss", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: x["i"] % 2 == 1),
        lambda x: F.substring(F.col("formatted"), (F.get(at, x["i"]) + 1).cast("int"), x["n"])), ""))
    turns = F.array_join(F.transform("messages", lambda m: F.concat(
        m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return (done.select("conv_id", chats.read_back(F.col("formatted")).alias("messages"),
                        chats.unescape(learned).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    "formatted_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, quality.references(docs)).drop("text", "lang")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whitening.whiten(vectors, whitening.fit(vectors))
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


# Host, path and verdict of the rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_page_text": op3_page_text,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_personal_data": op8_personal_data,
    "op9_chat_format": op9_chat_format,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
ORACLES = {**SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
