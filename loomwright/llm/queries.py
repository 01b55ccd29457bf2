"""The registered queries of this subpackage: each applies its operator to the whole table with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, forest, jaccard, mixing, neardup, records, repair, secret_scan, spelling, substrings, token_counts, toxicity, warc
from loomwright.llm.oracle import ORACLE  # noqa: F401

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, secret_scan.KINDS), F.sha2(secret_scan.written(F.col("base_spans")), 256).alias("base_sha256"),
                        secret_scan.written(F.col("all_spans")).alias("spans"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE).drop("text")
    both = bpe.decode(coded, BYTE_BPE)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(_table(spark, sf_dir, "documents"), WORD_BPE, END_ID)
    back = records.read(manifest)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = substrings.dedup(_table(spark, sf_dir, "documents"))
    return short.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return forest.nearest(table, table.filter("vec_id % 20 = 0"), 20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations")
    return repair.report(talks, repair.damage(talks))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mix, op3_jaccard, op4_substrings, op5_neighbours, op6_toxicity, op7_bpe, op8_warc, op9_neardup, op10_records,
                                    op11_token_counts, op12_spelling, op13_repair)}
