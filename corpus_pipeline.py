"""A corpus pipeline over documents: toxic documents go, one of each near-duplicate group stays, secrets are masked,
sources are mixed to their targets, texts become token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return
the columns of documents, and no others. Rows with NULL text stay until the last stage, where they have no ids. Repeated
rows count each, but for the second stage, which keeps one; ties there go to the smallest id. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, jaccard, mixing, secret_scan, toxicity
from loomwright.plans.store import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; rows without an id stay as they are.

    Of rows that share id and text the one with the least other columns stays; other texts under that id stay as well.
    """
    groups = jaccard.join(docs)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(first, "doc_id", "left_semi")
    kept = rows.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return kept.unionByName(docs.select(*COLUMNS).filter("doc_id is null")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the scan is replaced by a mark; n_chars follows the text."""
    masked = secret_scan.redact(secret_scan.scan(docs.select(*COLUMNS)))
    changed = F.size("all_spans") > 0
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emit(mixing.plan(docs.select(*COLUMNS))).select(*COLUMNS)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic), ("jaccard_join", one_of_each), ("secret_scan", mask_secrets), ("mixing", mix_sources), ("bpe", to_ids),
]
#: SQL can't say the classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
