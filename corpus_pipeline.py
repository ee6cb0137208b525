"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and rereads it as the next one's docs.  All
but the last return the columns of documents; the last returns doc_id, lang,
source, n_tokens, ids and decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm import bpe, decontaminate, language, line_dedup, simhash
from wearcast.llm.common import materialise
from wearcast.session import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted (operator 6); the rest go."""
    return language.identify(docs).where("accepted").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines (operator 1), n_chars set anew.  Documents
    that lose every line go: each line stands in an earlier document."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (operator 8)."""
    return simhash.near_dedup(docs, shingle=4, max_distance=4)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 10)."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (operator 3) and a digest of their decoding."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(tokens.withColumn("kept_ids", F.col("ids")), ranks)
    return decoded.select("doc_id", "lang", "source", F.size("kept_ids").cast("long").alias("n_tokens"), F.col("kept_ids").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate_stage),
    ("byte_bpe", tokenize),
]

#: SQL expresses neither the language model, the components nor the encoder;
#: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
