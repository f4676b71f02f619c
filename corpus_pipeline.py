"""From raw documents to token ids: five stages, each a function of the one before.

Quality rules drop documents, near-dedup keeps one of each group, personal data
is masked, sources are mixed to their weights (documents repeat or go), and what
is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.llm import bpe, minhash, mixing, pii, quality
from hrefloom.llm.common import Stages, table, text_of

SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    judged = quality.judge_documents(rows, labels, Stages(spark, "pipeline-quality"), ["_row"])
    return judged.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; of repeated rows one stays."""
    found = minhash.near_duplicates(docs, Stages(spark, "pipeline-dedup"), size=SHINGLE)
    kept = found.where("kept").select(F.xxhash64("doc_id", "row_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64(text_of())).withColumn("_key", F.xxhash64("doc_id", "_text_key"))
    # repeated rows meet where the join has put them, without another shuffle
    stays = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key", "doc_id", "_text_key"])
    return stays.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by its kind."""
    return pii.redact(docs, Stages(spark, "pipeline-pii"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken n times is there n times."""
    return mixing.mix_documents(docs, Stages(spark, "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256`` of every document of the mix."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]

# no SQL: hashed ratios, minima and dependent rounding are not to be had in it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stages.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
