"""The pipeline's stages against what each operator says of the same rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from hrefloom.llm import minhash, pii, quality
from hrefloom.llm.common import Stages, table
from hrefloom.llm.queries import QUERIES

from .test_operators import plain_components


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    stages, docs = Stages(spark, "steps"), table(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stages.write(name, stage(spark, docs, sf_dir))
    return out


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_stages(spark, sf_dir, steps):
    columns = steps["documents"].columns
    assert all(steps[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])
    judged = quality.judge_documents(steps["documents"], table(spark, sf_dir, "labels"), Stages(spark, "t"), ["doc_id"])
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert {r.doc_id for r in steps["quality_rules"].select("doc_id").collect()} == kept and 0 < len(kept)
    before = sorted((r.doc_id, r.text) for r in steps["quality_rules"].collect())
    root, _ = plain_components([t for _, t in before], corpus_pipeline.SHINGLE)
    assert {r.doc_id for r in steps["near_dedup"].collect()} == {before[r][0] for r in set(root)}
    masked = {r.doc_id: r.text for r in steps["personal_data"].collect()}
    assert all(not [s for s in pii.base_spans(t) if s[1] in (0, 3)] for t in masked.values())
    mixed = steps["mix"].groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("text")).collect()
    assert all(1 <= r.n <= 3 and masked[r.doc_id] == r.text for r in mixed)
    assert steps["encode"].count() == steps["mix"].count()
    texts = {r.doc_id: r.text for r in mixed}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in steps["encode"].collect())


def test_odd_rows_go_through(spark, sf_dir, docs, no_docs):
    for rows in (docs, no_docs):
        stages, now = Stages(spark, "odd"), rows
        for name, stage in corpus_pipeline.STAGES:
            now = stages.write(name, stage(spark, now, sf_dir))
        assert now.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]


def test_near_dedup_keeps_one_of_repeated_rows(spark, sf_dir, docs):
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15] and kept.count(None) == 2


def test_minhash_of_a_table_of_copies(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    found = minhash.near_duplicates(docs, Stages(spark, "copies")).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1
