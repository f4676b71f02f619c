"""The registered query of each corpus operator: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.llm import adsearch, alignment, bpe, classifier, conversations, langid, licenses, logbilinear, minhash, mixing, pii, quality, warc
from hrefloom.llm.common import Stages, table

Query = Callable[[SparkSession, str], DataFrame]


def _warc(spark, sf_dir):
    stages = Stages(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), f"{stages.root}/archives")
    read = warc.read_records(warc.read_chunks(spark, f"{stages.root}/archives"))
    return read.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"), "error",
    )


def _quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge_documents(docs, labels, Stages(spark, "quality"), ["doc_id"])


def _pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), Stages(spark, "pii"))
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = {pii.KINDS.index(kind)})) AS bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.span_list("base"), 256).alias("base_sha256"),
        pii.span_list("spans").alias("spans"),
    )


def _licenses(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), "score",
    )


def _near_duplicates(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), Stages(spark, "minhash"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.train(docs, labels.where(_remainder(4) != 2))
    return classifier.score(docs, model).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def _search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return adsearch.search(vectors, vectors.where("vec_id % 20 = 0"), Stages(spark, "adsearch"))


def _language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    scored, stats = logbilinear.score_documents(docs, ~held_out, Stages(spark, "logbilinear"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(stats.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


def _bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(bpe.id_list("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), Stages(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    samples = langid.learn(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _alignment(spark, sf_dir):
    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), a, b, Stages(spark, "alignment"))


def _conversations(spark, sf_dir):
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(damaged, Stages(spark, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_warc_chunks": _warc,
    "op2_ngram_ratio": _quality,
    "op3_pii_contexts": _pii,
    "op4_license_spans": _licenses,
    "op5_bbit_minhash": _near_duplicates,
    "op6_byte_cnn": _classifier,
    "op7_dimension_scan": _search,
    "op8_log_bilinear": _language_model,
    "op9_byte_bpe": _bpe,
    "op10_pivotal_mix": _mixing,
    "op11_cross_parse": _languages,
    "op12_token_alignment": _alignment,
    "op13_conversation_repair": _conversations,
}
ORACLE: dict[str, str] = {}
