"""Quality rules: counts per text, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words fall into ``BUCKETS`` hash buckets.  One
pass over all documents counts each bucket in the raw corpus and in the trusted
target, without moving a text; a document's score is the mean over its words and pairs of

    log p_target(bucket) - log p_raw(bucket)

and every document is kept or rejected by a fixed threshold.  All of it is SQL:
the corpus pass ends in one row per bucket and task, and the ratios (one number
per bucket, however large the corpus) enter the plan of the scoring as a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.text import let, lift
from hrefloom.llm.common import Stages, sieved, text_of, words_of

BUCKETS = 1 << 14
# hits of each bucket that both multinomials begin with, at the target's size
PRIOR = 4.0
# mean log ratio below which a text is rejected
THRESHOLD = -0.05
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` -> the ids of all rows of quality 1, once each."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def _shrunk(ratio: str, error: str) -> str:
    """SQL: a ratio brought nearer to 0 by its standard error, as far as 0."""
    return f"sign({ratio}) * greatest(0D, abs({ratio}) - {error})"


def _hits(texts: DataFrame, buckets: int) -> DataFrame:
    """``text, _in`` -> ``b, raw, target``: hits of each bucket by words and pairs, and those of rows that are ``_in``."""
    worded = texts.select("_in", words_of(text_of()).alias("w"))
    pairs = worded.select("_in", F.explode(F.expr("arrays_zip(w, slice(w, 2, greatest(size(w) - 1, 0)))")).alias("z")).toDF("_in", "z")
    x, y = F.col("z").getField("w"), F.col("z").getField("1")
    one = F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")
    two = F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
    hits = pairs.select("_in", F.explode(F.array(one, two)).alias("b")).where("b IS NOT NULL")
    return hits.groupBy("b").agg(F.count("*").alias("raw"), F.count("_in").alias("target"))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, stages: Stages, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, text`` -> one row ``ratios``: an array of a log ratio per bucket.

    ``trusted`` has each id once and grows with the labels.  One pass over the
    texts, which stay where they are, counts the raw corpus and the rows whose
    id a sieve of fixed size lets through: all trusted ones and a few others.
    Those others are found by their ids alone, and their words are taken off
    again, so the target is exact at any size and only their texts are joined.
    Each bucket of the target gets ``PRIOR`` hits more, and the raw corpus the
    same share of its own total, so the ratio of a bucket that few words fall
    into stays near 0 rather than blaming it for what a small target can't show.
    With no trusted words all ratios are 0.
    """
    docs = docs.select("doc_id", "text")
    through = sieved(docs.select("doc_id"), "doc_id", trusted, "doc_id").where("_in = 1").select("doc_id")
    others = stages.write("others", through.join(trusted, "doc_id", "left_anti").distinct())
    wrong = sieved(docs, "doc_id", others, "doc_id").where("_in = 1").join(others, "doc_id", "left_semi")
    taken = _hits(wrong, buckets).select("b", F.lit(0).cast("bigint").alias("raw"), (-F.col("raw")).alias("target"))
    counts = _hits(sieved(docs, "doc_id", trusted, "doc_id"), buckets).unionByName(taken).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # every bucket has a row, in order; the number of buckets is fixed
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").na.fill(0, ["raw", "target"])
    return full.agg(
        F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"),
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"),
    ).select(
        F.expr(
            f"transform(transform(c, x -> struct(x.target AS t, x.raw * coalesce(try_divide(n_target, n_raw), 0D) AS e)), x -> if(n_target = 0, 0D,"
            f" {_shrunk('ln((x.t + {0}) / (x.e + {0}))'.format(PRIOR), f'sqrt(x.e) / (x.e + {PRIOR})')}))"
        ).alias("ratios")
    )


def _repeated_words(w: str) -> str:
    """SQL: words that lie in three-word windows found twice or more."""
    windows = (
        f"sort_array(transform(slice({w}, 1, greatest(size({w}) - 2, 0)),"
        f" (x, i) -> struct(xxhash64(x, {w}[i + 1], {w}[i + 2]) AS h, i AS i)))"
    )
    starts = let(
        windows, "s",
        "sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h), x -> x.i))",
    )
    return (
        f"aggregate({starts}, named_struct('last', -3, 'n', 0),"
        " (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    )


def _score(w: str, r: str, buckets: int) -> str:
    """SQL: the mean ratio of a text's words and pairs."""
    per_word = (
        f"transform({w}, (x, i) -> {r}[cast(pmod(xxhash64(x), {buckets}) AS int)] + if(i + 1 < size({w}),"
        f" {r}[cast(pmod(xxhash64(x, {w}[i + 1]), {buckets}) AS int)], 0D))"
    )
    total = f"aggregate({per_word}, 0D, (a, v) -> a + v)"
    return f"if(size({w}) = 0, 0D, {total} / (2 * size({w}) - 1))"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _constant(ratios: list[float]) -> Column:
    """Numbers as one constant array; Spark folds the expression when it plans."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def quality_columns(docs: DataFrame, ratios: list[float], keep: list[str], threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Columns ``keep`` and the counts, ``score``, ``base_failed`` and ``kept`` of each row.

    Rows are judged on their own: no shuffle, repeated rows and null ids are
    rows like others.  A null or empty text has no words, score 0, and fails.
    """
    # explodes of one element: a filter on what follows must not be pushed below them and repeat the work
    words = docs.select(*keep, F.inline(F.array(F.struct(text_of().alias("_t"), words_of(text_of()).alias("_w")))))
    lines = F.expr("filter(split(_t, '\\n', -1), x -> x rlike '[^\\\\t-\\\\r ]')")
    spaces = " \t\n\x0b\x0c\r"
    counts = (
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", spaces, "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        lift(lines, lambda x: f"size({x}) - size(array_distinct({x}))").cast("bigint").alias("n_dup_lines"),
        F.expr(_repeated_words("_w")).cast("bigint").alias("n_repeat_words"),
        lift(_constant(ratios), lambda r: _score("_w", r, buckets)).alias("score"),
    )
    counted = words.select(*keep, F.inline(F.array(F.struct(*counts))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def judge_documents(docs: DataFrame, labels: DataFrame, stages: Stages, keep: list[str]) -> DataFrame:
    """``quality_columns`` of all ``docs`` by the ratios of all ``docs`` against trusted ``labels``."""
    trusted = stages.write("trusted", trusted_ids(labels))
    ratios = bucket_ratios(docs, trusted, stages).first()["ratios"]
    return quality_columns(docs, ratios, keep)
