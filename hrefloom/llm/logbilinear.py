"""Language-model scores by a log-bilinear network in numpy.

Two words of context, each with its own vector and its own matrix, predict the
vector of the next; the score of a word is the product with its vector, plus a
bias.  The network knows ``VOCABULARY`` words, the end of a text and one class
for all other words, which share that class's probability by their counts.

Training is noise-contrastive: true words against ``NOISE`` words drawn from
the counts, so no step sums over the vocabulary.  A start is fitted on a bounded
sample; from there every task trains over all its texts, and the parameters
meet in a reduction tree, weighted by words.

Scores are normalised: as a logit is a sum of one term per context word, the
sums over the vocabulary of all pairs of context words are one matrix product.

Counts are made over all training texts.  The most frequent ``HEAD`` words are
looked up where a text stands; the others of a text are joined to the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages, by_hash, text_of, words_of

VOCABULARY = 2048
HEAD = 1 << 17
WIDTH = 16
NOISE = 64
BATCH = 4096
RATE = 0.01
# texts of smallest hash that the start is fitted on
START_TEXTS = 2000
# results that meet in one task of the reduction tree
FAN_IN = 32
# texts that go to Python at a time: both sides hold them, besides what is made of them
TEXTS = 1000
END, OTHER = 0, 1

_LOG10 = np.log(10.0)


@dataclass
class Statistics:
    """Words by falling count, the most frequent ones only, and totals of all."""

    words: list[bytes]
    counts: np.ndarray
    texts: int
    tokens: int
    types: int

    def unigram(self) -> np.ndarray:
        """Shares of end, other and the vocabulary."""
        known = self.counts[: VOCABULARY - 2]
        share = np.ones(VOCABULARY)
        share[END] += self.texts
        share[OTHER] += self.tokens - self.texts - known.sum()
        share[2 : 2 + len(known)] += known
        return share / share.sum()

    def other(self) -> tuple[int, int]:
        """Tokens and types of the words outside the vocabulary."""
        known = self.counts[: VOCABULARY - 2]
        return int(self.tokens - self.texts - known.sum()), max(0, int(self.types - 1 - len(known)))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame) -> DataFrame:
    """``text`` -> ``word, c``: counts over all texts."""
    words = docs.select(F.explode(words_of(_lowered(text_of()))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("c"))


def statistics(docs: DataFrame, counts: DataFrame, head: int = HEAD) -> Statistics:
    """Totals of all counts; of the words only the ``head`` most frequent ones go to the driver."""
    # by powers of two: a count that enough words reach, but not many times more
    powers = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()
    reached, least = 0, 0
    for power, n in sorted(powers, reverse=True):
        reached, least = reached + n, 1 << power
        if reached >= head:
            break
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(head).collect()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = docs.count()
    return Statistics(
        [r["word"].encode() for r in top], np.array([r["c"] for r in top], dtype=np.int64), texts, total[0] + texts,
        total[1] + (1 if texts else 0),
    )


def start_parameters(unigram: np.ndarray, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    return {
        "R": rng.normal(0, 0.1, (VOCABULARY, WIDTH)).astype(np.float32),
        "Q": rng.normal(0, 0.1, (VOCABULARY, WIDTH)).astype(np.float32),
        "C1": np.eye(WIDTH, dtype=np.float32), "C2": np.eye(WIDTH, dtype=np.float32),
        "b": np.log(unigram).astype(np.float32),
    }


def _summed(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums of rows that share an index."""
    return np.stack([np.bincount(by, rows[:, k], VOCABULARY) for k in range(WIDTH)], axis=1)


class Trainer:
    """Noise-contrastive steps by Adam."""

    def __init__(self, parameters: dict, unigram: np.ndarray, seed: int = 3):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.rng = np.random.default_rng(seed)
        self.cumulated = np.cumsum(unigram)
        self.log_noise = np.log(unigram * NOISE).astype(np.float32)
        self.steps = self.seen = 0

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        """Context two back, context one back, and the word that follows."""
        p, n = self.p, len(word)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), VOCABULARY - 1)
        rf, rn = p["R"][far], p["R"][near]
        context = rf @ p["C2"] + rn @ p["C1"]
        true = np.einsum("nd,nd->n", context, p["Q"][word]) + p["b"][word] - self.log_noise[word]
        false = context @ p["Q"][noise].T + (p["b"][noise] - self.log_noise[noise])
        g_true = (1 / (1 + np.exp(-true)) - 1) / n
        g_false = 1 / (1 + np.exp(-false)) / n
        to_context = g_true[:, None] * p["Q"][word] + g_false @ p["Q"][noise]
        q = _summed(g_true[:, None] * context, word) + _summed(g_false.T @ context, noise)
        b = np.bincount(word, g_true, VOCABULARY) + np.bincount(noise, g_false.sum(axis=0), VOCABULARY)
        r = _summed(to_context @ p["C2"].T, far) + _summed(to_context @ p["C1"].T, near)
        gradients = {"R": r, "Q": q, "b": b, "C1": rn.T @ to_context, "C2": rf.T @ to_context}
        self.steps += 1
        self.seen += n
        rate = RATE / np.sqrt(1 + self.steps / 100)
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            p[k] -= rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-9)


class Coder:
    """Texts to arrays of word numbers by falling count; -1 for words beyond the head."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}.get

    def __call__(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        words = text.lower().split()
        return words, np.fromiter(map(self.number, words, repeat(-1)), dtype=np.int64, count=len(words))


def _ids(numbers: np.ndarray) -> np.ndarray:
    """Word numbers to ids of the network, with the end of the text."""
    ids = np.where((numbers >= 0) & (numbers < VOCABULARY - 2), numbers + 2, OTHER)
    return np.append(ids, END)


def _contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts one after the other, with both contexts, and where each text starts; a text begins after two ends."""
    flat = np.concatenate(ids)
    starts = np.cumsum([0, *(len(i) for i in ids[:-1])])
    near, far = np.roll(flat, 1), np.roll(flat, 2)
    near[starts] = far[starts] = END
    second = starts + 1
    far[second[second < len(flat)]] = END
    return far, near, flat, starts


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        for t in b.column(column):
            held.append(t.as_py())
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _flat(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64).tobytes()


def _unflat(raw: bytes, like: dict) -> dict:
    values, out, at = np.frombuffer(raw, dtype=np.float64), {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train_over(docs: DataFrame, stats: Statistics, parameters: dict) -> DataFrame:
    """``text`` (binary) -> a row per task: ``tokens`` seen and the parameters times ``tokens``."""
    words, unigram = stats.words[: VOCABULARY - 2], stats.unigram()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, trainer = Coder(words), Trainer(parameters, unigram)
        for texts in _texts(batches, 0):
            far, near, flat, _ = _contexts([_ids(code(t)[1]) for t in texts])
            # words of one text are alike, so a step takes them from all over the list
            order = trainer.rng.permutation(len(flat))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                trainer.step(far[at], near[at], flat[at])
        if trainer.seen:
            weighted = {k: v.astype(np.float64) * trainer.seen for k, v in trainer.p.items()}
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([trainer.seen], pa.int64()), "sums": pa.array([_flat(weighted)], pa.binary())})

    return docs.mapInArrow(run, "tokens BIGINT, sums BINARY")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0, None
    for b in batches:
        for n, s in zip(b.column(0), b.column(1)):
            values = np.frombuffer(s.as_py(), dtype=np.float64)
            total = values.copy() if total is None else total + values
            tokens += n.as_py()
    if total is not None:
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, stats: Statistics, stages: Stages) -> dict:
    """``doc_id, text`` -> parameters, from all texts.

    With no texts the parameters are those of the start, which says no more
    than the counts do.
    """
    start = start_parameters(stats.unigram())
    texts = docs.select(text_of().cast("binary").alias("text"))
    keyed = docs.select(F.xxhash64("doc_id", text_of()).alias("row_key"), text_of().cast("binary").alias("text"))
    # the keys are chosen first, so only the texts of the sample move
    chosen = by_hash(keyed.select("row_key").distinct(), ["row_key"], START_TEXTS)
    sample = keyed.join(F.broadcast(chosen), "row_key").dropDuplicates(["row_key"]).select("text").coalesce(1)
    for name, rows in (("start", sample), ("all", texts)):
        found = stages.write(f"parameters-{name}-0", _train_over(rows, stats, start), TEXTS)
        left, level = found.count(), 0
        while left > 1:
            level += 1
            left = -(-left // FAN_IN)
            summed = found.repartition(left).mapInArrow(_add_up, "tokens BIGINT, sums BINARY")
            found = stages.write(f"parameters-{name}-{level}", summed)
            left = found.count()
        last = found.first()
        if last is not None:
            sums = {k: v / last["tokens"] for k, v in _unflat(last["sums"], start).items()}
            start = {k: v.astype(np.float32) for k, v in sums.items()}
    return start


class Scorer:
    """Normalised log probabilities of ids after two others."""

    def __init__(self, p: dict):
        near = (p["R"] @ p["C1"]) @ p["Q"].T + p["b"]
        far = (p["R"] @ p["C2"]) @ p["Q"].T
        top_near, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        near -= top_near
        far -= top_far
        self.near, self.far = near, far
        sums = np.exp(far) @ np.exp(near).T
        self.log_sum = np.log(sums, out=sums)

    def __call__(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.far[far, word] + self.near[near, word] - self.log_sum[far, near]


def _tails(tails: list[Counter]) -> pa.Array:
    """Counted words of each text as lists of ``word, n``, without a Python object for each pair."""
    offsets = np.cumsum([0, *map(len, tails)], dtype=np.int32)
    words = pa.array([w for t in tails for w in t], pa.binary()).cast(pa.string())
    n = pa.array([n for t in tails for n in t.values()], pa.int64())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, n], ["word", "n"]))


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text: rows bound nothing where texts are long."""
    for b in batches:
        ends, first, rest = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0, 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, rest + most, side="right")))
            yield b.slice(first, last - first)
            first, rest = last, int(ends[last - 1])


def score(docs: DataFrame, counts: DataFrame, stats: Statistics, parameters: dict, stages: Stages) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_tokens, n_known, base_score, score``, a row per row; log10.

    A token is a word or the one end of a text.  ``base_score`` goes by counts
    alone.  A null text has the end alone.  Rows that agree in id and text
    share their rare words' sums.
    """
    denominator = stats.tokens + stats.types + 1
    other_tokens, other_types = stats.other()
    other_denominator = other_tokens + other_types + 1
    words, head_counts, texts = stats.words, stats.counts, stats.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, scorer = Coder(words), Scorer(parameters)
        per_word = np.log10(np.append(head_counts, 0) + 1.0)
        at_end = np.log10(texts + 1.0)
        for b in _slices(batches, 2):
            out = {"n_tokens": [], "n_known": [], "base": [], "model": [], "tail": []}
            group, size = [], 0

            def flush() -> None:
                far, near, flat, starts = _contexts(group)
                out["model"].extend((np.add.reduceat(scorer(far, near, flat).astype(np.float64), starts) / _LOG10).tolist())
                group.clear()

            for t in b.column(2):
                own, numbers = code(t.as_py())
                rare = numbers < 0
                group.append(_ids(numbers))
                size += len(numbers)
                found = per_word[numbers]
                # end first; rare words are added by the join
                out["base"].append(float(found.sum() + at_end - np.log10(denominator) * (len(own) + 1 - rare.sum())))
                others = (numbers >= VOCABULARY - 2)
                out["tail"].append(Counter(own[i] for i in np.flatnonzero(rare)))
                out["n_tokens"].append(len(own) + 1)
                out["n_known"].append(int(len(own) - rare.sum() + (texts > 0)))
                out.setdefault("inside", []).append(float(found[others].sum() - np.log10(other_denominator) * others.sum()))
                if size > 1 << 19:
                    flush()
                    size = 0
            if group:
                flush()
            model = np.array(out["model"]) + np.array(out.get("inside", []))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()),
                 pa.array(out["base"], pa.float64()), pa.array(model, pa.float64()), _tails(out["tail"])],
                ["doc_id", "row_key", "n_tokens", "n_known", "base", "model", "tail"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text_of()).alias("row_key"), text_of().cast("binary").alias("text"))
    schema = f"doc_id {kind}, row_key BIGINT, n_tokens BIGINT, n_known BIGINT, base DOUBLE, model DOUBLE, tail ARRAY<STRUCT<word: STRING, n: BIGINT>>"
    scored = stages.write("scored", keyed.mapInArrow(run, schema), TEXTS)
    rare = scored.where(F.size("tail") > 0).select("row_key", F.explode("tail").alias("t")).select("row_key", "t.*")
    c = F.coalesce("c", F.lit(0))
    n = F.col("n")
    sums = rare.join(counts, "word", "left").groupBy("row_key").agg(
        F.sum(n * F.log10((c + 1) / denominator)).alias("rare_base"),
        F.sum(n * F.log10((c + 1) / other_denominator)).alias("rare_model"),
        F.sum(F.when(c > 0, n).otherwise(0)).alias("rare_known"), F.sum(n).alias("rare_tokens"),
    )
    # repeated rows have added up the same words once each
    rows = scored.select("row_key", F.expr("aggregate(tail, 0L, (a, t) -> a + t.n)").alias("own")).where("own > 0")
    rows = rows.groupBy("row_key").agg((F.sum("own") / F.max("own")).alias("times"))
    sums = sums.join(rows, "row_key")
    joined = scored.select("doc_id", "row_key", "n_tokens", "n_known", "base", "model").join(sums, "row_key", "left")
    part = lambda name: F.coalesce(F.col(name) / F.col("times"), F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.round(part("rare_known")).cast("bigint")).alias("n_known"),
        (F.col("base") + part("rare_base")).alias("base_score"), (F.col("model") + part("rare_model")).alias("score"),
    )


def score_documents(docs: DataFrame, training: Column, stages: Stages) -> tuple[DataFrame, Statistics]:
    """Counts, trains on the rows where ``training`` holds, and scores all rows."""
    chosen = docs.where(training).select("doc_id", "text")
    counts = stages.write("counts", count_words(chosen))
    stats = statistics(chosen, counts)
    parameters = train(chosen, stats, stages)
    return score(docs.select("doc_id", "text"), counts, stats, parameters, stages), stats
