"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters look at ``2 * BLOCK`` bytes every ``BLOCK`` bytes;
activations are max-pooled over chunks of ``CHUNK`` groups that overlap by one
group and cover the whole document; the chunks' maxima and means go into one
logistic unit.  Texts are scored where they stand, in slabs of bounded size.

The network is fitted in one task on a bounded sample of labelled rows, with a
fixed seed; its parameters are a few thousand numbers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import by_hash, text_of

# labelled rows of each class that the network is fitted on: those of smallest hash
SAMPLE = 2000
# steps of the fit, a batch of texts each
STEPS = 1600
WIDTH, FILTERS = 8, 32
BLOCK = 4
GROUP = 32  # blocks of a group
CHUNK = 5  # groups of a chunk; a chunk starts every CHUNK - 1 groups
PAD = 256
# groups that are worked on at a time
SLAB = 2048
_BATCH = 32


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other as byte codes, each filled up to whole groups; groups of each.

    The last block of a text is always padding, so its window is no text's.
    """
    step = GROUP * BLOCK
    groups = np.array([(len(t) + BLOCK) // step + 1 for t in texts], dtype=np.int64)
    codes = np.full(int(groups.sum()) * step, PAD, dtype=np.int16)
    at = 0
    for t, g in zip(texts, groups):
        codes[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(g) * step
    return codes, groups


def _activations(p: dict, codes: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter activations of every block (and the embedded blocks); ``following`` is the block after the last."""
    blocks = p["E"][np.concatenate([codes, following])].reshape(-1, BLOCK * WIDTH)
    half = BLOCK * WIDTH
    out = blocks[:-1] @ p["K"][:half]
    out += blocks[1:] @ p["K"][half:]
    out += p["b"]
    np.maximum(out, 0, out=out)
    return out, blocks


def _group_maxima(p: dict, codes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    step = GROUP * BLOCK
    total = int(groups.sum())
    ends = np.cumsum(groups) - 1
    maxima = np.empty((total, FILTERS), dtype=np.float32)
    for start in range(0, total, SLAB):
        stop = min(start + SLAB, total)
        following = codes[stop * step : stop * step + BLOCK] if stop < total else np.full(BLOCK, PAD, dtype=np.int16)
        out, _ = _activations(p, codes[start * step : stop * step], following)
        out = out.reshape(stop - start, GROUP, FILTERS)
        own = ends[(ends >= start) & (ends < stop)] - start
        out[own, -1] = 0  # looks into the next text
        maxima[start:stop] = out.max(axis=1)
    return maxima


def _chunk_starts(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group of every chunk, and chunks of each text."""
    chunks = np.maximum(1, -(-(groups - 1) // (CHUNK - 1)))
    firsts = np.cumsum(groups) - groups
    nth = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return np.repeat(firsts, chunks) + nth * (CHUNK - 1), chunks


def features(p: dict, texts: list[bytes]) -> np.ndarray:
    codes, groups = _padded(texts)
    maxima = _group_maxima(p, codes, groups)
    starts, chunks = _chunk_starts(groups)
    last = np.repeat(np.cumsum(groups) - 1, chunks)
    pooled = maxima[starts]
    for k in range(1, CHUNK):
        np.maximum(pooled, maxima[np.minimum(starts + k, last)], out=pooled)
    at = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(pooled, at, axis=0) / chunks[:, None]
    return np.concatenate([np.maximum.reduceat(pooled, at, axis=0), mean], axis=1)


def score_texts(p: dict, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    z = features(p, texts).astype(np.float64) @ p["w"].astype(np.float64) + float(p["c"][0]) + float(p["prior"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(p: dict, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict:
    """Gradients of the weighted log loss; only the places of maxima get any."""
    codes, groups = _padded(texts)
    out, blocks = _activations(p, codes, np.full(BLOCK, PAD, dtype=np.int16))
    ends = np.cumsum(groups)
    out[ends * GROUP - 1] = 0
    by_group = out.reshape(-1, GROUP, FILTERS)
    where = by_group.argmax(axis=1)
    maxima = np.take_along_axis(by_group, where[:, None], axis=1)[:, 0]
    where += np.arange(len(where))[:, None] * GROUP
    starts, chunks = _chunk_starts(groups)
    last = np.repeat(ends - 1, chunks)
    members = np.minimum(starts[:, None] + np.arange(CHUNK), last[:, None])
    best = maxima[members].argmax(axis=1)
    group_of = np.take_along_axis(members, best, axis=1)
    cols = np.arange(FILTERS)
    pooled, place = maxima[group_of, cols], where[group_of, cols]
    at = np.cumsum(chunks) - chunks
    top = np.maximum.reduceat(pooled, at, axis=0)
    feats = np.concatenate([top, np.add.reduceat(pooled, at, axis=0) / chunks[:, None]], axis=1)
    z = feats @ p["w"] + p["c"][0]
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / len(texts)
    to_feats = error[:, None] * p["w"]
    text_of_chunk = np.repeat(np.arange(len(texts)), chunks)
    to_pooled = to_feats[text_of_chunk, FILTERS:] / chunks[text_of_chunk, None]
    # of chunks that share a text's maximum the first one gets the gradient
    is_top = pooled == top[text_of_chunk]
    nth = np.cumsum(is_top, axis=0)
    before = (nth - is_top)[at][text_of_chunk]
    to_pooled = to_pooled + np.where(is_top & (nth - before == 1), to_feats[text_of_chunk, :FILTERS], 0)
    to_pooled = np.where(pooled > 0, to_pooled, 0).astype(np.float32)
    windows = np.concatenate([blocks[place], blocks[place + 1]], axis=2)
    to_windows = to_pooled[:, :, None] * p["K"].T[None]
    seen = np.concatenate([codes, np.full(BLOCK, PAD, dtype=np.int16)])[place[:, :, None] * BLOCK + np.arange(2 * BLOCK)]
    flat = to_windows.reshape(-1, WIDTH)
    to_e = np.stack([np.bincount(seen.ravel(), flat[:, k], PAD + 1) for k in range(WIDTH)], axis=1).astype(np.float32)
    to_e[PAD] = 0
    return {
        "E": to_e, "K": np.einsum("cf,cfw->wf", to_pooled, windows), "b": to_pooled.sum(axis=0),
        "w": (feats.T @ error).astype(np.float32), "c": np.array([error.sum()], dtype=np.float32),
    }


def fit(texts: list[bytes], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> dict:
    """Parameters by Adam; ``share`` is the share of label 1 that scores allow for.

    Both classes weigh the same in the loss, whatever their numbers.  With one class only (or no rows) the network stays 0 and the score is ``share``.
    """
    rng = np.random.default_rng(seed)
    p = {
        "E": rng.normal(0, 0.5, (PAD + 1, WIDTH)), "K": rng.normal(0, 1 / np.sqrt(2 * BLOCK * WIDTH), (2 * BLOCK * WIDTH, FILTERS)),
        "b": np.zeros(FILTERS), "w": np.zeros(2 * FILTERS), "c": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["E"][PAD] = 0
    share = min(max(share, 0.01), 0.99)
    p["prior"] = np.array([np.log(share / (1 - share))], dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return p
    p["w"] = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    target = np.where(labels == 1, 1.0, 0.0)
    weight = np.where(labels == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    order = np.empty(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(texts))
        rows, order = order[:_BATCH], order[_BATCH:]
        rate = 0.004 * (1 - (step - 1) / steps)
        for k, g in _gradients(p, [texts[r] for r in rows], target[rows], weight[rows]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return p


def _packed(p: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpacked(model: bytes) -> dict:
    with np.load(io.BytesIO(model)) as f:
        return {k: f[k] for k in f.files}


def sampled(usable: DataFrame, docs: DataFrame, sample: int) -> DataFrame:
    """``doc_id, text, quality`` of at most ``sample`` ids a class: each id once, with the smallest of its texts."""
    ids = usable.distinct()
    rows = [by_hash(ids.where(F.col("quality") == q), ["doc_id"], sample) for q in (0, 1)]
    chosen = rows[0].unionByName(rows[1])
    texts = docs.select("doc_id", text_of().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> bytes:
    """``doc_id, text`` and ``doc_id, quality`` -> the fitted network.

    Of each class the ``sample`` labelled ids of smallest hash are used, each
    once and with one whole text.  Rows without an id or with another label than 0 and 1
    are not.  The share of label 1 is that of all rows of ``labels``.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = usable.agg(F.coalesce(F.avg("quality"), F.lit(0.5))).first()[0]
    texts = sampled(usable, docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((d, t, q) for b in batches for d, t, q in zip(*(c.to_pylist() for c in b.columns)))
        p = fit([t for _, t, _ in seen], np.array([q for _, _, q in seen]), float(counts), steps)
        yield pa.RecordBatch.from_pydict({"model": pa.array([_packed(p)], pa.binary())})

    # one task: its rows are bounded by the sample
    fitted = texts.repartition(1).mapInArrow(run, "model BINARY").first()
    return fitted["model"] if fitted else _packed(fit([], np.empty(0, dtype=np.int64), float(counts), steps))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, score``, a row per row, without a shuffle.

    Null and empty texts are scored as the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpacked(model)
        for b in batches:
            texts, out, held = [], [], 0
            for t in b.column(1):
                texts.append(t.as_py())
                held += len(texts[-1])
                if held > 1 << 22:
                    out.append(score_texts(p, texts))
                    texts, held = [], 0
            out.append(score_texts(p, texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score DOUBLE")
