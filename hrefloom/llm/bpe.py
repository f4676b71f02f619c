"""Byte-level BPE: texts to ids and back.

``encode_words`` folds ranked merges over the byte arrays of distinct words
with Spark's higher-order functions; the ranks are a constant map of the plan.
A lookup is cheap there (the map is dealt into small maps by hash, since Spark
searches a map from its start), but each step of the fold is interpreted, and
ids must be joined back to every place of every word.  README has the figures:
over whole corpora that join moves several times the input, so
``encode_documents`` folds the distinct words of each task where they stand.
Both forms give the ids of the public tokenizer's library.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.text import let, lift
from hrefloom.llm.common import text_of

# distinct words whose ids a task remembers; others are folded when they come
REMEMBERED = 200_000
# from this many bytes on a word is folded with a heap
LONG = 48


def read_ranks(path: str) -> bytes:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) >= LONG:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, s in enumerate(scores):
            if s is not None and (best is None or s < best):
                best, at = s, i
        if best is None:
            return tuple(ranks[p] for p in parts)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """``fold`` in n log n: pairs in a heap, parts in a linked list."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts at i; 0 where none does
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or not end[j] or end[j] != stop:
            continue  # one of its parts was merged meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[word[i : end[i]]] for i in range(n) if end[i])


def encode_documents(docs: DataFrame, raw_ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, ids``, a row per row, without a shuffle.

    Each match of ``pattern`` is encoded on its own; there are no special
    tokens.  A null or empty text has no ids.  Very long words cost n log n.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find = parse_ranks(raw_ranks), regex.compile(pattern).findall
        known: dict[str, tuple[int, ...]] = {}

        def ids_of(word: str) -> tuple[int, ...]:
            ids = known.get(word)
            if ids is None:
                ids = fold(word.encode("utf-8"), ranks)
                if len(known) < REMEMBERED and len(word) < LONG:
                    known[word] = ids
            return ids

        for b in batches:
            rows = [pa.array(list(chain.from_iterable(map(ids_of, find(t.as_py())))), pa.int32()) for t in b.column(1)]
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r))
            flat = pa.concat_arrays(rows) if rows else pa.array([], pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(encode, f"doc_id {kind}, ids ARRAY<INT>")


def decode_documents(encoded: DataFrame, raw_ranks: bytes) -> DataFrame:
    """``ids`` and any other columns -> ``+ decoded``: the bytes of the tokens, concatenated.

    The tokens are a constant of the plan, in hex.  Null ids decode to null; an
    id that is no token's is an error.
    """
    tokens = {rank: token for token, rank in parse_ranks(raw_ranks).items()}
    pieces = F.split(F.lit(",".join(tokens[rank].hex() for rank in range(len(tokens)))), ",")
    return encoded.withColumn("decoded", lift(pieces, lambda t: f"unhex(array_join(transform(ids, i -> {t}[i]), ''))"))


def _rank_map(ranks: dict[bytes, int], maps: int) -> str:
    """SQL of the ranks as a constant: an array of maps from hex to rank, dealt by CRC-32."""
    dealt: list[dict[str, int]] = [{} for _ in range(maps)]
    for token, rank in ranks.items():
        dealt[zlib.crc32(token) % maps][token.hex().upper()] = rank
    return f"from_json('{json.dumps(dealt, separators=(',', ':'))}', 'array<map<string,int>>')"


def encode_words(words: DataFrame, raw_ranks: bytes) -> DataFrame:
    """``word`` -> ``word, ids``, by higher-order functions alone.

    Words are taken as they are (nulls have null ids); give distinct ones.
    """
    ranks = parse_ranks(raw_ranks)
    maps = 1 << 14

    def rank(piece: str) -> str:
        return f"element_at(r[cast(pmod(crc32({piece}), {maps}) AS int)], hex({piece}))"

    pairs = f"transform(slice(p, 1, size(p) - 1), (x, i) -> named_struct('rank', {rank('concat(x, p[i + 1])')}, 'at', i))"
    lowest = f"array_min(filter({pairs}, x -> x.rank IS NOT NULL))"
    merged = (
        "concat(slice(p, 1, m.at), array(concat(p[m.at], p[m.at + 1])),"
        " if(m.at + 2 < size(p), slice(p, m.at + 3, size(p)), cast(array() AS array<binary>)))"
    )
    step = let(f"if(size(p) < 2, NULL, {lowest})", "m", f"if(m IS NULL, p, {merged})")
    bytes_of = "transform(sequence(1, octet_length(b)), i -> substring(b, i, 1))"
    folded = f"transform(aggregate(sequence(2, octet_length(b)), {bytes_of}, (p, _) -> {step}), x -> {rank('x')})"
    whole = let(rank("b"), "w", f"if(w IS NOT NULL, array(w), {folded})")
    ids = f"if(octet_length(b) = 0, cast(array() AS array<int>), {let(_rank_map(ranks, maps), 'r', whole)})"
    return words.withColumn("b", F.col("word").cast("binary")).select("word", F.when(F.col("b").isNotNull(), F.expr(ids)).alias("ids"))


def id_list(ids: str) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` of all ``docs`` by a rank file."""
    raw = read_ranks(path)
    return decode_documents(encode_documents(docs, raw, pattern), raw)
