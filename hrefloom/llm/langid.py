"""Language identification by cross-parsing.

Of every language a bounded sample of labelled text becomes a suffix automaton
over UTF-8 bytes.  A text is cut, from its start, into the longest phrases that
occur in the sample: the automaton is walked until it has no way on, the phrase
ends, and the next one starts there.  A phrase costs the bits that point into
the sample, so the cross entropy of a text under a language is

    phrases * log2(sample length + 1) / text length

and the language in which it is smallest wins, ties by code points of the name.

The samples are blocks of whole texts, chosen by a hash of what they say over
all labelled rows, so they are the same on any partitioning, long texts and
copies weigh no more than others, and their size is fixed.  Texts are parsed in
pieces of ``PIECE`` bytes, all pieces of a batch side by side: a step looks up
the next byte of every piece at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import text_of

# bytes of sample a language has, in blocks of so many characters
SAMPLE, BLOCK = 16_000, 400
# a parse starts anew after so many bytes; bytes of text parsed side by side
PIECE, SIDE_BY_SIDE = 1024, 1 << 22
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = 1 << 52


def has_letter(text: str) -> bool:
    """Whether a text holds a letter (Unicode category L)."""
    return any(map(str.isalpha, _LETTER.findall(text)))


def folded(text: str) -> str:
    """Lower-case words with one space before each and one after the last."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


def automaton(text: bytes) -> list[dict[int, int]]:
    """The suffix automaton of a text: the ways on from each state, byte to state, from state 0.

    Every path from the start spells a substring of ``text``, and every
    substring is such a path.
    """
    ways: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in ways[at]:
            ways[at][c] = new
            at = link[at]
        if at >= 0:
            to = ways[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(ways)
                ways.append(dict(ways[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and ways[at].get(c) == to:
                    ways[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return ways


def longest_matches(text: bytes, ways: list[dict[int, int]]) -> list[int]:
    """Lengths of the phrases of the cross-parse; a byte that the sample lacks is a phrase of its own."""
    out, at = [], 0
    while at < len(text):
        state, i = 0, at
        while i < len(text) and (to := ways[state].get(text[i])) is not None:
            state, i = to, i + 1
        out.append(max(1, i - at))
        at += out[-1]
    return out


_ENDED = 28  # bits of a step's table entry below the number of phrases that the step ends
_ROW = (1 << _ENDED) - 1


class Parser:
    """An automaton as a table: a row per state, a column per byte, the last for unknown ones.

    An entry holds where the row of the next state starts and how many phrases
    end with the step, so a step of many texts is one look-up.
    """

    def __init__(self, sample: bytes):
        ways = automaton(sample)
        used = sorted(set(sample))
        self.width = len(used) + 1
        self.column = np.full(256, len(used), dtype=np.uint8)
        self.column[used] = np.arange(len(used), dtype=np.uint8)
        column = {c: i for i, c in enumerate(used)}
        # with no way on, a phrase ends and the next begins with this byte; an unknown byte is one itself
        start = np.full(self.width, 2 << _ENDED, dtype=np.int32)
        for c, to in ways[0].items():
            start[column[c]] = (1 << _ENDED) + to * self.width
        self.table = np.tile(start, (len(ways), 1))
        self.table[0] -= 1 << _ENDED
        cells = [(at * self.width + column[c], to * self.width) for at, way in enumerate(ways) for c, to in way.items()]
        where, to = np.array(cells, dtype=np.int64).T if cells else np.empty((2, 0), dtype=np.int64)
        self.table.reshape(-1)[where] = to
        self.table = self.table.reshape(-1)
        self.bits = math.log2(len(sample) + 1)

    def __call__(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each piece: bytes by (place, piece), pieces from the longest to the shortest."""
        state, count = np.zeros(len(lengths), dtype=np.int32), np.zeros(len(lengths), dtype=np.int32)
        reach = np.searchsorted(-lengths, -np.arange(1, len(pieces) + 1), side="right")
        for place, n in enumerate(reach):
            entry = self.table.take(state[:n] + self.column.take(pieces[place, :n]))
            count[:n] += entry >> _ENDED
            state[:n] = entry & _ROW
        return count + (state != 0)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in pieces: bytes by (place, piece), lengths from longest to shortest, and the text of each piece."""
    owner, lengths, parts = [], [], []
    for n, text in enumerate(texts):
        for i in range(0, len(text), PIECE):
            parts.append(text[i : i + PIECE])
            lengths.append(len(parts[-1]))
            owner.append(n)
    lengths = np.array(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    padded = b"".join(parts[i].ljust(lengths[order[0]], b" ") for i in order)
    pieces = np.frombuffer(padded, dtype=np.uint8).reshape(len(parts), -1).T if parts else np.empty((0, 0), dtype=np.uint8)
    return np.ascontiguousarray(pieces), lengths[order], np.array(owner, dtype=np.int64)[order]


class Identifier:
    """Samples by language -> ``(language, score)`` of texts."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.parsers = [Parser(_bytes(samples[n])) for n in self.names]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The winner of each text and how far it is ahead: its share of the sum of inverse entropies.

        ``und`` and 0 without a letter or a language.
        """
        out = [(UNKNOWN, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if self.names else []
        if not asked:
            return out
        pieces, lengths, owner = cut([_bytes(folded(texts[i])) for i in asked])
        bits = np.array([
            p.bits * np.bincount(owner, weights=p(pieces, lengths), minlength=len(asked)) for p in self.parsers
        ])
        best = bits.argmin(axis=0)
        share = 1 / (bits.min(axis=0) * (1 / bits).sum(axis=0))
        for k, i in enumerate(asked):
            out[i] = self.names[best[k]], float(share[k])
        return out


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _blocks(text: str) -> Iterator[str]:
    """A folded text in pieces of ``BLOCK`` characters, the last one shorter."""
    text = folded(text)
    return (text[i : i + BLOCK] for i in range(0, len(text), BLOCK))


def _place(block: str) -> int:
    return xxhash.xxh64_intdigest(_bytes(block), seed=5) % _SPACE


def learn(docs: DataFrame, trusted: Column, sample: int = SAMPLE) -> dict[str, str]:
    """``lang, text`` -> a sample of at most ``sample`` bytes a language, from the rows that are ``trusted``.

    Rows without a language or a letter teach nothing.  All blocks of all rows
    take part: those with the smallest hashes stay, once each.  First the bytes
    of a language are summed, then only blocks whose hash lies in its share
    leave their task, so about twice the sample reaches the driver.
    """
    rows = docs.where(trusted & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 0")
    limits = {r["lang"]: min(_SPACE, int(_SPACE * 2 * sample / r["n"]) + 1) for r in sizes.collect()}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                limit = limits.get(lang, 0)
                for block in _blocks(text.as_py()):
                    place = _place(block)
                    if place < limit and has_letter(block):
                        found.append((lang, place, block))
            columns = list(zip(*found)) if found else [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "place", "block"])

    candidates = rows.mapInArrow(choose, "lang STRING, place BIGINT, block STRING").distinct()
    samples: dict[str, str] = {}
    size: dict[str, int] = {}
    for r in candidates.orderBy("lang", "place", "block").collect():
        size[r["lang"]] = size.get(r["lang"], 0) + len(_bytes(r["block"]))
        if size[r["lang"]] <= sample or r["lang"] not in samples:
            samples[r["lang"]] = samples.get(r["lang"], "") + r["block"]
    return samples


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; text is all that is looked at.

    Rows are judged on their own and whole: no shuffle, repeated rows get equal
    results.  ``und`` with score 0 for null texts, texts without a letter, and
    where nothing was learned.  The score is the winner's share of the inverse
    entropies, 1 where only one language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier(shared.value)
        for b in batches:
            judged, held, size = [], [], 0
            for t in b.column(1):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size >= SIDE_BY_SIDE:
                    judged += judge(held)
                    held, size = [], 0
            judged += judge(held)
            names, scores = zip(*judged) if judged else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"]
            )

    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred STRING, score DOUBLE"
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")
