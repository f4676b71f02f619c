"""Alignment of two tokenizers by products of sparse incidence matrices.

The tokens of a text under a tokenizer are the rows of a matrix with a column
per byte of the text.  A . B^T of two such matrices links the tokens whose byte
ranges overlap, an entry being the bytes they share.  Where tokens of both end
at the same byte the text is cut into groups; the matrices of tokens by groups
give, in the same product, the links of tokens that share a group.

Matrices are compressed rows made by hand (``Rows``), products are row by row:
each entry (i, k) of A brings row k of B^T into row i.

Counts of linked id pairs cover the corpus.  Texts are dealt into chunks of
bounded size where they are encoded; a chunk's distinct pairs are summed up
before anything is shuffled, and a chunk gets back one count per distinct pair,
so a pair that stands in every text is a row per chunk.  A row of what is written
and shuffled is one pair of a chunk or one text, so readers and writers, which
hold many rows at a time, hold little however many chunks a task makes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages

# bytes of text in a chunk, and of text that is aligned at once, but for a longer text
CHUNK_BYTES, BATCH_BYTES = 4 << 20, 1 << 18
# entries of a product that are made at a time
PRODUCT_ROWS = 1 << 20


@dataclass
class Rows:
    """A sparse 0/1 matrix: ``columns[starts[i]:starts[i + 1]]`` are the entries of row i, in order."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_ranges(cls, ends: np.ndarray) -> Rows:
        """Row i covers the columns from the end of the row before it to ``ends[i]``."""
        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]), np.arange(width), width)

    @classmethod
    def of_columns(cls, columns: np.ndarray, width: int) -> Rows:
        """Row i has the one entry ``columns[i]``."""
        return cls(np.arange(len(columns) + 1), columns, width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Rows:
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        rows = np.repeat(np.arange(len(self)), np.diff(self.starts))
        return Rows(starts, rows[np.argsort(self.columns, kind="stable")], len(self))

    def sizes_of_product(self, other: Rows) -> np.ndarray:
        """How many pairs each row of ``self . other`` is made of, without making them."""
        brought = np.concatenate([[0], np.cumsum(np.diff(other.starts)[self.columns])])
        return brought[self.starts[1:]] - brought[self.starts[:-1]]

    def product(self, other: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``self . other`` as (row, column, value), sorted, some rows at a time."""
        sizes = self.sizes_of_product(other)
        upto, first = np.cumsum(sizes), 0
        while first < len(self):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + PRODUCT_ROWS, side="right")))
            mine = self.columns[self.starts[first] : self.starts[last]]
            n = np.diff(other.starts)[mine]
            row = np.repeat(np.arange(first, last), sizes[first:last])
            # entry t of a brought row k stands at starts[k] + t
            place = np.arange(len(row)) + np.repeat(other.starts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            key = row * other.width + other.columns[place]
            if (key[1:] < key[:-1]).any():
                key = np.sort(key)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
            yield key[new] // max(1, other.width), key[new] % max(1, other.width), np.diff(np.append(new, len(key)))
            first = last


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in A, in B) of all tokens whose byte ranges overlap."""
    parts = list(Rows.of_ranges(a_ends).product(Rows.of_ranges(b_ends).transposed()))
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and how many groups there are."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(common, a_ends), np.searchsorted(common, b_ends), len(common)


def shared_group_links(a_group: np.ndarray, b_group: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places (in A, in B) of all tokens that share a group, some at a time."""
    yield from Rows.of_columns(a_group, n).product(Rows.of_columns(b_group, n).transposed())


def n_shared_group_links(a_group: np.ndarray, b_group: np.ndarray, n: int) -> int:
    return int(Rows.of_columns(a_group, n).sizes_of_product(Rows.of_columns(b_group, n).transposed()).sum())


# white space that a backtracking pattern may give up on
_LONG_BLANK = re.compile(r"\s{10000}")


class ByteLevel:
    """Tokenizer A: byte-level BPE of a tokenizer file, of space and text.

    Where the file's ids are in the order of its merges, merging by merges is
    merging by the rank of what comes out, and the quicker library for that is
    asked; any other file, and texts with long runs of blanks, go to the file's
    own library.  A test holds the two against each other on all tokens and all
    characters.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        # bytes that print stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.own.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.ranked = self._ranked(path, vocabulary)

    def _ranked(self, path: str, vocabulary: dict[str, int]):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"].get("merges", [])]
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        split = file["pre_tokenizer"] or {}
        plain = file["normalizer"] is None and all(split.get(k) == v for k, v in byte_level.items())
        if not plain or len(vocabulary) != 256 + len(merges) or any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {token: i for i, token in enumerate(self.bytes)}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.ranked is not None and not _LONG_BLANK.search(text):
            return self.ranked.encode_ordinary(" " + text)
        return self.by_merges(text)

    def by_merges(self, text: str) -> list[int]:
        return self.own.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """Tokenizer B: a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        self.bytes = [self._of(i) for i in range(self.own.get_piece_size())]

    def _of(self, i: int) -> bytes:
        piece = self.own.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.own.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> list[int]:
        return self.own.encode(text, num_threads=1)


@dataclass
class Aligned:
    """Some texts, aligned: figures by text, and the id pairs of each with how often they are linked."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_group_links: np.ndarray
    groups: list[str]
    owner: np.ndarray  # of a pair: the text, in order
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Texts to links between the tokens of two tokenizers."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.a_size = np.array([len(x) for x in a.bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in b.bytes], dtype=np.int64)
        # an id as text with what follows it: "," inside a side of a group, "|" after A's, ";" after B's
        self.written = [f"{i}{end}" for n, ends in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for end in ends for i in range(n)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids under A and B; none where either does not spell space and text."""
        if text:
            whole = b" " + text.encode("utf-8", "surrogatepass")
            a, b = self.a(text), self.b(text)
            if all(b"".join(map(table.__getitem__, ids)) == whole for ids, table in ((a, self.a.bytes), (b, self.b.bytes))):
                return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def align(self, coded: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
        """All texts in one go, end to end: both sides of a text end at the same byte, so no link or group leaves it."""
        n_a, n_b = (np.array([len(c[side]) for c in coded], dtype=np.int64) for side in (0, 1))
        a, b = (np.concatenate([c[side] for c in coded]) for side in (0, 1))
        text_of_a = np.repeat(np.arange(len(coded)), n_a)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        row, column = overlap_links(a_ends, b_ends)
        a_group, b_group, n = groups(a_ends, b_ends)
        by_group = Rows.of_columns(a_group, n).sizes_of_product(Rows.of_columns(b_group, n).transposed())
        count = lambda texts, weights=None: np.bincount(texts, weights, minlength=len(coded)).astype(np.int64)
        upto = np.concatenate([np.diff(a_group) > 0, [True]]) if len(a) else np.empty(0, dtype=bool)
        # links of a text by id pair
        width = len(self.b.bytes)
        key = (text_of_a[row] * len(self.a.bytes) + a[row]) * width + b[column]
        key, times = np.unique(key, return_counts=True)
        per_text = len(self.a.bytes) * width
        return Aligned(
            n_a, n_b, count(text_of_a[upto]), count(text_of_a[row]), count(text_of_a, by_group),
            self._texts(a, b, a_group, b_group, n, n_a + n_b), key // per_text, key % per_text, times,
        )

    def _texts(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n: int, sizes: np.ndarray) -> list[str]:
        a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[a_upto - 1] = last_b[b_upto - 1] = True
        # a group is its tokens of A, then those of B
        codes[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]] = a + len(self.a.bytes) * last_a
        codes[np.arange(len(b)) + a_upto[b_group]] = 2 * len(self.a.bytes) + b + len(self.b.bytes) * last_b
        written = list(map(self.written.__getitem__, codes.tolist()))
        ends = np.cumsum(sizes).tolist()
        return ["".join(written[start:end])[:-1] for start, end in zip([0, *ends], ends)]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_COUNTS = "n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_group_links BIGINT, groups_sha256 STRING"


def pack(numbers: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Lists of numbers from 0, end to end, as a cell each: seven bits a byte from the lowest on, the high bit where more follow."""
    more = [numbers >> 7 * k > 0 for k in range(1, 9)]
    n = 1 + sum(x.astype(np.int64) for x in more)
    upto = np.concatenate([[0], np.cumsum(n)])
    data = np.empty(upto[-1], dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > k)
        data[upto[some] + k] = (numbers[some] >> 7 * k & 127) | (n[some] > k + 1).astype(np.int64) << 7
    offsets = upto[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells, and where each cell's begin; one place more, the end."""
    cells = cells.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], dtype=np.int64)[cells.offset :][: len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    last = np.concatenate([[0], np.cumsum(data < 128)])
    starts = np.concatenate([[0], np.flatnonzero(data < 128) + 1])
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    parts = np.concatenate([(data & 127).astype(np.int64) << 7 * place, [0]])
    return np.add.reduceat(parts, starts)[:-1], last[offsets - offsets[0]]


def _chunks(a_path: str, b_path: str, kind: pa.DataType):
    """Texts to chunks: a row for each distinct id pair of a chunk with its links, and one for each text."""
    doc_type = pa.struct([
        ("doc_id", kind), *((c, pa.int64()) for c in _FIGURES), ("groups_sha256", pa.string()), ("steps", pa.binary()), ("times", pa.binary()),
    ])

    def emit(number: int, ids: list, parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([p.pair for p in parts]), return_inverse=True)
        all_times = np.concatenate([p.times for p in parts])
        links = np.bincount(place, all_times, minlength=len(pairs)).astype(np.int64)
        sizes = np.concatenate([np.bincount(p.owner, minlength=len(p.n_a)) for p in parts])
        ends = np.cumsum(sizes)
        hashed = [hashlib.sha256(g.encode()).hexdigest() if n else "" for p in parts for g, n in zip(p.groups, p.n_a.tolist())]
        numbers = [np.concatenate([getattr(p, c) for p in parts]) for c in _FIGURES]
        # a text's pairs are places in the chunk's list, in order: the first place, then the steps to the next
        steps, first = np.diff(place, prepend=0), (ends - sizes)[sizes > 0]
        steps[first] = place[first]
        found = pa.StructArray.from_arrays(
            [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in numbers), pa.array(hashed, pa.string()), pack(steps, ends), pack(all_times, ends)],
            fields=list(doc_type),
        )
        chunk = (TaskContext.get().partitionId() << 32) + number
        n, m = len(pairs), len(ids)
        for columns in (
            [pa.array(np.arange(n), pa.int32()), pa.array(pairs, pa.int64()), pa.array(links, pa.int64()), pa.nulls(n, doc_type)],
            [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), found],
        ):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), chunk), pa.int64()), *columns], ["chunk", "at", "pair", "links", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(ByteLevel(a_path), Pieces(b_path))
        number, size, held, ids, coded, parts = 0, 0, 0, [], [], []
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                ids.append(i.as_py())
                coded.append(align.encode(text))
                held += len(text or "") + 64
                if held >= BATCH_BYTES:
                    parts.append(align.align(coded))
                    size, held, coded = size + held, 0, []
                if size >= CHUNK_BYTES:
                    yield from emit(number, ids, parts)
                    number, size, ids, parts = number + 1, 0, [], []
        if coded:
            parts.append(align.align(coded))
        if parts:
            yield from emit(number, ids, parts)

    return run


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """``pair, links`` -> ``pair, count, best``: links of each id pair in the corpus, and whether its B id has no pair with more.

    A pair is the number A * ``width`` + B.
    """
    pairs = pairs.groupBy("pair").agg(F.sum("links").alias("count"))
    second = F.col("pair") % width
    highest = pairs.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))
    joined = pairs.withColumn("b", second).join(highest, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(docs: pa.StructArray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Texts of a chunk with their links by the counts of the chunk's pairs."""
    (steps, starts), (times, _) = unpack(docs.field("steps")), unpack(docs.field("times"))
    walked = np.concatenate([[0], np.cumsum(steps)])
    place = walked[1:] - np.repeat(walked[starts[:-1]], np.diff(starts))
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
    names = ["doc_id", *_FIGURES, "groups_sha256"]
    columns = [*map(docs.field, names), pa.array(sums(times * best[place]), pa.int64()), pa.array(sums(times * counts[place]), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum"])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk, its pairs in order and then its texts: what is held is the counts of one chunk."""
    chunk, counts, best = None, [], []
    for b in batches:
        chunks, told = b.column("chunk").to_numpy(), b.column("at").is_valid().to_numpy(zero_copy_only=False)
        new = np.flatnonzero((chunks[1:] != chunks[:-1]) | (told[1:] != told[:-1])) + 1
        for start, end in zip([0, *new.tolist()], [*new.tolist(), len(chunks)]):
            if start == end:
                continue
            if chunks[start] != chunk:
                chunk, counts, best = chunks[start], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=bool)]
            rows = b.slice(start, end - start)
            if told[start]:
                counts.append(np.array(rows.column("count"), dtype=np.int64))
                best.append(np.array(rows.column("best"), dtype=bool))
            else:
                counts, best = [np.concatenate(counts)], [np.concatenate(best)]
                yield _scored(rows.column("doc"), counts[0], best[0])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, stages: Stages) -> DataFrame:
    """``doc_id, text`` -> a row per row: ``doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum``.

    A text that is null, empty, or not spelt by both tokenizers has no tokens:
    zeros and an empty ``groups_sha256``.  ``n_best`` are the links whose id
    pair has the highest count of its B id in the corpus, ties included, and
    ``count_sum`` is the sum of the counts over all links.  Repeated rows count
    each time.  A text of any length is encoded whole.
    """
    kind = docs.select("doc_id").schema
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.sparkSession.createDataFrame([], kind).toArrow().schema.field(0).type
    doc = f"STRUCT<doc_id: {doc_type}, {_COUNTS.replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING')}, steps: BINARY, times: BINARY>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _chunks(a_path, b_path, arrow), f"chunk BIGINT, at INT, pair BIGINT, links BIGINT, doc {doc}"
    )
    rows = stages.write("chunks", rows)
    pairs, texts = rows.where("at IS NOT NULL"), rows.where("at IS NULL")
    counts = stages.write("counts", pair_counts(pairs, len(Pieces(b_path).bytes)))
    # a chunk's counts in the order of its pairs, then its texts
    told = pairs.join(counts, "pair").select("chunk", "at", "count", "best", F.lit(None).cast(doc).alias("doc"))
    asked = texts.select("chunk", "at", F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("boolean").alias("best"), "doc")
    dealt = told.union(asked).repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last())
    return dealt.mapInArrow(_score, f"doc_id {doc_type}, {_COUNTS}, n_best BIGINT, count_sum BIGINT")
