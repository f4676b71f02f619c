"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles.  Documents with the same
set are one node.  ``HASHES`` minima of a node's shingles are cut into bands;
nodes that agree in a band are candidates.  Of each minimum only the low
``BITS`` bits are kept, packed as bit planes: the bits that agree, corrected
for those that agree by chance, estimate the similarity of a candidate pair,
and pairs far below the threshold go.  What is left is confirmed on the full
sets.

Buckets are never expanded into all pairs.  In a few bands every node is first
compared with the smallest of its bucket, its best candidate alone; groups of
near copies become components there, and a bucket of one component needs no
more.  In the other buckets, of all bands, components are compared by one node
each, until that links no more.  Where a bucket then still holds several, nodes
are compared across them, each pair in one bucket that it shares, if it can be
alike at all: if its sizes allow it, and if it still can when what only one of
the nodes holds is taken off, which is exact and leaves little of families whose
members each differ in words of their own.  Their sets are at hand there, so a
sharper sketch of the same kind (the low bits of the least hash of each of
``BINS`` bins) picks pairs, and sets of up to ``BINS`` shingles are compared
whole before a pair leaves the join: what it makes are links, not the pairs of a
family that are near the threshold.  A pair at the threshold misses
all ``BANDS`` bands with a probability of 3e-6; estimates are asked for with a
margin of five standard errors, and nothing else is left out.

Texts, sets, nodes and buckets that a join needs are few among all, so a sieve of
fixed size (``common.sieved``) picks them before anything is shuffled.  Once it is
known which nodes stand in open buckets, only these are read again, and a pair that
was confirmed or refused is not tried a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages, sieved, text_of
from hrefloom.llm.components import components

HASHES, BANDS, ROWS, BITS = 256, 42, 6, 2
PERCENT = 80
# estimates this far below the threshold are more than five standard errors off
MARGIN = 0.16
# bins of the sketch of an open node, and five standard errors of its estimate
BINS, SHARP = 2048, 0.055
# bands whose buckets are turned into components first
FIRST_BANDS = 3
# rounds of one node for each component, and of leaving out nodes that are like no other
ROUNDS, PRUNINGS = 4, 2
# hashes of frequent words that a task remembers
_REMEMBERED = 200_000
# shingles that leave a task at a time
_SINGLES = 1 << 18
_SLICE = 256

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    for m in _MIX:
        h = h * m
        h ^= h >> np.uint64(33)
    return h


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        h = self.known.get(word)
        if h is None:
            h = xxhash.xxh64_intdigest(word)
            if len(self.known) < _REMEMBERED:
                self.known[word] = h
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        # A-Z are lowered and ASCII white space parts words, as bytes do it
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(self._word, words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(words))
        count = len(words) - size + 1
        h = np.full(count, size, dtype=np.uint64)
        for k in range(size):
            h = _mixed(h * _STEP + hashes[k : k + count])
        return np.unique(h)


def _planes(minima: np.ndarray) -> list[int]:
    """The low bits of the minima as ``BITS`` planes of 64-bit words."""
    planes = [np.packbits(((minima >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)]
    return np.concatenate(planes).tolist()


class Signer:
    """Shingle sets to minima: band keys and packed low bits."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[list[int], list[int]]:
        minima = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(shingles), _SLICE):
            hashed = shingles[i : i + _SLICE, None] * self.a
            hashed += self.b
            np.minimum(minima, (hashed >> np.uint64(32)).min(axis=0).astype(np.uint32), out=minima)
        rows = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            keys = _mixed(keys * _STEP + rows[:, k])
        return keys.view(np.int64).tolist(), _planes(minima)


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, row_key, text`` -> ``doc_id, row_key, node, n_shingles, bands, planes``; no node without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(size), Signer()
        for b in batches:
            nodes, counts, bands, planes = [], [], [], []
            for t in b.column(2):
                found = shingle(t.as_py())
                keys, low = sign(found) if len(found) else (None, None)
                nodes.append(node_of(found) if len(found) else None)
                counts.append(len(found))
                bands.append(keys)
                planes.append(low)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, longs), pa.array(planes, longs)],
                ["doc_id", "row_key", "node", "n_shingles", "bands", "planes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row_key BIGINT, node BINARY, n_shingles BIGINT, bands ARRAY<BIGINT>, planes ARRAY<BIGINT>")


def estimate(p: str, q: str) -> Column:
    """Similarity of two packed signatures: equal lanes, less those equal by chance."""
    words = HASHES // 64
    differ = " + ".join(
        "bit_count(" + " | ".join(f"({p}[{b * words + w}] ^ {q}[{b * words + w}])" for b in range(BITS)) + ")" for w in range(words)
    )
    chance = 2.0**-BITS
    return F.expr(f"((1 - ({differ}) / {HASHES}) - {chance}) / {1 - chance}")


def _sets(docs: DataFrame, nodes: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """``node, shingles`` of the nodes asked for (``node, row_key``; ``most`` at most), from one text of each."""
    texts = docs.select(F.xxhash64(text_of()).alias("row_key"), text_of().cast("binary").alias("text"))
    # copies meet before and in the shuffle that the join needs as well, so a text moves once
    texts = sieved(texts, "row_key", nodes, "row_key", most).where("_in = 1").groupBy("row_key").agg(F.min("text").alias("text"))
    texts = texts.join(nodes, "row_key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node BINARY, shingles BINARY")


def sketch(shingles: np.ndarray) -> list[int]:
    """Which of ``BINS`` bins hold a shingle, and the two low bits of the least hash in each, as planes of 64-bit words."""
    hashed = _mixed(shingles ^ _STEP)
    at = (hashed >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, at, hashed << np.uint64(BINS.bit_length() - 1))
    held = np.zeros(BINS, dtype=np.uint8)
    held[at] = 1
    # the bits come from another mix of the least hash, so they are even whatever the number of shingles
    low = _mixed(least + _STEP)
    planes = [held, ((low & np.uint64(1)) * held).astype(np.uint8), ((low >> np.uint64(1) & np.uint64(1)) * held).astype(np.uint8)]
    return np.concatenate([np.packbits(p).view(np.int64) for p in planes]).tolist()


def sharp_estimate(p: str, q: str) -> Column:
    """Similarity of two sketches: bins that agree, less those that agree by chance, of those that either holds."""
    n = BINS // 64
    both = " + ".join(f"bit_count({p}[{w}] & {q}[{w}])" for w in range(n))
    either = " + ".join(f"bit_count({p}[{w}] | {q}[{w}])" for w in range(n))
    equal = " + ".join(
        f"bit_count({p}[{w}] & {q}[{w}] & ~(({p}[{n + w}] ^ {q}[{n + w}]) | ({p}[{2 * n + w}] ^ {q}[{2 * n + w}])))" for w in range(n)
    )
    return F.expr(f"(({equal}) - ({both}) / 4) / 0.75 / greatest(1, {either})")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, shingles`` -> ``node, sketch, halves``: of sets of up to ``BINS`` shingles, the distinct upper halves of all."""
    for b in batches:
        sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in b.column(1)]
        halves = [np.unique(s >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(s) <= BINS else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(map(sketch, sets), pa.list_(pa.int64())), pa.array(halves, pa.list_(pa.int32()))], ["node", "sketch", "halves"]
        )


def most_common(p: str, q: str, n: str, m: str) -> Column:
    """Of two sets of ``n`` and ``m`` shingles by their halves: what they have in common at most, and but for equal halves just that; null if a set is long."""
    both = f"size(array_intersect({p}, {q})) + least({n} - size({p}), {m} - size({q}))"
    return F.expr(f"if({p} IS NULL OR {q} IS NULL, NULL, {both})")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, shingles`` -> a row per shingle."""
    for b in batches:
        nodes, sets, held = [], [], 0
        for node, shingles in zip(b.column(0).to_pylist(), b.column(1)):
            sets.append(np.frombuffer(shingles.as_py(), dtype=np.int64))
            nodes.append(node)
            held += len(sets[-1])
            if held >= _SINGLES or len(nodes) == b.num_rows:
                yield _flat(nodes, sets)
                nodes, sets, held = [], [], 0
        if nodes:
            yield _flat(nodes, sets)


def _flat(nodes: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    place = np.repeat(np.arange(len(nodes)), [len(s) for s in sets])
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()).take(pa.array(place)), pa.array(np.concatenate(sets))], ["node", "shingle"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                one, two = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["x", "y", "linked"])

    return run


def _fits(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be alike."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def among(df: DataFrame, keys: DataFrame, key: str = "node", most: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``keys`` (``most`` at most), and few others; no row moves."""
    return sieved(df, key, keys, key, most).where("_in = 1").drop("_in")


class _Search:
    """The state of one run: nodes, and the components found so far."""

    def __init__(self, docs: DataFrame, size: int, percent: int, stages: Stages):
        self.docs, self.size, self.percent, self.stages = docs, size, percent, stages
        keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("row_key"), text_of().cast("binary").alias("text"))
        signed = stages.write("signatures", _signatures(keyed, size))
        firsts = signed.where("node IS NOT NULL").dropDuplicates(["node"])
        self.nodes = stages.write("nodes", firsts.select("node", "row_key", "n_shingles", "bands", "planes"))
        self.rows = stages.write("rows", signed.select("doc_id", "row_key", "node", "n_shingles"))
        stages.drop("signatures")
        # no sieve of nodes holds more
        self.most = self.nodes.count()
        self.round = 0
        # pairs of the rounds so far: linked ones are in one component, the others never link
        self.tried: list[DataFrame] = []
        # the components, of nodes, before the last round that linked any, and that round's, of the nodes that stood for them
        self.roots: list[DataFrame] = []

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        """``node`` -> ``node, shingles``, written."""
        asked = self.stages.write("asked", nodes.join(self.nodes.select("node", "row_key"), "node"))
        sets = self.stages.write(name, _sets(self.docs, asked, self.size, self.most))
        self.stages.drop("asked")
        return sets

    def try_pairs(self, pairs: DataFrame, sets: DataFrame | None = None) -> bool:
        """``x, y`` -> confirms those pairs on full sets and joins the components they link; whether there are any."""
        self.round += 1
        pairs = pairs.select("x", "y").distinct()
        if self.tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tried), ["x", "y"], "left_anti")
        pairs = self.stages.write(f"pairs-{self.round}", pairs)
        if pairs.isEmpty():
            return False
        self.tried.append(pairs)
        asked = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        sets = self.sets_of(asked, "sets") if sets is None else among(sets, asked, most=self.most)
        one = sets.select(F.col("node").alias("x"), F.col("shingles").alias("p"))
        two = sets.select(F.col("node").alias("y"), F.col("shingles").alias("q"))
        full = pairs.join(one, "x").join(two, "y").select("x", "y", "p", "q")
        done = self.stages.write("confirmed", full.mapInArrow(_confirm(self.percent), "x BINARY, y BINARY, linked BOOLEAN").where("linked"))
        self.stages.drop("sets")
        found = not done.isEmpty()
        if found:
            self.fold(f"folded-{self.round}")
            links = self.rooted(self.rooted(done.select("x", "y"), "x", "_rx"), "y", "_ry")
            links = links.select(F.col("_rx").alias("x"), F.col("_ry").alias("y"))
            self.roots.append(components(links, self.stages, f"roots-{self.round}"))
        self.stages.drop("confirmed")
        return found

    def fold(self, name: str) -> None:
        """Makes one table of the rounds' components, so rows are placed by one join however many rounds there were."""
        if len(self.roots) > 1:
            first, last = self.roots
            # what a round links stood for components, so it has none of the nodes below them
            folded = self.rooted(first, "root", "root", 1).select("node", "root").unionByName(last.select("node", "root"))
            self.roots = [self.stages.write(name, folded)]

    def promising(self, pairs: DataFrame) -> DataFrame:
        """``x, y`` -> ``x, y, e``: the pairs whose sizes fit and whose estimate is near the threshold or above."""
        one = self.nodes.select(F.col("node").alias("x"), F.col("planes").alias("p"), F.col("n_shingles").alias("_n"))
        two = self.nodes.select(F.col("node").alias("y"), F.col("planes").alias("q"), F.col("n_shingles").alias("_m"))
        scored = pairs.distinct().join(one, "x").join(two, "y").where(_fits("_n", "_m", self.percent)).withColumn("e", estimate("p", "q"))
        return scored.where(F.col("e") >= self.percent / 100 - MARGIN).select("x", "y", "e")

    def rooted(self, rows: DataFrame, node: str, root: str, last: int | None = None) -> DataFrame:
        """Adds the component of a node; ``last``: of what was its component so many rounds ago."""
        rows = rows.withColumn(root, F.col(node))
        for step in self.roots if last is None else self.roots[-last:]:
            above = step.select(F.col("node").alias(root), F.col("root").alias("_above"))
            rows = rows.join(above, root, "left").withColumn(root, F.coalesce("_above", root)).drop("_above")
        return rows

    def keep_open(self, rows: DataFrame) -> None:
        """Forgets all nodes but those of ``rows``: components only grow, so no other is asked for again."""
        live = rows.select("node").distinct()
        kept = among(self.nodes, live, most=self.most).join(live, "node", "left_semi")
        self.nodes = self.stages.write("open-nodes", kept.select("node", "row_key", "n_shingles", "planes"))
        self.most = self.nodes.count()
        self.stages.drop("nodes")

    def first_stars(self) -> DataFrame:
        """The best candidate of each node among the smallest nodes of its first buckets."""
        buckets = self.nodes.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
        least = buckets.groupBy("bucket").agg(F.min("node").alias("y"), F.count("*").alias("n")).where("n > 1").drop("n")
        stars = buckets.join(least, "bucket").where("node > y").select(F.col("node").alias("x"), "y")
        return self.promising(stars).groupBy("x").agg(F.max_by("y", F.struct("e", "y")).alias("y"))

    def several(self, marked: DataFrame) -> DataFrame:
        """``bucket, r`` -> the buckets that hold more than one r."""
        found = marked.groupBy("bucket").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("bucket")
        return self.stages.write("several", found)

    def open_rows(self) -> DataFrame:
        """``bucket, node`` of the buckets that hold several components.

        Most buckets hold one: they go by a narrow count before anything wider
        is dealt, and nothing reads them again, since components only grow.
        """
        nodes = self.nodes.select("node", "bands")
        rooted = nodes.withColumn("root", F.col("node"))
        if self.roots:
            # the bands of nodes that were not linked stay where they are
            marked = sieved(nodes, "node", reduce(DataFrame.unionByName, self.roots), "node", self.most)
            moved = self.rooted(marked.where("_in = 1").drop("_in"), "node", "root")
            rooted = moved.unionByName(marked.where("_in IS NULL").drop("_in").withColumn("root", F.col("node")))
        several = self.several(rooted.select(F.xxhash64("root").alias("r"), F.explode("bands").alias("bucket")))
        rows = among(self.nodes.select("node", F.explode("bands").alias("bucket")), several, "bucket", several.count())
        return self.stages.write("open-0", rows.join(several, "bucket").select("bucket", "node"))

    def still_open(self, rows: DataFrame, name: str) -> DataFrame:
        """``bucket, node, root`` of the buckets of ``rows`` that hold several components still.

        Rows with a root have that of the round before.
        """
        placed = self.rooted(rows, "root", "root", 1) if "root" in rows.columns else self.rooted(rows, "node", "root")
        rooted = self.stages.write("rooted", placed.select("bucket", "node", "root"))
        several = self.several(rooted.select("bucket", F.xxhash64("root").alias("r")))
        return self.stages.write(name, rooted.join(several, "bucket").select("bucket", "node", "root"))

    def representatives(self, rows: DataFrame) -> DataFrame:
        """Of every bucket, a node of each component with one of the smallest component.

        A component is one row of the aggregate however many nodes it has there.
        """
        per_root = self.stages.write("per-root", rows.groupBy("bucket", "root").agg(F.min("node").alias("x")))
        least = per_root.groupBy("bucket").agg(F.min(F.struct("root", "x")).alias("l"))
        joined = per_root.join(least, "bucket").where("root <> l.root")
        return self.promising(joined.select(F.greatest("x", "l.x").alias("x"), F.least("x", "l.x").alias("y")))

    def pruned(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """``rows`` and ``n, c`` of their nodes: the size of a set, and of what of it some other node of ``rows`` holds too.

        A node's link to another lies in those shingles, so one that holds too
        few of them has none, and without it others may fall below as well.  A set
        that the sieve lets through by chance makes shingles look shared, no link less.
        """
        sizes = self.nodes.select("node", F.col("n_shingles").alias("n"))
        for k in range(PRUNINGS):
            live = rows.select("node").distinct()
            singles = among(sets, live, most=self.most).mapInArrow(_one_by_one, "node BINARY, shingle BIGINT")
            alone = singles.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("u"))
            held = live.join(sizes, "node").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
            held = self.stages.write(f"held-{k}", held.where(F.col("c") * 100 >= F.col("n") * self.percent))
            kept = self.stages.write("kept", rows.select("bucket", "node", "root").join(held, "node"))
            several = self.several(kept.select("bucket", F.xxhash64("root").alias("r")))
            rows = self.stages.write(f"pruned-{k}", kept.join(several, "bucket"))
        return rows

    def across(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of a bucket's nodes that are in different components still.

        The largest component of a bucket is compared with the others only, and
        of the buckets that a pair shares the least one names it.  The estimate,
        the bounds and the comparison of whole sets are part of the join: other
        pairs never leave it.
        """
        rows = self.pruned(rows, sets)
        sharp = among(sets, rows.select("node").distinct(), most=self.most).mapInArrow(_sketches, "node BINARY, sketch ARRAY<BIGINT>, halves ARRAY<INT>")
        sharp = self.stages.write("sketches", sharp)
        counted = rows.groupBy("bucket", F.xxhash64("root").alias("r")).agg(F.count("*").alias("k"))
        body = counted.groupBy("bucket").agg(F.max_by("r", F.struct("k", "r")).alias("body"))
        buckets = rows.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
        signed = rows.withColumn("r", F.xxhash64("root")).join(body, "bucket").join(buckets.join(sharp, "node"), "node")
        signed = signed.withColumn("earlier", F.expr("filter(buckets, b -> b < bucket)"))
        signed = self.stages.write("signed", signed.select("bucket", "node", "r", "body", "n", "c", "sketch", "halves", "earlier"))
        self.stages.drop("sketches")
        one = signed.where("r <> body").select(
            "bucket", F.col("node").alias("x"), F.col("r").alias("_r"), F.col("n").alias("_n"), F.col("c").alias("_c"),
            F.col("sketch").alias("p"), F.col("halves").alias("_halves"), F.col("earlier").alias("_earlier"),
        )
        two = signed.select("bucket", F.col("node").alias("y"), "r", "body", "n", "c", F.col("sketch").alias("q"), "halves", "earlier")
        apart = (F.col("_r") < F.col("r")) | ((F.col("r") == F.col("body")) & (F.col("_r") > F.col("r")))
        most = F.least("_c", "c")
        possible = 100 * most >= self.percent * (F.col("_n") + F.col("n") - most)
        near = sharp_estimate("p", "q") >= self.percent / 100 - SHARP
        first = ~F.arrays_overlap("_earlier", "earlier")
        both = most_common("_halves", "halves", "_n", "n")
        # last, as it costs most
        linked = F.coalesce(100 * both >= self.percent * (F.col("_n") + F.col("n") - both), F.lit(True))
        pairs = one.join(two, "bucket").where(apart & possible & near & first & linked)
        return pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))

    def run(self) -> None:
        self.try_pairs(self.first_stars())
        rows = self.still_open(self.open_rows(), "open-1")
        if rows.isEmpty():
            return
        self.keep_open(rows)
        sets = self.sets_of(rows.select("node").distinct(), "open-sets")
        for n in range(ROUNDS):
            if not self.try_pairs(self.representatives(rows), sets):
                break
            rows = self.still_open(rows, f"open-{n + 2}")
        if not rows.isEmpty():
            self.try_pairs(self.across(rows, sets), sets)
        self.stages.drop("open-nodes", "open-sets", "signed", "kept", "rooted", "per-root", "several", *(f"open-{n}" for n in range(ROUNDS + 2)))


def near_duplicates(docs: DataFrame, stages: Stages, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, row_key, n_shingles, component_id, kept``, a row per row.

    Documents are linked if 100 * common shingles >= ``percent`` * all
    shingles; ``component_id`` is the smallest id of those linked directly or
    through others, and ``kept`` marks it.  A text of fewer than ``size`` words
    is one shingle; a null text or one without words has none and stands
    alone.  Rows of one id that stand in several components are judged each in
    its own.  A null id is kept only where a component has no other.
    """
    search = _Search(docs.select("doc_id", "text"), size, percent, stages)
    search.run()
    search.fold("folded")
    placed = stages.write("placed", search.rooted(search.rows, "node", "root"))
    stages.drop("rows", "nodes", *(f"pairs-{n + 1}" for n in range(search.round)))
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = placed.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select(
        "doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
