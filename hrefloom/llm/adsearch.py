"""Approximate nearest neighbours by an adaptive dimension scan.

Inner products become distances when every vector gets one more component that
brings it to the greatest norm of all.  Vectors are rotated at random, so the
first dimensions of a difference tell of the others, and dealt into lists
around centroids (fitted on a bounded sample; every vector is indexed).  A
query scores the few lists nearest to it in full, which bounds the distance of
what it still looks for, and then scans its other lists: distances are summed
up over blocks of columns, and after each block a candidate is abandoned if
its partial distance would be this large by chance only with a small
probability, were it within the bound.  What survives is scored exactly, in
double precision on the original vectors.

A query scans its nearest lists, a share ``PROBED`` of all, and every list after
these as long as the lists before it hold fewer than ``ENOUGH`` (or ``k + 1``)
candidates together.  So a table of that many distinct vectors is scanned whole,
and no query stays short of rows that there are candidates for.

Equal vectors are one candidate with their smallest ids, and one query, so a
vector that a third of all rows share costs what one costs.  Lists are put
together in shards, and a query is sent to a shard once, with the numbers of the
lists that it scans there; a shard and its queries are cut into tiles of bounded
size.  So a query has a copy per shard and a vector one per tile of queries, and
both numbers only grow where tiles are full.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages, by_hash

SAMPLE = 20_000
MOST_LISTS = 16_384
# lists that bound a query, and the share of all lists that it scans
NEAR = 2
PROBED = 0.7
# a query goes on to further lists while those before held fewer candidates
ENOUGH = 1024
# vectors of a shard and queries of a tile: a small table is cut into this many pieces, a large one by the second bound
PIECES = 16
TILE_VECTORS, TILE_QUERIES = (4096, 32_768), (1024, 16_384)
COLUMNS = 16  # of a block
STEP = 64  # queries of a tile that are worked on together
# standard errors that a partial distance may be too large by
STRICT = 2.1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` -> ``vec_id, v`` as doubles, repeated rows once.

    Rows without an id take no part, nor do vectors that are null, zero, hold
    null, NaN or infinite components, or differ in length from most others
    (the greater length, where two are as common).
    """
    doubles = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    sound = doubles.where(
        "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    )
    common = sound.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    size = common[0]["n"] if common else 0
    return sound.where(F.size("v") == size).distinct()


def _smallest(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before it shuffles them."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_n") <= k)


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(model: bytes) -> dict:
    with np.load(io.BytesIO(model)) as f:
        return {k: f[k] for k in f.files}


def _augmented(v: np.ndarray, radius: float) -> np.ndarray:
    rest = np.maximum(radius * radius - np.einsum("nd,nd->n", v, v), 0)
    return np.concatenate([v, np.sqrt(rest)[:, None]], axis=1)


def _nearest_lists(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    d = np.einsum("cd,cd->c", centroids, centroids) - 2 * x @ centroids.T
    if k == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def fit(sample: np.ndarray, lists: int, radius: float, seed: int = 13) -> bytes:
    """Rotation and centroids from sample rows (k-means, a fixed number of rounds)."""
    rng = np.random.default_rng(seed)
    x = _augmented(sample, radius)
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    x = x @ rotation
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(8):
        own = np.concatenate([_nearest_lists(x[i : i + 4096], centroids, 1)[:, 0] for i in range(0, len(x), 4096)])
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x[:, k], len(centroids)) for k in range(x.shape[1])], axis=1)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return _packed(rotation=rotation, centroids=centroids, radius=np.array([radius]))


def _rotated(model: dict, v: np.ndarray, query: bool) -> np.ndarray:
    full = np.concatenate([v, np.zeros((len(v), 1))], axis=1) if query else _augmented(v, float(model["radius"][0]))
    return full @ model["rotation"]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _place(model: bytes, names: list[str]):
    """Rows with their nearest list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _unpacked(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                lists = _nearest_lists(_rotated(m, _matrix(b.column(names.index("v"))), False), m["centroids"], 1)
                yield pa.RecordBatch.from_arrays([pa.array(lists[:, 0].astype(np.int32)), *b.columns], ["list", *names])

    return run


def shards_of(sizes: np.ndarray, vectors: int) -> np.ndarray:
    """The shard of each list: neighbours in number, together about ``vectors`` vectors; a larger list is a shard alone."""
    shards, shard, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for n, size in enumerate(sizes.tolist()):
        if held and held + size > vectors:
            shard, held = shard + 1, 0
        shards[n], held = shard, held + size
    return shards


def _probe(model: bytes, probes: int, sizes: np.ndarray, shards: np.ndarray, enough: int, names: list[str]):
    """Rows with each of their ``probes`` nearest lists, and more until ``enough`` candidates are held.

    A row for each shard that holds some: its lists, the ``NEAR`` nearest ones
    apart from those further away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _unpacked(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lists = _nearest_lists(_rotated(m, _matrix(b.column(names.index("v"))), True), m["centroids"], len(sizes))
                own = sizes[lists]
                row, nth = np.nonzero((np.arange(len(sizes)) < probes) | (np.cumsum(own, axis=1) - own < enough))
                chosen, further = lists[row, nth], nth >= NEAR
                order = np.lexsort((chosen, shards[chosen], further, row))
                row, chosen, further = row[order], chosen[order], further[order]
                key = (row * 2 + further) * (int(shards.max()) + 1) + shards[chosen]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(chosen.astype(np.int32)))
                columns = [c.take(pa.array(row[starts])) for c in b.columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[chosen[starts]].astype(np.int32)), pa.array(further[starts]), held, *columns], ["shard", "further", "lists", *names]
                )

    return run


def scan(x: np.ndarray, v: np.ndarray, q: np.ndarray, qv: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, product) of the candidates that no test abandons.

    ``x`` and ``q`` are the rotated forms of ``v`` and ``qv``; ``least`` is the
    product that a query's candidates must reach.
    """
    size = x.shape[1]
    # |q - x|^2 of the augmented vectors goes by the product alone
    constant = np.einsum("nd,nd->n", q, q) + float(x[0] @ x[0])
    bound = constant - 2 * least + 1e-9 * constant
    i = j = partial = None
    for c in range(0, size, COLUMNS):
        qb, xb = q[:, c : c + COLUMNS], x[:, c : c + COLUMNS]
        done = c + qb.shape[1]
        most = bound if done == size else bound * (done / size) * (1 + STRICT / np.sqrt(done)) ** 2
        if i is None:  # the first block, of all candidates
            sums = np.einsum("nd,nd->n", qb, qb)[:, None] + np.einsum("nd,nd->n", xb, xb) - 2 * qb @ xb.T
            i, j = np.nonzero(sums <= most[:, None])
            partial = sums[i, j]
        else:
            difference = qb[i] - xb[j]
            partial += np.einsum("nd,nd->n", difference, difference)
            near = partial <= most[i]
            i, j, partial = i[near], j[near], partial[near]
    return i, j, np.einsum("nd,nd->n", qv[i], v[j])


def _top(i: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each i, in order; ties to the smaller ``first``."""
    order = np.lexsort((first, -score, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


def _tile(model: bytes, k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            m = _unpacked(model)
            vectors = vectors.sort_values("list")
            ids = vectors["ids"].to_numpy()
            first = np.array([own[0] for own in ids])
            v = np.stack(vectors["v"].to_numpy()).astype(np.float64)
            x = _rotated(m, v, False)
            lists, starts = np.unique(vectors["list"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(v))
            qv = np.stack(queries["v"].to_numpy()).astype(np.float64)
            q, names = _rotated(m, qv, True), queries["query_key"].to_numpy()
            least = queries["least"].to_numpy(dtype=np.float64)
            asked = queries["lists"].to_numpy()
            for at in range(0, len(q), STEP):
                some = asked[at : at + STEP]
                who = at + np.repeat(np.arange(len(some)), [len(a) for a in some])
                wanted = np.concatenate(some)
                parts = []
                for n, (start, end) in zip(lists, zip(starts, ends)):
                    own = who[wanted == n]
                    if len(own):
                        i, j, score = scan(x[start:end], v[start:end], q[own], qv[own], least[own])
                        best = _top(i, score, first[start:end][j], k)
                        parts.append((own[i[best]], start + j[best], score[best]))
                if parts:
                    i, j, score = (np.concatenate(p) for p in zip(*parts))
                    best = _top(i, score, first[j], k)
                    found.append(pd.DataFrame({"query_key": names[i[best]], "score": score[best], "ids": ids[j[best]]}))
        empty = pd.DataFrame({"query_key": pd.Series(dtype=str), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})
        return pd.concat(found) if found else empty

    return run


def _scan_shards(indexed: DataFrame, probes: DataFrame, model: bytes, k: int, vectors: int, queries: int) -> DataFrame:
    """``shard, list, v, ids`` and ``shard, lists, v, query_key, least`` -> ``query_key, score, ids``, at most ``k`` of a query and tile."""
    # a row per shard: into how many tiles its vectors and its queries are cut
    tiles = indexed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * vectors)).cast("int").alias("across")).join(
        probes.groupBy("shard").agg(F.ceil(F.count("*") / queries).cast("int").alias("down")), "shard"
    )
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(tiles, "shard").withColumn("i", own("v", "across")).withColumn("j", every("down"))
    right = probes.join(tiles, "shard").withColumn("j", own("query_key", "down")).withColumn("i", every("across"))
    cell = ["shard", "i", "j"]
    return left.select(*cell, "list", "v", "ids").groupBy(*cell).cogroup(right.select(*cell, "lists", "v", "query_key", "least").groupBy(*cell)).applyInPandas(
        _tile(model, k), "query_key STRING, score DOUBLE, ids ARRAY<BIGINT>"
    )


def search(vectors: DataFrame, queries: DataFrame, stages: Stages, k: int = 20, probed: float = PROBED) -> DataFrame:
    """``vec_id, embedding`` twice -> ``query_id, rank, vec_id, score``.

    For each query the ``k`` largest inner products found with vectors of
    another id, nearest first, ties to the smaller id.  Rows that ``usable``
    leaves out take no part on either side.  Empty tables give no rows.
    """
    rows = stages.write("rows", usable(vectors))
    # one more than asked for: a query's own id is among them
    firsts = _smallest(rows, ["v"], ["vec_id"], k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = stages.write("distinct", firsts)
    total, radius = distinct.agg(F.count("*"), F.sqrt(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")))).first()
    lists = int(min(MOST_LISTS, max(1, np.sqrt(total))))
    sample = by_hash(distinct.select("v"), ["v"], SAMPLE)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if seen:
            yield pa.RecordBatch.from_pydict({"model": pa.array([fit(np.concatenate(seen), lists, radius)], pa.binary())})

    fitted = sample.coalesce(1).mapInArrow(train, "model BINARY").first()
    model = fitted["model"] if fitted else _packed(rotation=np.eye(1), centroids=np.zeros((1, 1)), radius=np.zeros(1))

    asked = stages.write("asked", usable_queries(rows, queries))
    wanted = asked.select("v").distinct().withColumn("query_key", F.concat_ws(":", F.xxhash64("v"), F.hash("v"), F.crc32(F.col("v").cast("string").cast("binary"))))
    wanted = stages.write("wanted", wanted)
    indexed = distinct.mapInArrow(_place(model, ["v", "ids"]), "list INT, v ARRAY<DOUBLE>, ids ARRAY<BIGINT>")
    indexed = stages.write("indexed", indexed)
    count = max(1, int(np.ceil(probed * lists)))
    # a number per list
    sizes = np.zeros(lists, dtype=np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    cut = lambda n, bounds: int(min(bounds[1], max(bounds[0], n // PIECES)))
    per_shard, per_tile = cut(total, TILE_VECTORS), cut(wanted.count(), TILE_QUERIES)
    shards = shards_of(sizes, per_shard)
    probe = _probe(model, count, sizes, shards, max(ENOUGH, k + 1), ["v", "query_key"])
    probes = stages.write("probes", wanted.mapInArrow(probe, "shard INT, further BOOLEAN, lists ARRAY<INT>, v ARRAY<DOUBLE>, query_key STRING"))
    # a number per list
    shard = F.element_at(F.split(F.lit(",".join(map(str, shards.tolist()))), ",").cast("array<int>"), F.col("list") + 1)
    indexed = indexed.withColumn("shard", shard)
    none = F.lit(float("-inf"))
    near = _scan_shards(indexed, probes.where("NOT further").withColumn("least", none), model, k + 1, per_shard, per_tile)
    near = stages.write("near", near)
    # the product a query has k others for already; with fewer there is no bound
    kth = _smallest(near, ["query_key"], [F.desc("score"), F.col("ids")[0]], k + 1).where(F.col("_n") == k + 1)
    bounds = kth.select("query_key", F.col("score").alias("least"))
    further = probes.where("further").join(bounds, "query_key", "left").na.fill(float("-inf"), ["least"])
    found = near.unionByName(_scan_shards(indexed, further, model, k + 1, per_shard, per_tile))
    best = _smallest(found, ["query_key"], [F.desc("score"), F.col("ids")[0]], k + 1)
    each = best.select("query_key", "score", F.explode("ids").alias("vec_id"))
    nearest = _smallest(each, ["query_key"], [F.desc("score"), "vec_id"], k + 1)
    packed = nearest.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    answered = asked.join(wanted, "v").select("query_id", "query_key").join(packed, "query_key")
    others = F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {k})")
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score")
    )


def usable_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, v`` of the usable rows whose ids are asked for."""
    ids = queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    return rows.join(ids, "vec_id").select(F.col("vec_id").alias("query_id"), "v")
