"""Fetching from a page snapshot: the table stands in for the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.urls import canonicalise
from hrefloom.operators.links import INFRA
from hrefloom.operators.skew import salted_join

# id ranges that a fetch asks its snapshot for, at most
ID_RANGES = 256
# bytes of a row group of a stored snapshot
ROW_GROUP = 8 << 20

NOT_FOUND = "page is not in the snapshot"
TOO_MANY_REDIRECTS = "too many redirects"


def page_index(pages: DataFrame) -> DataFrame:
    """``key, page_id``: the page that answers each canonical URL (lowest id wins).

    Reads the two narrow columns only; the page content is not touched.
    """
    keyed = pages.select(canonicalise("url").alias("key"), "page_id").where(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))


def store_snapshot(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``page_id, url, html`` by ``page_id`` in small row groups, and reads it back.

    Ids that lie together are pages that lie together, so a filter on ranges of
    ids skips files, row groups and pages of the files by their statistics.
    """
    ordered = pages.repartitionByRange("page_id").sortWithinPartitions("page_id")
    ordered.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
    return pages.sparkSession.read.schema(pages.schema).parquet(path)


def id_ranges(ids: DataFrame, limit: int = ID_RANGES) -> list[tuple[int, int]]:
    """At most ``limit`` ranges that hold all ``page_id``s, inclusive and apart.

    The ids' own range is cut into ``limit`` equal pieces; those that hold an id
    shrink to what they hold, and neighbours without a gap are one.
    """
    low, high = ids.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    width = (high - low) // limit + 1
    piece = F.expr(f"(page_id - ({low})) div {width}")
    held = ids.where("page_id IS NOT NULL").groupBy(piece.alias("piece")).agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    out: list[tuple[int, int]] = []
    for r in sorted(tuple(r) for r in held.select("low", "high").collect()):
        if out and r[0] == out[-1][1] + 1:
            out[-1] = out[-1][0], r[1]
        else:
            out.append(r)
    return out


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Whether ``page_id`` lies in one of the ranges: a filter that reaches the scan."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | F.col("page_id").between(low, high)
    return out


def fetch_pages(
    frontier: DataFrame, pages: DataFrame, index: DataFrame | None = None, work_dir: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``seq, url`` against ``page_id, url, html`` -> (found, missing).

    Pages are matched on the canonical URL of both sides, and a found page
    keeps the URL that was asked for.  The match is settled on narrow columns.
    The content is cut down to the pages that are wanted before it is joined;
    that cut is free where Spark can broadcast the wanted ids, and one shuffle
    of the content by ``page_id`` where it can't.  Many spellings may ask for
    one page: the index is probed with distinct keys, and the answers and the
    content go back by salted joins.  ``index`` is a stored ``page_index``
    of these pages.

    With ``work_dir`` the content comes late: what matched is written there, the
    wanted ids become ranges, and the scan of the content is filtered by these.
    Of pages in ``store_snapshot``'s order html that nobody asked for is then
    neither shuffled nor, but for neighbours of wanted pages, read.
    """
    wanted = frontier.withColumn("key", canonicalise("url"))
    keys = wanted.select("key").distinct()
    answers = keys.join(page_index(pages) if index is None else index, "key")
    matched = salted_join(wanted, answers, "key", "left")
    content = pages.select("page_id", "html")
    if work_dir is not None:
        matched.write.mode("overwrite").parquet(f"{work_dir.rstrip('/')}/matched")
        matched = pages.sparkSession.read.schema(matched.schema).parquet(f"{work_dir.rstrip('/')}/matched")
        answers = matched.where(F.col("page_id").isNotNull()).select("page_id").distinct()
        content = content.where(in_ranges(id_ranges(answers)))
    content = content.join(answers.select("page_id"), "page_id", "left_semi")
    hit = matched.where(F.col("page_id").isNotNull()).select("url", "seq", "page_id")
    found = salted_join(hit, content, "page_id", "inner").select("url", "html", "seq")
    missing = matched.where(F.col("page_id").isNull()).select(
        "url", F.lit(INFRA).alias("error_class"), F.lit(NOT_FOUND).alias("error")
    )
    return found, missing


def resolve_redirects(df: DataFrame, redirects: DataFrame, max_hops: int = 3) -> DataFrame:
    """``url`` -> ``url, final_url, hops, error_class`` over ``redirects(src, dst)``.

    A URL that still redirects after ``max_hops`` is a failure.  The URLs of
    the table are walked to their ends once; the input then meets the ends in
    one join.  Many URLs may lead to one target (a login page) and many rows
    may hold one URL, so both are salted joins.
    """
    table = redirects.groupBy(F.col("src").alias("_at")).agg(F.min("dst").alias("_next"))
    walk = table.select(F.col("_at").alias("url"), F.col("_next").alias("_at"), F.lit(1).alias("hops"))
    for _ in range(max_hops - 1):
        walk = salted_join(walk, table, "_at", "left").select(
            "url",
            F.coalesce("_next", "_at").alias("_at"),
            (F.col("hops") + F.col("_next").isNotNull().cast("int")).alias("hops"),
        )
    last = salted_join(walk, table, "_at", "left")
    stuck = F.col("_next").isNotNull()
    ends = last.select("url", F.when(~stuck, F.col("_at")).alias("_end"), F.col("hops").alias("_hops"), stuck.alias("_stuck"))
    extra = [c for c in df.columns if c not in ("url", "final_url", "hops", "error_class")]
    met = salted_join(df.select("url", *extra), ends, "url", "left")
    return met.select(
        "url",
        *extra,
        F.when(F.col("_hops").isNull(), F.col("url")).otherwise(F.col("_end")).alias("final_url"),
        F.coalesce("_hops", F.lit(0)).alias("hops"),
        F.when(F.col("_stuck"), INFRA).alias("error_class"),
    )
