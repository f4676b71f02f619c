"""The crawl: rounds of fetch and discover over a page snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.functions import urls as U
from hrefloom.operators.links import INFRA, failed_pages, page_links
from hrefloom.plans.discover import accepted_links, failed_links
from hrefloom.sources.keyed_log import KeyedLog
from hrefloom.sources.snapshot import NOT_FOUND, fetch_pages, page_index
from hrefloom.workdir import work_dir as fresh_dir

MET_SCHEMA = "key STRING, url STRING, host STRING, round INT"
WORK_SCHEMA = "round INT, tracked BIGINT, completed BIGINT, outstanding BIGINT"


def _links_of(pages: DataFrame) -> DataFrame:
    """Accepted links of pages: ``page_id, src, url``; ``src`` is the page URL."""
    return accepted_links(page_links(pages)).select("page_id", F.col("page").alias("src"), "url")


def crawl(seeds: DataFrame, pages: DataFrame, max_rounds: int | None = None, work_dir: str | None = None) -> DataFrame:
    """``url`` seeds over ``page_id, url, html`` -> every URL met: ``url, host, round``.

    Seeds are round 0; they skip the rules and enter as written.  Round n+1
    holds the links first met on pages of round n.  It ends when a round finds
    nothing new.  With ``max_rounds`` it may end before; what was met last and
    not yet asked for is then left in ``work_dir``/frontier (empty otherwise).

    All pages are read and parsed once, into a narrow table of distinct links
    by page URL; a round is then one join of the frontier to that table and one
    of its distinct links to the log of URLs met, which lies in buckets: the
    round's links are shuffled to it, and it is read where they fall and never
    shuffled.  What is new is appended to the log, which is the result as well.
    Html is never touched again.  A page's base is its canonical URL, since that
    is how every URL but a seed is asked for; seeds fetch their pages on their
    own.  Every round is written to ``work_dir`` before the next starts: lineage
    stays short and a lost executor costs at most the tasks it ran.
    ``crawl_work`` reads what the rounds counted as they were written.
    """
    spark = pages.sparkSession
    root = fresh_dir(spark, "crawl") if work_dir is None else work_dir.rstrip("/")
    met = KeyedLog(spark, f"{root}/met", MET_SCHEMA, "key")
    # a folder that held another crawl
    met.drop(met.spans)

    def table(name: str, df: DataFrame) -> DataFrame:
        path = f"{root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def enter(n: int, urls: DataFrame) -> DataFrame:
        """Writes a round, which the log counts on the way."""
        met.append(n, urls.select("key", "url", U.host_of("url").alias("host"), F.lit(n).alias("round")))
        tracked.append(met.spans[-1].rows)
        # earlier rounds only: the next one starts from this one's rows
        met.compact(n)
        return met.rows_of(met.spans[-1:])

    tracked: list[int] = []
    frontier = enter(0, seeds.select("url").distinct().withColumn("key", U.url_key("url")))
    n = 0
    if max_rounds is None or max_rounds > 0:
        # where several pages share a canonical URL, the index keeps the one that answers
        index = table("index", page_index(pages))
        asked = pages.withColumn("url", U.canonicalise("url"))
        answers = _links_of(asked).join(index.select("page_id"), "page_id", "left_semi")
        links = table("links", answers.select("src", "url").distinct())

        # seeds: pages resolved against the URL exactly as given
        found, _ = fetch_pages(frontier.select("url", F.xxhash64("url").alias("seq")), pages, index)
        candidates = _links_of(found.withColumnRenamed("seq", "page_id"))
        while tracked[n] and (max_rounds is None or n < max_rounds):
            n += 1
            linked = table(f"candidates/round={n}", candidates.select("url").distinct())
            frontier = enter(n, met.unseen(linked, "url").withColumn("key", F.col("url")))
            candidates = links.join(frontier.select(F.col("key").alias("src")), "src")
    table("frontier", frontier.select("url", "host"))
    # a round's URLs are done when the next round is written
    done = [0, *tracked[:-1]]
    work = [(i, tracked[i], done[i], sum(tracked[: i + 1]) - sum(done[: i + 1])) for i in range(n + 1)]
    spark.createDataFrame(work, WORK_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/work")
    met.close()
    return met.stored().select("url", "host", "round")


def crawl_work(spark: SparkSession, work_dir: str) -> DataFrame:
    """What each round of the crawl in ``work_dir`` counted: ``round, tracked, completed, outstanding``.

    ``tracked`` URLs entered with the round, ``completed`` ones were asked for
    by its end, ``outstanding`` ones were not.  A crawl to the end has none left.
    """
    return spark.read.schema(WORK_SCHEMA).parquet(f"{work_dir.rstrip('/')}/work")


def _answering(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that answer a crawled URL, once each, under their canonical URL."""
    keys = crawled.select(U.canonicalise("url").alias("key")).distinct()
    ids = page_index(pages).join(keys, "key", "left_semi").select("page_id")
    return pages.withColumn("url", U.canonicalise("url")).join(ids, "page_id", "left_semi")


def crawl_failures(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """What a crawl could not read: links of its pages that are no URLs, pages without html.

    ``page_id, page, pos, href, error_class, error``.
    """
    answering = _answering(crawled, pages)
    return failed_links(page_links(answering)).unionByName(failed_pages(answering), allowMissingColumns=True)


def unanswered(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """Crawled URLs that no page answers: ``url, error_class, error``."""
    keyed = crawled.select("url", U.canonicalise("url").alias("key"))
    missing = keyed.join(page_index(pages), "key", "left_anti")
    return missing.select("url", F.lit(INFRA).alias("error_class"), F.lit(NOT_FOUND).alias("error"))
