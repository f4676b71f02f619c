"""Input tables derived from the given ones, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.functions.text import quoted
from hrefloom.functions.urls import host_of
from hrefloom.operators.skew import fill_cores

# Hrefs that exercise every rule; each page is given all of them.
PROBE_HREFS = (
    "https://assets.shop.example/bundle.min.js",
    "https://assets.shop.example/bundle.min.js/",
    "https://assets.shop.example/Photo.JPEG",
    "https://shop.example/css/guide",
    "https://pedia.example/w/index.php?title=Tea&veaction=edit",
    "https://pedia.example/w/index.php?title=Tea&diff",
    "https://pedia.example/wiki/Help:Contents",
    "https://pedia.example//wiki/Help:Contents",
    "https://pedia.example/wiki/Green_tea",
    "https://de.wiktionary.org./wiki/Tee",
    "https://GIST.GitLab.com/teas",
    "https://mygitlab.com/teas",
    "https://www.etsy.com/listing/1",
    "https://data.gov.example/set",
    "http://navy.mil",
    "http://hiddentea.onion/menu",
    "http://onion.tea.example/menu",
    "HTTPS://TEA.EXAMPLE:443/%54ea%2fpot?z=9&b=1&gclid=k#steep",
    "http://tea.example:80//pots//clay/",
    "http://tea.example:8081/pots/?q=oolong+tea&none=&flag&y=%7E&y=%2f",
    "https://me:secret@tea.example./cup",
    "https://tea.example/cup?locale=de&size=3",
    "https://tea.example",
    "https://tea.example/",
    "https://tea.example:000000000443/th%c3%a9?k=%C3%a9",
    "http://two words/x",
    "http://tea.example:tcp/x",
    "mailto:host@tea.example",
    "javascript:void(1)",
    "ftp://tea.example/leaf",
    "//static.tea.example/leaf",
    "/menu/today/",
    "../back/one",
    "./here",
    "../../../../p/../q/./r",
    "deep/leaf.html",
    "?kind=green&lang=de",
    "#steep",
    "",
    "http://mail.spam-farm.example.org/offer",
)

# An operator's own block rules.
SPAM_RULES = (
    ("cheap-pills.example.com", "domain", "spam"),
    ("casino-win.example.org", "domain", "spam"),
    ("free-bets.example.com", "domain", "spam"),
    ("spam-farm.example.org", "domain", "spam"),
    ("ads-track.example.org", "domain", "spam"),
    ("gov", "label", "government"),
    ("onion", "final_tld", "tor"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cores(table(spark, sf_dir, "pages"))


def probe_links(pages: DataFrame) -> DataFrame:
    """Every page with every probe: ``page_id, pos, page, href``."""
    hrefs = F.expr(f"posexplode(array({', '.join(map(quoted, PROBE_HREFS))})) AS (pos, href)")
    return pages.select("page_id", F.col("url").alias("page"), hrefs).select("page_id", "pos", "page", "href")


def probe_urls(pages: DataFrame) -> DataFrame:
    """Page URLs and probe hrefs as one URL column: ``page_id, pos, url``."""
    own = pages.select("page_id", F.lit(-1).alias("pos"), "url")
    return own.unionByName(probe_links(pages).select("page_id", "pos", F.col("href").alias("url")))


def probe_anchors() -> str:
    """The probes as HTML."""
    return "".join(f'<a href="{h.replace("&", "&amp;")}">x</a>' for h in PROBE_HREFS)


def rich_pages(pages: DataFrame) -> DataFrame:
    """Pages whose html ends in all the probes."""
    return pages.select("page_id", "url", F.concat("html", F.lit(probe_anchors())).alias("html"))


def _row_count(df: DataFrame):
    return df.agg(F.count("*").alias("n")).scalar()


def linked_pages(pages: DataFrame) -> DataFrame:
    """Pages that link to each other: page i to 7i+1 and 13i+5 (mod n)."""
    n = _row_count(pages)
    edges = pages.select(
        "page_id", F.explode(F.array(F.col("page_id") * 7 + 1, F.col("page_id") * 13 + 5)).alias("dst")
    ).withColumn("dst", F.col("dst") % n)
    targets = pages.select(F.col("page_id").alias("dst"), F.col("url").alias("target"))
    anchors = (
        edges.join(targets, "dst")
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "target", F.lit('">')))).alias("anchors"))
    )
    return pages.join(anchors, "page_id").select(
        "page_id", "url", F.concat("html", F.array_join("anchors", "")).alias("html")
    )


def arrivals(events: DataFrame, pages: DataFrame) -> DataFrame:
    """``seq, host, url, arrival_ms``: event k asks for page k mod n at its time."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    host = host_of("url")
    return (
        events.select(
            F.col("event_id").alias("seq"), (F.col("event_id") % _row_count(pages)).alias("page_id"), ms.alias("arrival_ms")
        )
        .join(pages.select("page_id", "url", host.alias("host")), "page_id")
        .select("seq", "host", "url", "arrival_ms")
    )


def redirects(pages: DataFrame) -> DataFrame:
    """Pages 10k to 10k+4 each redirect to the next one: chains of 1 to 5 hops."""
    src = pages.where(F.col("page_id") % 10 < 5).select(
        (F.col("page_id") + 1).alias("next_id"), F.col("url").alias("src")
    )
    dst = pages.select(F.col("page_id").alias("next_id"), F.col("url").alias("dst"))
    return src.join(dst, "next_id").select("src", "dst")


def work_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """``ts_ms, seq, delta``: +1 as an event arrives, -1 as its work ends."""
    arrived = arrivals(events, pages)
    return arrived.select(
        F.explode(
            F.array(
                F.struct(F.col("arrival_ms").alias("ts_ms"), (F.col("seq") * 2).alias("seq"), F.lit(1).alias("delta")),
                F.struct(
                    (F.col("arrival_ms") + F.col("seq") % 5000).alias("ts_ms"),
                    (F.col("seq") * 2 + 1).alias("seq"),
                    F.lit(-1).alias("delta"),
                ),
            )
        ).alias("e")
    ).select("e.*")


def spam_blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPAM_RULES), "rule STRING, kind STRING, category STRING")
