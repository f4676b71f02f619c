"""Link discovery: pages in, new crawlable URLs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions import policy
from hrefloom.functions import urls as U
from hrefloom.operators.links import DOMAIN, failed_pages, page_links
from hrefloom.operators.numbering import global_index
from hrefloom.sources.keyed_log import SeenBatch

# links of 2**PAGE_LEAF_BITS consecutive pages are numbered together
PAGE_LEAF_BITS = 12


def accepted_links(links: DataFrame) -> DataFrame:
    """Resolved links that pass block list and filter: ``+ url, host``.

    Both rules look at the link as written, before canonicalisation, so a link
    to ``/app.js/`` passes although it becomes ``/app.js``.
    """

    kept = [c for c in links.columns if c not in ("pieces", "error")]
    # an explode of one element: the filter below must not repeat this part
    hosted = links.where("pieces IS NOT NULL").selectExpr(
        *kept, f"inline(array(struct(pieces, {policy.bare_host_of('pieces')} AS host)))"
    )
    good = hosted.where(f"{policy.accept_sql('pieces')} AND NOT {policy.blocked_host_sql('host')}")
    return good.selectExpr(*kept, f"{U.canonical_sql(U.parts_of_pieces('pieces'))} AS url", "host")


def failed_links(links: DataFrame) -> DataFrame:
    """Links with no absolute URL: ``page_id, page, pos, href, error_class, error``."""
    return links.where(F.col("error").isNotNull()).select(
        "page_id", "page", "pos", "href", F.lit(DOMAIN).alias("error_class"), "error"
    )


def new_links(links: DataFrame, seen: DataFrame | None = None, order: str = "page_id") -> DataFrame:
    """First sight of each URL not in ``seen(key)``: ``order, pos, page, url, host``.

    One shuffle by URL.  Repeats of a popular link go in the partial aggregate
    before it, and the aggregate leaves the rows sorted for the anti join.
    """
    # the host comes after the order in the struct, so it never decides
    first = F.min(F.struct(order, "pos", "page", "host")).alias("_first")
    firsts = links.groupBy("url").agg(first)
    if seen is not None:
        firsts = firsts.join(seen.select(F.col("key").alias("url")), "url", "left_anti")
    return firsts.select(f"_first.{order}", "_first.pos", "_first.page", "url", "_first.host")


def discover_links(
    pages: DataFrame, seen: DataFrame | SeenBatch | None = None, work_dir: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``page_id, url, html`` -> (new ``seq, page, url, host``, quarantined).

    Extract, drop blocked, filter, canonicalise, keep first sights, in that
    order.  ``seq`` counts the new URLs by page order (``seq`` of the pages
    where they have one, else ``page_id``) and position on the page.

    The two results are two queries.  With ``work_dir`` the resolved links are
    written there first, so that both read them and the pages are parsed once;
    so are the first sights, which the numbering reads more than once.

    ``seen`` may also be a batch of a ``KeyedLog``, which is then joined where it
    lies: only the first sights are shuffled, and they need ``work_dir``.
    """
    order = "seq" if "seq" in pages.columns else "page_id"
    if "page_id" not in pages.columns:
        pages = pages.withColumn("page_id", F.col("seq"))
    links = page_links(pages, *(["seq"] if order == "seq" else []))

    def staged(name: str, df: DataFrame) -> DataFrame:
        if work_dir is None:
            return df
        path = f"{work_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    links = staged("links", links)
    logged = isinstance(seen, SeenBatch)
    firsts = new_links(accepted_links(links), None if logged else seen, order).withColumnRenamed(order, "_order")
    firsts = staged("firsts", firsts)
    if logged:
        firsts = staged("new", seen.unseen(firsts, "url"))
    numbered = global_index(firsts, ["_order", "pos"], "seq", PAGE_LEAF_BITS)
    bad = failed_links(links).unionByName(failed_pages(pages), allowMissingColumns=True)
    return numbered.select("seq", "page", "url", "host"), bad
