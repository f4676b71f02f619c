"""From pages to links: extract, resolve, report, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions import html as H
from hrefloom.functions import urls as U
from hrefloom.functions.text import let

DOMAIN, INFRA = "domain", "infra"
BAD_HREF = "href is not a valid URI reference"
NO_BASE = "page URL is not an absolute URL"
NO_HTML = "page has no content"


def _no_dots(path: str) -> str:
    """RFC 3986 5.2.4 for an absolute path."""
    step = r"CASE s WHEN '..' THEN regexp_replace(d, '/[^/]*\\z', '') WHEN '.' THEN d ELSE concat(d, '/', s) END"
    walked = f"aggregate(split(substr({path}, 2), '/'), '', (d, s) -> {step})"
    tail = rf"if({path} RLIKE '/[.][.]?\\z', '/', '')"
    return f"if(startswith({path}, '/') AND instr({path}, '/.') > 0, concat({walked}, {tail}), {path})"


def _own_host(r: str) -> str:
    return f"({r}[{U.SCHEME}] <> '' OR {r}[{U.SLASHES}] <> '')"


def _own(r: str) -> str:
    return f"({_own_host(r)} OR {r}[{U.PATH}] <> '')"


def merged_sql(b: str, r: str) -> str:
    """Path of a reference ``r`` on a base ``b``, dots not removed yet."""
    root = f"{b}[{U.SLASHES}] <> '' AND {b}[{U.PATH}] = ''"
    folder = rf"if({root}, '/', regexp_replace({b}[{U.PATH}], '[^/]*\\z', ''))"
    rooted = f"{_own_host(r)} OR startswith({r}[{U.PATH}], '/')"
    path = f"if({rooted}, {r}[{U.PATH}], concat({folder}, {r}[{U.PATH}]))"
    return f"if({_own(r)}, {path}, {b}[{U.PATH}])"


def resolved_sql(b: str, r: str, path: str) -> str:
    """RFC 3986 5.2.2: pieces of a reference on a base, with their merged path."""

    def inherited(i: int, own: str) -> str:
        return f"if({own}, {r}[{i}], {b}[{i}])"

    pieces = [
        inherited(U.SCHEME, f"{r}[{U.SCHEME}] <> ''"),
        *[inherited(i, _own_host(r)) for i in (U.SLASHES, U.USERINFO, U.HOST, U.PORT)],
        f"if({_own(r)}, {_no_dots(path)}, {path})",
        inherited(U.QUERY, f"{_own(r)} OR {r}[{U.QUERY}] <> ''"),
        f"{r}[{U.FRAGMENT}]",
    ]
    return f"array({', '.join(pieces)})"


def base_sql(page: str, base: str) -> str:
    """Raw pieces links resolve against: the page's <base>, else the page URL.

    NULL unless the page URL is absolute.
    """
    own = U.with_pieces_sql(base, "r", let(merged_sql("a", "r"), "m", resolved_sql("a", "r", "m")))
    absolute = f"filter(array({U.pieces_sql(page)}), a -> size(a) = {U.PIECES} AND a[{U.SCHEME}] <> '')"
    return f"get(transform({absolute}, a -> if({base} IS NULL, a, coalesce({own}, a))), 0)"


def _error_sql(base: str, link: str) -> str:
    return f"CASE WHEN {base} IS NULL THEN '{NO_BASE}' WHEN {link} IS NULL THEN '{BAD_HREF}' END"


def _page_tags(pages: DataFrame, *carry: str) -> DataFrame:
    """One row per page: its link tags and base; html is gone."""
    tags = pages.selectExpr("page_id", "url AS page", *carry, f"{H.tags_sql('html')} AS _tags")
    first_base = H.raw_href_sql(f"get(filter(_tags, t -> {H.is_base_sql('t')}), 0)")
    base = let(first_base, "w", H.href_sql("w"))
    return tags.selectExpr("page_id", "page", *carry, f"{base} AS base", "_tags")


def _hrefs(tags: DataFrame, kept: list[str]) -> DataFrame:
    """Explode ``_tags`` to ``pos, href``."""
    # Exploding an expression, not a column, keeps Spark from inferring a filter
    # on the array's size, which would find all tags of every page once more.
    anchors = f"filter(_tags, t -> NOT {H.is_base_sql('t')})"
    rows = tags.selectExpr(*kept, f"posexplode({anchors}) AS (pos, _tag)")
    raw = rows.selectExpr(*kept, "pos", f"{H.raw_href_sql('_tag')} AS _raw")
    return raw.selectExpr(*kept, "pos", f"{H.href_sql('_raw')} AS href")


def extract_links(pages: DataFrame, *carry: str) -> DataFrame:
    """``page_id, url, html`` -> ``page_id, page, base, pos, href``.

    One row per ``a[href]`` in document order; ``base`` is the page's first
    ``<base href>``.  ``carry`` names page columns to keep on every link.
    """
    return _hrefs(_page_tags(pages, *carry), ["page_id", "page", *carry, "base"])


def _with_pieces(links: DataFrame, kept: list[str]) -> DataFrame:
    """``_base, href`` -> ``+ pieces, error``: raw pieces of the absolute link.

    Each step is a projection over plain columns, so Spark compiles it.  The
    explode of one element at the end is a fence: a filter on its result is not
    pushed down, where it would resolve the link a second time.
    """
    ref = links.selectExpr(*kept, "_base", f"{U.pieces_sql('href')} AS _ref")
    usable = f"_base IS NOT NULL AND size(_ref) = {U.PIECES}"
    path = ref.selectExpr("*", f"if({usable}, {merged_sql('_base', '_ref')}, NULL) AS _path")
    found = path.selectExpr(*kept, "_base", f"if({usable}, {resolved_sql('_base', '_ref', '_path')}, NULL) AS _pieces")
    return found.selectExpr(*kept, f"inline(array(struct(_pieces AS pieces, {_error_sql('_base', '_pieces')} AS error)))")


def resolve_links(links: DataFrame) -> DataFrame:
    """``page, base, href`` -> ``+ link, error``: the absolute URL or a reason."""
    based = links.selectExpr("*", f"{base_sql('page', 'base')} AS _base")
    link = f"if(pieces IS NULL, NULL, {U.joined_sql('pieces')}) AS link"
    return _with_pieces(based, links.columns).selectExpr(*links.columns, link, "error")


def page_links(pages: DataFrame, *carry: str) -> DataFrame:
    """Extract and resolve in one step: ``page_id, page, pos, href, pieces, error``.

    The base is parsed once per page.
    """
    kept = ["page_id", "page", *carry]
    based = _page_tags(pages, *carry).selectExpr(*kept, f"{base_sql('page', 'base')} AS _base", "_tags")
    return _with_pieces(_hrefs(based, [*kept, "_base"]), [*kept, "pos", "href"])


def failed_pages(pages: DataFrame) -> DataFrame:
    """Pages that cannot be read at all: ``page_id, page, error_class, error``."""
    return pages.where(F.col("html").isNull()).select(
        "page_id",
        F.col("url").alias("page"),
        F.lit(DOMAIN).alias("error_class"),
        F.lit(NO_HTML).alias("error"),
    )


def page_links_set(links: DataFrame) -> DataFrame:
    """Distinct links of each page: ``page, link``.  Two spellings of one URL are one."""
    spelled = links.where(F.col("link").isNotNull()).select("page", U.url_key("link").alias("_key"), "link")
    return spelled.groupBy("page", "_key").agg(F.min("link").alias("link")).select("page", "link")


def page_report(links: DataFrame) -> DataFrame:
    """Each page with its links, sorted: ``page, links ARRAY``.

    Takes links before any filter.  Repeats go in the partial aggregate, so
    what a page's row gathers is its own distinct links.
    """
    return page_links_set(links).groupBy("page").agg(F.array_sort(F.collect_list("link")).alias("links"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split on ``error_class``: rows that are fine, rows that failed."""
    failed = F.col("error_class").isNotNull()
    return df.where(~failed), df.where(failed)
