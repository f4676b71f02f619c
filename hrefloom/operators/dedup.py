"""First-seen logic: which URLs, in arrival order, were met before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.urls import url_key


def has_seen(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``seq, url`` -> ``+ seen``: FALSE for the first sight of a URL, else TRUE.

    ``seq`` must be unique.  ``seen`` is the table of earlier URLs by ``key``.

    The first ``seq`` of each key comes from a partial aggregate, so a URL that
    makes up a third of all rows reaches the shuffle as one row per task.  The
    flag goes back by (key, seq), which spreads that URL's rows evenly; a window
    over the key would sort them all in one task.
    """
    keyed = df.withColumn("_key", url_key("url"))
    firsts = keyed.groupBy(F.col("_key").alias("_k")).agg(F.min("seq").alias("_first"))
    if seen is not None:
        firsts = firsts.join(seen.select(F.col("key").alias("_k")), "_k", "left_anti")
    # rows without a URL share the NULL key, so it must match as well
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("_first"))
    flagged = keyed.join(firsts, same, "left")
    return flagged.select(*df.columns, F.col("_first").isNull().alias("seen"))


def first_seen(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Only the first sight of each new URL: ``key, first_seq``."""
    firsts = df.groupBy(url_key("url").alias("key")).agg(F.min("seq").alias("first_seq"))
    return firsts if seen is None else firsts.join(seen.select("key"), "key", "left_anti")
