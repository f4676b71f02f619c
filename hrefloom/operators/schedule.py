"""Dispatch plans: when each queued URL may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefloom.operators.numbering import LEAF_BITS, global_index, global_rank, leaf_of, totals_before


def _before_bucket(summary: DataFrame, c: Column, bits: int, levels: int) -> DataFrame:
    """``host, _bucket, _size, _peak`` -> ``host, _bucket, _offset, _peak_before``.

    ``_offset`` is the number of the host's rows in earlier buckets, and
    ``_peak_before`` the greatest ``a(k) - k*c`` among them.
    """
    part = ["host"] if levels == 0 else ["host", "_group"]
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = (
        summary.withColumn("_group", leaf_of("_bucket", bits))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_shifted", F.col("_peak") - F.col("_offset") * c)
        .withColumn("_peak_before", F.max("_shifted").over(before))
    )
    if levels == 0:
        return local.select("host", "_bucket", "_offset", "_peak_before")
    groups = local.groupBy("host", "_group").agg(F.sum("_size").alias("_size"), F.max("_shifted").alias("_peak"))
    above = _before_bucket(groups.withColumnRenamed("_group", "_bucket"), c, bits, levels - 1).select(
        "host",
        F.col("_bucket").alias("_group"),
        F.col("_offset").alias("_rows"),
        F.col("_peak_before").alias("_highest"),
    )
    return local.join(above, ["host", "_group"]).select(
        "host",
        "_bucket",
        (F.col("_rows") + F.col("_offset")).alias("_offset"),
        F.greatest("_highest", F.col("_peak_before") - F.col("_rows") * c).alias("_peak_before"),
    )


def politeness_plan(
    df: DataFrame,
    cooldown_ms: int,
    host_state: DataFrame | None = None,
    bucket_bits: int = LEAF_BITS,
) -> DataFrame:
    """``seq, host, url, arrival_ms`` -> ``+ eligible_at, dispatch_at``.

    Per host, first come first served, ``cooldown_ms`` apart:
    ``d(n) = max(a(n), d(n-1) + c)``, that is ``n*c + max over k<=n of a(k) - k*c``.
    ``host_state(host, last_dispatch_at)`` carries the last plan's end, so plans
    of successive batches agree with one plan over all of them.

    A running count and a running max combine across pieces, so a host is cut
    by ``seq`` into buckets of at most 2**bucket_bits rows.  Rows are sorted
    within their bucket only; bucket summaries are combined in groups of at most
    2**bucket_bits, and only group summaries meet in one task per host.  ``seq``
    must be unique per host.  URLs without a host share the host ''.
    """
    c = F.lit(cooldown_ms).cast("bigint")
    bucket = ["host", "_bucket"]
    inside = Window.partitionBy(*bucket).orderBy("seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        df.withColumn("host", F.coalesce("host", F.lit("")))
        .withColumn("_bucket", leaf_of("seq", bucket_bits))
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_slack", F.col("arrival_ms") - F.col("_n") * c)
    )

    sizes = ranked.groupBy(*bucket).agg(F.max("_n").alias("_size"), F.max("_slack").alias("_peak"))
    summary = _before_bucket(sizes, c, bucket_bits, 1)
    if host_state is not None:
        state = host_state.select(F.coalesce("host", F.lit("")).alias("host"), "last_dispatch_at")
        summary = summary.join(state, "host", "left").withColumn(
            "_peak_before", F.greatest("_peak_before", "last_dispatch_at")
        )
    summary = summary.select(*bucket, "_offset", "_peak_before")
    # the join keeps the partitioning of the windows: rows are shuffled once
    joined = ranked.withColumn("_slack_before", F.max("_slack").over(earlier)).join(summary, bucket)
    rank = F.col("_offset") + F.col("_n")
    peak = F.greatest("_peak_before", F.col("_slack_before") - F.col("_offset") * c)
    eligible = F.coalesce(peak + rank * c, F.col("arrival_ms"))
    planned = joined.withColumn("eligible_at", eligible).withColumn(
        "dispatch_at", F.greatest("eligible_at", "arrival_ms")
    )
    return planned.select(*df.columns, "eligible_at", "dispatch_at")


def next_host_state(plan: DataFrame, host_state: DataFrame | None = None) -> DataFrame:
    """``host, last_dispatch_at`` after a plan; hosts it did not touch stay."""
    ended = plan.select("host", F.col("dispatch_at").alias("last_dispatch_at"))
    if host_state is not None:
        ended = ended.unionByName(host_state.select("host", "last_dispatch_at"))
    return ended.groupBy("host").agg(F.max("last_dispatch_at").alias("last_dispatch_at"))


FAIR = ("dispatch_at", "eligible_at", "host")


def fair_order(plan: DataFrame, work_dir: str | None = None) -> DataFrame:
    """The global dispatch order: earliest first, ties by eligibility, then host, then ``seq``.

    With ``work_dir`` the order is written there and comes back as ``position``
    (from 1) and ``_range``: one range partitioning of the rows serves both the
    order and the numbers, and a dispatcher filters on the first ranges.
    """
    order = [*FAIR, *(c for c in ("seq",) if c in plan.columns)]
    return plan.orderBy(*order) if work_dir is None else global_rank(plan, order, "position", work_dir, keep_range=True)


def fifo_plan(df: DataFrame, interval_ms: int, start_ms: int = 0) -> DataFrame:
    """``seq`` -> ``+ dispatch_at``: one URL per interval in arrival order.

    The first goes out one interval after ``start_ms``.
    """
    numbered = global_index(df, ["seq"], "_tick")
    at = F.lit(start_ms).cast("bigint") + F.col("_tick") * F.lit(interval_ms).cast("bigint")
    return numbered.select(*df.columns, at.alias("dispatch_at"))


def host_queue_stats(plan: DataFrame, as_of_ms: int | None = None, cooldown_ms: int = 0) -> DataFrame:
    """Queue depth and next eligible time per host: ``host, queued, next_eligible_at``.

    With ``as_of_ms`` the state of that time: URLs that have arrived and are not
    dispatched yet.  A host met by then whose queue is empty stays, with 0 and
    the time its cooldown ends.
    """
    if as_of_ms is None:
        return plan.groupBy("host").agg(F.count("*").alias("queued"), F.min("eligible_at").alias("next_eligible_at"))
    waiting = F.col("dispatch_at") > as_of_ms
    rested = F.max(F.when(~waiting, F.col("dispatch_at") + F.lit(cooldown_ms).cast("bigint")))
    return plan.where(F.col("arrival_ms") <= as_of_ms).groupBy("host").agg(
        F.count(F.when(waiting, True)).alias("queued"),
        F.coalesce(F.min(F.when(waiting, F.col("eligible_at"))), rested).alias("next_eligible_at"),
    )


def work_ledger(df: DataFrame) -> DataFrame:
    """``ts_ms, seq, delta`` -> ``+ outstanding, halted``.

    ``outstanding`` is the running sum in (ts_ms, seq) order; ``halted`` turns
    TRUE at the first row that brings it to zero and stays so.
    """
    leaf = ["ts_ms", "_leaf"]
    rows = df.withColumn("_leaf", leaf_of("seq"))
    sums = rows.groupBy(*leaf).agg(F.sum("delta").alias("_sum"))
    # a millisecond holds leaves of its own; the times before it add up in groups of 2**20 of them
    own = Window.partitionBy("ts_ms").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    leaves = sums.withColumn("_own", F.coalesce(F.sum("_sum").over(own), F.lit(0)))
    times = sums.groupBy("ts_ms").agg(F.sum("_sum").alias("_sum"))
    earlier = totals_before(times, ["ts_ms"], leaf_of("ts_ms"), "_sum", "_earlier")
    before = leaves.join(earlier, "ts_ms").select(*leaf, (F.col("_earlier") + F.col("_own")).alias("_before"))
    upto = Window.partitionBy(*leaf).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        rows.withColumn("_upto", F.sum("delta").over(upto))
        .join(before, leaf)
        .select(*df.columns, (F.col("_before") + F.col("_upto")).alias("outstanding"))
    )
    position = F.struct("ts_ms", "seq")
    first_zero = running.where(F.col("outstanding") == 0).agg(F.min(position).alias("first_zero"))
    halted = F.coalesce(position >= first_zero.scalar(), F.lit(False))
    return running.withColumn("halted", halted)


def work_totals(df: DataFrame) -> DataFrame:
    """``delta`` -> one row ``tracked, completed, outstanding``."""
    delta = F.col("delta")
    return df.agg(
        F.coalesce(F.sum(F.when(delta > 0, delta)), F.lit(0)).alias("tracked"),
        F.coalesce(F.sum(F.when(delta < 0, -delta)), F.lit(0)).alias("completed"),
        F.coalesce(F.sum(delta), F.lit(0)).alias("outstanding"),
    )
