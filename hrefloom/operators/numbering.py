"""Running totals and dense numbers over a whole table.

``global_index`` orders by a 64-bit integer without any sort of the whole: the
integers are cut by their bits into leaves, leaves into groups of 2**20, groups
again into groups, two levels deep.  Each level needs only a sum per group, so a
window holds a million rows at most, but for the last one: it holds a row per
2**60 of the values' range (2**52 with leaves of 2**12), which is a few.  ``global_rank``
takes any order, ties included, at the price of a written sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_BITS = 20


def leaf_of(c: Column | str, bits: int = LEAF_BITS) -> Column:
    return F.shiftright(F.col(c) if isinstance(c, str) else c, bits)


def totals_before(leaves: DataFrame, keys: list[str], group: Column, total: str, out: str, levels: int = 2) -> DataFrame:
    """Per leaf (``keys``, in order): the sum of ``total`` over all earlier leaves.

    ``group`` is a BIGINT that grows with the keys.  Leaves of a group meet in
    one window; the groups are summed up the same way, ``levels`` deep, and the
    few groups left at the top meet in a last one.
    """
    inside = Window.partitionBy("_group").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    grouped = leaves.withColumn("_group", group)
    sums = grouped.groupBy("_group").agg(F.sum(total).alias("_sum"))
    if levels > 1:
        over = sums.withColumnRenamed("_group", "_leaf")
        groups = totals_before(over, ["_leaf"], leaf_of("_leaf"), "_sum", "_before", levels - 1)
        groups = groups.withColumnRenamed("_leaf", "_group")
    else:
        across = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
        groups = sums.select("_group", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    within = grouped.select(*keys, "_group", F.coalesce(F.sum(total).over(inside), F.lit(0)).alias("_within"))
    return within.join(groups, "_group").select(*keys, (F.col("_before") + F.col("_within")).alias(out))


def global_index(df: DataFrame, order_by: list[str], out: str, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """Adds ``out``: the dense 1-based rank of each row in ``order_by``.

    The first order column must be a BIGINT without NULLs and with few rows per
    value; ``leaf_bits`` says how many consecutive values are numbered together.
    """
    rows = df.withColumn("_leaf", leaf_of(order_by[0], leaf_bits))
    sizes = rows.groupBy("_leaf").agg(F.count("*").alias("_n"))
    before = totals_before(sizes, ["_leaf"], leaf_of("_leaf"), "_n", "_before_leaf")
    within = F.row_number().over(Window.partitionBy("_leaf").orderBy(*order_by))
    numbered = rows.withColumn("_within_leaf", within).join(before, "_leaf")
    return numbered.select(*df.columns, (F.col("_before_leaf") + F.col("_within_leaf")).alias(out))


def global_rank(df: DataFrame, order_by: list[str], out: str, work_dir: str, keep_range: bool = False) -> DataFrame:
    """Adds ``out``: the dense 1-based rank of each row in any order.

    The rows are range sorted on all of ``order_by``, so ties in the leading
    columns are split as well, and written with their range and their place in
    it: a range sort may cut differently when run again, and what is counted
    must be what is numbered.  A rank is that place and the sizes of the ranges
    before, one number per task of the sort, so rows are shuffled and sorted
    once.  With ``keep_range`` the column ``_range`` stays: a file holds one, so
    whoever wants the front of the order filters on it and reads the first files.
    """
    path = f"{work_dir.rstrip('/')}/ranges"
    # the upper bits of this id are the task, the lower 33 count its rows in their order
    place = F.monotonically_increasing_id()
    ranged = df.orderBy(*order_by).withColumn("_place", place)
    ranged = ranged.withColumn("_range", F.shiftright("_place", 33).cast("int")).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    ranged.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
    # one row per partition of the sort
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before")
    )
    numbered = rows.join(F.broadcast(before), "_range")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(out), *["_range"] * keep_range)
