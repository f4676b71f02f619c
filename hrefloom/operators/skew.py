"""Balance: joins with a key on a large share of the rows, scans of few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(df: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` joined to a table with unique ``key``, left, inner or anti.

    Rows of one key are spread over salts by a hash of all their columns, so
    they part where anything but the key differs; each table row is there once
    per salt.  The salt also makes both sides of the join plain shuffles, which
    is the shape adaptive execution can split further, so a hot key ends up in
    as many tasks as its size asks for, rows that agree in all columns included.
    A table small enough to broadcast is broadcast by Spark as usual.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return spread.join(table.withColumn("_salt", copies), [key, "_salt"], how).drop("_salt")


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores where its scan would not fill them.

    A file of one row group is one task, however many cores wait.  An input big
    enough to have a split per core is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
