"""What the corpus operators share: staged tables, words as SQL, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.workdir import work_dir

# ASCII white space; words are what stands between
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\t-\\r ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stages:
    """Tables that a job writes to its shared work folder and reads again.

    What is written there survives the executor that made it, and is not
    computed twice by two readers.  Shuffle files of a table go as soon as it
    is written: nothing reads them again.
    """

    CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_dir(spark, name)

    def write(self, name: str, df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
        """``arrow_rows``: so many rows at a time go to Python at most."""
        path = f"{self.root}/{name}"
        now = {self.CLEAN_UP: "true"}
        if arrow_rows and arrow_rows < int(self.spark.conf.get(self.ARROW_ROWS)):
            now[self.ARROW_ROWS] = str(arrow_rows)
        before = {self.CLEAN_UP: self.spark.conf.get(self.CLEAN_UP, "false"), self.ARROW_ROWS: self.spark.conf.get(self.ARROW_ROWS)}
        for key, value in now.items():
            self.spark.conf.set(key, value)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for key in now:
                self.spark.conf.set(key, before[key])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# bits of a sieve: 2,048 rows of 4 KB at most
SIEVE_BITS = 1 << 26


def sieve_bits(keys: int | None) -> int:
    """Bits of a sieve: at least 64 for each of so many keys, so about one other in 64 passes, up to ``SIEVE_BITS``, as many as for an unknown number."""
    return SIEVE_BITS if keys is None else min(SIEVE_BITS, max(1 << 15, 1 << (64 * keys).bit_length()))


def _place(column: str, size: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(size))


def sieve(keys: DataFrame, column: str, size: int = SIEVE_BITS) -> DataFrame:
    """``part, words``: a bit for each hash of a key, in rows of 4 KB; its size is bounded whatever the keys' number."""
    bits = keys.select(_place(column, size).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("v"))
    parts = bits.groupBy(F.expr("w div 512").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(w % 512 AS int)"), "v"))).alias("m"))
    return parts.select("part", F.expr("transform(sequence(0, 511), i -> coalesce(m[i], 0L))").alias("words"))


def sieved(df: DataFrame, column: str, keys: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``df`` and ``_in``: 1 where the sieve of ``keys`` lets the row's column through, else null.

    A sieve has a bounded size, so it is broadcast and no row moves.  It lets
    all keys through, and a share of others that grows with the keys' number:
    what must be exact is joined after it, and finds the rest of the work gone.
    ``most``: there are no more keys than that, so a smaller sieve may do; more
    keys only let more rows through.
    """
    size = sieve_bits(most)
    placed = df.withColumn("_p", _place(column, size))
    filtered = placed.join(F.broadcast(sieve(keys, key, size)), F.expr("_p div 32768") == F.col("part"), "left")
    bit = F.expr("shiftright(words[cast((_p div 64) % 512 AS int)], cast(_p % 64 AS int)) & 1L")
    inside = F.when(F.col(column).isNotNull() & F.col("words").isNotNull() & (bit == 1), 1)
    return filtered.select(*df.columns, inside.alias("_in"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, without Python."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_CLASS))


def by_hash(df: DataFrame, columns: list, n: int) -> DataFrame:
    """At most ``n`` rows: those whose ``columns`` have the smallest hashes.

    A large table is cut to about twice as many by the hash itself first, so no
    task hands over more than its share.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << 52))
    rows = df.count()
    if rows > 4 * n:
        df = df.where(place < int((1 << 52) * (2 * n / rows)))
    return df.orderBy(place, *columns).limit(n)
