"""Rows by key, appended batch by batch, that joins never shuffle.

A ``KeyedLog`` is a partitioned and bucketed Spark table in a folder of its own.
A batch is written as one span of batch numbers, a file per bucket of its key,
and each bucket is a partition as well.  So

* a join on the key takes the log as it lies, bucket to bucket, and only the
  other side is shuffled;
* a small batch reads the buckets that its keys fall into and no others;
* an append writes the new rows only.

A manifest, written anew with every change, names the spans that count and holds
the writer's notes.  A batch
that runs again after a crash overwrites its own span and sees those of earlier
batches only.  Small spans are merged into larger ones now and then, so their
number stays logarithmic in the number of batches.  The folder outlives the
session: a new one registers the table again from the manifest.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# spans of a like size that are merged at once
MERGED = 4
# versions of the manifest that stay
KEPT, SUFFIX = 4, ".json"


class Span(NamedTuple):
    """Batches ``first`` to ``last`` in one piece, the ``buckets`` that hold rows; ``info`` is the writer's own."""

    first: int
    last: int
    rows: int
    buckets: list[int]
    info: dict

    @property
    def name(self) -> str:
        return f"{self.first:012d}-{self.last:012d}"


class KeyedLog:
    """The log in folder ``root``: rows of ``schema``, of which ``key`` is a column.

    A new log has as many ``buckets`` as the session has shuffle partitions, if
    nothing else is said; one that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema)
        self.spans, self.notes, self.version, self.buckets = self._stored(buckets)
        self.name = f"hrefloom_log_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}, span STRING, bucket INT) USING parquet PARTITIONED BY (span, bucket)"
            f" CLUSTERED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.root}/rows'"
        )
        self.stale: list[Span] = []
        # buckets of each span that the session's table knows
        self.known: dict[str, list[int]] = {}
        for s in self.spans:
            self._register(s.name, s.buckets)

    def _register(self, name: str, buckets: list[int]) -> None:
        """Makes these the table's partitions of a span."""
        for change, some in (("DROP", self.known.pop(name, [])), ("ADD", buckets)):
            parts = [f"PARTITION (span = '{name}', bucket = {b})" for b in some]
            if parts:
                self.spark.sql(f"ALTER TABLE {self.name} {change} {(', ' if change == 'DROP' else ' ').join(parts)}")
        self.known[name] = buckets

    def close(self) -> None:
        """Takes the table out of the session's catalogue; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    # the manifest

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, buckets: int | None) -> tuple[list[Span], dict, int, int]:
        folder, files = self._path("manifest")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        # one that was begun and not renamed is none
        versions = [int(n[: -len(SUFFIX)]) for n in names if n.endswith(SUFFIX)]
        if not versions:
            return [], {}, 0, buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        version = max(versions)
        kept = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifest/{version:012d}{SUFFIX}").collect()))
        return [Span(*s) for s in kept["spans"]], kept["notes"], version, kept["buckets"]

    def keep(self, spans: list[Span], notes: dict | None = None) -> None:
        """Makes these the live spans and adds to the notes, both at once.

        A version is written under another name first, so it is there whole or
        not at all.
        """
        self.spans, self.version = sorted(spans, key=lambda s: s[:3]), self.version + 1
        self.notes = {**self.notes, **(notes or {})}
        begun, files = self._path(f"manifest/{self.version:012d}.begun")
        out = files.create(begun, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "notes": self.notes, "spans": self.spans}).encode()))
        out.close()
        done, _ = self._path(f"manifest/{self.version:012d}{SUFFIX}")
        files.delete(done, False)
        files.rename(begun, done)
        files.delete(self._path(f"manifest/{self.version - KEPT:012d}{SUFFIX}")[0], False)

    # rows

    def bucket_of(self, key: str | Column) -> Column:
        """The bucket of a key: what Spark deals rows to when it writes the table."""
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` partitioned like the log, as the other side of a join with it."""
        return rows.repartition(self.buckets, key)

    def _write(self, first: int, last: int, info: dict, rows: DataFrame) -> Span:
        """Writes a span over whatever is there by that name."""
        span = Span(first, last, 0, [], info)
        columns = [f.name for f in self.schema]
        staged = f"{self.name}_staged"
        counted = Observation()
        counting = rows.select(*columns).observe(counted, F.count(F.lit(1)).alias("rows"))
        dealt = self.dealt(counting, self.key).withColumn("bucket", self.bucket_of(self.key))
        writer = dealt.write.mode("overwrite").partitionBy("bucket").bucketBy(self.buckets, self.key)
        # the log itself may be among what is read, so the span is a table of its own until it is complete
        writer.option("path", f"{self.root}/rows/span={span.name}").saveAsTable(staged)
        self.spark.sql(f"DROP TABLE {staged}")
        # what was written is counted on the way, and its buckets are its folders: nothing is read again
        folder, files = self._path(f"rows/span={span.name}")
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        held = sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))
        span = span._replace(rows=counted.get.get("rows", 0) if held else 0, buckets=held)
        self._register(span.name, span.buckets)
        self.spark.catalog.refreshTable(self.name)
        return span

    def append(self, batch: int, rows: DataFrame, info: dict | None = None, notes: dict | None = None) -> None:
        """Writes a batch; the batch that was written last may be written again."""
        span = self._write(batch, batch, info or {}, rows)
        self.keep([*(s for s in self.spans if s.first != batch), span], notes)

    def rows_of(self, spans: list[Span], buckets: list[int] | None = None) -> DataFrame:
        """The rows of some spans; with ``buckets`` those of some buckets only."""
        table = self.spark.table(self.name).where(F.col("span").isin([s.name for s in spans]))
        if buckets is not None and len(buckets) < self.buckets:
            table = table.where(F.col("bucket").isin(buckets))
        return table.select(*(f.name for f in self.schema))

    def before(self, batch: int | None = None) -> list[Span]:
        return [s for s in self.spans if batch is None or s.last < batch]

    def rows(self, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of batches before ``batch``; with ``buckets`` those of some buckets only."""
        return self.rows_of(self.before(batch), buckets)

    def stored(self) -> DataFrame:
        """All rows as plain files, which outlast the session's table; spans that are merged later take theirs along."""
        paths = [f"{self.root}/rows/span={s.name}" for s in self.spans if s.rows]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/rows").parquet(*paths).select(*(f.name for f in self.schema))

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that the keys of ``rows`` fall into: no more numbers than buckets."""
        found = rows.select(self.bucket_of(key).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    def unseen(self, rows: DataFrame, key: str, batch: int | None = None, where: Column | None = None) -> DataFrame:
        """``rows`` whose key is in no row of an earlier batch (that meets ``where``).

        ``rows`` are read twice, so they should be stored.  A null key equals no other.
        """
        known = self.rows(batch, self.touched(rows, key))
        known = (known if where is None else known.where(where)).select(F.col(self.key).alias("_known"))
        dealt = self.dealt(rows, key)
        return dealt.join(known, dealt[key] == known["_known"], "left_anti")

    def batch(self, number: int) -> SeenBatch:
        """The log as batch ``number`` sees it."""
        return SeenBatch(self, number)

    def compact(self, batch: int | None = None) -> None:
        """Merges neighbouring spans of earlier batches, if ``MERGED`` of them are of a like size.

        A span is merged with smaller ones only, so a row is written again once
        for each power of ``MERGED`` that the log has grown by.  Rows that were
        asked for before a merge can be read until the next one.
        """
        spans, later = self.before(batch), [s for s in self.spans if s not in self.before(batch)]
        tail: list[Span] = []
        while spans and (len(tail) < MERGED - 1 or spans[-1].rows <= sum(s.rows for s in tail)):
            tail.insert(0, spans.pop())
        if len(tail) < MERGED:
            return
        self.keep([*spans, self._write(tail[0].first, tail[-1].last, tail[-1].info, self.rows_of(tail)), *later])
        # what was asked of the log before may still name them, so they go with the next merge
        self.forget(self.stale)
        self.stale = tail

    def forget(self, spans: list[Span]) -> None:
        """Deletes the files of spans that the manifest does not name."""
        live = {s.name for s in self.spans}
        for s in spans:
            if s.name not in live:
                path, files = self._path(f"rows/span={s.name}")
                self._register(s.name, [])
                files.delete(path, True)

    def drop(self, spans: list[Span]) -> None:
        """Takes spans out of the log for good."""
        gone = {s.name for s in spans}
        self.keep([s for s in self.spans if s.name not in gone])
        self.forget(spans)


class SeenBatch(NamedTuple):
    """What a batch may ask a log: about batches before it."""

    log: KeyedLog
    number: int

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        return self.log.unseen(rows, key, self.number)
