"""The admission queue: ``id, url, created_at`` snapshots, first in first out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefloom.functions.urls import PIECES, pieces_sql
from hrefloom.operators.numbering import global_index
from hrefloom.sources.keyed_log import KeyedLog, Span

QUEUE_SCHEMA = "id BIGINT, url STRING, created_at TIMESTAMP"


def queue_publish(
    queue: DataFrame, urls: DataFrame, now: Column | None = None, last_id: int | None = None
) -> DataFrame:
    """The queue after publishing ``seq, url``: queued URLs are left as they are.

    Uniqueness is on the exact text, among the new URLs as well (lowest ``seq``
    wins).  New ids go on from the highest id, or from ``last_id`` if that is
    higher (ids of URLs that left the queue are then never used again).
    """
    firsts = urls.groupBy("url").agg(F.min("seq").alias("_seq"))
    new = firsts.join(queue.select("url"), "url", "left_anti")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    start = top if last_id is None else F.greatest(top, F.lit(last_id).cast("bigint"))
    numbered = global_index(new, ["_seq"], "_n")
    added = numbered.select(
        (start + F.col("_n")).alias("id"),
        "url",
        (F.current_timestamp() if now is None else now).cast("timestamp").alias("created_at"),
    )
    return queue.select("id", "url", "created_at").unionByName(added)


def _parses() -> Column:
    return F.expr(f"size({pieces_sql('url')}) = {PIECES}")


def queue_dequeue(queue: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Take the ``k`` lowest ids: (batch, rest).

    A stored URL that does not parse is taken too, but not handed out.  The id
    to cut at comes from the ids alone; the URLs are filtered where they stand,
    so a batch of any size stays spread over the cluster.
    """
    ranked = global_index(queue.select("id"), ["id"], "_rank")
    cut = ranked.where(F.col("_rank") <= k).agg(F.max("id").alias("cut")).scalar()
    rows = queue.select("id", "url", "created_at")
    return rows.where((F.col("id") <= cut) & _parses()), rows.where(cut.isNull() | (F.col("id") > cut))


class QueueLog:
    """The admission queue as a log in folder ``root``, which outlives the session.

    Ids are dense and only grow, and the lowest go first, so what is queued is
    what lies above one number.  Publishing writes the new rows only; it joins
    the log where it lies, without shuffling it.  Taking k rows moves the
    number and reads the spans that hold those ids.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.root = root.rstrip("/")
        self.log = KeyedLog(spark, f"{self.root}/log", "url STRING, id BIGINT, created_at TIMESTAMP", "url", buckets)

    @property
    def top(self) -> int:
        """The highest id given out."""
        return self.log.notes.get("top", 0)

    @property
    def taken(self) -> int:
        """The highest id that has left the queue."""
        return self.log.notes.get("taken", 0)

    def size(self) -> int:
        return self.top - self.taken

    def publish(self, batch: int, urls: DataFrame, now: Column | None = None) -> None:
        """Queues ``seq, url``, lowest ``seq`` first; URLs that are queued stay as they are.

        Batches are numbered by the caller, upwards; one that is published
        already is left alone, so a rerun after a crash adds nothing.
        """
        if batch <= self.log.notes.get("batch", -1):
            return
        spark = self.log.spark

        def staged(name: str, df: DataFrame) -> DataFrame:
            path = f"{self.root}/staged/{name}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        firsts = staged("asked", urls.groupBy("url").agg(F.min("seq").alias("_seq")).where("url IS NOT NULL"))
        new = staged("new", self.log.unseen(firsts, "url", where=F.col("id") > self.taken))
        added = global_index(new, ["_seq"], "_n").select(
            "url", (F.lit(self.top) + F.col("_n")).alias("id"), (F.current_timestamp() if now is None else now).cast("timestamp").alias("created_at")
        )
        top = self.top + new.count()
        self.log.append(batch, added, {"top": top}, {"top": top, "batch": batch})

    def _holding(self, first: int, last: int) -> list[Span]:
        """The spans with ids of this range: each goes on where the one before it ends."""
        tops = [0, *(s.info["top"] for s in self.log.spans)]
        return [s for below, s in zip(tops, self.log.spans) if s.info["top"] >= first and below < last]

    def _between(self, first: int, last: int) -> DataFrame:
        rows = self.log.rows_of(self._holding(first, last)).select("id", "url", "created_at")
        return rows.where(F.col("id").between(first, last))

    def take(self, k: int, token: str, consumer: str = "") -> DataFrame:
        """The next ``k`` rows, those that parse: ``id, url, created_at``.

        They have left the queue when this returns.  ``token`` names the take: a
        consumer that asks again with the token of its last take, after a crash
        say, gets the same rows and takes nothing twice.
        """
        takes = self.log.notes.get("takes", {})
        named, first, last = takes.get(consumer, (None, 0, 0))
        if named != token:
            first, last = self.taken + 1, min(self.top, self.taken + k)
            self.log.keep(self.log.spans, {"taken": last, "takes": {**takes, consumer: (token, first, last)}})
        return self._between(first, last).where(_parses())

    def rest(self) -> DataFrame:
        """What is queued: ``id, url, created_at``."""
        return self._between(self.taken + 1, self.top)

    def compact(self) -> None:
        """Deletes spans that are taken whole, but for those of a consumer's last take, and merges small ones."""
        needed = min([self.taken + 1, *(first for _, first, last in self.log.notes.get("takes", {}).values() if first <= last)])
        self.log.drop([s for s in self.log.spans if s.info["top"] < needed])
        self.log.compact()
