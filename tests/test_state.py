"""What outlives a job: the bucketed log, the queue on it, stream state, and what is read of them."""

import random

import pytest
from pyspark.sql import functions as F

from hrefloom.operators import schedule as S
from hrefloom.operators.schedule import politeness_plan
from hrefloom.plans.crawl import crawl, crawl_work
from hrefloom.plans.discover import discover_links
from hrefloom.sources.keyed_log import MERGED, KeyedLog
from hrefloom.sources.queue import QueueLog
from hrefloom.sources.snapshot import ID_RANGES, fetch_pages, id_ranges, page_index, store_snapshot
from hrefloom.sources.stream import link_stream
from hrefloom.streaming.streams import (
    dedup_stream,
    discover_stream,
    disk_state,
    first_sights,
    politeness_stream,
    run_dedup_stream,
    run_discover_stream,
)
from hrefloom.workdir import work_dir


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def _stored(spark, root, name, rows, schema="url STRING, id BIGINT"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}")


def _urls(log):
    return sorted(r["url"] for r in log.rows().collect())


# the bucketed log


def test_log_keeps_first_sights_over_batches_and_sessions(spark):
    rng, root = random.Random(3), work_dir(spark, "log")
    log, met = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 16), set()
    for batch in range(2 * MERGED + 1):
        rows = sorted({f"u{rng.randrange(120)}" for _ in range(30)}) + [None]
        new = log.unseen(_stored(spark, root, f"in-{batch}", [(u, batch) for u in rows]), "url", batch)
        assert {r["url"] for r in new.collect()} == set(rows) - {u for u in met if u is not None}
        log.append(batch, new.where("url IS NOT NULL"))
        log.compact(batch + 1)
        met |= set(rows) - {None}
        if batch % 3 == 1:
            log.close()
            log = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 999)
            assert log.buckets == 16
        assert _urls(log) == sorted(met)
    # spans stay few, and what was merged is gone
    assert len(log.spans) <= 2 * MERGED and sum(s.rows for s in log.spans) == len(met)


def test_log_join_shuffles_the_batch_alone_and_reads_its_buckets(spark, no_broadcast):
    root = work_dir(spark, "log")
    log = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 16)
    log.append(0, _stored(spark, root, "in-0", [(f"u{k}", k) for k in range(500)]))
    log.append(1, _stored(spark, root, "in-1", [(f"v{k}", k) for k in range(500)]))
    few = _stored(spark, root, "in-2", [("u3", 0), ("w1", 1)])
    text = _plan(log.unseen(few, "url", 2))
    exchanges = [line for line in text.split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(url" in exchanges[0] and ", 16)" in exchanges[0]
    # the exchange stands on the batch's side: nothing lies between the join and the log but a sort
    below = text[text.index("_known") :]
    assert "Bucketed: true" in text and "Exchange" not in below[below.index("\n+- ") :]
    touched = log.touched(few, "url")
    assert len(touched) == len({r["b"] for r in few.select(log.bucket_of("url").alias("b")).collect()}) <= 2
    assert f"InMemoryFileIndex({2 * len(touched)} paths)" in text
    assert [r["url"] for r in log.unseen(few, "url", 2).collect()] == ["w1"]
    # a batch sees earlier ones only
    assert {r["url"] for r in log.unseen(few, "url", 0).collect()} == {"u3", "w1"}


def test_log_batch_written_again_after_a_crash(spark):
    root = work_dir(spark, "log")
    # a crash while the first manifest was written
    log = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 4)
    log._write(0, 0, {}, _stored(spark, root, "in", [("x", 1)]))
    begun, files = log._path("manifest/000000000001.begun")
    files.create(begun, True).close()
    assert KeyedLog(spark, root, "url STRING, id BIGINT", "url", 4).rows().count() == 0
    log = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 4)
    log.append(0, _stored(spark, root, "in-0", [("a", 1)]))
    # a crash between the rows and the manifest: rows lie there, but nothing names them
    log._write(1, 1, {}, _stored(spark, root, "in-1", [("b", 1), ("c", 1)]))
    log = KeyedLog(spark, root, "url STRING, id BIGINT", "url")
    assert _urls(log) == ["a"]
    log.append(1, _stored(spark, root, "in-2", [("b", 2)]))
    assert _urls(log) == ["a", "b"]
    log.append(1, _stored(spark, root, "in-3", [("d", 2)]))
    assert _urls(log) == ["a", "d"] and log.spans[1].rows == 1
    log.append(2, _stored(spark, root, "in-4", []))
    assert _urls(log) == ["a", "d"]
    assert log.rows(0).count() == 0


def test_log_rows_asked_for_before_a_merge_stay(spark):
    root = work_dir(spark, "log")
    log = KeyedLog(spark, root, "url STRING, id BIGINT", "url", 4)
    for batch in range(MERGED):
        log.append(batch, _stored(spark, root, f"in-{batch}", [(f"u{batch}", 1)]))
    unseen = log.unseen(_stored(spark, root, "in", [("u0", 1), ("v", 1)]), "url")
    stored = log.stored()
    log.compact()
    assert len(log.spans) == 1 and [r["url"] for r in unseen.collect()] == ["v"] and stored.count() == MERGED == log.stored().count()


# the queue


def _asked(spark, rows):
    return spark.createDataFrame(rows, "seq BIGINT, url STRING")


def test_queue_log_publishes_once_and_takes_once(spark):
    queue = QueueLog(spark, work_dir(spark, "queue"), 4)
    queue.publish(0, _asked(spark, [(3, "http://c/"), (1, "http://a/"), (2, "http://b/"), (9, "http://a/"), (4, None)]))
    assert queue.size() == 3
    # publishing what is queued changes nothing
    queue.publish(1, _asked(spark, [(1, "http://b/"), (2, "not a url"), (3, "http://d/")]))
    assert [tuple(r) for r in queue.rest().orderBy("id").select("id", "url").collect()] == [
        (1, "http://a/"), (2, "http://b/"), (3, "http://c/"), (4, "not a url"), (5, "http://d/"),
    ]
    assert queue.rest().where("created_at IS NULL").count() == 0
    # a batch that runs again adds nothing
    queue.publish(1, _asked(spark, [(1, "http://z/")]))
    assert queue.size() == 5
    assert [r["url"] for r in queue.take(2, "one").orderBy("id").collect()] == ["http://a/", "http://b/"] and queue.size() == 3
    # after a crash the same take gives the same rows, also in a new session
    again = QueueLog(spark, queue.root)
    assert [r["url"] for r in again.take(2, "one").orderBy("id").collect()] == ["http://a/", "http://b/"] and again.size() == 3
    # text that does not parse is taken and not handed out
    assert [r["url"] for r in again.take(9, "two").orderBy("id").collect()] == ["http://c/", "http://d/"]
    assert again.size() == 0 and again.rest().count() == 0 and again.take(1, "three").count() == 0
    # a URL that has left may come back, under an id of its own
    again.publish(2, _asked(spark, [(1, "http://a/")]))
    assert [tuple(r) for r in again.rest().select("id", "url").collect()] == [(6, "http://a/")]


def test_queue_log_takes_read_the_first_spans_only(spark):
    queue = QueueLog(spark, work_dir(spark, "queue"), 4)
    for batch in range(MERGED - 1):
        queue.publish(batch, _asked(spark, [(k, f"http://h{batch}/{k}") for k in range(50)]))
    taken = queue.take(10, "one")
    assert "IN (000000000000-000000000000)" in _plan(taken) or "span#" in _plan(taken) and "000000000001-" not in _plan(taken)
    assert taken.count() == 10
    queue.take(60, "two")
    # two consumers' last takes end in spans 0 and 1; the first span stays until neither needs it
    queue.take(45, "three")
    queue.compact()
    assert queue.log.spans[0].last >= 1 and queue.size() == 35 and queue.rest().count() == 35
    assert queue.take(45, "three").count() == 45
    for batch in range(MERGED - 1, 3 * MERGED):
        queue.publish(batch, _asked(spark, [(k, f"http://h{batch}/{k}") for k in range(5)]))
        queue.compact()
    assert len(queue.log.spans) < 2 * MERGED and queue.rest().count() == queue.size()
    ids = [r["id"] for r in queue.rest().orderBy("id").collect()]
    assert ids == list(range(queue.taken + 1, queue.top + 1))


# crawl


def _chain(spark, n):
    pages = [(k, f"http://tea.example/{k}", f'<a href="/{k + 1}"><a href="/{k // 2}"><a href="/x{k % 3}">') for k in range(n)]
    return spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")


def test_crawl_counts_its_work_by_round(spark):
    pages, root = _chain(spark, 9), work_dir(spark, "crawl")
    met = crawl(pages.where("page_id = 0").select("url"), pages, work_dir=root)
    rounds = {r["round"]: r["count"] for r in met.groupBy("round").count().collect()}
    work = [tuple(r) for r in crawl_work(spark, root).orderBy("round").collect()]
    assert [w[0] for w in work] == list(range(len(rounds) + 1)) and work[-1][1:] == (0, rounds[len(rounds) - 1], 0)
    for n, tracked, completed, outstanding in work[:-1]:
        assert tracked == rounds[n] and completed == rounds.get(n - 1, 0)
        assert outstanding == sum(w[1] for w in work[: n + 1]) - sum(w[2] for w in work[: n + 1])
    assert spark.read.parquet(f"{root}/frontier").count() == 0
    cut = work_dir(spark, "crawl")
    crawl(pages.where("page_id = 0").select("url"), pages, 2, cut)
    last = crawl_work(spark, cut).orderBy(F.desc("round")).first()
    assert last["round"] == 2 and last["outstanding"] == spark.read.parquet(f"{cut}/frontier").count() > 0


# fetching late


def _scanned_rows(df):
    """Rows that left the scans of html, once ``df`` has run."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "html" in node.simpleString(10_000) and node.nodeName().startswith("Scan"):
            found.append(node.metrics().get("numOutputRows").get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(found)


def test_late_fetch_reads_what_is_wanted(spark):
    root = work_dir(spark, "fetch")
    # row groups are written small by small pages of the files: 40,000 rows make many of them
    rows = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    pages = store_snapshot(rows, f"{root}/snapshot")
    asked = spark.createDataFrame([(1, "http://h/7"), (2, "http://h/7#again"), (3, "http://h/20001"), (4, "http://h/none")], "seq BIGINT, url STRING")
    found, missing = fetch_pages(asked, pages, page_index(pages), root)
    got = found.collect()
    assert sorted(r["seq"] for r in got) == [1, 2, 3] and [r["url"] for r in missing.collect()] == ["http://h/none"]
    plain, _ = fetch_pages(asked, pages)
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.collect()))
    scan = pages.where(f"page_id BETWEEN 7 AND 7 OR page_id BETWEEN 20001 AND 20001").select("page_id", "html")
    scan.collect()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(page_id,7)" in _plan(scan)
    assert 0 < _scanned_rows(scan) < 40_000


def test_id_ranges(spark):
    ids = [5, 6, 7, 100, 5000, 5001, 10**15]
    ranges = id_ranges(spark.createDataFrame([(i,) for i in ids], "page_id BIGINT"))
    assert len(ranges) <= ID_RANGES and all(any(a <= i <= b for a, b in ranges) for i in ids)
    assert all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
    assert id_ranges(spark.createDataFrame([], "page_id BIGINT")) == []
    assert id_ranges(spark.createDataFrame([(None,), (-3,)], "page_id BIGINT")) == [(-3, -3)]
    dense = id_ranges(spark.range(10_000).select(F.col("id").alias("page_id")))
    assert dense == [(0, 9999)]
    two = id_ranges(spark.createDataFrame([(1,), (2,), (9,)], "page_id BIGINT"), limit=2)
    assert two == [(1, 2), (9, 9)]


# the fair order


def test_fair_order_sorts_rows_once(spark, no_broadcast):
    rows = [(k, f"h{k % 7}", "u", k * 10) for k in range(200)]
    plan = politeness_plan(spark.createDataFrame(rows, "seq BIGINT, host STRING, url STRING, arrival_ms BIGINT"), 1000)
    ordered = S.fair_order(plan, work_dir(spark, "fair"))
    text = _plan(ordered)
    # the rows come from their file; only sizes of ranges are dealt and sorted
    assert all("url" not in line for line in text.split("\n") if "Exchange" in line or "Sort " in line)
    got = [tuple(r) for r in ordered.orderBy("position").select("dispatch_at", "eligible_at", "host", "seq").collect()]
    assert got == sorted(got) and got == [tuple(r) for r in S.fair_order(plan).select("dispatch_at", "eligible_at", "host", "seq").collect()]
    assert [r["position"] for r in ordered.orderBy("position").collect()] == list(range(1, 201))
    # ranges go up with positions, so the front of the order is the first ranges
    spans = ordered.groupBy("_range").agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("_range").collect()
    assert all(x["b"] + 1 == y["a"] for x, y in zip(spans, spans[1:]))


# streams


def _feed(spark, root, batch, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return link_stream(spark, f"{root}/in", schema, 1)


def _drain(stream, root):
    """Runs a stream over what has arrived, from its checkpoint on."""
    with disk_state(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    assert query.exception() is None
    return [tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out").collect()]


SIGHTS = "seq BIGINT, url STRING"


def test_first_sights_outlive_a_restart(spark):
    root = work_dir(spark, "sights")
    first = _feed(spark, root, 0, [(3, "a"), (1, "b"), (2, "a"), (7, None), (6, None)], SIGHTS)
    assert sorted(_drain(first_sights(first, "url", ["seq"]), root)) == [(1, "b"), (2, "a"), (6, None)]
    second = _feed(spark, root, 1, [(0, "a"), (9, "c"), (8, "c"), (5, None)], SIGHTS)
    assert sorted(_drain(first_sights(second, "url", ["seq"]), root)) == [(1, "b"), (2, "a"), (6, None), (8, "c")]


def test_dedup_stream_on_disk_outlives_a_restart(spark):
    root = work_dir(spark, "dedup")
    first = _feed(spark, root, 0, [(1, "http://a/"), (2, "http://b/"), (3, "HTTP://a/")], SIGHTS)
    assert sorted(r[2] for r in _drain(dedup_stream(first), root)) == ["http://a/", "http://b/"]
    second = _feed(spark, root, 1, [(4, "http://b/"), (5, "http://c/")], SIGHTS)
    assert sorted(r[2] for r in _drain(dedup_stream(second), root)) == ["http://a/", "http://b/", "http://c/"]


def test_dedup_stream_with_a_watermark_forgets(spark):
    root, schema = work_dir(spark, "bounded"), "url STRING, at TIMESTAMP"
    day = lambda d, h=0: __import__("datetime").datetime(2024, 1, d, h)
    feed = _feed(spark, root, 0, [("http://a/", day(1)), ("http://a/", day(1, 2))], schema)
    assert len(_drain(dedup_stream(feed, ("at", "1 day")), root)) == 1
    feed = _feed(spark, root, 1, [("http://a/", day(1, 5)), ("http://b/", day(9))], schema)
    assert len(_drain(dedup_stream(feed, ("at", "1 day")), root)) == 2
    # the watermark has passed the first sight by more than a day: its state is gone
    feed = _feed(spark, root, 2, [("http://a/", day(9, 1))], schema)
    assert len(_drain(dedup_stream(feed, ("at", "1 day")), root)) == 3


ARRIVALS = "seq BIGINT, host STRING, url STRING, arrival_ms BIGINT"


def test_politeness_stream_equals_the_plan_over_restarts(spark):
    rng, root = random.Random(5), work_dir(spark, "polite")
    rows, at = [], 0
    for k in range(90):
        at += rng.randrange(900)
        rows.append((k, rng.choice(["a", "a", "b", None]), "u", at))
    for n in range(3):
        feed = _feed(spark, root, n, rng.sample(rows[n * 30 : n * 30 + 30], 30), ARRIVALS)
        got = _drain(politeness_stream(feed, 1000), root)
    want = politeness_plan(spark.createDataFrame(rows, ARRIVALS), 1000)
    assert sorted((r[0], r[-2], r[-1]) for r in got) == sorted((r["seq"], r["eligible_at"], r["dispatch_at"]) for r in want.collect())


def test_politeness_stream_holds_one_frame_of_a_host(spark):
    root = work_dir(spark, "frames")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        feed = _feed(spark, root, 0, [(k, "a", "u", 5) for k in range(100)], ARRIVALS)
        got = _drain(politeness_stream(feed, 10), root)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # frames follow one another: every slot is given out once, and within a frame by seq
    assert sorted(r[-1] for r in got) == [5 + 10 * k for k in range(100)]


def test_discover_stream_equals_batch_over_restarts(spark):
    root, schema = work_dir(spark, "discover"), "page_id BIGINT, url STRING, html STRING, arrival_ms BIGINT"
    rows = [(k, f"http://tea.example/{k}", "".join(f'<a href="/{(k * j) % 13}"><a href="http://h{j % 3}.example/{k % 4}">' for j in range(5)), k * 100) for k in range(12)]
    for n in range(3):
        feed = _feed(spark, root, n, rows[n * 4 : n * 4 + 4], schema)
        got = _drain(discover_stream(feed, 1000), root)
    pages = spark.createDataFrame(rows, schema)
    new, _ = discover_links(pages.select("page_id", "url", "html"))
    timed = new.join(pages.select(F.col("url").alias("page"), "arrival_ms"), "page")
    want = politeness_plan(timed, 1000)
    assert sorted((r[3], r[2], r[-1]) for r in got) == sorted((r["url"], r["page"], r["dispatch_at"]) for r in want.collect()) and got


def test_batch_streams_join_the_log_where_it_lies(spark):
    root = work_dir(spark, "runs")
    for n, rows in enumerate([[(1, "http://a/"), (2, None)], [(3, "http://a/"), (4, "http://b/"), (5, None)], [(6, "http://b/")]]):
        run_dedup_stream(_feed(spark, root, n, rows, SIGHTS), root).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{root}/firsts").collect()) == [1, 2, 4]
    log = KeyedLog(spark, f"{root}/seen", "met STRING", "met")
    assert _met(log) == ["", "=http://a/", "=http://b/"]
    pages = work_dir(spark, "runs")
    schema = "page_id BIGINT, url STRING, html STRING"
    for n in range(2):
        feed = _feed(spark, pages, n, [(k, f"http://t/{k}", f'<a href="/x{k % 3}"><a href="/y{k}">') for k in range(n * 4, n * 4 + 4)], schema)
        run_discover_stream(feed, 1000, pages).awaitTermination()
    plan = spark.read.parquet(f"{pages}/plan")
    assert sorted(r["seq"] for r in plan.collect()) == list(range(1, 12)) and plan.select("url").distinct().count() == 11


def _met(log):
    return sorted(r["met"] for r in log.rows().collect())
