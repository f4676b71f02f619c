import random
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from hrefloom.operators import links as L
from hrefloom.operators import schedule as S
from hrefloom.plans.crawl import crawl, crawl_failures, unanswered
from hrefloom.plans.discover import discover_links
from hrefloom.sources.queue import QUEUE_SCHEMA, queue_dequeue, queue_publish
from hrefloom.sources.seeds import validate_seeds
from hrefloom.sources.snapshot import fetch_pages, resolve_redirects
from hrefloom.sources.stream import PAGE_SCHEMA, link_stream
from hrefloom.streaming.streams import (
    dedup_stream,
    disk_state,
    politeness_stream,
    run_dedup_stream,
    run_discover_stream,
    run_politeness_stream,
)
from hrefloom.workdir import work_dir

PAGES = "page_id bigint, url string, html string"


def _anchors(*hrefs):
    return "".join(f'<a href="{h}">' for h in hrefs)


def test_seeds(spark):
    df = spark.createDataFrame([(u,) for u in ("https://h/", "ftp://h/", "/x", "http:///x", "a b", None)], "url string")
    valid, rejected = validate_seeds(df)
    assert [r["url"] for r in valid.collect()] == ["https://h/"]
    reasons = {r["url"]: r["reason"] for r in rejected.collect()}
    assert reasons == {
        "ftp://h/": "scheme is not http or https", "/x": "no host", "http:///x": "no host",
        "a b": "not a valid URL", None: "not a valid URL",
    }


def _queue(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, url string")


def _queued(rng, k):
    """A text for the queue and whether it parses."""
    host = f"n{k}.{rng.choice(['tea', 'cup', 'pot'])}.example"
    host = host.upper() if rng.random() < 0.3 else host
    text, parses = {
        "port": (f"http://{host}:{rng.randrange(1, 70000)}/x", True),
        "query": (f"https://{host}/?q={k}&r=%{rng.randrange(16, 256):02x}", True),
        "fragment": (f"https://{host}/x#part-{k}", True),
        "percent": (f"https://{host}/%{rng.randrange(16, 256):02X}", True),
        "user": (f"https://me:{k}@{host}", True),
        "broken": (f"https://{host}/two words", False),
        "half": (f"https://{host}/%{k % 10}", False),
    }[rng.choice(["port", "query", "fragment", "percent", "user", "broken", "half"])]
    return text, parses


def test_queue(spark):
    rng = random.Random(11)
    texts = [_queued(rng, k) for k in range(40)]
    urls = [u for u, _ in texts]
    assert 5 < sum(p for _, p in texts) < 40
    empty = spark.createDataFrame([], QUEUE_SCHEMA)
    once = queue_publish(empty, _queue(spark, [(i, u) for i, u in enumerate(urls)]))
    rows = once.orderBy("id").collect()
    assert [r["url"] for r in rows] == urls and [r["id"] for r in rows] == list(range(1, 41))
    assert all(r["created_at"] is not None for r in rows)

    again = queue_publish(once, _queue(spark, [(9, "http://new/"), (1, urls[3]), (5, "http://first/"), (7, "http://new/")]))
    assert [tuple(r) for r in again.where("id > 40").select("id", "url").orderBy("id").collect()] == [
        (41, "http://first/"), (42, "http://new/"),
    ]
    batch, rest = queue_dequeue(once, 3)
    assert sorted(r["url"] for r in batch.collect()) == sorted(u for u, parses in texts[:3] if parses) and rest.count() == 37
    drained, left = queue_dequeue(once, 100)
    assert drained.count() == sum(parses for _, parses in texts) and left.count() == 0
    back = queue_publish(left, _queue(spark, [(1, urls[0])]), last_id=40)
    assert [tuple(r) for r in back.select("id", "url").collect()] == [(41, urls[0])]


def test_dequeue_skips_text_that_is_no_url(spark):
    stored = spark.createDataFrame([(1, "not a url", None), (2, "http://a/", None), (3, "http://b/", None)], QUEUE_SCHEMA)
    batch, rest = queue_dequeue(stored, 2)
    assert [r["id"] for r in batch.collect()] == [2] and [r["id"] for r in rest.collect()] == [3]


def test_fetch_keeps_the_asked_url_and_lowest_page(spark):
    pages = spark.createDataFrame([(5, "http://h/a/", "five"), (2, "http://h/a#x", "two"), (3, "http://h/b", "b")], PAGES)
    frontier = spark.createDataFrame([(1, "http://h/a?ref=1"), (2, "http://H/b"), (3, "http://h/none"), (4, "bad url")], "seq bigint, url string")
    found, missing = fetch_pages(frontier, pages)
    assert {tuple(r) for r in found.collect()} == {("http://h/a?ref=1", "two", 1), ("http://H/b", "b", 2)}
    assert {(r["url"], r["error_class"]) for r in missing.collect()} == {("http://h/none", "infra"), ("bad url", "infra")}


def test_redirects(spark):
    hops = [(f"u{i}", f"u{i + 1}") for i in range(5)] + [("loop", "loop")] + [(f"x{i}", "login") for i in range(20)] + [("login", "home")]
    redirects = spark.createDataFrame(hops, "src string, dst string")
    urls = [f"u{i}" for i in range(6)] + ["loop"] + [f"x{i}" for i in range(20)]
    got = {r["url"]: (r["final_url"], r["hops"], r["error_class"]) for r in resolve_redirects(spark.createDataFrame([(u,) for u in urls], "url string"), redirects).collect()}
    assert len(got) == len(urls)
    assert got["u5"] == ("u5", 0, None) and got["u2"] == ("u5", 3, None)
    assert got["u1"] == (None, 3, "infra") and got["loop"] == (None, 3, "infra")
    assert all(got[f"x{i}"] == ("home", 2, None) for i in range(20))


def test_discover_links_order_and_quirks(spark):
    pages = spark.createDataFrame(
        [
            (2, "https://h.example/2", _anchors("/b", "/a", "https://github.com/x")),
            (1, "https://h.example/1", _anchors("/a/", "/app.js", "/app.js/", "//h.example/wiki/Special:X",
                                               "https://h.example//wiki/Special:Y", "/é", "https://off.example/z?b=1&a=2", "/a#f", "/seen")),
            (3, "not a url", _anchors("/x")),
            (4, "https://h.example/4", None),
        ],
        PAGES,
    )
    seen = spark.createDataFrame([("https://h.example/seen",)], "key string")
    new, bad = discover_links(pages, seen)
    assert [tuple(r) for r in new.select("seq", "page", "url", "host").orderBy("seq").collect()] == [
        (1, "https://h.example/1", "https://h.example/a", "h.example"),
        (2, "https://h.example/1", "https://h.example/app.js", "h.example"),
        (3, "https://h.example/1", "https://h.example/wiki/Special:Y", "h.example"),
        (4, "https://h.example/1", "https://off.example/z?a=2&b=1", "off.example"),
        (5, "https://h.example/2", "https://h.example/b", "h.example"),
    ]
    failed = {(1, "domain", L.BAD_HREF), (3, "domain", L.NO_BASE), (4, "domain", L.NO_HTML)}
    assert {(r["page_id"], r["error_class"], r["error"]) for r in bad.collect()} == failed
    staged, bad = discover_links(pages, seen, work_dir(spark, "discover"))
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, new.collect()))
    assert {(r["page_id"], r["error_class"], r["error"]) for r in bad.collect()} == failed


def _crawl_by_hand(seeds, pages, max_rounds):
    """``pages``: canonical url -> list of canonical links."""
    met = {u: 0 for u in seeds}
    frontier = list(seeds)
    n = 0
    while max_rounds is None or n < max_rounds:
        n += 1
        new = []
        for u in frontier:
            for v in pages.get(u.rstrip("/"), []):
                if v not in met:
                    met[v] = n
                    new.append(v)
        frontier = new
        if not frontier:
            break
    return met


def test_crawl_matches_a_walk_by_hand(spark):
    rng = random.Random(2)
    names = [f"https://h{i % 5}.example/p{i}" for i in range(60)]
    links = {u: rng.sample(names, rng.randint(0, 3)) + [f"https://gone.example/{i}"] for i, u in enumerate(names)}
    pages = spark.createDataFrame([(i, u + "/", _anchors(*links[u])) for i, u in enumerate(names)], PAGES)
    seeds = [names[0] + "/", names[7]]
    for rounds in (0, 2, 30, None):
        got = crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), pages, rounds)
        assert {r["url"]: r["round"] for r in got.collect()} == _crawl_by_hand(seeds, links, rounds)


def test_crawl_goes_on_to_an_empty_frontier(spark):
    # a chain of 14 pages, the last of which links to one that is not there
    url = "https://h.example/p{}".format
    pages = spark.createDataFrame([(i, url(i), _anchors(url(i + 1), "/bad url" if i == 9 else url(0))) for i in range(14)], PAGES)
    seeds = spark.createDataFrame([(url(0),)], "url string")
    root = work_dir(spark, "chain")
    got = crawl(seeds, pages, work_dir=root)
    assert {r["url"]: r["round"] for r in got.collect()} == {url(i): i for i in range(15)}
    assert spark.read.parquet(f"{root}/frontier").count() == 0
    assert [r["url"] for r in unanswered(got, pages).collect()] == [url(14)]
    assert [(r["page_id"], r["href"]) for r in crawl_failures(got, pages).collect()] == [(9, "/bad url")]
    root = work_dir(spark, "chain-cut")
    crawl(seeds, pages, 3, root)
    assert [r["url"] for r in spark.read.parquet(f"{root}/frontier").collect()] == [url(3)]


def test_crawl_seed_is_seen_as_written(spark):
    # the seed has a trailing slash, so its canonical form is a new URL; relative
    # links resolve against the seed as given, later against the canonical URL
    pages = spark.createDataFrame([(1, "https://h.example/d/", _anchors("x", "/d"))], PAGES)
    got = crawl(spark.createDataFrame([("https://h.example/d/",)], "url string"), pages, 5)
    assert {(r["url"], r["host"], r["round"]) for r in got.collect()} == {
        ("https://h.example/d/", "h.example", 0), ("https://h.example/d/x", "h.example", 1),
        ("https://h.example/d", "h.example", 1), ("https://h.example/x", "h.example", 2),
    }


def test_crawl_may_reuse_its_folder(spark):
    root = work_dir(spark, "crawl-twice")
    pages = spark.createDataFrame([(1, "https://h.example/a", _anchors("/b")), (2, "https://h.example/b", _anchors("/c"))], PAGES)
    seeds = spark.createDataFrame([("https://h.example/a",)], "url string")
    crawled = crawl(seeds, pages, 5, root)
    assert crawled.count() == 3
    assert [tuple(r)[:2] for r in unanswered(crawled, pages).collect()] == [("https://h.example/c", "infra")]
    assert crawl(seeds, pages, 1, root).count() == 2


@pytest.fixture
def arrival_files(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"{rng.choice('aab')}.example", f"http://x/{rng.randrange(40)}", rng.randrange(5000)) for i in range(120)]
    schema = "seq bigint, host string, url string, arrival_ms bigint"
    for k in range(3):
        spark.createDataFrame(rows[k * 40:(k + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, schema, str(tmp_path)


def _drain(stream, root):
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def test_politeness_stream_equals_batch(spark, arrival_files):
    rows, schema, root = arrival_files
    stream = link_stream(spark, f"{root}/in", schema, max_files_per_trigger=1)
    got = {r["seq"]: (r["eligible_at"], r["dispatch_at"]) for r in _drain(politeness_stream(stream, 300), root).collect()}
    batch = S.politeness_plan(spark.createDataFrame(rows, schema), 300)
    want = {r["seq"]: (r["eligible_at"], r["dispatch_at"]) for r in batch.collect()}
    assert got == want
    again = link_stream(spark, f"{root}/in", schema, max_files_per_trigger=1)
    run_politeness_stream(again, 300, f"{root}/work").awaitTermination()
    plan = spark.read.parquet(f"{root}/work/plan")
    assert plan.select("batch").distinct().count() == 3
    assert {r["seq"]: (r["eligible_at"], r["dispatch_at"]) for r in plan.collect()} == want


def test_dedup_stream_survives_restart(spark, arrival_files):
    rows, schema, root = arrival_files
    stream = dedup_stream(link_stream(spark, f"{root}/in", schema, max_files_per_trigger=1)).select("key")
    assert sorted(r["key"] for r in _drain(stream, root).collect()) == sorted({r[2] for r in rows})
    spark.createDataFrame([(500, "a.example", "http://x/1", 0), (501, "a.example", "http://x/new", 0)], schema).write.mode("append").parquet(f"{root}/in")
    assert _drain(stream, root).count() == len({r[2] for r in rows}) + 1


def test_first_row_of_a_key_wins_over_batches(spark, arrival_files):
    rows, schema, root = arrival_files
    stream = link_stream(spark, f"{root}/in", schema, max_files_per_trigger=1)
    run_dedup_stream(stream, f"{root}/work").awaitTermination()
    got = {r["key"]: r["seq"] for r in spark.read.parquet(f"{root}/work/firsts").collect()}
    assert got == {u: min(r[0] for r in rows if r[2] == u) for u in {r[2] for r in rows}}


def test_politeness_stream_keeps_large_times_and_rows_without_host(spark, tmp_path):
    far = 2**53
    rows = [(0, None, "http://x/0", far + 1), (1, "", "http://x/1", far + 1), (2, "a", "http://x/2", far + 3), (3, "a", "http://x/3", far + 3)]
    schema = "seq bigint, host string, url string, arrival_ms bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = _drain(politeness_stream(link_stream(spark, f"{tmp_path}/in", schema), 7), str(tmp_path)).collect()
    assert {r["seq"]: (r["host"], r["dispatch_at"]) for r in out} == {0: ("", far + 1), 1: ("", far + 8), 2: ("a", far + 3), 3: ("a", far + 10)}


@pytest.mark.parametrize("on_disk", [False, True])
def test_politeness_stream_goes_on_in_either_store(spark, tmp_path, on_disk):
    """It asked for RocksDB, so a query started in a plain session failed with its first batch."""
    schema = "seq bigint, host string, url string, arrival_ms bigint"
    rows = [(k, f"h{k % 2}", f"http://x/{k}", k * 10) for k in range(20)]
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = politeness_stream(link_stream(spark, f"{tmp_path}/in", schema), 300)
        with disk_state(spark) if on_disk else nullcontext():
            out = _drain(stream, str(tmp_path))
    want = S.politeness_plan(spark.createDataFrame(rows, schema), 300).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == len(rows)
    assert spark.conf.get(store, None) == before


def test_discover_stream_equals_batch(spark, tmp_path):
    parts = [
        [(1, "https://h.example/1", _anchors("/a", "/b", "https://o.example/x")), (2, "https://h.example/2", _anchors("/b", "/c"))],
        [(3, "https://h.example/3", _anchors("/c", "/d", "https://o.example/y", "/bad url")), (4, "https://h.example/4", _anchors("/a"))],
    ]
    root = str(tmp_path)
    for p in parts:
        spark.createDataFrame(p, PAGES).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = link_stream(spark, f"{root}/in", PAGE_SCHEMA, 1).withColumn("arrival_ms", F.col("page_id") * 10)
    run_discover_stream(stream, 100, f"{root}/work").awaitTermination()
    got = spark.read.parquet(f"{root}/work/plan")
    assert got.select("batch").distinct().count() == 2
    assert [r["href"] for r in spark.read.parquet(f"{root}/work/quarantine").collect()] == ["/bad url"]
    new, _ = discover_links(spark.createDataFrame(parts[0] + parts[1], PAGES))
    timed = new.withColumn("arrival_ms", F.substring_index("page", "/", -1).cast("bigint") * 10)
    plan = S.politeness_plan(timed, 100)
    cols = ["seq", "page", "url", "host", "dispatch_at"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, plan.select(cols).collect()))


def test_quarantine_splits(spark):
    df = spark.createDataFrame([("a", None), ("b", "domain"), ("c", "infra")], "url string, error_class string")
    good, bad = L.quarantine(df)
    assert [r["url"] for r in good.collect()] == ["a"] and bad.count() == 2


def test_work_dir_needs_a_shared_folder_on_a_cluster(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Session:
        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})()
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(Session(master), "x")
    assert work_dir(Session("local[2]"), "x")


def test_salts_split_a_hot_key(spark):
    # a third of all rows on one key: no salt holds more than its share of them
    from hrefloom.operators import skew

    n = 6000
    rows = spark.range(n).selectExpr("id AS seq", "if(id % 3 = 0, 'hot', concat('k', id)) AS key")
    table = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = skew.salted_join(rows, table, "key", "left")
        sizes = [r["n"] for r in joined.where("key = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert joined.where("v = 1").count() == n // 3 and joined.count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == n // 3 and max(sizes) <= n // 3 // 2


def test_ledger_windows_stay_small(spark):
    # as many milliseconds as rows, and numbers unrelated to them
    from pyspark.sql import Window

    from hrefloom.operators.numbering import leaf_of

    rows = spark.range(50_000).selectExpr("id * 7919 % 5000000000 AS ts_ms", "id * 104729 % 1000003 * 1048577 AS seq", "1L AS delta")
    groups = rows.groupBy(leaf_of("ts_ms").alias("g")).agg(F.countDistinct("ts_ms").alias("n"))
    assert groups.agg(F.max("n")).first()[0] < 2**20
    ledger = S.work_ledger(rows)
    running = F.row_number().over(Window.orderBy("ts_ms", "seq"))
    assert ledger.withColumn("want", running).where("want <> outstanding OR halted").count() == 0 and ledger.count() == 50_000


def test_hot_keys_give_whole_results(spark):
    # a third of all rows on one key
    n = 3000
    rows = spark.range(n).selectExpr("id", "if(id % 3 = 0, 'http://hot.example/', concat('http://h', id, '.example/')) AS url")
    from hrefloom.operators.blocklist import blocklist_anti_join
    from hrefloom.operators.dedup import has_seen

    rules = spark.createDataFrame([("hot.example", "domain")], "rule string, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert blocklist_anti_join(rows, rules).count() == n - n // 3
        flags = has_seen(rows.withColumnRenamed("id", "seq"))
        assert flags.where("seen").count() == n // 3 - 1 and flags.count() == n
        hops = spark.createDataFrame([("http://hot.example/", "http://x/")], "src string, dst string")
        ends = resolve_redirects(rows, hops)
        assert ends.where("final_url = 'http://x/' and hops = 1").count() == n // 3 and ends.count() == n
        pages = spark.createDataFrame([(1, "http://hot.example/", "h")], PAGES)
        found, missing = fetch_pages(rows.select(F.col("id").alias("seq"), F.concat("url", F.lit("#"), "id").alias("url")), pages)
        assert found.count() == n // 3 and missing.count() == n - n // 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
