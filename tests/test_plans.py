"""Plan shapes that matter at scale, and a sample of queries against DuckDB."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hrefloom.functions.urls import URI_PATTERN, canonicalise
from hrefloom.operators import links as L
from hrefloom.plans.discover import accepted_links, new_links
from hrefloom.plans.oracle import ORACLE
from hrefloom.plans.registry import QUERIES
from hrefloom.sources.queue import QUEUE_SCHEMA, queue_dequeue
from hrefloom.sources.snapshot import page_index


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def test_page_index_reads_narrow_columns(pages):
    text = _plan(page_index(pages))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text or "ReadSchema: struct<url:string,page_id:bigint>" in text


def test_html_is_scanned_once_and_links_resolved_once(spark, pages):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    links = accepted_links(L.page_links(pages))
    text = _plan(links.where(F.col("host") == "x.example").select("url"))
    assert text.count("regexp_extract_all(html") == 1
    # the pattern stands once each for the page URL, its base and the link
    assert text.count(URI_PATTERN) == 3
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    listed = _plan(L.page_links_set(L.resolve_links(L.extract_links(pages))))
    assert listed.count("regexp_extract_all(html") == 1
    # and once more for the key of the link
    assert listed.count(URI_PATTERN) == 4


def test_new_links_is_one_shuffle_and_shares_it_with_the_anti_join(spark, pages):
    seen = pages.select(canonicalise("url").alias("key")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        text = _plan(new_links(accepted_links(L.page_links(pages)), seen))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # one exchange of the links (after a partial aggregate), one of the seen keys
    assert sum("Exchange hashpartitioning" in line for line in text.split("\n")) == 2
    assert text.count("SortMergeJoin") == 1 and "partial_min" in text


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin_is_quick_in_little_memory(name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '600MB'")
    for table in ("pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    start = time.perf_counter()
    con.execute(ORACLE[name]).fetchall()
    took = time.perf_counter() - start
    print(f"{name}: {took:.2f} s")
    assert took < 20


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    con = duckdb.connect()
    for table in ("pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(names) == cols and got == want and got


def test_dequeue_shuffles_ids_only(spark):
    queue = spark.createDataFrame([(k, f"http://tea.example/{k}", None) for k in range(9)], QUEUE_SCHEMA)
    for part in queue_dequeue(queue, 4):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan
        shuffled = [line for line in _plan(part).split("\n") if "Exchange" in line]
        assert shuffled and not any("url" in line for line in shuffled)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["seq", "page", "url", "host"]
