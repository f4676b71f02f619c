import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from hrefloom.operators import links as L
from hrefloom.operators.blocklist import blocklist_anti_join
from hrefloom.operators.dedup import has_seen
from hrefloom.operators.numbering import global_index, global_rank
from hrefloom.operators import schedule as S
from hrefloom.workdir import work_dir

PAGE = "https://h.example/a/b/c?q=1"

# html, links in document order (None: quarantined)
EXTRACT = [
    ('<a href="x">', ["https://h.example/a/b/x"]),
    ("<a href='x'>", ["https://h.example/a/b/x"]),
    ("<a href=x>", ["https://h.example/a/b/x"]),
    ("<A HREF=x/y>", ["https://h.example/a/b/x/y"]),
    ('<a\nclass="z"\thref = "x" id=1>', ["https://h.example/a/b/x"]),
    ('<a title="href=no" data-href="no" href="x">', ["https://h.example/a/b/x"]),
    ('<a href="first" href="second">', ["https://h.example/a/b/first"]),
    ('<a href="?a=1&amp;b=2">', ["https://h.example/a/b/c?a=1&b=2"]),
    ('<a href="&#x2F;x&#47;y&sol;z">', ["https://h.example/x/y/z"]),
    ('<a href="?a&copy=1&lt">', [None]),
    ('<a href="?a&copy=1">', ["https://h.example/a/b/c?a&copy=1"]),
    ('<a href="/caf&eacute;">', [None]),
    ("<a>no</a><abbr href='x'><area href='x'>", []),
    ("<!-- <a href='no'> --><a href='x'>", ["https://h.example/a/b/x"]),
    ("<!--> <a href='x'>", ["https://h.example/a/b/x"]),
    ("<script>'<a href=\"no\">'</script><style><a href=no></style><a href=x>", ["https://h.example/a/b/x"]),
    ("<title><a href=no></title><textarea><a href=no></textarea>", []),
    ("<script>var a = '<a href=no>'", []),
    ("<div data-x=\"<a href='no'>\"><a href=x>", ["https://h.example/a/b/x"]),
    ("<a href='x'", []),
    ("<a href='x>", []),
    ("<a href>", ["https://h.example/a/b/c?q=1"]),
    ('<a href="">', ["https://h.example/a/b/c?q=1"]),
    ('<a href="  x\n">', ["https://h.example/a/b/x"]),
    ('<a href="a b">', [None]),
    ('<a href="/é">', [None]),
    ('<a href="../x"><a href="./x"><a href="../../../x">',
     ["https://h.example/a/x", "https://h.example/a/b/x", "https://h.example/x"]),
    ('<a href="?q"><a href="#f"><a href="//o.example/x"><a href="/x">',
     ["https://h.example/a/b/c?q", "https://h.example/a/b/c?q=1#f", "https://o.example/x", "https://h.example/x"]),
    ('<a href="mailto:a@b"><a href="javascript:void(0)"><a href="HTTP://Q.example">',
     ["mailto:a@b", "javascript:void(0)", "HTTP://Q.example"]),
    ('<a href="x"><a href="x">', ["https://h.example/a/b/x", "https://h.example/a/b/x"]),
    ('<a href="x"><base href="/r/s"><base href="/no/">', ["https://h.example/r/x"]),
    ('<base href="http://o.example"><a href="x">', ["http://o.example/x"]),
    ("<svg/><p a=1/><a/href=x>", ["https://h.example/a/b/x"]),
    ("a < b <a href=x> c > d", ["https://h.example/a/b/x"]),
    (None, []),
    ("", []),
]


def test_extract_and_resolve(spark):
    rows = [(i, PAGE, html) for i, (html, _) in enumerate(EXTRACT)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {i: [] for i in range(len(EXTRACT))}
    for r in L.resolve_links(L.extract_links(pages)).orderBy("page_id", "pos").collect():
        assert (r["link"] is None) == (r["error"] is not None)
        assert r["pos"] == len(got[r["page_id"]])
        got[r["page_id"]].append(r["link"])
    assert [(h, got[i]) for i, (h, e) in enumerate(EXTRACT) if got[i] != e] == []
    fused = L.page_links(pages).select("page_id", "pos", "href", F.expr(L.U.joined_sql("pieces")).alias("link"), "error")
    plain = L.resolve_links(L.extract_links(pages)).select("page_id", "pos", "href", "link", "error")
    assert sorted(map(str, fused.collect())) == sorted(map(str, plain.collect()))
    assert L.failed_pages(pages).count() == 1


def test_rfc3986_examples(spark):
    base = "http://a/b/c/d;p?q"
    cases = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
        "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
        "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
        "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
        "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
        "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g",
        "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
        "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x",
        "http:g": "http:g",
    }
    df = spark.createDataFrame([(base, None, h, e) for h, e in cases.items()], "page string, base string, href string, want string")
    bad = L.resolve_links(df).where("link is null or link <> want").select("href", "link", "want").collect()
    assert bad == []


def test_unusable_page_url(spark):
    df = spark.createDataFrame([("not a url", None, "/x"), ("/rel", None, "/x")], "page string, base string, href string")
    assert {r["error"] for r in L.resolve_links(df).collect()} == {L.NO_BASE}


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.found.append(href)


def test_extraction_agrees_with_html_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = _Anchors()
        parser.feed(r["html"])
        want[r["page_id"]] = parser.found
    got = {k: [] for k in want}
    for r in L.extract_links(pages).orderBy("page_id", "pos").collect():
        got[r["page_id"]].append(r["href"])
    assert got == want and sum(map(len, want.values())) > 200


def test_pathological_pages_stay_linear(spark):
    big = "<a " + "x='1' " * 50000 + "href=ok>" + "<" * 100000 + "<!--" + "-" * 100000 + "<a href=no>"
    pages = spark.createDataFrame([(1, PAGE, big)], "page_id bigint, url string, html string")
    assert [r["href"] for r in L.extract_links(pages).collect()] == ["ok"]


def test_page_report(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "b"), ("q", None), ("q", "http://X.example/"), ("q", "http://x.example/")], "page string, link string")
    got = {r["page"]: r["links"] for r in L.page_report(df).collect()}
    assert got == {"p": ["a", "b"], "q": ["http://X.example/"]}


SEEN = [
    # three spellings of one URL: scheme and host in any case
    (["http://tea.example/cup", "HTTP://tea.example/cup", "http://TEA.example/cup"], [False, True, True]),
    # everything else counts as written
    (["http://tea.example/cup", "http://tea.example/Cup", "http://tea.example/cup/", "http://tea.example/cup?"], [False] * 4),
    (["http://tea.example:80/", "http://tea.example/", "http://tea.example:80/"], [False, False, True]),
    (["http://Me@tea.example/", "http://me@tea.example/", "http://Me@TEA.example/"], [False, False, True]),
    (["http://tea.example/#a", "http://tea.example/#b", "http://tea.example/#a"], [False, False, True]),
    # repeats far apart, and text that is no URL
    (["http://a.example/"] + [f"http://b.example/{k}" for k in range(5)] + ["http://a.example/"], [False] * 6 + [True]),
    (["two words", "Two words", "two words"], [False, False, True]),
]


def test_has_seen(spark):
    for urls, want in SEEN:
        df = spark.createDataFrame(list(enumerate(urls)), "seq bigint, url string")
        assert [r["seen"] for r in has_seen(df).orderBy("seq").collect()] == want
    df = spark.createDataFrame([(1, "http://a"), (2, "http://b"), (3, "http://b")], "seq bigint, url string")
    seen = spark.createDataFrame([("http://a",)], "key string")
    assert [r["seen"] for r in has_seen(df, seen).orderBy("seq").collect()] == [True, False, True]


def test_blocklist_anti_join(spark):
    rules = spark.createDataFrame([("Spam.example", "domain"), ("gov", "label"), ("onion", "final_tld")], "rule string, kind string")
    urls = {
        "http://spam.example/": 0, "http://a.b.SPAM.example./x": 0, "http://notspam.example": 1, "http://a.gov.uk": 0,
        "http://gov": 0, "http://x.onion": 0, "http://onion.x": 1, "/rel": 1, "mailto:a@spam.example": 1, "bad url": 1,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"] for r in blocklist_anti_join(df, rules).collect()} == {u for u, keep in urls.items() if keep}


def test_global_index(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(200)] + list(range(50)) + [2**45 + i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "seq bigint")
    got = {r["seq"]: r["i"] for r in global_index(df, ["seq"], "i").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}
    for bits in (0, 3, 12):
        again = {r["seq"]: r["i"] for r in global_index(df, ["seq"], "i", bits).collect()}
        assert again == got


def test_global_rank_splits_ties(spark):
    rows = [(0, i % 3, i) for i in range(500)] + [(1, 0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, seq bigint").repartition(5)
    got = {(r["a"], r["seq"]): r["i"] for r in global_rank(df, ["a", "b", "seq"], "i", work_dir(spark, "rank")).collect()}
    assert got == {(a, s): i + 1 for i, (a, _, s) in enumerate(sorted(rows))}


def _simulate(rows, c, state=None):
    last, out = dict(state or {}), {}
    for seq, host, arrival in sorted(rows):
        eligible = last[host] + c if host in last else arrival
        last[host] = max(arrival, eligible)
        out[seq] = (eligible, last[host])
    return out, last


def _plan(spark, rows, c, state=None, bits=20):
    df = spark.createDataFrame([(s, h, f"http://{h}/{s}", a) for s, h, a in rows], "seq bigint, host string, url string, arrival_ms bigint")
    st = None if state is None else spark.createDataFrame(list(state.items()), "host string, last_dispatch_at bigint")
    return S.politeness_plan(df, c, st, bits)


def test_politeness_plan_matches_simulation(spark):
    rng = random.Random(7)
    rows = [(s, rng.choice("aaabcd") + ".example", rng.randrange(0, 40000)) for s in range(400)]
    want, last = _simulate(rows, 700)
    for bits in (0, 1, 3, 20):
        plan = _plan(spark, rows, 700, bits=bits)
        assert {r["seq"]: (r["eligible_at"], r["dispatch_at"]) for r in plan.collect()} == want
    assert {r["host"]: r["last_dispatch_at"] for r in S.next_host_state(plan).collect()} == last
    first, mid = _simulate(rows[:150], 700)
    rest = _plan(spark, rows[150:], 700, mid, bits=4)
    assert {r["seq"]: (r["eligible_at"], r["dispatch_at"]) for r in rest.collect()} == {s: want[s] for s in range(150, 400)}


def test_politeness_plan_shuffles_rows_once_and_takes_no_host(spark):
    rows = [(i, None if i % 3 else "a", 0) for i in range(9)]
    plan = _plan(spark, rows, 10, bits=1)
    assert [r["dispatch_at"] for r in plan.where("host = ''").orderBy("seq").collect()] == [0, 10, 20, 30, 40, 50]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        text = _plan(spark, rows, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    wide = [line for line in text.split("\n") if "Exchange" in line]
    # the rows once, the finished summaries, and the narrow rows the summaries
    # are made of (twice in this plan without reuse, at two levels)
    assert len([w for w in wide if "hashpartitioning(host" in w and "_bucket" in w and "_group" not in w]) <= 4
    assert "SortMergeJoin" in text and "CartesianProduct" not in text


def test_schedule_cases(spark):
    hour = 3_600_000
    cases = [
        (["a", "a"], [0, hour]),
        (["a", "b", "a"], [0, 0, hour]),
        (["a", "b", "a", "b"], [0, 0, hour, hour]),
        (["a", "a", "a"], [0, hour, 2 * hour]),
        ([], []),
    ]
    for hosts, want in cases:
        plan = _plan(spark, [(i, f"{h}.com", 0) for i, h in enumerate(hosts)], hour)
        assert [r["dispatch_at"] for r in plan.orderBy("seq").collect()] == want
    order = S.fair_order(_plan(spark, [(0, "b", 0), (1, "a", 0), (2, "b", 0), (3, "a", 0)], hour))
    assert [r["seq"] for r in order.collect()] == [1, 0, 3, 2]


def test_fifo_stats_and_ledger(spark):
    df = spark.createDataFrame([(30, "x"), (10, "y"), (20, "z")], "seq bigint, url string")
    assert {r["seq"]: r["dispatch_at"] for r in S.fifo_plan(df, 100).collect()} == {10: 100, 20: 200, 30: 300}
    plan = _plan(spark, [(0, "a", 0), (1, "a", 0), (2, "b", 5)], 10)
    stats = {r["host"]: (r["queued"], r["next_eligible_at"]) for r in S.host_queue_stats(plan).collect()}
    assert stats == {"a": (2, 0), "b": (1, 5)}
    at = lambda ms, c: {r["host"]: (r["queued"], r["next_eligible_at"]) for r in S.host_queue_stats(plan, ms, c).collect()}
    assert at(4, 10) == {"a": (1, 10)}
    assert at(5, 10) == {"a": (1, 10), "b": (0, 15)}
    # what has not arrived is not queued; a drained host stays with its cooldown
    plan = _plan(spark, [(0, "a", 0), (1, "a", 10), (2, "a", 9000)], 1000)
    assert at(100, 1000) == {"a": (1, 1000)} and at(2000, 1000) == {"a": (0, 2000)} and at(9000, 1000) == {"a": (0, 10000)}

    rng = random.Random(5)
    events = [(rng.choice([0, 0, 0, 10**12, 17, 2**31]), s, rng.choice([1, 1, -1])) for s in range(300)]
    events.append((-5, 1000, 2))
    total, halted, want = 0, False, {}
    for ts, seq, delta in sorted(events):
        total += delta
        halted = halted or total == 0
        want[seq] = (total, halted)
    led = spark.createDataFrame(events, "ts_ms bigint, seq bigint, delta bigint")
    assert {r["seq"]: (r["outstanding"], r["halted"]) for r in S.work_ledger(led).collect()} == want
    assert S.work_totals(led).first()["outstanding"] == total
