"""The same queries as DuckDB SQL, written on their own terms.

URLs are cut with the loose pattern of RFC 3986 appendix B and checked apart;
block rules are a suffix scan; plans are computed by recursion, row by row;
the crawl is a recursive CTE.  None of it shares logic with the Spark side.
"""

from __future__ import annotations

import re

from hrefloom.functions import rules
from hrefloom.plans.inputs import PROBE_HREFS, SPAM_RULES, probe_anchors
from hrefloom.plans.registry import (
    ASKED_EVERY,
    COOLDOWN_MS,
    DEQUEUED,
    FIFO_INTERVAL_MS,
    PAGE_INTERVAL_MS,
    STATS_AT_MS,
    TAKEN,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "(" + ", ".join(_q(i) for i in items) + ")"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(c) for c in r) + ")" for r in rows) + ")"


PROBES = f"""
probes AS (
  SELECT p.page_id, p.url AS page, CAST(h.pos - 1 AS INTEGER) AS pos, h.href
  FROM pages p, (SELECT unnest([{", ".join(_q(h) for h in PROBE_HREFS)}]) AS href,
                        generate_subscripts([{", ".join(_q(h) for h in PROBE_HREFS)}], 1) AS pos) h
),
urls AS (
  SELECT page_id, -1 AS pos, url FROM pages
  UNION ALL SELECT page_id, pos, href FROM probes
)"""

APPENDIX_B = r"'^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$'"
B_NAMES = "['g1', 'scheme', 'g2', 'auth', 'path', 'g3', 'query', 'g4', 'fragment']"
CHARS = r"'^([A-Za-z0-9._~:/?#@!$&''()*+,;=\[\]-]|%[0-9A-Fa-f]{2})*$'"
AUTH = r"'^(([^@]*)@)?(\[[^\]]*\]|[^:]*)(:([0-9]*))?$'"


def _cut(source: str, out: str, keys: str = "page_id, pos", url: str = "url") -> str:
    """CTE ``out``: the URLs of ``source`` cut into parts."""
    return rf"""
{out}_b AS (
  SELECT {keys}, {url} AS url, regexp_extract({url}, {APPENDIX_B}, {B_NAMES}) AS m FROM {source}
),
{out}_a AS MATERIALIZED (
  SELECT *, regexp_extract(m.auth, {AUTH}, ['g1', 'userinfo', 'host', 'g2', 'port']) AS a FROM {out}_b
),
{out} AS (
  SELECT {keys}, url,
    regexp_matches(url, {CHARS}) AND (m.g2 = '' OR regexp_matches(m.auth, {AUTH}))
      AND NOT (m.scheme = '' AND regexp_matches(url, '^[^/?#]*:'))
      AND (coalesce(a.port, '') = '' OR TRY_CAST(a.port AS INTEGER) IS NOT NULL) AS ok,
    nullif(lower(m.scheme), '') AS scheme,
    nullif(a.userinfo, '') AS userinfo,
    CASE WHEN m.g2 <> '' THEN lower(a.host) END AS host,
    TRY_CAST(nullif(a.port, '') AS INTEGER) AS port,
    m.path AS path, m.g3 <> '' AS asked, m.query AS query, nullif(m.fragment, '') AS fragment,
    m.g1 AS raw_scheme, m.auth AS raw_auth, m.g2 AS raw_slashes, m.g3 AS raw_query, m.g4 AS raw_fragment
  FROM {out}_a
)"""


def _canon(source: str, out: str, paths: bool = True, queries: bool = True) -> str:
    """CTE ``out``: ``source`` (a cut) with each canonical part beside the raw one.

    Every part is made from its own row by list functions.  Without ``paths`` or
    ``queries`` those parts are left out, and so is what they are made of.
    """
    path_parts = r"""
    coalesce(array_to_string(list_transform(regexp_extract_all(path, '%[0-9A-Fa-f]{2}|[^%]|%'), lambda t:
      CASE WHEN NOT regexp_matches(t, '^%[0-9A-Fa-f]{2}$') THEN t
           WHEN regexp_matches(url_decode(CASE WHEN t < '%8' THEN t ELSE '%00' END), '^[A-Za-z0-9._~-]$') THEN url_decode(t)
           ELSE upper(t) END), ''), '') AS recoded,"""
    pairs = r"""list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: {
      'k': url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')),
      'v': CASE WHEN contains(p, '=') THEN url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) END})"""
    tracking, wiki = (f"[{_list(keys)[1:-1]}]" for keys in (rules.TRACKING_KEYS, rules.WIKI_ACTION_KEYS))
    query_ctes = rf"""
{out}_pairs AS (SELECT *, {pairs} AS pairs FROM {source}),
{out}_texts AS (
  SELECT * EXCLUDE (pairs), list_transform(pairs, lambda x, i: {{'k': x.k, 'v': coalesce(x.v, ''), 'i': i,
    'txt': replace(replace(url_encode(x.k) || coalesce('=' || url_encode(x.v), ''), '%2F', '/'), '%3F', '?'),
    'plain': x.k || coalesce('=' || x.v, '')}}) AS texts
  FROM {out}_pairs
),"""
    query_parts = f"""
    coalesce(array_to_string(list_transform(texts, lambda x: x.plain), '&'), '') AS plain,
    coalesce(array_to_string(list_transform(texts, lambda x: x.txt), '&'), '') AS qtext,
    coalesce(array_to_string(list_transform(list_sort(list_filter(texts, lambda x: NOT list_contains({tracking}, x.k))), lambda x: x.txt), '&'), '') AS ctext,
    coalesce(len(list_filter(texts, lambda x: list_contains({wiki}, x.k))) > 0, false) AS wiki_action,"""
    cpath = "coalesce('/' || nullif(array_to_string(list_filter(string_split(recoded, '/'), lambda s: s <> ''), '/'), ''), '')"
    return rf"""
{query_ctes if queries else ""}
{out}_parts AS (
  SELECT *, {path_parts if paths else ""} {query_parts if queries else ""}
    regexp_replace(host, '\.$', '') AS bare_host,
    CASE WHEN (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN NULL ELSE port END AS cport,
    coalesce('/' || nullif(array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/'), ''), '') AS flat
  FROM {f"{out}_texts" if queries else source}
),
{out} AS (SELECT *{", " + cpath + " AS cpath" if paths else ""} FROM {out}_parts)"""


def _text(host="host", port="port", path="path", query="qtext", fragment="fragment") -> str:
    """SQL for a URL rendered from parts."""
    return (
        "coalesce(scheme || ':', '') || CASE WHEN host IS NULL THEN '' ELSE '//' || coalesce(userinfo || '@', '') || "
        f"{host} || coalesce(':' || CAST({port} AS VARCHAR), '') END || {path} || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END || coalesce('#' || {fragment}, '')"
    )


CANONICAL = _text("bare_host", "cport", "cpath", "ctext", "CAST(NULL AS VARCHAR)")

HAS_HOST = "coalesce(ok AND host <> '', false)"
SCHEME_OK = "coalesce(ok AND scheme IN ('http', 'https'), false)"
ASSET = f"(ok AND regexp_matches(lower(path), '\\.({'|'.join(rules.ASSET_EXTENSIONS)})$'))"
NAMESPACE = "(ok AND regexp_matches(path, '^/wiki/[^/]*:'))"
ACTION = "(ok AND wiki_action)"
ACCEPT = f"({HAS_HOST} AND {SCHEME_OK} AND NOT {ASSET} AND NOT {ACTION} AND NOT {NAMESPACE})"
LABEL = r"coalesce(ok AND regexp_matches(bare_host, '(^|\.)(gov|mil)(\.|$)'), false)"
FINAL = r"coalesce(ok AND regexp_matches(bare_host, '(^|\.)onion$'), false)"
_DOMAINS = _values([(d,) for d in sorted({d for group in rules.BLOCKED_DOMAINS.values() for d in group})])
BLOCKED = (
    f"({LABEL} OR {FINAL} OR coalesce(ok AND EXISTS (SELECT 1 FROM {_DOMAINS} AS rule(d) "
    "WHERE bare_host = d OR ends_with(bare_host, '.' || d)), false))"
)


def _on_urls(select: str, where: str = "true") -> str:
    """Over all URLs; only the parts that ``select`` and ``where`` name are made."""
    asked = f"{select} {where}"
    paths = bool(re.search(r"\b(recoded|cpath)\b", asked))
    queries = bool(re.search(r"\b(plain|qtext|ctext|wiki_action)\b", asked))
    return f"WITH {PROBES},{_cut('urls', 'cut')},{_canon('cut', 'u', paths=paths, queries=queries)} SELECT {select} FROM u WHERE {where}"


def _step(**parts: str) -> str:
    return _on_urls(f"page_id, pos, CASE WHEN ok THEN {_text(**parts)} END AS url")


# -- pages to links ---------------------------------------------------------

RICH = f"rich AS (SELECT page_id, url, html || {_q(probe_anchors())} AS html FROM pages)"


def _extracted(source: str) -> str:
    """CTE ``hrefs``: page_id, page, pos, href."""
    return rf"""
hrefs_raw AS (
  SELECT page_id, url AS page, regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '<(script|style|title)[^>]*>.*?</(script|style|title)', '', 'gs'), '<a\s[^>]*href="([^"]*)"', 1) AS hs
  FROM {source}
),
hrefs AS (
  SELECT page_id, page, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS pos, replace(unnest(hs), '&amp;', '&') AS href FROM hrefs_raw
)"""


def _resolved() -> str:
    """CTEs ``rcut`` (hrefs cut) and ``links``: page_id, page, pos, href, link."""
    return f"""
pcut_in AS (SELECT DISTINCT page_id, page FROM hrefs),{_cut("pcut_in", "pcut", "page_id", "page")},
{_cut("hrefs", "rcut", "page_id, page, pos, href", "href")},
joined AS (
  SELECT r.page_id, r.page, r.pos, r.href, r.ok, r.raw_fragment,
    CASE WHEN r.raw_scheme <> '' THEN r.raw_scheme ELSE b.raw_scheme END AS t_scheme,
    CASE WHEN r.raw_scheme <> '' OR r.raw_slashes <> '' THEN r.raw_slashes ELSE b.raw_slashes END AS t_auth,
    CASE WHEN r.raw_scheme <> '' OR r.raw_slashes <> '' OR starts_with(r.path, '/') THEN r.path
         WHEN r.path = '' THEN b.path
         WHEN b.raw_slashes <> '' AND b.path = '' THEN '/' || r.path
         ELSE regexp_replace(b.path, '[^/]*$', '') || r.path END AS t_path,
    r.raw_scheme = '' AND r.raw_slashes = '' AND r.path = '' AS same_doc,
    CASE WHEN r.raw_scheme = '' AND r.raw_slashes = '' AND r.path = '' AND r.raw_query = '' THEN b.raw_query
         ELSE r.raw_query END AS t_query
  FROM rcut r JOIN pcut b ON r.page_id = b.page_id
),
walked AS (
  SELECT *, CASE WHEN NOT same_doc AND starts_with(t_path, '/') AND contains(t_path, '/.') THEN
    list_reduce(list_prepend('', string_split(substr(t_path, 2), '/')),
      lambda acc, s: CASE s WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || s END)
      || CASE WHEN regexp_matches(t_path, '/[.][.]?$') THEN '/' ELSE '' END
    ELSE t_path END AS d_path
  FROM joined
),
links AS (
  SELECT page_id, page, pos, href,
    CASE WHEN ok THEN t_scheme || t_auth || d_path || t_query || raw_fragment END AS link
  FROM walked
)"""


RICH_LINKS = f"{RICH},{_extracted('rich')},{_resolved()}"

KEY = r"""CASE WHEN ok THEN lower(raw_scheme) || CASE WHEN raw_slashes = '' THEN '' ELSE
  '//' || regexp_extract(raw_auth, '^[^@]*@') || lower(regexp_replace(raw_auth, '^[^@]*@', '')) END || path || raw_query || raw_fragment
  ELSE url END"""


def _discovered(source: str, name: str) -> str:
    """CTE ``name``: page_id, page, pos, url, host of accepted links of ``links``."""
    return f"""
good AS (SELECT page_id, page, pos, link FROM {source} WHERE link IS NOT NULL),
{_cut("good", "lcut", "page_id, page, pos", "link")},
{_canon("lcut", "lu")},
{name} AS (
  SELECT page_id, page, pos, {CANONICAL} AS url, bare_host AS host FROM lu WHERE {ACCEPT} AND NOT {BLOCKED}
)"""


FIRSTS = """
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS nth FROM accepted) WHERE nth = 1
)"""

PAGE_CANON = f"{_cut('pages', 'pgcut', 'page_id')},{_canon('pgcut', 'pgu')}, page_keys AS (SELECT page_id, {CANONICAL} AS key FROM pgu)"

# -- plans ------------------------------------------------------------------

ARRIVALS = r"""
arrivals AS (
  SELECT e.event_id AS seq, lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]*)', 1)) AS host, p.url, epoch_us(e.ts) // 1000 AS arrival_ms
  FROM events e JOIN pages p ON e.event_id % (SELECT count(*) FROM pages) = p.page_id
)"""


def _planned(source: str) -> str:
    """CTE ``plan``: the schedule of ``source`` by stepping through each host."""
    return f"""
lined AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS nth FROM {source}),
stepped AS (
  SELECT host, nth, seq, arrival_ms AS eligible_at, arrival_ms AS dispatch_at FROM lined WHERE nth = 1
  UNION ALL
  SELECT l.host, l.nth, l.seq, s.dispatch_at + {COOLDOWN_MS}, greatest(l.arrival_ms, s.dispatch_at + {COOLDOWN_MS})
  FROM stepped s JOIN lined l ON l.host = s.host AND l.nth = s.nth + 1
),
plan AS (SELECT host, seq, eligible_at, dispatch_at FROM stepped)"""


PLAN = f"WITH RECURSIVE {ARRIVALS},{_planned('arrivals')}"

WORK = f"""WITH {ARRIVALS},
work AS (
  SELECT arrival_ms AS ts_ms, seq * 2 AS seq, 1 AS delta FROM arrivals
  UNION ALL SELECT arrival_ms + seq % 5000, seq * 2 + 1, -1 FROM arrivals
)"""

SEQUENCE = f"{PROBES}, sequence AS (SELECT page_id * 100 + pos + 1 AS seq, page_id, pos, url FROM urls)"

QUEUE = f"""{SEQUENCE},
batch1 AS (SELECT url, row_number() OVER (ORDER BY min(page_id)) AS id FROM pages GROUP BY url),
batch2 AS (
  SELECT url, (SELECT max(id) FROM batch1) + row_number() OVER (ORDER BY min(seq)) AS id
  FROM sequence s WHERE NOT EXISTS (SELECT 1 FROM batch1 b WHERE b.url = s.url) GROUP BY url
),
queue AS (SELECT id, url FROM batch1 UNION ALL SELECT id, url FROM batch2)"""

_SPAM = _values(SPAM_RULES)

# breadth first over a set keyed by URL, so it ends where nothing new is met
CRAWL = f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM pages),
        edges AS (
          SELECT a.page_id, b.url AS target FROM (
            SELECT page_id, (page_id * 7 + 1) % n AS dst FROM pages, size
            UNION ALL SELECT page_id, (page_id * 13 + 5) % n FROM pages, size) a JOIN pages b ON b.page_id = a.dst
        ),
        anchors AS (SELECT page_id, string_agg('<a href="' || target || '">', '' ORDER BY target) AS txt FROM edges GROUP BY page_id),
        linked AS (SELECT p.page_id, p.url, p.html || a.txt AS html FROM pages p JOIN anchors a ON a.page_id = p.page_id),
        {_extracted("linked")},{_resolved()},{_discovered("links", "accepted")},{PAGE_CANON},
        graph AS MATERIALIZED (
          SELECT DISTINCT k.key AS src, a.url AS dst, a.host FROM accepted a JOIN page_keys k ON k.page_id = a.page_id
          WHERE k.page_id IN (SELECT min(page_id) FROM page_keys GROUP BY key)
        ),
        met(url, host, round) USING KEY (url) AS (
          SELECT DISTINCT dst, host, 1 FROM graph WHERE src = (SELECT key FROM page_keys WHERE page_id = 0)
          UNION SELECT g.dst, g.host, m.round + 1 FROM met m JOIN graph g ON g.src = m.url
            WHERE g.dst NOT IN (SELECT r.url FROM recurring.met r)
        ),
        seed AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 0 AS round FROM pages WHERE page_id = 0),
        crawled AS (
          SELECT url, host, round FROM seed
          UNION ALL SELECT url, host, round FROM met WHERE url NOT IN (SELECT url FROM seed)
        )"""

ORACLE: dict[str, str] = {
    "url_components": _on_urls(
        "page_id, pos, scheme, userinfo, host, coalesce(port, -1) AS port, path, plain AS query, fragment", "ok"
    ),
    "url_key": _on_urls(f"page_id, pos, {KEY} AS key"),
    "norm_auth": _step(host="bare_host", port="cport"),
    "norm_path": _step(path="flat"),
    "norm_encoding": _step(path="recoded"),
    "norm_query": _step(query="ctext"),
    "norm_fragment": _step(fragment="CAST(NULL AS VARCHAR)"),
    "canonicalise": _on_urls(f"page_id, pos, CASE WHEN ok THEN {CANONICAL} END AS canonical"),
    "has_host": _on_urls(f"page_id, pos, {HAS_HOST} AS verdict"),
    "allowed_scheme": _on_urls(f"page_id, pos, {SCHEME_OK} AS verdict"),
    "is_valid_url": _on_urls(f"page_id, pos, {HAS_HOST} AND {SCHEME_OK} AS verdict"),
    "is_asset": _on_urls(f"page_id, pos, {ASSET} AS verdict"),
    "has_wiki_action": _on_urls(f"page_id, pos, {ACTION} AS verdict"),
    "is_wiki_namespace": _on_urls(f"page_id, pos, {NAMESPACE} AS verdict"),
    "accept_url": _on_urls(f"page_id, pos, {ACCEPT} AS verdict"),
    "is_blocked": _on_urls(f"page_id, pos, {BLOCKED} AS verdict"),
    "tld_label_blocked": _on_urls(f"page_id, pos, {LABEL} AS verdict"),
    "final_tld_blocked": _on_urls(f"page_id, pos, {FINAL} AS verdict"),
    "blocklist_anti_join": _on_urls(
        "page_id, pos, url",
        f"""NOT coalesce(ok AND EXISTS (SELECT 1 FROM {_SPAM} AS s(rule, kind, category) WHERE
          (kind = 'domain' AND (bare_host = rule OR ends_with(bare_host, '.' || rule)))
          OR (kind = 'label' AND list_contains(string_split(bare_host, '.'), rule))
          OR (kind = 'final_tld' AND (bare_host = rule OR ends_with(bare_host, '.' || rule)))), false)""",
    ),
    "extract_links": f"WITH {RICH},{_extracted('rich')} SELECT page_id, pos, href FROM hrefs",
    "resolve_links": f"""WITH {RICH_LINKS} SELECT page_id, pos, link,
        CASE WHEN link IS NULL THEN 'href is not a valid URI reference' END AS error FROM links""",
    "page_links_set": f"""WITH {RICH_LINKS}, good AS (SELECT page_id, page, pos, link FROM links WHERE link IS NOT NULL),
        {_cut("good", "c", "page_id, page, pos", "link")}
        SELECT page, min(url) AS link FROM c GROUP BY page, {KEY}""",
    "page_report": f"""WITH {RICH_LINKS}, good AS (SELECT page_id, page, pos, link FROM links WHERE link IS NOT NULL),
        {_cut("good", "c", "page_id, page, pos", "link")},
        once AS (SELECT page, min(url) AS link FROM c GROUP BY page, {KEY})
        SELECT page, string_agg(link, chr(10) ORDER BY link) AS links FROM once GROUP BY page""",
    "quarantine": f"""WITH {RICH_LINKS} SELECT page_id, pos, href, 'domain' AS error_class,
        'href is not a valid URI reference' AS error FROM links WHERE link IS NULL""",
    "has_seen": f"""WITH {SEQUENCE},{_cut("sequence", "c", "seq, page_id, pos")},
        keyed AS (SELECT seq, page_id, pos, {KEY} AS key FROM c)
        SELECT seq, row_number() OVER (PARTITION BY key ORDER BY seq) > 1
          OR key IN (SELECT key FROM keyed WHERE pos = -1) AS seen FROM keyed""",
    "discover_links": f"""WITH {RICH_LINKS},{_discovered("links", "accepted")},{FIRSTS},{PAGE_CANON}
        SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, page, url, host FROM firsts
        WHERE url NOT IN (SELECT key FROM page_keys)""",
    "politeness_plan": f"{PLAN} SELECT seq, host, eligible_at, dispatch_at FROM plan",
    "fair_order": f"""{PLAN} SELECT row_number() OVER (ORDER BY dispatch_at, eligible_at, host, seq) AS position,
        dispatch_at, eligible_at, host, seq FROM plan""",
    "fifo_plan": f"""WITH {ARRIVALS} SELECT seq, url,
        row_number() OVER (ORDER BY seq) * {FIFO_INTERVAL_MS} AS dispatch_at FROM arrivals""",
    "host_queue_stats": f"""{PLAN} SELECT host, count(*) AS queued, min(eligible_at) AS next_eligible_at
        FROM plan GROUP BY host""",
    "host_queue_stats_at": f"""{PLAN}, state AS (
          SELECT p.*, p.dispatch_at > {STATS_AT_MS} AS waiting FROM plan p JOIN arrivals a ON a.seq = p.seq WHERE a.arrival_ms <= {STATS_AT_MS})
        SELECT host, count(*) FILTER (WHERE waiting) AS queued,
          coalesce(min(eligible_at) FILTER (WHERE waiting), max(dispatch_at) + {COOLDOWN_MS}) AS next_eligible_at
        FROM state GROUP BY host""",
    "work_ledger": f"""{WORK}, running AS (
          SELECT *, CAST(sum(delta) OVER (ORDER BY ts_ms, seq) AS BIGINT) AS outstanding FROM work)
        SELECT ts_ms, seq, delta, outstanding,
          coalesce(max(CASE WHEN outstanding = 0 THEN 1 END) OVER (ORDER BY ts_ms, seq), 0) = 1 AS halted FROM running""",
    "work_totals": f"""{WORK} SELECT CAST(sum(delta) FILTER (WHERE delta > 0) AS BIGINT) AS tracked,
        CAST(-sum(delta) FILTER (WHERE delta < 0) AS BIGINT) AS completed,
        CAST(sum(delta) AS BIGINT) AS outstanding FROM work""",
    "validate_seeds": _on_urls(
        f"url, CASE WHEN NOT ok THEN 'not a valid URL' WHEN NOT {HAS_HOST} THEN 'no host' "
        f"WHEN NOT {SCHEME_OK} THEN 'scheme is not http or https' ELSE '' END AS reason"
    ),
    "fetch_pages": f"""WITH {PAGE_CANON},
        answers AS (SELECT key, min(page_id) AS page_id FROM page_keys GROUP BY key)
        SELECT regexp_extract(a.url, '^[^#]*') || '#again' AS url, CAST(length(w.html) AS INTEGER) AS n_chars, 'found' AS outcome
        FROM pages a JOIN page_keys k ON k.page_id = a.page_id JOIN answers n ON n.key = k.key
        JOIN pages w ON w.page_id = n.page_id
        UNION ALL SELECT 'https://gone.example.com/' || CAST(page_id AS VARCHAR), -1, 'infra' FROM pages""",
    "fetch_pages_late": f"""WITH {PAGE_CANON},
        answers AS (SELECT key, min(page_id) AS page_id FROM page_keys GROUP BY key)
        SELECT a.url || '#late' AS url, CAST(length(w.html) AS INTEGER) AS n_chars, 'found' AS outcome
        FROM pages a JOIN page_keys k ON k.page_id = a.page_id JOIN answers n ON n.key = k.key
        JOIN pages w ON w.page_id = n.page_id WHERE a.page_id % {ASKED_EVERY} = 0
        UNION ALL SELECT 'https://gone.example.com/' || CAST(page_id AS VARCHAR), -1, 'infra' FROM pages WHERE page_id % {ASKED_EVERY} = 0""",
    "resolve_redirects": """WITH RECURSIVE hop AS (
          SELECT a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 10 < 5
        ), walk AS (
          SELECT url, url AS at, 0 AS n FROM pages
          UNION ALL SELECT w.url, h.dst, w.n + 1 FROM walk w JOIN hop h ON h.src = w.at
        ), ends AS (SELECT url, max(n) AS depth FROM walk GROUP BY url)
        SELECT e.url, CASE WHEN depth <= 3 THEN w.at END AS final_url, least(depth, 3) AS hops,
          CASE WHEN depth > 3 THEN 'infra' END AS error_class
        FROM ends e JOIN walk w ON w.url = e.url AND w.n = e.depth""",
    "queue_publish": f"WITH {QUEUE} SELECT id, url FROM queue",
    "queue_log": f"""WITH {QUEUE},{_cut("queue", "qcut", "id")}
        SELECT CASE WHEN id <= {TAKEN} THEN 'batch' ELSE 'rest' END AS part, id, url FROM qcut WHERE id > {TAKEN} OR ok""",
    "queue_size": f"WITH {QUEUE} SELECT count(*) AS queued FROM queue",
    "queue_dequeue": f"""WITH stored AS (
          SELECT page_id * 3 + 7 AS id, CASE WHEN page_id % 9 = 4 THEN url || ' not a url' ELSE url END AS url FROM pages
        ), taken AS (SELECT id FROM stored ORDER BY id LIMIT {DEQUEUED})
        SELECT 'batch' AS part, id, url FROM stored WHERE id IN (SELECT id FROM taken) AND NOT contains(url, ' ')
        UNION ALL SELECT 'rest', id, url FROM stored WHERE id NOT IN (SELECT id FROM taken)""",
    "crawl": f"{CRAWL} SELECT url, host, round FROM crawled",
    "crawl_work": f"""{CRAWL}, per AS (SELECT round, count(*) AS n FROM crawled GROUP BY round),
        steps AS (SELECT round, n FROM per UNION ALL SELECT max(round) + 1, 0 FROM per),
        done AS (SELECT round, n, coalesce(lag(n) OVER (ORDER BY round), 0) AS d FROM steps)
        SELECT CAST(round AS INTEGER) AS round, CAST(n AS BIGINT) AS tracked, CAST(d AS BIGINT) AS completed,
          CAST(sum(n - d) OVER (ORDER BY round) AS BIGINT) AS outstanding FROM done""",
    "crawl_failures": f"""{CRAWL}, reached AS (
          SELECT min(k.page_id) AS page_id FROM page_keys k GROUP BY k.key HAVING k.key IN (SELECT url FROM crawled WHERE round > 0)
            OR k.key = (SELECT key FROM page_keys WHERE page_id = 0))
        SELECT page_id, pos, href, 'domain' AS error_class, 'href is not a valid URI reference' AS error
        FROM links WHERE link IS NULL AND page_id IN (SELECT page_id FROM reached)""",
    "crawl_unanswered": f"""{CRAWL}
        SELECT url, 'infra' AS error_class FROM crawled
        WHERE url NOT IN (SELECT key FROM page_keys) AND url NOT IN (SELECT url FROM seed)""",
    "link_stream": "SELECT page_id, url FROM pages",
    "dedup_stream": f"""WITH {SEQUENCE},{_cut("sequence", "c", "seq")} SELECT min(seq) AS seq, {KEY} AS key FROM c GROUP BY ALL""",
    "politeness_stream": f"{PLAN} SELECT seq, host, eligible_at, dispatch_at FROM plan",
    "discover_stream": f"""WITH RECURSIVE {RICH_LINKS},{_discovered("links", "accepted")},{FIRSTS},
        found AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, page, url, host,
          page_id * {PAGE_INTERVAL_MS} AS arrival_ms FROM firsts),
        {_planned("found")}
        SELECT f.seq, f.page, f.url, f.host, p.dispatch_at FROM found f JOIN plan p ON p.seq = f.seq""",
    "dedup_state_stream": f"""WITH {SEQUENCE},{_cut("sequence", "c", "seq")} SELECT min(seq) AS seq, {KEY} AS key FROM c GROUP BY ALL""",
    "dedup_bounded_stream": f"""WITH {SEQUENCE},{_cut("sequence", "c", "seq")} SELECT DISTINCT {KEY} AS key FROM c""",
    "politeness_state_stream": f"{PLAN} SELECT seq, host, eligible_at, dispatch_at FROM plan",
    "discover_state_stream": f"""WITH RECURSIVE {RICH_LINKS},{_discovered("links", "accepted")},{FIRSTS},
        found AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, page_id, pos, page, url, host,
          page_id * {PAGE_INTERVAL_MS} AS arrival_ms FROM firsts),
        {_planned("found")}
        SELECT f.page_id, f.pos, f.page, f.url, f.host, p.dispatch_at FROM found f JOIN plan p ON p.seq = f.seq""",
}
