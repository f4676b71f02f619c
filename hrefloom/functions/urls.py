"""URL expressions: split, compare and canonicalise URLs.

One strict RFC 3986 pattern reads a URL exactly once and rewrites it into its
eight raw pieces; every later rule is a lookup into that one array.  All group
repeats are possessive: the regex engine then loops instead of recursing, so a
megabyte-long URL cannot overflow an executor's stack.

Functions that end in ``_sql`` map SQL text to SQL text; the others take and
give Columns.  A rule over pieces reads the same for a lambda variable and for
a column: the Column functions bind the pieces in a lambda, which works on any
input, and the jobs put them in a column first, so that the rules are compiled.
Parts that few URLs have (a query, percent codes) are handled behind an ``if``
and are the only place where a job's rows meet a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column

from hrefloom.functions.rules import TRACKING_KEYS
from hrefloom.functions.text import let, lift, quoted, words

SEP = "\x1f"
PIECES = 8
# positions in the raw array: the text of a piece keeps its delimiter
SCHEME, SLASHES, USERINFO, HOST, PORT, PATH, QUERY, FRAGMENT = range(PIECES)

_PCT = "%[0-9A-Fa-f]{2}"
# digits of a port: any number of leading zeros, then at most 2147483647
_PORT = (
    "0*+(?:[0-9]{0,9}(?![0-9])|1[0-9]{9}|20[0-9]{8}|21[0-3][0-9]{7}|214[0-6][0-9]{6}|2147[0-3][0-9]{5}|21474[0-7][0-9]{4}"
    "|214748[0-2][0-9]{3}|2147483[0-5][0-9]{2}|21474836[0-3][0-9]|214748364[0-7])"
)
_NAME = r"A-Za-z0-9\-._~!$&'()*+,;="
# A relative reference may not hold a colon in its first segment; a path with
# no authority may not start with "//".  Square brackets are let into queries,
# where real links use them ("?id[]=1").
URI_PATTERN = (
    r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*+):|(?![^/?#]*:))"
    rf"(?:(//)((?:[{_NAME}:]++|{_PCT})*+@)?+"
    rf"(\[[0-9A-Fa-f:.]++\]|(?:[{_NAME}]++|{_PCT})*+)(:{_PORT})?+(?=[/?#]|\z)|(?!//))"
    rf"((?:[{_NAME}:@/]++|{_PCT})*+)"
    rf"(\?(?:[{_NAME}:@/?\[\]]++|{_PCT})*+)?+"
    rf"(#(?:[{_NAME}:@/?]++|{_PCT})*+)?+\z"
)
_REWRITE = SEP.join(f"${i}" for i in range(1, PIECES + 1))

# %XX of A-Z a-z 0-9 - . _ ~
_UNRESERVED_HEX = "^%(?:2[DEde]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])$"


# -- raw pieces -------------------------------------------------------------

def pieces_sql(url: str) -> str:
    """ARRAY of the eight raw pieces; a one-element array if not RFC 3986."""
    text = f"replace({url}, {quoted(SEP)}, ' ')"
    return f"split(regexp_replace({text}, {quoted(URI_PATTERN)}, {quoted(_REWRITE)}), {quoted(SEP)})"


def with_pieces_sql(url: str, var: str, body: str) -> str:
    """``body`` over the pieces ``var`` of a valid URL, else NULL."""
    valid = f"filter(array({pieces_sql(url)}), {var} -> size({var}) = {PIECES})"
    return f"get(transform({valid}, {var} -> {body}), 0)"


def joined_sql(p: str) -> str:
    """The URL text of raw pieces."""
    rest = ", ".join(f"{p}[{i}]" for i in range(1, PIECES))
    return f"concat({p}[{SCHEME}], if({p}[{SCHEME}] = '', '', ':'), {rest})"


def with_pieces(url: Column | str, body: Callable[[str], str]) -> Column:
    """``body(pieces)`` for a valid URL, else NULL."""
    return lift(url, lambda u: with_pieces_sql(u, "p", body("p")))


# -- parts ------------------------------------------------------------------

@dataclass(frozen=True)
class UrlParts:
    """The parts of one URL as SQL text; a missing part is NULL, never ''."""

    scheme: str
    userinfo: str
    host: str
    port: str
    path: str
    query: str
    fragment: str


_FIELDS = [f.name for f in fields(UrlParts)]


def _decode(text: str) -> str:
    return f"if({text} RLIKE '[%+]', coalesce(try_url_decode({text}), {text}), {text})"


def _encode(text: str) -> str:
    """RFC 3986 percent encoding; unreserved characters, '/' and '?' stay."""
    out = f"url_encode({text})"
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3F", "?")):
        out = f"replace({out}, '{old}', '{new}')"
    return f"if({text} RLIKE '[^A-Za-z0-9._~/?-]', {out}, {text})"


def pairs_sql(query: str) -> str:
    """Decoded ``k``/``v`` pairs of a raw '?...' piece, in order, blanks left out."""
    key = _decode("substring_index(s, '=', 1)")
    value = f"if(instr(s, '=') > 0, {_decode('substr(s, instr(s, ' + quoted('=') + ') + 1)')}, NULL)"
    texts = f"filter(split(substr({query}, 2), '&'), s -> s <> '')"
    return f"if(length({query}) > 1, transform({texts}, (s, i) -> struct({key} AS k, {value} AS v, i AS pos)), NULL)"


def parts_of_pieces(p: str) -> UrlParts:
    return UrlParts(
        scheme=f"nullif(lower({p}[{SCHEME}]), '')",
        userinfo=f"nullif(substring_index({p}[{USERINFO}], '@', 1), '')",
        host=f"if({p}[{SLASHES}] = '//', lower({p}[{HOST}]), NULL)",
        port=f"CAST(nullif(substr({p}[{PORT}], 2), '') AS INT)",
        path=f"{p}[{PATH}]",
        query=pairs_sql(f"{p}[{QUERY}]"),
        fragment=f"nullif(substr({p}[{FRAGMENT}], 2), '')",
    )


def _parts_of_struct(c: str) -> UrlParts:
    return UrlParts(**{f: f"{c}.{f}" for f in _FIELDS})


def _struct_sql(p: UrlParts) -> str:
    return "struct(" + ", ".join(f"{getattr(p, f)} AS {f}" for f in _FIELDS) + ")"


def url_components(url: Column | str) -> Column:
    """STRUCT<scheme, userinfo, host, port, path, query, fragment>; NULL if invalid.

    ``query`` is ARRAY<STRUCT<k, v, pos>> with ``v`` NULL for a bare key.
    """
    return with_pieces(url, lambda p: _struct_sql(parts_of_pieces(p)))


def key_sql(url: str) -> str:
    lowered = f"transform(p, (x, i) -> if(i IN ({SCHEME}, {HOST}), lower(x), x))"
    exact = with_pieces_sql("u", "p", let(lowered, "l", joined_sql("l")))
    # Most URLs are lower case already: then the key is the URL itself.
    return let(url, "u", f"if(u = lower(u), u, coalesce({exact}, u))")


def url_key(url: Column | str) -> Column:
    """The URL with scheme and host lower-cased and nothing else changed.

    This is URL equality.  Text that is no valid URL is its own key.
    """
    return lift(url, key_sql)


# -- canonical form ---------------------------------------------------------

def bare_host_sql(host: str) -> str:
    """Host without one trailing dot."""
    return rf"regexp_replace({host}, '\\.\\z', '')"


def _auth(p: UrlParts) -> UrlParts:
    default_port = f"({p.scheme} = 'http' AND {p.port} = 80) OR ({p.scheme} = 'https' AND {p.port} = 443)"
    return replace(p, host=bare_host_sql(p.host), port=f"if({default_port}, NULL, {p.port})")


def _path(p: UrlParts) -> UrlParts:
    # a run of slashes goes but for the last one before a segment
    return replace(p, path=rf"regexp_replace(concat('/', {p.path}), '/+(?=/|\\z)', '')")


def _encoding(p: UrlParts) -> UrlParts:
    recoded = (
        f"CASE WHEN t RLIKE '{_UNRESERVED_HEX}' THEN char(CAST(conv(substr(t, 2, 2), 16, 10) AS INT)) "
        f"WHEN t RLIKE '^{_PCT}$' THEN upper(t) ELSE t END"
    )
    tokens = f"regexp_extract_all({p.path}, '{_PCT}|[^%]+|%', 0)"
    joined = f"array_join(transform({tokens}, t -> {recoded}), '')"
    return replace(p, path=f"if(instr({p.path}, '%') > 0, {joined}, {p.path})")


def _sorted_pairs(pairs: str) -> str:
    """Pairs without tracking keys, by (key, value or '', first position)."""
    kept = f"filter({pairs}, q -> q.k NOT IN {words(TRACKING_KEYS)})"
    return f"array_sort(transform({kept}, q -> struct(q.k AS k, coalesce(q.v, '') AS w, q.pos AS pos, q.v AS v)))"


def _query(p: UrlParts) -> UrlParts:
    back = f"transform({_sorted_pairs(p.query)}, q -> struct(q.k AS k, q.v AS v, q.pos AS pos))"
    return replace(p, query=back)


def _fragment(p: UrlParts) -> UrlParts:
    return replace(p, fragment="CAST(NULL AS STRING)")


def _render(p: UrlParts, pairs: str) -> str:
    def around(*texts: str) -> str:
        return f"coalesce(concat({', '.join(texts)}), '')"

    pair = f"concat({_encode('q.k')}, coalesce(concat('=', {_encode('q.v')}), ''))"
    query = f"array_join(transform({pairs}, q -> {pair}), '&')"
    parts = [
        around(p.scheme, "':'"),
        around("'//'", around(p.userinfo, "'@'"), p.host, around("':'", f"CAST({p.port} AS STRING)")),
        p.path,
        # '?' goes before a query that is not empty
        f"coalesce(regexp_replace({query}, '^(.)', '?$1'), '')",
        around("'#'", p.fragment),
    ]
    return f"concat({', '.join(parts)})"


def _on_struct(step):
    def apply(components: Column | str) -> Column:
        out = f"if(c IS NULL, NULL, {_struct_sql(step(_parts_of_struct('c')))})"
        return lift(components, lambda value: let(value, "c", out))

    apply.__name__ = f"norm{step.__name__}"
    apply.__doc__ = f"Struct to struct: the {step.__name__[1:]} step of ``canonicalise``."
    return apply


norm_auth = _on_struct(_auth)
norm_path = _on_struct(_path)
norm_encoding = _on_struct(_encoding)
norm_query = _on_struct(_query)
norm_fragment = _on_struct(_fragment)


def render_url(components: Column | str) -> Column:
    """The text of a ``url_components`` struct."""

    p = _parts_of_struct("c")
    out = f"if(c IS NULL, NULL, {_render(p, p.query)})"
    return lift(components, lambda value: let(value, "c", out))


def canonical_sql(p: UrlParts) -> str:
    p = _fragment(_encoding(_path(_auth(p))))
    return _render(p, _sorted_pairs(p.query))


def canonicalise(url: Column | str) -> Column:
    """The canonical URL: auth, path, encoding, query, fragment; NULL if invalid."""
    return with_pieces(url, lambda p: canonical_sql(parts_of_pieces(p)))


def host_of(url: Column | str) -> Column:
    """Lower-case host without a trailing dot; NULL if there is none."""
    return with_pieces(url, lambda p: bare_host_sql(parts_of_pieces(p).host))
