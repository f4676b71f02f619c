"""Link policy as boolean Columns: which URLs are worth crawling.

Every predicate takes a URL column and is FALSE, never NULL, for text that is
not a valid URL.  The ``*_sql`` forms work on the raw pieces of a valid one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from hrefloom.functions.rules import (
    ASSET_EXTENSIONS,
    BLOCKED_FINAL_LABELS,
    BLOCKED_LABELS,
    WIKI_ACTION_KEYS,
    blocked_domain_set,
)
from hrefloom.functions.text import let, lift, quoted, words
from hrefloom.functions.urls import HOST, PATH, QUERY, SCHEME, SLASHES, bare_host_sql, with_pieces_sql


def _sure(condition: str) -> str:
    return f"coalesce({condition}, false)"


def _spelled(key: str) -> str:
    """Pattern of a query key in any mix of plain and percent-coded letters."""
    return "".join(f"(?:{c}|%(?i:{ord(c):02x}))" for c in key)


_ACTION_PATTERN = f"[?&](?:{'|'.join(map(_spelled, WIKI_ACTION_KEYS))})(?:[=&]|$)"


def has_host_sql(p: str) -> str:
    return f"({p}[{SLASHES}] = '//' AND {p}[{HOST}] <> '')"


def allowed_scheme_sql(p: str) -> str:
    return f"(lower({p}[{SCHEME}]) IN ('http', 'https'))"


def is_asset_sql(p: str) -> str:
    last = f"substring_index(lower({p}[{PATH}]), '.', -1)"
    return f"(instr({p}[{PATH}], '.') > 0 AND {last} IN {words(ASSET_EXTENSIONS)})"


def has_wiki_action_sql(p: str) -> str:
    return f"({p}[{QUERY}] <> '' AND {p}[{QUERY}] RLIKE {quoted(_ACTION_PATTERN)})"


def is_wiki_namespace_sql(p: str) -> str:
    return f"({p}[{PATH}] RLIKE '^/wiki/[^/]*:')"


def accept_sql(p: str) -> str:
    # cheap tests first
    return " AND ".join(
        [
            allowed_scheme_sql(p),
            has_host_sql(p),
            f"NOT {is_asset_sql(p)}",
            f"NOT {is_wiki_namespace_sql(p)}",
            f"NOT {has_wiki_action_sql(p)}",
        ]
    )


def _tld_label(host: str) -> str:
    dotted = f"concat('.', {host}, '.')"
    return _sure(" OR ".join(f"instr({dotted}, '.{label}.') > 0" for label in BLOCKED_LABELS))


def _final_tld(host: str) -> str:
    return _sure(f"substring_index({host}, '.', -1) IN {words(BLOCKED_FINAL_LABELS)}")


def blocked_host_sql(host: str) -> str:
    """Suffix match by set lookup: one probe per label depth the rules use.

    A host is covered by a rule of n labels exactly when its last n labels are
    that rule, so the cost does not grow with the number of rules.
    """
    by_depth: dict[int, list[str]] = {}
    for rule in blocked_domain_set():
        by_depth.setdefault(rule.count(".") + 1, []).append(rule)
    probes = [f"substring_index({host}, '.', -{depth}) IN {words(rules)}" for depth, rules in sorted(by_depth.items())]
    return _sure(" OR ".join([_tld_label(host), _final_tld(host), *probes]))


def bare_host_of(p: str) -> str:
    """Host as the block rules see it: lower case, one trailing dot dropped."""
    return bare_host_sql(f"if({p}[{SLASHES}] = '//', lower({p}[{HOST}]), NULL)")


def is_blocked_sql(p: str) -> str:
    return let(bare_host_of(p), "h", blocked_host_sql("h"))


def _on_url(url: Column | str, rule: Callable[[str], str]) -> Column:
    return lift(url, lambda u: _sure(with_pieces_sql(u, "p", rule("p"))))


def has_host(url: Column | str) -> Column:
    """The URL names a host."""
    return _on_url(url, has_host_sql)


def allowed_scheme(url: Column | str) -> Column:
    """The scheme is http or https."""
    return _on_url(url, allowed_scheme_sql)


def is_valid_url(url: Column | str) -> Column:
    """Has a host and an allowed scheme."""
    return _on_url(url, lambda p: f"{has_host_sql(p)} AND {allowed_scheme_sql(p)}")


def is_asset(url: Column | str) -> Column:
    """The path ends in the extension of an asset, in any case."""
    return _on_url(url, is_asset_sql)


def has_wiki_action(url: Column | str) -> Column:
    """Any query key, bare ones too, asks for a MediaWiki action."""
    return _on_url(url, has_wiki_action_sql)


def is_wiki_namespace(url: Column | str) -> Column:
    """The segment after /wiki/ holds a literal colon."""
    return _on_url(url, is_wiki_namespace_sql)


def accept_url(url: Column | str) -> Column:
    """Allowed scheme, a host, and none of the content rules hit."""
    return _on_url(url, accept_sql)


def tld_label_blocked(url: Column | str) -> Column:
    """Any label of the host is one of the blocked labels."""
    return _on_url(url, lambda p: _tld_label(bare_host_of(p)))


def final_tld_blocked(url: Column | str) -> Column:
    """The last label of the host is one of the blocked final labels."""
    return _on_url(url, lambda p: _final_tld(bare_host_of(p)))


def is_blocked(url: Column | str) -> Column:
    """The host is on the built-in list, is under it, or hits a label rule."""
    return _on_url(url, is_blocked_sql)
