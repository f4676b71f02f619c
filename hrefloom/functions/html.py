"""HTML expressions: find the anchors of a page with one regex pass.

The pattern follows the tokenisation rules of the HTML standard closely enough
for link discovery: comments, raw-text elements and quoted attribute values
are consumed as whole tokens, so a link inside any of them is not found.
Each alternative always consumes up to its end or the end of the text, and
repeats are possessive: a page costs linear time and constant stack.
"""

from __future__ import annotations

from html.entities import html5

from hrefloom.functions.text import let, quoted

_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)?+"""
_ATTR = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+{_VALUE})"
_OTHER_ATTR = rf"(?:[\s/]++|(?!href(?:[\s/>=]|\z))[^\s/>][^\s/>=]*+{_VALUE})"
_END = r"(?:>|\z)"

# One branch after the "<", so text between tags costs one comparison a
# character.  Group 2 is the head of an <a> or <base> tag, without its "<", up
# to the end of its first href.
TOKEN_PATTERN = (
    r"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTR}*+"
    r"(?:>.*?(?:</\1(?=[\s/>])|\z)|\z)"
    rf"|((?:a|base)(?=[\s/>]){_OTHER_ATTR}*+href{_VALUE}){_ATTR}*+>"
    rf"|/?[a-z][^\s/>]*+{_ATTR}*+{_END}"
    rf"|[!?/][^>]*+{_END})"
)
_HREF_PATTERN = (
    rf"(?is)\A(?:a|base){_OTHER_ATTR}*+href"
    r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+))?+\z"""
)

_WHITESPACE = " \t\n\r\f\x0b"
_KEY_MARK, _PAIR_MARK = "\x02", "\x03"
_BAD_CHARACTER = "\ufffd"
_REFERENCE = r"&#[xX][0-9A-Fa-f]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|[^&]++|&"


def tags_sql(html: str) -> str:
    """ARRAY of the <a> and <base> heads that carry an href, in document order."""
    return f"filter(regexp_extract_all({html}, {quoted(TOKEN_PATTERN)}, 2), t -> t <> '')"


def is_base_sql(tag: str) -> str:
    return f"lower(left({tag}, 1)) = 'b'"


def _named_entities() -> str:
    # the standard's own table, as shipped with Python, folded to one map literal
    table = _PAIR_MARK.join(f"&{name}{_KEY_MARK}{value}" for name, value in html5.items())
    return f"str_to_map({quoted(table)}, {quoted(_PAIR_MARK)}, {quoted(_KEY_MARK)})"


def decoded_sql(text: str) -> str:
    """Character references as they count inside an attribute value."""
    hexadecimal = "regexp_extract(t, '^&#[xX]0*+([0-9A-Fa-f]{1,6});?$', 1)"
    decimal = "regexp_extract(t, '^&#0*+([0-9]{1,7});?$', 1)"
    code = f"CASE WHEN {hexadecimal} <> '' THEN CAST(conv({hexadecimal}, 16, 10) AS BIGINT) WHEN {decimal} <> '' THEN CAST({decimal} AS BIGINT) ELSE 0 END"
    usable = f"(n > 0 AND n < {0xD800}) OR (n > {0xDFFF} AND n <= {0x10FFFF})"
    character = let(code, "n", f"if({usable}, decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32'), '{_BAD_CHARACTER}')")
    one = (
        "CASE WHEN t = '&amp;' THEN '&' "
        f"WHEN startswith(t, '&#') AND length(t) > 2 THEN {character} "
        f"WHEN startswith(t, '&') AND length(t) > 1 THEN coalesce(try_element_at({_named_entities()}, t), t) "
        "ELSE t END"
    )
    tokens = f"regexp_extract_all({text}, {quoted(_REFERENCE)}, 0)"
    return f"if(instr({text}, '&') > 0, array_join(transform({tokens}, t -> {one}), ''), {text})"


def raw_href_sql(tag: str) -> str:
    """The href value of a tag head, as written."""
    return f"regexp_replace({tag}, {quoted(_HREF_PATTERN)}, '$1$2$3')"


def href_sql(raw: str) -> str:
    """An href as written, with references decoded and outer blanks cut."""
    return f"btrim({decoded_sql(raw)}, {quoted(_WHITESPACE)})"
