"""Small helpers to write Spark SQL expressions as text.

The URL and HTML rules are deep expressions.  As SQL text a rule reaches the
JVM in one call and is parsed there; built call by call from Python the same
rule takes about a second on the driver.  ``let`` keeps the trees small: an
input that a rule names ten times would otherwise be copied ten times, and
rules on rules multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(items: Iterable[str]) -> str:
    """A SQL list of string literals, for IN."""
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def let(value: str, var: str, body: str) -> str:
    """``body`` with ``value`` evaluated once and bound to ``var``."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def lift(value: Column | str, body: Callable[[str], str]) -> Column:
    """A text rule applied to a column, by name or as an expression."""
    if isinstance(value, str):
        return F.expr(body(value))
    rule = F.expr(f"input -> {body('input')}")
    return F.get(F.call_function("transform", F.array(value), rule), F.lit(0))
