"""Block rules supplied as a table rather than built in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.text import let
from hrefloom.functions.urls import host_of
from hrefloom.operators.skew import salted_join


def blocklist_anti_join(df: DataFrame, blocklist: DataFrame) -> DataFrame:
    """``url`` rows that no rule of ``rule, kind`` blocks; no host is not blocked.

    ``kind`` is ``domain`` (the host is the rule or under it), ``label`` (any
    label of the host) or ``final_tld`` (its last label).

    The rules are matched against distinct hosts, found with a partial
    aggregate, so a host that holds a third of the rows is matched once; its
    rows are then dropped by a salted anti join.  Spark broadcasts the rules or
    the blocked hosts when their size allows and shuffles them otherwise.
    """
    keyed = df.withColumn("_host", host_of("url"))
    hosts = keyed.where("_host <> ''").select("_host").distinct()
    probes = """concat(
        transform(l, (x, i) -> struct('domain' AS kind, array_join(slice(l, i + 1, size(l)), '.') AS rule)),
        transform(l, x -> struct('label' AS kind, x AS rule)),
        array(struct('final_tld' AS kind, l[size(l) - 1] AS rule)))"""
    labels = r"split(_host, '\\.')"
    probed = hosts.selectExpr("_host", f"inline({let(labels, 'l', probes)})")
    rules = blocklist.select(F.lower("kind").alias("kind"), F.lower("rule").alias("rule"))
    # most hosts share a few probes (their last label): the rules meet each probe once
    hit = probed.select("kind", "rule").distinct().join(rules, ["kind", "rule"], "left_semi").withColumn("_probe", F.struct("kind", "rule"))
    named = probed.select("_host", F.struct("kind", "rule").alias("_probe"))
    blocked = salted_join(named, hit.select("_probe"), "_probe", "left_semi").select("_host").distinct()
    return salted_join(keyed, blocked, "_host", "left_anti").drop("_host")
