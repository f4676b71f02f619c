"""Seed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.policy import allowed_scheme_sql, has_host_sql
from hrefloom.functions.urls import with_pieces

NOT_A_URL = "not a valid URL"
NO_HOST = "no host"
BAD_SCHEME = "scheme is not http or https"


def validate_seeds(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``url`` -> (valid ``url``, rejected ``url, reason``); any number of seeds."""

    def verdict(p: str) -> str:
        return f"CASE WHEN NOT {has_host_sql(p)} THEN '{NO_HOST}' WHEN NOT {allowed_scheme_sql(p)} THEN '{BAD_SCHEME}' ELSE '' END"

    judged = seeds.select("url", F.coalesce(with_pieces("url", verdict), F.lit(NOT_A_URL)).alias("reason"))
    ok = F.col("reason") == ""
    return judged.where(ok).select("url"), judged.where(~ok)
