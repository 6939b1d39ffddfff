"""Canonical URLs and post ids, native on the query's own pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def parameters(url: Column) -> Column:
    """array<struct<key, value>> in the order of the query; pieces without `=` have an empty value."""
    pieces = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.element_at(F.split(p, "=", 2), 1).alias("key"), F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")).alias("value")))


def stable_url(url: Column, drop: tuple[str, ...] = ("nonce", "page")) -> Column:
    """Without the parameters that change from visit to visit and without a fragment; parameters sorted."""
    kept = F.array_sort(F.filter(parameters(url), lambda p: ~p["key"].isin(*drop)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    head = F.regexp_extract(url, r"\A[^?#]*", 0)
    return F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def post_id(url: Column, keys: tuple[str, ...] = ("wr_id", "no", "idx")) -> Column:
    """The first of these parameters that has a value, else the start of a hash of the URL without `page`."""
    first = lambda k: F.get(F.filter(parameters(url), lambda p: (p["key"] == k) & (p["value"] != "")), F.lit(0))["value"]
    return F.coalesce(*map(first, keys), F.substring(F.sha1(stable_url(url, ("page",)).cast("binary")), 1, 16))
