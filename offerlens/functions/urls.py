"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that track visits.
TRACKING = r"^(?:utm_[a-z]+|ref|gclid|fbclid)(?:=|$)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalized(url: Column) -> Column:
    """https, lower-case host without www., no trailing slash, parameters sorted without tracking, no fragment."""
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), r"/+$", ""), query)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path(url), r"/+$", ""), "/"), -1)


def is_detail(url: Column) -> Column:
    """Looks like one campaign's page: not a listing, a page of one, or an archive."""
    return path(url).rlike(r"/[^/]+/[^/]+") & ~url.rlike(r"[?&](?:page|sayfa)=|/(?:arsiv|archive|liste|list)(?:/|$)")


def kind_of(url: Column, markers: dict[str, str]) -> Column:
    """The kind of the first marker, in order of the table, that the url has; null without one."""
    low = F.lower(url)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(kind)) for m, kind in markers.items()])


def refined(kind: Column, by_url: Column, broad: list[str]) -> Column:
    """A kind as extracted, but what the url says where the former is missing or one of the broad ones."""
    return F.when(kind.isNull() | kind.isin(broad), F.coalesce(by_url, kind)).otherwise(kind)


def fetch_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def fetch_path(url: Column) -> Column:
    """The path in lower case, percent signs decoded where they are well formed."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def matched_sites(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (with host) and the registered site that is the host or a parent domain of it, the longest first; null without one.

    Each host is joined by its own parent domains, so a registry of any size is an equi-join.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().withColumn("site", F.explode(parents)).join(registry, "site", "left_semi")
    best = hosts.groupBy("host").agg(F.max_by("site", F.length("site")).alias("site"))
    return rows.join(best, "host", "left")
