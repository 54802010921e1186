"""URLs of listings, with parse_url only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def canonical_url(url: Column, drop: Sequence[str] = ()) -> Column:
    """Scheme and host in lower case, no fragment, query parameters sorted and without those in ``drop``; null if it's no URL."""
    params = F.array_sort(F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*drop) if drop else p != ""))
    authority = F.lower(part(url, "AUTHORITY"))
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    base = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), authority, path)
    return F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)


def url_allowed(url: Column, hosts: Sequence[str], *, schemes: Sequence[str] = ("https",), path: str = "") -> Column:
    """Scheme and host are listed, there is neither port nor user, and the path fits the pattern."""
    host = F.lower(part(url, "HOST"))
    plain = F.lower(part(url, "AUTHORITY")) == host
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin(*schemes) & host.isin(*hosts) & plain & part(url, "PATH").rlike(path or "^"), F.lit(False))


def host_matches(url: Column, suffix: str) -> Column:
    """The host is the name or lies under it."""
    host = F.lower(part(url, "HOST"))
    return F.coalesce((host == suffix) | host.endswith("." + suffix), F.lit(False))
