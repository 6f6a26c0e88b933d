"""URL functions as native column expressions (no UDF), so predicates on them stay inside codegen.

Null input gives null for parts and "" for `domain_of`; malformed URLs give empty parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B (fixed value).
RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, RFC3986, n)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority_of(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), r"^.*@", "")


def host_of(url: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority_of(url), r":\d*$", ""), r"[\[\]]", ""))


def port_of(url: Column) -> Column:
    return F.regexp_extract(authority_of(url), r":(\d+)$", 1).try_cast("int")


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return _part(url, 4)


def userinfo_of(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r"^(.*)@", 1)


def domain_of(url: Column) -> Column:
    """Host without one leading `www.`; "" where there is none."""
    return F.coalesce(F.regexp_replace(host_of(url), r"^www\.", ""), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for all its uses in `then` (which must not hold a Python UDF)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dedup_key(url: Column) -> Column:
    """Canonical spelling: lower scheme and host, no default port, no trailing slashes, no fragment."""
    found = F.struct(
        scheme_of(url).alias("scheme"),
        host_of(url).alias("host"),
        F.regexp_extract(authority_of(url), r":(\d+)$", 1).alias("port"),
        F.regexp_replace(path_of(url), r"/+$", "").alias("path"),
        query_of(url).alias("query"),
    )

    def written(p: Column) -> Column:
        bare = (p["scheme"] == "") & (p["host"] == "")
        return F.concat(
            F.when(p["scheme"] == "", F.lit("")).otherwise(F.concat(p["scheme"], F.lit(":"))),
            F.when(bare, F.lit("")).otherwise(F.lit("//")),
            p["host"],
            F.when((p["port"] == "") | p["port"].isin("80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"])),
            F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
        )

    return let(found, written)


def normalize_url(url: Column) -> Column:
    return dedup_key(F.trim(url))


def rescue_scheme(url: Column) -> Column:
    """Prepend https:// to something that looks like a bare host: it has a dot and no space."""
    u = F.trim(url)
    bare = (~u.rlike(r"(?i)^https?://")) & u.contains(".") & ~u.contains(" ")
    return F.when(bare, F.concat(F.lit("https://"), F.regexp_replace(u, r"^/+", ""))).otherwise(u)


def same_page(a: Column, b: Column) -> Column:
    return dedup_key(a) == dedup_key(b)


def same_domain(a: Column, b: Column) -> Column:
    da, db = domain_of(a), domain_of(b)
    return (da != "") & (da == db)
