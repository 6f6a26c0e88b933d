"""The URL guard: which addresses may be fetched, and why not.

Host names are judged natively; only literal addresses need Python's address rules, in Arrow batches.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestack.functions.urls import authority_of, host_of, let, scheme_of, userinfo_of

#: Local names and suffixes (fixed values).
LOCAL_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal", "metadata.goog", "instance-data")
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".home.arpa")


def literal_is_private(host: str | None) -> bool | None:
    """For a literal address whether it is not publicly routable; null for anything else."""
    try:
        a = ipaddress.ip_address(host or "")
    except ValueError:
        return None
    inner = getattr(a, "ipv4_mapped", None)
    if inner is not None:
        return literal_is_private(str(inner))
    return a.is_multicast or a.is_reserved or a.is_unspecified or not a.is_global


@F.arrow_udf(BooleanType())
def _literal(hosts: pa.Array) -> pa.Array:
    known: dict = {}
    return pa.array([known[h] if h in known else known.setdefault(h, literal_is_private(h)) for h in hosts.to_pylist()], pa.bool_())


def host_is_private(host: Column) -> Column:
    name = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"^\[|\]$", "")), r"\.+$", "")
    local = name.isin(*LOCAL_NAMES)
    for s in LOCAL_SUFFIXES:
        local = local | name.endswith(s)
    # names with a letter beyond hexadecimal cannot be literals, so most rows skip the Python rule
    looks = name.rlike(r"^[0-9a-f:.]+$") & (name.contains(":") | name.rlike(r"^[0-9.]+$"))
    return (name == "") | local | F.coalesce(_literal(F.when(looks, name)), F.lit(False))


def reject_reason(url: Column, allow_private: bool = False) -> Column:
    """"" for an acceptable URL, else the first reason against it, in the fixed order of the rules."""
    u = F.trim(F.coalesce(url, F.lit("")))
    authority = authority_of(u)
    marks = lambda other: F.length(F.regexp_replace(authority, other, ""))
    found = F.struct(
        u.alias("u"),
        scheme_of(u).alias("scheme"),
        host_of(u).alias("host"),
        F.regexp_extract(authority, r":([^:\]]*)$", 1).alias("port"),
        (marks(r"[^\[]") != marks(r"[^\]]")).alias("open"),
        (userinfo_of(u) != "").alias("login"),
        (F.lit(False) if allow_private else host_is_private(host_of(u))).alias("private"),
    )

    def judged(p: Column) -> Column:
        scheme = F.when(p["scheme"].rlike(r"^[a-z][a-z0-9+.-]*$"), p["scheme"]).otherwise(F.lit(""))
        bad_port = (p["port"] != "") & (~p["port"].rlike(r"^\d+$") | (F.coalesce(p["port"].try_cast("long"), F.lit(99999)) > 65535))
        rules = [
            (p["u"] == "", F.lit("empty URL")),
            (p["open"] | bad_port, F.lit("malformed URL")),
            (~scheme.isin("http", "https"), F.concat(F.lit("unsupported scheme '"), F.when(scheme == "", "none").otherwise(scheme), F.lit("' - only http and https"))),
            (p["host"] == "", F.lit("no host in URL")),
            (p["login"], F.lit("credentials in URL are not accepted")),
            (p["private"], F.concat(F.lit("'"), p["host"], F.lit("' is a local or private address"))),
        ]
        return F.coalesce(*[F.when(c, r) for c, r in rules], F.lit(""))

    return let(found, judged)


def leads_inside(host: str | None, resolver: Callable[[str], list[str]] | None) -> bool:
    """At fetch time: whether any address of the host is not public; a name that does not resolve is not refused."""
    try:
        return any(map(literal_is_private, resolver(host))) if resolver and host else False
    except OSError:
        return False
