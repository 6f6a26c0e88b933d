"""Fetching as a pluggable, partitioned operator: robots rules, politeness, retries and size caps.

There is no network here; `CaptureFetcher` serves a table of captured responses, and any callable with
the same shape can take its place. Rows are grouped by host so that the gap between two requests to one
host is kept inside one task; hosts are independent of each other.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestack.functions.guard import leads_inside, reject_reason
from lodestack.functions.urls import host_of
from lodestack.settings import DEFAULTS, Settings

RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
#: Error texts that no retry cures (fixed values).
PERMANENT = ("certificate", "ssl", "tls", "hostname mismatch", "self-signed", "unknown ca")
ROBOTS_REASON = "disallowed by robots.txt"
#: Addresses of a host as text; an OSError for a name that does not resolve.
Resolver = Callable[[str], list[str]]
RAW = "url string, status_code int, final_url string, content_type string, body binary, error string, attempts int, elapsed_ms int"


@dataclass
class Response:
    status_code: int | None
    content_type: str = ""
    body: bytes | Iterator[bytes] = b""
    final_url: str = ""
    error: str = ""


class Fetcher(Protocol):
    def __call__(self, url: str) -> Response:
        """One request; transport errors are raised or given as `error`."""


class CaptureFetcher:
    """Serves captured responses, the offline default."""

    def __init__(self, captured: dict[str, Response]):
        self.captured = captured

    def __call__(self, url: str) -> Response:
        return self.captured.get(url) or Response(None, error="connection refused: not captured")


def capped(body: bytes | Iterator[bytes] | None, limit: int) -> bytes:
    """At most limit bytes; a body that comes in pieces is read no further than that."""
    if body is None or isinstance(body, (bytes, bytearray)):
        return bytes(body or b"")[:limit]
    out = bytearray()
    for piece in body:
        out += piece
        if len(out) >= limit:
            break
    return bytes(out[:limit])


class Robots:
    """robots.txt of each origin, fetched once; a file that is missing or fails allows all."""

    def __init__(self, fetch: Fetcher, agent: str, limit: int = 512 * 1024):
        self.fetch, self.agent, self.limit = fetch, agent, limit
        self.known: dict[str, RobotFileParser | None] = {}

    def allows(self, url: str) -> bool:
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        if origin not in self.known:
            try:
                r = self.fetch(f"{origin}/robots.txt")
                text = capped(r.body, self.limit).decode("utf-8", "replace") if r.status_code is not None and r.status_code < 400 else None
            except Exception:  # an unreachable file allows all, whatever the transport raised
                text = None
            self.known[origin] = parsed_robots(text)
        rules = self.known[origin]
        return rules is None or rules.can_fetch(self.agent, url)


def parsed_robots(text: str | None) -> RobotFileParser | None:
    if text is None:
        return None
    p = RobotFileParser()
    p.parse(text.splitlines())
    return p


def backoff_s(attempt: int, base: float, jitter: float = 0.0) -> float:
    """base * 2^(attempt - 1), plus up to half of it as jitter."""
    d = base * 2 ** (attempt - 1)
    return d + jitter * d / 2


def is_permanent(error: str) -> bool:
    return any(p in (error or "").lower() for p in PERMANENT)


def fetch_with_retries(fetch: Fetcher, url: str, s: Settings, sleep=time.sleep, rnd=random.random) -> tuple[Response, int]:
    """The last response and the attempts made; a status worth a retry is returned when attempts run out."""
    for attempt in range(1, s.max_retries + 2):
        try:
            r = fetch(url)
        except Exception as e:  # a fetcher never fails the row's task
            r = Response(None, error=f"{type(e).__name__}: {e}")
        again = r.status_code in RETRY_STATUS or (r.status_code is None and not is_permanent(r.error))
        if not again or attempt == s.max_retries + 1:
            return r, attempt
        sleep(backoff_s(attempt, s.retry_backoff_s, rnd()))
    raise AssertionError("unreachable")


def fetch_all(urls: DataFrame, fetch: Fetcher, s: Settings = DEFAULTS, sleep=time.sleep, resolver: Resolver | None = None, second: Fetcher | None = None) -> DataFrame:
    """RAW rows for the `url` column: guarded, within robots rules, polite to each host, retried, capped; never raises for a row.

    URLs of one host meet in one partition by hash and are fetched there in order, so a host's robots file and
    addresses are asked for once. Where the first engine itself fails, the second one is tried. Refused rows
    have no attempts and say why.
    """
    guarded = urls.select("url", reject_reason(F.col("url"), s.allow_private_hosts).alias("refused"), host_of(F.col("url")).alias("host"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        inside: dict[str, bool] = {}
        robots = Robots(fetch, s.user_agent)
        for df in frames:
            rows = []
            for url, refused, host in df.itertuples(index=False):
                if not refused and not s.allow_private_hosts:
                    if host not in inside:
                        inside[host] = leads_inside(host, resolver)
                    refused = f"'{host}' resolves to a local or private address" if inside[host] else ""
                if not refused and s.respect_robots and not robots.allows(url):
                    refused = ROBOTS_REASON
                if refused:
                    rows.append((url, None, url, "", None, refused, 0, 0))
                    continue
                wait = last.get(host, -1e9) + s.crawl_delay_s - time.monotonic()
                if wait > 0:
                    sleep(wait)
                t = time.monotonic()
                r, attempts = fetch_with_retries(fetch, url, s, sleep)
                if second is not None and r.status_code is None:
                    other, more = fetch_with_retries(second, url, s, sleep)
                    attempts += more
                    r = other if other.status_code is not None else r
                last[host] = time.monotonic()
                rows.append((url, r.status_code, r.final_url or url, r.content_type, capped(r.body, s.max_document_bytes), r.error, attempts, int((last[host] - t) * 1000)))
            out = pd.DataFrame(rows, columns=["url", "status_code", "final_url", "content_type", "body", "error", "attempts", "elapsed_ms"])
            out["status_code"] = out["status_code"].astype("Int32")
            yield out

    return guarded.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, RAW)


def robots_allowed(agent: str = "*") -> callable:
    """An Arrow UDF (robots text, robots status, url) -> allowed, for robots files that are at hand as rows."""

    @F.arrow_udf(BooleanType())
    def run(rules: pa.Array, codes: pa.Array, urls: pa.Array) -> pa.Array:
        read = lru_cache(parsed_robots)
        told = ((read(t if code is not None and code < 400 else None), url or "") for t, code, url in zip(rules.to_pylist(), codes.to_pylist(), urls.to_pylist()))
        return pa.array([p is None or p.can_fetch(agent, url) for p, url in told], pa.bool_())

    return run


def rerendered_wins(chars: Column, quality_ok: Column, rendered_chars: Column, s: Settings = DEFAULTS) -> Column:
    """Whether a browser's text replaces the plain one: good quality and a clear gain."""
    return F.coalesce(quality_ok & (rendered_chars >= s.browser_min_gain * chars), F.lit(False))
