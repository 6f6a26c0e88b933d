"""Classification of fetches: outcomes, labels and plain-language reasons, as ordered native rules."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import strip
from lodestack.functions.urls import let
from lodestack.settings import DEFAULTS, Settings

#: Status groups (fixed values).
BLOCKED_HTTP = (401, 403, 429, 451)
TRANSIENT_HTTP = (408, 425, 500, 502, 503, 504)
RETRY_HTTP = (408, 425, 429, 500, 502, 503, 504)
USABLE = ("SUCCESS", "PARTIAL")
LABELS = {"SUCCESS": "Crawled", "PARTIAL": "Partial content", "BLOCKED": "Blocked by site", "FAILED": "Failed", "SKIPPED": "Skipped", "PENDING": "Queued", "PROCESSING": "Crawling"}
BADGES = {"SUCCESS": "badge-ok", "PARTIAL": "badge-warn", "BLOCKED": "badge-blocked", "FAILED": "badge-error", "SKIPPED": "badge-muted", "PENDING": "badge-muted", "PROCESSING": "badge-info"}
#: Markup of named bot-mitigation products, first match wins (fixed values).
CHALLENGE_MARKERS = (
    ("awswafcookiedomainlist", "AWS WAF challenge"),
    ("gokuprops", "AWS WAF challenge"),
    ("challenge-container", "AWS WAF challenge"),
    ("cf-chl-", "Cloudflare challenge"),
    ("cf_chl_opt", "Cloudflare challenge"),
    ("__cf_chl", "Cloudflare challenge"),
    ("incapsula", "Imperva Incapsula challenge"),
    ("_incap_", "Imperva Incapsula challenge"),
    ("distil_r_captcha", "Distil Networks challenge"),
    ("perimeterx", "PerimeterX challenge"),
    ("_pxhd", "PerimeterX challenge"),
    ("datadome", "DataDome challenge"),
    ("geo.captcha-delivery.com", "DataDome challenge"),
)
#: Wordings of challenge pages (fixed values).
CHALLENGE_PHRASES = (
    "your request has been blocked",
    "appears to be from an automated process",
    "access denied",
    "attention required! | cloudflare",
    "enable javascript and cookies to continue",
    "checking your browser before accessing",
    "verify you are human",
    "please verify you are a human",
    "verify that you are not a robot",
    "verify that you're not a robot",
    "are you a robot",
    "unusual traffic from your computer network",
    "request unsuccessful. incapsula",
    "ddos protection by",
    "please complete the security check",
    "this site is protected by recaptcha",
    "captcha",
    "sign in to continue",
    "log in to continue",
    "click the button below to continue shopping",
    "continue shopping",
)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def status_from_http(code: Column) -> Column:
    return F.when(code.isNull(), "FAILED").when(code.isin(*BLOCKED_HTTP), "BLOCKED").when(code >= 400, "FAILED").otherwise("SUCCESS")


def is_html(content_type: Column) -> Column:
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return t.contains("text/html") | t.contains("application/xhtml+xml")


def block_reason(text: Column, title: Column, html: Column, s: Settings = DEFAULTS) -> Column:
    """Why a page is a challenge: a product's marker in the markup, else a wording on a short page, else ""."""
    shown = F.lower(strip(F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")))

    def judged(p: Column) -> Column:
        product = F.coalesce(*[F.when(p["markup"].contains(m), F.lit(name)) for m, name in CHALLENGE_MARKERS])
        worded = (F.length(p["shown"]) <= s.block_page_max_chars) & _any(p["shown"], *CHALLENGE_PHRASES)
        return F.coalesce(
            F.concat(F.lit("blocked by "), product, F.lit(" (a challenge page was served with HTTP 200)")),
            F.when(worded, F.lit("blocked by site bot protection (a challenge page was served with HTTP 200)")),
            F.lit(""),
        )

    return let(F.struct(F.lower(F.coalesce(html, F.lit(""))).alias("markup"), shown.alias("shown")), judged)


def humanise_failure(reason: Column, code: Column) -> Column:
    """One plain sentence for a technical reason; the rules are tried in this order."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    c = F.coalesce(code, F.lit(0))
    rules = (
        (_any(r, "robots"), "The site's robots.txt asks crawlers not to fetch this page."),
        ((c == 401) | _any(r, "login", "auth"), "This page requires signing in, so its content is not public."),
        ((c == 403) | _any(r, "denied", "forbidden"), "The website denied automated access to this page."),
        ((c == 429) | _any(r, "rate"), "The website rate-limited the crawler. Try again later."),
        ((c == 404) | _any(r, "not found"), "The page does not exist at this address."),
        ((c == 408) | _any(r, "timeout"), "The page took too long to respond."),
        (c >= 500, "The website returned a server error."),
        (_any(r, "bot protection", "captcha"), "The website showed a bot-protection challenge instead of the page."),
        (_any(r, "ssl", "certificate"), "The site's security certificate could not be verified."),
        (_any(r, "dns", "name or service", "getaddrinfo"), "The domain could not be resolved - it may not exist."),
        (_any(r, "connection", "reset", "refused"), "The connection to the website failed."),
        (_any(r, "no extractable text", "insufficient"), "The page loaded but no useful text could be extracted."),
        (_any(r, "javascript"), "The page needs JavaScript rendering, and no browser was available."),
        (_any(r, "unsupported content type", "document"), "This URL does not point at a readable web page."),
    )
    return F.coalesce(*[F.when(cond, F.lit(text)) for cond, text in rules], F.lit("The page could not be harvested."))


def _lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(up == k, F.lit(v)) for k, v in table.items()], default)


def status_label(status: Column) -> Column:
    return _lookup(status, LABELS, F.coalesce(status, F.lit("")))


def status_badge(status: Column) -> Column:
    return F.concat(F.lit("badge "), _lookup(status, BADGES, F.lit("badge-muted")))


def http_badge(code: Column, error: Column) -> Column:
    return F.when(~blank(error), "badge badge-error").when(code.isNull(), "badge badge-muted").when((code >= 200) & (code < 300), "badge badge-ok").when((code >= 300) & (code < 400), "badge badge-warn").otherwise("badge badge-error")


def http_phrase(code: Column) -> Column:
    """The reason phrase of a status code, "" for unknown codes and null."""
    return F.coalesce(*[F.when(code == int(x), F.lit(x.phrase)) for x in HTTPStatus], F.lit(""))


def failure_line(error: Column, code: Column) -> Column:
    return F.when(blank(error), F.lit("")).otherwise(humanise_failure(error, code))


def backfill_status(code: Column, text: Column, error: Column) -> Column:
    """crawl_status of rows that were fetched before the column existed."""
    has_text, clean, e = ~blank(text), blank(error), F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(has_text & clean, "SUCCESS")
        .when(has_text, "PARTIAL")
        .when(code.isin(*BLOCKED_HTTP), "BLOCKED")
        .when(e.contains("bot protection"), "BLOCKED")
        .when(e.contains("robots.txt"), "SKIPPED")
        .when(code.isNull() & clean, "PENDING")
        .when(code.isNull(), "FAILED")
        .when(code < 400, "PARTIAL")
        .otherwise("FAILED")
    )


def is_usable(status: Column, text: Column) -> Column:
    return F.coalesce(status.isin(*USABLE), F.lit(False)) & ~blank(text)


def describe_transport_error(kind: Column, message: Column) -> Column:
    """A reason someone can act on for a transport exception, given its class name and message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    named = lambda label: F.concat(F.lit(f"{label}: "), kind)
    return (
        F.when(kind.rlike("Timeout"), F.lit("timeout"))
        .when(_any(m, "getaddrinfo", "name or service not known", "nodename"), named("dns failure"))
        .when(_any(m, "certificate", "ssl", "tls"), named("ssl error"))
        .when(_any(m, "connection reset", "reset by peer"), named("connection reset"))
        .when(_any(m, "refused"), named("connection refused"))
        .otherwise(F.concat(F.lit("network error: "), kind, F.lit(": "), F.coalesce(message, F.lit(""))))
    )


def is_permanent_error(message: Column) -> Column:
    """Whether a transport error cannot be cured by a retry."""
    return _any(F.lower(F.coalesce(message, F.lit(""))), "certificate", "ssl", "tls", "hostname mismatch", "self-signed", "unknown ca")
