"""Link scoring and filters as native expressions over literal keyword arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.urls import path_of, same_domain

#: Keywords by priority; the position is the rank (fixed values).
HIGH = ("leadership", "executive", "executives", "board-of-directors", "board", "directors", "officers", "management", "our-team", "our-people", "team", "people", "founders", "founder", "who-we-are")
MEDIUM = ("about", "company", "biography", "bio", "profile", "investors", "governance", "corporate")
LOW = ("privacy", "terms", "cookie", "legal", "accessibility", "sitemap", "login", "signin", "sign-in", "register", "cart", "checkout", "careers", "jobs", "blog", "news", "press", "events", "podcast", "support", "help", "contact", "unsubscribe", "rss", "feed")
#: Suffixes that are never pages (fixed values).
ASSETS = (".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".mp4", ".mp3", ".css", ".js", ".ico", ".xml", ".json")
RELEVANT = 100


def _ranked(high: int, medium: int) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("w"), F.lit(base - i).alias("s")) for words, base in ((HIGH, high), (MEDIUM, medium)) for i, w in enumerate(words)])


def link_score(url: Column, anchor: Column) -> Column:
    """struct(score, matched): how likely a link leads to pages about people.

    Keywords are tried one by one, each first as (the head of) a path segment, then in the anchor text;
    then inside longer segments; then the words of no value; anything else gets 10.
    """
    path = F.regexp_replace(F.lower(path_of(url)), "_", "-")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    text = F.trim(F.lower(F.coalesce(anchor, F.lit(""))))
    leads = lambda w: F.exists(segments, lambda s: (s == w) | s.startswith(F.concat(w, F.lit("-"))))
    buried = lambda w: F.exists(segments, lambda s: s.contains(w))
    clean = F.get(F.filter(_ranked(100, 50), lambda k: leads(k["w"]) | text.contains(k["w"])), F.lit(0))
    inner = F.get(F.filter(_ranked(60, 15), lambda k: buried(k["w"])), F.lit(0))
    low = F.get(F.filter(F.array(*[F.lit(w) for w in LOW]), lambda w: buried(w) | text.contains(w)), F.lit(0))
    out = lambda s, w: F.struct(s.cast("int").alias("score"), w.alias("matched"))
    return (
        F.when(clean.isNotNull(), out(clean["s"] - F.when(leads(clean["w"]), 0).otherwise(5), clean["w"]))
        .when(inner.isNotNull(), out(inner["s"], inner["w"]))
        .when(low.isNotNull(), out(F.lit(0), low))
        .otherwise(out(F.lit(10), F.lit("")))
    )


def is_crawlable(url: Column, origin: Column, same_domain_only: bool = True) -> Column:
    asset = F.lower(path_of(url)).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in ASSETS) + ")$")
    ok = url.rlike(r"^https?://") & ~asset
    return F.coalesce(ok & same_domain(url, origin) if same_domain_only else ok, F.lit(False))
