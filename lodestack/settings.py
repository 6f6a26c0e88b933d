"""Semantic parameters of the engine, as one immutable record."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    search_top_k: int = 8
    search_min_score: float = 0.25
    overfetch: int = 4
    person_relevance_ratio: float = 0.75
    context_chunks_per_page: int = 2
    synthesis_chunks: int = 6
    person_cards: int = 12
    min_text_chars: int = 500
    min_text_words: int = 100
    nav_words_per_line: float = 4.0
    nav_min_lines: int = 10
    block_page_max_chars: int = 2500
    max_html_bytes: int = 5 * 1024 * 1024
    max_document_bytes: int = 25 * 1024 * 1024
    max_upload_bytes: int = 10 * 1024 * 1024
    max_upload_urls: int = 500
    max_retries: int = 2
    retry_backoff_s: float = 0.75
    crawl_delay_s: float = 1.0
    respect_robots: bool = True
    user_agent: str = "lodestack"
    discover_links: bool = False
    max_pages_per_url: int = 25
    max_crawl_depth: int = 2
    same_domain_only: bool = True
    allow_private_hosts: bool = False
    embedding_dim: int = 384
    embedding_model: str = "hashed-bow"
    person_line_distance: int = 3
    prompt_head_chars: int = 6000
    prompt_tail_chars: int = 2000
    browser_min_gain: float = 1.5
    completion_fallbacks: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, prefix: str = "LODESTACK_") -> Settings:
        """Overrides from environment variables; a comma list fills a tuple."""
        got: dict[str, object] = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                got[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(f.default, tuple):
                got[f.name] = tuple(p.strip() for p in raw.split(",") if p.strip())
            else:
                got[f.name] = type(f.default)(raw)
        return cls(**got)


DEFAULTS = Settings()
