"""What a refresh asks for, read once from its configuration into typed records."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Providers, and the defaults of a refresh.
CRAWL, SEARCH = "common_crawl_registry", "google_cse_registry"
INDEX_LIST = "https://index.commoncrawl.org/collinfo.json"
HOSTS = ("boards.greenhouse.io/*", "job-boards.greenhouse.io/*", "job-boards.eu.greenhouse.io/*", "job-boards.anz.greenhouse.io/*", "jobs.lever.co/*", "jobs.ashbyhq.com/*")
MOST_INDEXES, MOST_URLS, MOST_QUERIES, PAGE = 4, 5000, 30, 10
CITY_TERMS, ROLE_TERMS, SINCE = 3, 6, "d14"


def _said(value: object) -> str:
    return "" if value is None else str(value).strip()


def _all_said(value: object) -> tuple[str, ...]:
    """What a setting names, one or several."""
    return tuple(filter(None, map(_said, value if isinstance(value, list | tuple) else [value])))


def _count(config: Mapping, names: tuple[str, ...], default: int) -> int:
    """The first of the named settings that is there, at least 1."""
    return max(1, int(next((config[n] for n in names if n in config), default)))


def search_part(config: Mapping) -> Mapping:
    own = config.get("google_cse")
    return own if isinstance(own, dict) else {}


@dataclass(frozen=True)
class CrawlSettings:
    """``one_index``: a single index was named, so no count applies."""

    fixture: str
    indexes: tuple[str, ...]
    one_index: bool
    most_indexes: int
    index_list: str
    hosts: tuple[str, ...]
    most_urls: int
    per_host: int

    @classmethod
    def of(cls, config: Mapping) -> CrawlSettings:
        named = config.get("common_crawl_indexes") or config.get("common_crawl_index")
        most = _count(config, ("max_registry_refresh_urls",), MOST_URLS)
        return cls(
            fixture=_said(config.get("fixture_path")), indexes=_all_said(named), one_index=isinstance(named, str) and bool(named.strip()),
            most_indexes=_count(config, ("max_common_crawl_indexes", "common_crawl_index_count"), MOST_INDEXES), index_list=_said(config.get("common_crawl_index_list_url")) or INDEX_LIST,
            hosts=tuple(h if "/" in h else f"{h}/*" for h in _all_said(list(config.get("ats_hosts", HOSTS)))), most_urls=most, per_host=min(most, _count(config, ("per_host_limit",), most)),
        )


@dataclass(frozen=True)
class SearchSettings:
    key: str
    engine: str
    page_size: int
    pages: int
    most_queries: int | None
    most_urls: int
    since: str

    @property
    def usable(self) -> bool:
        return bool(self.key and self.engine)

    @classmethod
    def of(cls, config: Mapping, env: Mapping[str, str]) -> SearchSettings:
        own = search_part(config)
        size, pages = min(PAGE, _count(own, ("results_per_query",), PAGE)), _count(own, ("max_pages_per_query",), 1)

        def secret(name: str, variable: str) -> str:
            """What is configured, else the environment's, under a name that may be configured too."""
            return _said(own.get(name)) or _said(env.get(_said(own.get(f"{name}_env")) or variable))

        return cls(
            key=secret("api_key", "GOOGLE_CSE_API_KEY"), engine=secret("cx", "GOOGLE_CSE_CX"), page_size=size, pages=pages, most_queries=_count(own, ("max_queries",), 1) if "max_queries" in own else None,
            most_urls=_count(own, ("max_results",), int(own.get("max_queries", MOST_QUERIES)) * size * pages), since=_said(own.get("date_restrict", SINCE)),
        )
