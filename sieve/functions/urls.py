"""URL pieces and recognizers of posting URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.text import blank, url_quote

# Hosts of posting boards, and the index query's fields.
GREENHOUSE = ("job-boards.greenhouse.io", "boards.greenhouse.io")
GREENHOUSE_API, LEVER, ASHBY = "boards-api.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com"
INDEX_FIELDS, INDEX_FILTER, INDEX_COLLAPSE = "url,timestamp,status,mime", "status:200", "urlkey"
# Domains whose postings are left out where none are configured.
EXCLUDED_DOMAINS = ("linkedin.com", "www.linkedin.com", "m.linkedin.com")
_TOKEN = "^[A-Za-z0-9_-]+$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(blank(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(F.trim(blank(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def query_value(url: Column, name: str) -> Column:
    return F.regexp_extract(blank(url), rf"[?&]{name}=([^&#]*)", 1)


def domain_excluded(host: Column, domains: list[str]) -> Column:
    """The host is a listed domain or below one."""
    tests = [(host == d) | host.endswith("." + d) for d in (x.lower() for x in domains if x)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def posting_ref(url: Column, excluded: list[str] = ()) -> Column:
    """struct(ats, board_token, job_id) of a posting URL; null for any other.  Without ``excluded``, EXCLUDED_DOMAINS are."""
    host, parts = host_of(url), path_parts(url)

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    board = host.isin(*GREENHOUSE) | (host.startswith("job-boards.") & host.endswith(".greenhouse.io"))
    api = (host == GREENHOUSE_API) & (part(0) == "v1") & (part(1) == "boards") & (part(3) == "jobs")
    second = F.lower(part(1))
    ats = F.when((board & (part(1) == "jobs")) | api, "greenhouse").when(host == LEVER, "lever").when(host == ASHBY, "ashby")
    token = F.when(api, part(2)).otherwise(part(0))
    job = F.when(api, part(4)).when(board, part(2)).when((host == ASHBY) & (second == "application"), query_value(url, "jobId")).when((host == ASHBY) & second.isin("department", "teams"), "").otherwise(part(1))
    good = ats.isNotNull() & token.rlike(_TOKEN) & job.rlike(_TOKEN) & ~domain_excluded(host, list(excluded) or list(EXCLUDED_DOMAINS))
    return F.when(good, F.struct(ats.alias("ats"), F.lower(token).alias("board_token"), job.alias("job_id")))


def index_url(endpoint: Column, pattern: Column, limit: int) -> Column:
    """Query of a crawl index with its fields, filter, distinct key and limit pushed to it."""
    return F.concat(endpoint, F.lit("?url="), url_quote(pattern), F.lit(f"&output=json&fl={INDEX_FIELDS.replace(',', '%2C')}&filter={INDEX_FILTER.replace(':', '%3A')}&collapse={INDEX_COLLAPSE}&limit={limit}"))


def board_urls(ats: Column, token: Column) -> Column:
    """Address of a board's list of postings."""
    return (
        F.when(ats == "greenhouse", F.concat(F.lit(f"https://{GREENHOUSE_API}/v1/boards/"), token, F.lit("/jobs")))
        .when(ats == "lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), token, F.lit("?mode=json")))
        .when(ats == "ashby", F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), token))
    )


def board_token(token: Column, url: Column) -> Column:
    """The token as configured, else from the URL's path; an error if neither has one."""
    found = F.coalesce(F.nullif(F.trim(blank(token)), F.lit("")), F.get(path_parts(url), F.lit(0)))
    return F.lower(F.coalesce(found, F.raise_error(F.lit("no board token"))))
