"""Listings, polls and adapters from canned answers; dates under other session zones; texts around a run."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from sieve.functions import dates, text
from sieve.functions.vocabulary import INACTIVE
from sieve.operators import delivery, ranking
from sieve.plans import jobs
from sieve.plans.catalogue import ORACLES, QUERIES
from sieve.settings import Settings
from sieve.sources import listing, payloads
from sieve.sources.listing_settings import CrawlSettings, SearchSettings
from sieve.sources.store import StateStore
from tests.core.test_catalogue import TABLES, rows_of

AT = "2026-06-20T00:00:00+00:00"
JOB = "https://boards.greenhouse.io/coolco/jobs/{}"


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, f"file://{tmp_path}/state", wait_s=0.2)


def answers(**by):
    """A GET that answers by the first key that the URL holds."""

    def get(url, headers, timeout=30):
        for part, answer in by.items():
            if part in url:
                return answer if isinstance(answer, tuple) else (200, {}, answer, "")
        return 404, {}, "", "HTTP 404: No Captures found"

    return get


def test_crawl_indexes(spark):
    def asked(config, getter=answers()):
        found, error = listing.crawl_indexes(spark, CrawlSettings.of(config), getter)
        return [r.endpoint for r in found.orderBy("n").collect()], error

    listed = json.dumps([{"id": "CC-MAIN-1", "cdx-api": "https://index.example/1"}, {"id": "CC MAIN-2"}, "x", {"id": "3"}])
    assert asked({"max_common_crawl_indexes": 2}, answers(collinfo=listed)) == (["https://index.example/1", listing.INDEX_HOST + "CC%20MAIN-2-index"], "")
    assert asked({"common_crawl_indexes": ["A-index", "", "https://x/"]}) == ([listing.INDEX_HOST + "A-index", "https://x"], "")
    assert asked({"common_crawl_index": "B"}) == ([listing.INDEX_HOST + "B-index"], "")
    assert asked({}, answers(collinfo="[]"))[1] == "common_crawl_index_list_empty"
    assert asked({}, answers(collinfo="oops"))[1] == "common_crawl_index_list_failed:JSONDecodeError"
    assert asked({}, answers(collinfo=(500, {}, "", "HTTP 500: no")))[1] == "common_crawl_index_list_failed:HTTP 500: no"


def test_settings_of_a_refresh():
    crawl = CrawlSettings.of({"common_crawl_index_count": 0, "ats_hosts": ["a.io", " ", "b.io/x*"], "max_registry_refresh_urls": 9, "per_host_limit": 20})
    assert (crawl.indexes, crawl.most_indexes, crawl.hosts, crawl.most_urls, crawl.per_host) == ((), 1, ("a.io/*", "b.io/x*"), 9, 9)
    search = SearchSettings.of({"google_cse": {"api_key_env": "K", "max_queries": 3, "results_per_query": 50}}, {"K": " k ", "GOOGLE_CSE_CX": "e"})
    assert (search.key, search.engine, search.page_size, search.most_queries, search.most_urls, search.since) == ("k", "e", 10, 3, 30, "d14")
    assert SearchSettings.of({"google_cse": "no"}, {}).usable is False and SearchSettings.of({}, {}).most_urls == 300


def test_waves_ask_what_is_left(spark, store, tmp_path):
    """The budget is met in the first wave: no later request goes out, and what failed past it is no failure."""

    def get(url, headers, timeout=30):
        (tmp_path / url.rsplit("/", 1)[1]).write_text("asked")
        return (503, {}, "", "HTTP 503: busy") if url.endswith(("1", "3")) else (200, {}, json.dumps([{"url": url + f"/{i}"} for i in range(4)]), "")

    urls_of = lambda answers: payloads.crawl_records(answers.select("source_id", "body")).select(F.col("source_id").alias("at"), "pos", "url")
    requests = listing._requests(spark, [(f"r{i}", f"https://x.io/{i}") for i in range(20)])
    found, failures = listing.in_waves(requests, get, urls_of, most=6, width=4, stage=lambda df: jobs.staged(store, df))
    assert [r.url for r in found.orderBy("at", "pos").collect()] == [f"https://x.io/{n}/{i}" for n, i in ((0, 0), (0, 1), (0, 2), (0, 3), (2, 0), (2, 1))]
    assert failures == [("r1", "HTTP 503: busy")] and sorted(p.name for p in tmp_path.iterdir() if p.name.isdigit()) == ["0", "1", "2", "3"]
    found, failures = listing.in_waves(requests, get, urls_of, most=30, width=4, stage=lambda df: jobs.staged(store, df))
    asked = {p.name for p in tmp_path.iterdir() if p.name.isdigit()}
    assert found.count() == 30 and asked == {str(i) for i in range(12)} and failures == [("r1", "HTTP 503: busy"), ("r3", "HTTP 503: busy")]
    assert listing.in_waves(requests.limit(0), get, urls_of, most=3)[0].count() == 0


def test_refresh_from_the_crawl(store):
    lines = "\n".join(json.dumps({"url": JOB.format(i), "status": "200"}) for i in range(5))
    other = json.dumps([{"url": "https://jobs.lever.co/acme/a1"}, {"url": "https://example.com/x"}])
    get = answers(**{"lever.co": other, "boards.greenhouse.io": lines, "broken": (503, {}, "", "HTTP 503: busy")})
    config = {"common_crawl_indexes": ["A"], "ats_hosts": ["boards.greenhouse.io/*", "jobs.lever.co", "jobs.ashbyhq.com", "broken.example"], "max_registry_refresh_urls": 7}
    out = jobs.refresh_from(store, config, at=AT, run_id="r", getter=get)
    assert (out["raw"], out["accepted"], out["rejected"], out["added"]) == (7, 6, 1, 2) and out["ok"]
    assert out["errors"] == []  # the budget is met before the broken host
    out = jobs.refresh_from(store, config | {"max_registry_refresh_urls": 9}, at=AT, run_id="q", getter=get)
    assert out["errors"] == ["common_crawl_query_failed:broken.example/*:HTTP 503: busy"] and out["raw"] == 7 and out["ok"]
    assert jobs.refresh_from(store, config | {"max_registry_refresh_urls": 3}, at=AT, run_id="s", getter=get)["raw"] == 3
    gone = jobs.refresh_from(store, {"common_crawl_indexes": ["A"], "ats_hosts": ["broken.example"]}, at=AT, run_id="t", getter=get)
    assert not gone["ok"] and gone["raw"] == 0 and jobs.refresh_from(store, {"enabled": False}, at=AT, run_id="u")["errors"] == ["discovery_disabled"]


def test_refresh_from_a_file(store, tmp_path):
    (tmp_path / "crawl.jsonl").write_text("﻿" + "\n".join(json.dumps({"url": u}) for u in (JOB.format(1), JOB.format(2), "https://jobs.lever.co/acme/a1", "https://example.com/jobs/1", "https://boards.greenhouse.io/about")), "utf-8")
    out = jobs.refresh_from(store, {"fixture_path": str(tmp_path / "crawl.jsonl"), "exclude_domains": ["example.com"]}, at=AT, run_id="r")
    assert (out["raw"], out["accepted"], out["rejected"], out["added"]) == (5, 3, 2, 2)
    assert jobs.refresh_from(store, {"fixture_path": "/none"}, at=AT, run_id="s")["errors"] == ["fixture_load_failed:FileNotFoundError"]


def test_search(spark, store):
    def get(url, headers, timeout=30):
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if q["q"] == "bad":
            return 429, {}, "", "HTTP 429: slow down"
        start = int(q["start"])
        return 200, {}, json.dumps({"items": [{"link": JOB.format(f"{q['q']}{start + i}")} for i in range(int(q["num"]))] + [{"formattedUrl": " https://example.com "}, {}, {"link": ""}]}), ""

    own = {"api_key": "k", "cx": "e", "queries": ["a", "bad", "b"], "results_per_query": 2, "max_pages_per_query": 2, "max_results": 8}
    found, errors = listing.search_urls(spark, {"google_cse": own}, {}, get)
    assert [r.url.rsplit("/", 1)[1] for r in found.collect()] == ["a1", "a2", "example.com", "a3", "a4", "example.com", "b1", "b2"]
    assert errors == ["google_cse_query_failed:HTTP 429: slow down"] * 2
    assert listing.search_urls(spark, {"google_cse": {"queries": ["a"]}}, {}, get, env={})[1] == ["google_cse_missing_credentials"]
    assert listing.search_urls(spark, {"google_cse": {"api_key_env": "K", "cx_env": "C"}}, {}, get, env={"K": "k", "C": "c"})[1] == ["google_cse_no_queries"]
    out = jobs.refresh_from(store, {"provider": listing.SEARCH, "google_cse": own}, at=AT, run_id="r", getter=get)
    assert (out["provider"], out["raw"], out["accepted"], out["rejected"], out["added"]) == (listing.SEARCH, 8, 6, 2, 1)


def test_search_queries_and_providers(spark):
    conditions = {"locations": ["Sydney", "New York"], "role_groups": [{"id": "a", "include_any": ["policy", "public affairs"]}, {"id": "b", "include_all": ["strategy"]}, {"id": "c"}]}
    made = listing.search_queries(spark, {"google_cse": {"sites": ["x.io", "y.io"], "max_city_aliases": 2, "max_queries": 3}}, conditions)
    assert len(made) == 3 and made[0].startswith('(site:x.io OR site:y.io) ("New York" OR ') and made[0].endswith(' (policy OR "public affairs")') and made[2].startswith("(site:x.io OR site:y.io) (Sydney OR ")
    assert listing.search_queries(spark, {"google_cse": {"queries": " one "}}, {}) == ["one"]
    assert listing.providers({}) == [listing.CRAWL] == listing.providers({"common_crawl_enabled": False})
    assert listing.providers({"provider": listing.SEARCH}) == [listing.SEARCH] == listing.providers({"common_crawl_enabled": False, "google_cse": {"enabled": True}})
    assert listing.providers({"google_cse": {"enabled": True}}) == [listing.CRAWL, listing.SEARCH]


def item(i, title, place, company="Co"):
    return {"external_id": str(i), "title": title, "company": company, "location": place, "canonical_url": f"https://x.io/{i}", "description_text": "Policy", "posted_at": "2026-06-18T00:00:00Z"}


RULES = {"posted_within_days": 0, "role_description_chars": 400, "role_groups": [{"id": "policy_ai", "label": "Policy", "include_any": ["policy"]}]}
SETTINGS = Settings(zone="UTC", least_jobs=0, most_jobs=20)


def test_every_adapter_and_the_rules_of_a_source(store, tmp_path):
    feed = "<rss><channel><item><guid>g1</guid><title>Policy in NYC</title><link>https://x.io/g1</link><description>d</description></item><item><title>Policy nowhere</title><link>https://x.io/g2</link></item></channel></rss>"
    page = "<ul><li><a href='https://x.io/h1'>Policy &amp; more</a><i>Sydney</i></li><li><a href='https://x.io/h2'>Cook</a><i>Sydney</i></li></ul>"
    (tmp_path / "f.json").write_text("﻿" + json.dumps([item(9, "Policy from a file", "Dubai")]), "utf-8")
    sources = [
        {"id": "feed", "adapter": "RSS", "url": "https://feed", "name": "Feed Co"},
        {"id": "page", "adapter": "html_static", "url": "https://page", "company": "Page Co", "item_regex": "<li>.*?</li>", "title_regex": "<a[^>]*>(.*?)</a>", "url_regex": "href='([^']*)'", "location_regex": "<i>(.*?)</i>"},
        {"id": "own", "adapter": "fixture", "jobs": [item(1, "Policy one", "Beijing"), item(2, "Policy sales", "Beijing"), item(3, "Policy late", "Beijing")], "exclude_keywords": ["sales"], "max_jobs_per_source": 2},
        {"id": "file", "adapter": "fixture", "fixture_path": str(tmp_path / "f.json"), "include_keywords": ["file"]},
        {"id": "strict", "adapter": "fixture", "jobs": [item(4, "Policy four", "Dubai")], "include_keywords": ["nothing like it"]},
        {"id": "off", "adapter": "fixture", "jobs": [item(5, "Policy five", "Dubai")], "enabled": False},
        {"id": "lost", "adapter": "lever"},
    ]
    bodies = jobs.poll(store, sources, getter=answers(feed=feed, page=page))
    assert {r.source_id: r.ok for r in bodies.collect()} == {"feed": True, "page": True, "own": True, "file": True, "strict": True, "lost": False}
    jobs.discover(store, bodies, conditions=RULES, now=AT, run_id="d", settings=SETTINGS, sources=sources)
    state = {r.stable_key: r for r in store.read("evaluated_jobs").collect()}
    accepted = {k for k, r in state.items() if not r.rejection_reason.startswith(("conditions_filter", "hard_filter"))}
    assert {k for k, r in state.items() if r.rejection_reason == "hard_filter"} == {"own:2", "strict:4"}
    assert accepted == {"feed:g1", "page:https-x-io-h1", "own:1", "file:9"}
    assert state["feed:g1"].job.city == "New York" and state["feed:g1"].job.source_name == "Feed Co" and state["page:https-x-io-h1"].job.title == "Policy & more"
    assert state["page:https-x-io-h2"].rejection_reason == "conditions_filter:no_role_group"


def test_polls_feed_the_registry_and_the_cache(store, spark):
    refs = spark.createDataFrame([("https://jobs.lever.co/good/1",), ("https://jobs.lever.co/bad/1",)], "url string")
    jobs.refresh_registry(store, refs, at=AT, run_id="r")
    body = json.dumps([{"id": "1", "text": "Policy lead", "hostedUrl": "https://jobs.lever.co/good/1", "categories": {"location": "Sydney"}}])

    def get(url, headers, timeout=30):
        if "/bad" in url:
            return 500, {}, "", "HTTP 500: no"
        return (304, {}, "", "") if headers.get("If-None-Match") == "e1" else (200, {"etag": "e1", "last-modified": "then"}, body, "")

    for n, (force, evaluated) in enumerate(((False, 1), (False, 0), (True, 1))):
        polled = jobs.poll(store, [], getter=get, boards=jobs.boards_to_poll(store, seed="s", most=5), force=force)
        out = jobs.discover(store, polled, conditions=RULES, now=AT, run_id=f"d{n}", settings=SETTINGS, force=force, most_failures=2)
        assert out["evaluated"] == evaluated
    boards = {r.board_key: r for r in store.read("board_registry").collect()}
    assert (boards["lever:good"].failure_count, boards["lever:good"].active, boards["lever:good"].last_polled) == (0, True, AT)
    assert not boards["lever:bad"].active and boards["lever:bad"].failure_count == 2 and boards["lever:bad"].last_error == "HTTP 500: no"
    assert [tuple(r) for r in store.read("source_cache").collect()] == [("registry-lever-good", "e1", "then")]


def test_recipients(spark):
    def of(*rows):
        table = spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "at int, cells array<string>")
        return [r.email for r in payloads.recipients(table, tuple(INACTIVE)).collect()]

    assert of(("Name", "Email Address", "Status"), ("A", "a@x.io", "active"), ("A", "A@X.io", ""), ("B", "mailto:b@x.io", "Unsubscribed"), ("C",), ("D", "Dee <d@x.io>"), ("E", "nobody")) == ["a@x.io", "d@x.io"]
    assert of(("a@x.io", "n"), ("b@x.io",)) == ["a@x.io", "b@x.io"] and of() == []


def test_prompt_report_and_titles(spark):
    system, user = ranking.prompt(['{"key":"a"}'], "Be bold", 3, 2)
    assert system["role"] == "system" and "Be bold" in user["content"] and '[{"key":"a"}]' in user["content"] and "Aim for 2-2" in user["content"]
    row = {"company": "C", "title": "T", "city": "Dubai", "score": 81.6}
    assert jobs.report({"raw_count": 2, "errors": []}, [row] * 12)[0].splitlines() == ["Raw count: 2", "Errors: none", *["- C - T (Dubai) score=82"] * 10]
    said, code = jobs.report({"ranker_error": "ranker_failed:ValueError"}, [row], as_json=True)
    assert code == 1 and json.loads(said)["included_jobs"] == [row]
    one = spark.range(1).select(
        delivery.preview_title(dates.parse_iso(F.lit("2026-06-20T09:30:10Z")), "Weekly", "Asia/Shanghai").alias("title"), text.whatsapp(F.lit(" +1 ")).alias("a"), text.whatsapp(F.lit("whatsapp:+1")).alias("b"),
        text.provider(F.lit(" Gmail "), {"gmail": "google"}, "none").alias("p"), text.provider(F.lit(None).cast("string"), {"gmail": "google"}, "none").alias("q"),
    ).first()
    assert tuple(one) == ("Weekly preview 2026-06-20 17:30", "whatsapp:+1", "whatsapp:+1", "google", "none")


def test_chat_model():
    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = self.headers["Authorization"] == "Bearer k" and body["messages"][1]["content"].count("row1")
            self.send_response(200 if good else 401)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "said"}}]} if self.path == "/ok" else {"oops": 1}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert ranking.chat_model(base + "/ok", " k ", "m", "c", 1, 2)(["row1"]) == "said"
    for url, key in ((base + "/ok", "other"), (base + "/odd", "k"), ("http://127.0.0.1:1/", "k")):
        with pytest.raises(ranking.ChatError):
            ranking.chat_model(url, key, "m", "c", 1, 2)(["row1"])
    with pytest.raises(ranking.ChatError):
        ranking.chat_model(base, " ", "m", "c", 1, 2)
    server.shutdown()


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["parse_dates", "week_key", "send_window", "recency_window", "week_range_label", "week_guard"])
def test_dates_in_another_session_zone(spark, sf, new_york, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(con.execute(ORACLES[name]).fetchdf())


def test_date_texts_in_another_session_zone(spark, new_york):
    said = {
        "2024-06-10T06:13:20": "2024-06-10T06:13:20+00:00", "2024-06-10": "2024-06-10T00:00:00+00:00", "2024-06-10T06:13:20Z": "2024-06-10T06:13:20+00:00", "2024-06-10 06:13": "2024-06-10T06:13:00+00:00",
        "2024-06-10T06:13:20.5+02:00": "2024-06-10T04:13:20+00:00", "20240610T061320Z": "2024-06-10T06:13:20+00:00", "1718000000": "2024-06-10T06:13:20+00:00", "1718000000000": "2024-06-10T06:13:20+00:00",
        "Mon, 10 Jun 2024 06:13:20 EST": "2024-06-10T11:13:20+00:00", "10 Jun 2024 06:13:20 PDT": "2024-06-10T13:13:20+00:00", "Mon, 10 Jun 2024 06:13:20 GMT": "2024-06-10T06:13:20+00:00",
        "Mon, 10 Jun 2024 06:13:20 +0200 (CEST)": "2024-06-10T04:13:20+00:00", "Mon, 10 Jun 2024 06:13:20": "2024-06-10T06:13:20+00:00", "2024-03-10T02:30:00": "2024-03-10T02:30:00+00:00", "soon": "soon", "": "",
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", dates.parse_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == said
    at = dates.parse_iso(F.lit("2024-06-10T02:00:00Z"))
    row = spark.range(1).select(dates.week_key(at).alias("w"), dates.week_key(at, "America/New_York").alias("n"), dates.in_send_window(dates.parse_iso(F.lit("2024-06-10T09:30:00")), "UTC", 0, 9).alias("s")).first()
    assert tuple(row) == ("2024-W24", "2024-W23", True)
