"""Discovery: parse outcomes, rules of sources, the detail frontier, and what a failed ranking leaves behind."""

import html
import json
import re

import pytest
from pyspark.sql import functions as F

from sieve.functions import text
from sieve.operators import delivery, frontier, source_rules
from sieve.plans import discovery, jobs
from sieve.settings import Settings
from sieve.sources import outcomes
from sieve.sources.store import StateStore

NOW = "2026-06-20T00:00:00+00:00"
RULES = {"posted_within_days": 30, "role_description_chars": 400, "role_groups": [{"id": "policy_ai", "label": "Policy", "include_any": ["policy"]}]}
SETTINGS = Settings(zone="UTC", least_jobs=0, most_jobs=20)


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, f"file://{tmp_path}/state", wait_s=0.2)


def listed(i, title="Policy analyst", place="Sydney", updated="2026-06-19T00:00:00Z", content=""):
    return {"id": str(i), "title": title, "absolute_url": f"https://boards.greenhouse.io/co/jobs/{i}", "location": {"name": place}, "first_published": "2026-06-18T00:00:00Z", "updated_at": updated, "content": content}


def board(spark, *postings, source="b1"):
    return spark.createDataFrame([(source, "greenhouse", "Co", json.dumps({"jobs": list(postings)}))], "source_id string, adapter string, company string, body string")


class Service:
    """Answers by the end of the address; counts what it is asked in a file, as workers are processes of their own."""

    def __init__(self, path, answers):
        self.path, self.answers = str(path), answers

    def __call__(self, url, headers, timeout=30):
        with open(self.path, "a") as f:
            f.write(url + "\n")
        body = next((b for end, b in self.answers.items() if url.endswith(end)), None)
        return (404, {}, "", "HTTP 404: none") if body is None else (200, {"etag": "e"}, body, "")

    def asked(self):
        try:
            with open(self.path) as f:
                return sorted(f.read().split())
        except FileNotFoundError:
            return []


def entries(store):
    return {r.stable_key: r for r in store.read("evaluated_jobs").collect()}


def test_frontier_admits_a_few_and_leaves_the_rest_for_the_next_run(spark, store, tmp_path):
    details = {f"/boards/tok/jobs/{i}": json.dumps(listed(i, content="policy work")) for i in (1, 3, 4, 5)}
    details["/boards/tok/jobs/2"] = "<html>"
    service = Service(tmp_path / "asked", details)
    sources = [{"id": "b1", "adapter": "greenhouse", "board_token": "tok", "max_detail_fetches": 2}]
    run = dict(conditions=RULES, now=NOW, settings=SETTINGS, sources=sources, details=frontier.fetch_details(service))
    bodies = board(spark, listed(0, place="London"), listed(1), listed(2, title="Painter"), listed(3), listed(4), listed(6, title="Policy", updated="", place="Sydney") | {"first_published": "2020-01-01"})
    first = jobs.discover(store, bodies, run_id="r1", **run)
    assert [u.rsplit("/", 2)[-2:] for u in service.asked()] == [["jobs", "1"], ["jobs", "2"]]
    # 2 has no readable detail and is judged by the list; 3 and 4 wait; 6 is too old to be asked for
    assert set(entries(store)) == {"b1:1", "b1:2"} and first["left_for_next_run"] == 2
    assert entries(store)["b1:1"].job.description_text == "policy work" and entries(store)["b1:2"].rejection_reason == "conditions_filter:no_role_group"
    second = jobs.discover(store, bodies, run_id="r2", **run)
    # what was not in a role group is looked at again, an unchanged candidate by its own date is not skipped
    assert second["left_for_next_run"] >= 1 and len(service.asked()) == 4


def test_frontier_moves_on_past_unchanged_rows(spark, store, tmp_path):
    service = Service(tmp_path / "asked", {f"/jobs/{i}": json.dumps(listed(i, content="8 years of experience needed", updated="2026-06-18T00:00:00Z")) for i in range(1, 6)})
    sources = [{"id": "b1", "adapter": "greenhouse", "url": "https://boards-api.greenhouse.io/v1/boards/tok/jobs", "max_detail_fetches": 2}]
    bodies = board(spark, *(listed(i, updated="2026-06-18T00:00:00Z") for i in range(1, 6))).withColumn("url", F.lit(sources[0]["url"]))
    run = dict(conditions=RULES | {"max_years_experience": 5}, now=NOW, settings=SETTINGS, sources=sources, details=frontier.fetch_details(service))
    left = [jobs.discover(store, bodies, run_id=f"r{n}", **run)["left_for_next_run"] for n in range(3)]
    assert left == [3, 1, 0] and len(service.asked()) == 5 and len(entries(store)) == 5


def test_detail_of_another_place_is_no_posting(spark, store):
    details = lambda rows: rows.select("source_id", "external_id", "company", F.lit(json.dumps(listed(1, place="London"))).alias("body"))
    jobs.discover(store, board(spark, listed(1)), conditions=RULES, now=NOW, run_id="r", settings=SETTINGS, details=details)
    assert entries(store) == {}


def test_a_failed_ranking_withholds_candidates_and_cache(spark, store, tmp_path):
    jobs.refresh_registry(store, spark.createDataFrame([("https://jobs.lever.co/good/1",)], "url string"), at=NOW, run_id="r")
    post = lambda i, said: {"id": str(i), "text": said, "hostedUrl": f"https://jobs.lever.co/good/{i}", "createdAt": 1781740800000, "categories": {"location": "Sydney"}}
    service = Service(tmp_path / "asked", {"good?mode=json": json.dumps([post(1, "Policy lead"), post(2, "Policy analyst"), post(3, "Cook")])})

    def run(name, **more):
        polled = jobs.poll(store, [], getter=service, boards=jobs.boards_to_poll(store, seed="s", most=5))
        return jobs.discover(store, polled, conditions=RULES, now=NOW, run_id=name, settings=SETTINGS, **more)

    failed = run("d1", model=lambda shown: 1 / 0)
    assert failed["ranker_error"] == "ranker_failed:ZeroDivisionError" and failed["errors"] == [failed["ranker_error"]] and failed["candidates"] == 2
    assert {k: r.rejection_reason for k, r in entries(store).items()} == {"registry-lever-good:3": "conditions_filter:no_role_group"}
    assert store.read("source_cache").count() == 0 and store.read("board_registry").first().last_polled == NOW and {r.run_id for r in store.read("runs").collect()} == {"r", "d1"}
    fine = run("d2", model=lambda shown: json.dumps({"opportunities": [{"key": "registry-lever-good:1", "score": 90, "include": True}]}))
    got = entries(store)
    assert fine["included"] == 1 and got["registry-lever-good:1"].status == "included" and got["registry-lever-good:2"].rejection_reason == "not_selected"
    # the board's name, its company by its token, and the date that a candidate is known by
    assert got["registry-lever-good:1"].job.company == "Good" and got["registry-lever-good:1"].job.source_name == "Discovered Lever: Good"
    assert got["registry-lever-good:2"].source_updated_at == got["registry-lever-good:2"].job.posted_at
    assert [r.source_id for r in store.read("source_cache").collect()] == ["registry-lever-good"]
    assert fine["role_group_counts"] == {"policy_ai": 2} and [(r["fetched_count"], r["normalized_count"], r["ok"]) for r in fine["source_results"]] == [(3, 3, True)]


def test_answers_that_cannot_be_read_are_failed_polls(spark, store):
    refs = [(f"https://jobs.lever.co/{t}/1",) for t in ("page", "fine")]
    jobs.refresh_registry(store, spark.createDataFrame(refs, "url string"), at=NOW, run_id="r")
    get = lambda url, headers, timeout=30: (200, {}, "<html>busy</html>" if "/page" in url else "[]", "")
    for n in range(2):
        polled = jobs.poll(store, [], getter=get, boards=jobs.boards_to_poll(store, seed="s", most=5), force=True)
        out = jobs.discover(store, polled, conditions=RULES, now=NOW, run_id=f"d{n}", settings=SETTINGS, most_failures=2)
        assert out["errors"] == ["source_failed:registry-lever-page:JSONDecodeError"]
    rows = {r.board_token: r for r in store.read("board_registry").collect()}
    assert (rows["page"].active, rows["page"].failure_count, rows["page"].last_error) == (False, 2, "JSONDecodeError") and rows["fine"].active
    revived = jobs.polled_boards(store.read("board_registry"), spark.createDataFrame([("lever:page", True, "")], "board_key string, ok boolean, error string"), at=NOW, most_failures=2).first()
    assert (revived.active, revived.failure_count) == (True, 0)


@pytest.mark.parametrize(
    ("adapter", "body", "error"),
    [
        ("greenhouse", '{"jobs": [{"id": 1}]}', ""), ("greenhouse", '{"id": 1, "title": "x"}', ""), ("greenhouse", "{}", ""), ("greenhouse", '[{"id": 1}, {"t": 2}]', ""), ("greenhouse", "﻿[]", ""), ("greenhouse", '["a"]', "AttributeError"), ("greenhouse", "", "JSONDecodeError"),
        ("greenhouse", '{"jobs": [', "JSONDecodeError"), ("lever", '{"message": "gone"}', ""), ("lever", "[1]", "AttributeError"), ("ashby", '{"jobs": []}', ""), ("ashby", '{"error": "no"}', "AttributeError"), ("ashby", "null", ""), ("rss", "<rss><channel/></rss>", ""), ("rss", "<rss><channel>", "ParseError"),
        ("rss", "no feed", "ParseError"), ("html_static", "<p>", ""), ("smoke", "{}", "ValueError"), ("fixture", '[{"id": 1}]', ""), ("fixture", "{", "JSONDecodeError"),
    ],
)
def test_read_errors(spark, adapter, body, error):
    row = spark.createDataFrame([(adapter, body)], "a string, b string").select(outcomes.read_error(F.col("a"), F.col("b"), F.lit("")).alias("e"))
    assert row.first().e == error


def test_a_thousand_wrappers_in_one_plan(spark):
    sources = [{"id": f"s{i}", "adapter": "html_static", "company": f"Co {i}", "item_regex": f"<li{i}>.*?</li>", "title_regex": "<b>(.*?)</b>", "url_regex": "href='([^']*)'", "location_regex": "<i>(.*?)</i>"} for i in range(1000)]
    sources += [{"id": "none", "adapter": "html_static"}, {"id": "broken", "adapter": "html_static", "item_regex": "<li", "title_regex": "(((("}, {"id": "nogroup", "adapter": "html_static", "item_regex": "<li", "title_regex": "b"}]
    pages = [(s["id"], "html_static", "", None, f"<li{k}><a href='u{k}'><b>Policy {k}</b></a><i>Sydney</i></li>") for k, s in enumerate(sources)]
    bodies = spark.createDataFrame(pages, "source_id string, adapter string, company string, board_key string, body string")
    ruled = source_rules.with_rules(bodies, source_rules.source_rules(spark, sources), places=F.array(F.lit("Sydney")), remote=False)
    found = discovery.payloads.html_raw(ruled.where("adapter = 'html_static'"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?m)^[\s:+-]*Union", plan) and plan.count("Scan") + plan.count("LocalTableScan") <= 6
    rows = {r.source_id: r for r in found.collect()}
    assert len(rows) == 1000 and (rows["s7"].title, rows["s7"].canonical_url, rows["s7"].company) == ("Policy 7", "u7", "Co 7")
    failed = {r.source_id: r.error for r in outcomes.read_outcomes(ruled).where("NOT ok").collect()}
    assert set(failed) == {"none", "broken", "nogroup"} and failed["none"] == "ValueError" and failed["nogroup"] == "IndexError"


def test_places_and_remote_flag_of_each_source(spark, store):
    post = lambda i, place: {"id": str(i), "title": "Policy", "company": "Co", "location": place, "url": f"https://x.io/{i}", "posted_at": "2026-06-18T00:00:00Z", "content": "Policy", "salary": "10"}
    postings = [post(1, "Sydney"), post(2, "Dubai"), post(3, "Remote, Mars")]
    sources = [{"id": "own", "adapter": "fixture", "jobs": postings, "cities": ["dubai"]}, {"id": "far", "adapter": "fixture", "jobs": postings, "allow_global_remote": True}, {"id": "plain", "adapter": "fixture", "jobs": postings}]
    out = jobs.discover(store, jobs.poll(store, sources), conditions=RULES | {"locations": ["Sydney", "Dubai"]}, now=NOW, run_id="r", settings=SETTINGS, sources=sources, defaults={"cities": ["Sydney"]})
    assert set(entries(store)) == {"own:2", "far:1", "far:3", "plain:1"} and out["city"] == 4
    row = entries(store)["plain:1"].job
    assert (row.canonical_url, row.description_text, row.salary_text, row.external_id) == ("https://x.io/1", row.description_text, "10", "1")


@pytest.mark.parametrize(
    ("wanted", "default", "places"),
    [(["Sydney", "dubai"], ["Sydney"], ["Sydney"]), (["Beijing"], ["Dubai"], ["Dubai"]), (["Sydney"], [], ["Sydney"]), ([], ["nyc"], ["New York"]), ([], [], ["Shenzhen"])],
)
def test_places_of_a_run(spark, wanted, default, places):
    column = source_rules.run_places({"locations": wanted}, {"cities": default}, Settings(cities=("Shenzhen",)))
    assert spark.range(1).select(column.alias("c")).first().c == places


def test_every_entity(spark):
    cases = [f"a&{n}b" for n in html.entities.html5] + [
        "caf&eacute; it&#8217;s A&#x26;B &amp;eacute; &notit; &notin; &copy2024 &ampamp; &#0; &#128; &#x9f; &#13; &#xD800; &#x110000; &#99999999999; &#1; &#xFFFE; &#xfdd0; &# &#x; && &;", "&", "a & b", "&unknown; &LT &GT;&lt", "", "&#38;#38;", "&NotEqualTilde;&Afr;",
    ]
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.unescape(F.col("c")).alias("u")).collect()
    wrong = [(r.c, r.u, html.unescape(r.c)) for r in rows if r.u != html.unescape(r.c)]
    assert not wrong, wrong[:5]


def test_trend_and_groups_of_a_digest(spark):
    rows = [dict(title="Lead", company="Co", department="", description_text="x" * 590 + " policy " + "later venture capital", why_cool="", reason="", city="Sydney", tags=["venture"], groups=["odd_kind"], rank=n) for n in range(3)]
    rows = [r.asDict() for r in delivery.in_groups(spark.createDataFrame(rows)).collect()]
    assert rows[0]["group"] == "Odd Kind" and "odd kind" in jobs.trend_of(spark, [r | {"description_text": ""} for r in rows])


def test_rows_of_a_digest_stand_group_by_group(spark):
    """Groups in their own order, then others in the order of their best rows; a row's first known group counts."""
    held = [(1, ["zeta_kind"]), (2, ["policy_ai"]), (3, []), (4, ["zeta_kind", "strategy_operations"]), (5, ["alpha"]), (6, ["zeta_kind"]), (7, None), (8, ["frontier_tech_startups", "policy_ai"])]
    got = delivery.in_groups(spark.createDataFrame(held, "rank int, groups array<string>")).collect()
    assert [(r["rank"], r.group) for r in got] == [
        (4, "Strategy / Operations"), (2, "Policy / AI Governance"), (8, "Policy / AI Governance"), (1, "Zeta Kind"), (6, "Zeta Kind"), (3, "Other Strong Matches"), (7, "Other Strong Matches"), (5, "Alpha"),
    ]
    tags = spark.createDataFrame([(["a", "condition: policy_ai ", "condition:", "condition:policy_ai", "condition:b"],), ([],), (None,)], "t array<string>")
    assert [r.i for r in tags.select(delivery.group_ids(F.col("t")).alias("i")).collect()] == [["policy_ai", "b"], [], None]
