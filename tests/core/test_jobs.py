"""State, fetching, settings, ranking and the three jobs, on small tables of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sieve.operators import delivery, ranking, relational
from sieve.plans import jobs
from sieve.settings import Settings, flag, listed, load_env, load_json
from sieve.sources.fetch import fetch_bodies
from sieve.sources.store import Conflict, StateStore, outgrown
from sieve.streaming.files import run_available

AT, LATER = "2026-06-20T00:00:00+00:00", "2026-06-21T00:00:00+00:00"
CONDITIONS = {"posted_within_days": 30, "max_years_experience": 5, "role_description_chars": 400, "role_groups": [{"id": "policy_ai", "label": "Policy", "include_any": ["policy"]}, {"id": "strategy_operations", "label": "Strategy", "include_any": ["strategy"]}]}
SETTINGS = Settings(zone="UTC", least_jobs=0, most_jobs=5)


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, f"file://{tmp_path}/state", wait_s=0.2)


def boards(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def posting(i, title, place, content="", posted="2026-06-18T00:00:00Z"):
    return {"id": str(i), "title": title, "absolute_url": f"https://boards.greenhouse.io/coolco/jobs/{i}", "location": {"name": place}, "first_published": posted, "updated_at": posted, "content": content}


def bodies(spark, *postings):
    return spark.createDataFrame([("s1", "greenhouse", "CoolCo", json.dumps({"jobs": list(postings)})), ("s2", "lever", "Bad", "not json"), ("s3", "ashby", "None", None)], "source_id string, adapter string, company string, body string")


JOBS = (
    posting(1, "AI policy lead", "New York"), posting(2, "Public policy and venture strategy", "Sydney"), posting(3, "Policy analyst", "London"),
    posting(4, "Policy analyst", "Beijing", "At least 8 years of experience needed"), posting(5, "Policy analyst", "Dubai", posted="2025-01-01T00:00:00Z"),
)


def test_store_keeps_versions_and_merges(store, spark):
    assert store.read("sent_weeks").count() == 0 and store.current() == (0, {})
    row = lambda *r: spark.createDataFrame([r], "week_key string, sent_at string, run_id string")
    assert store.commit({"sent_weeks": row("w1", "a", "r1")}) == 1
    assert store.commit({"sent_weeks": row("w2", "b", "r2")}) == 2 and store.commit({"sent_weeks": row("w1", "c", "r3")}) == 3
    assert sorted((r.week_key, r.sent_at) for r in store.read("sent_weeks").collect()) == [("w1", "c"), ("w2", "b")]


def test_store_retries_after_a_conflict_and_loses_nothing(store, spark, monkeypatch):
    row = lambda *r: spark.createDataFrame([r], "week_key string, sent_at string, run_id string")
    other, claim, beaten = StateStore(spark, store.root, wait_s=0.2), store._claim, []

    def late(number, body):
        if not beaten:
            beaten.append(other.commit({"sent_weeks": row("theirs", "x", "r")}))
        return claim(number, body)

    monkeypatch.setattr(store, "_claim", late)
    assert store.commit({"sent_weeks": row("ours", "y", "r")}) == 2 and beaten == [1]
    assert {r.week_key for r in store.read("sent_weeks").collect()} == {"ours", "theirs"}
    monkeypatch.setattr(store, "_claim", lambda *_: False)
    with pytest.raises(Conflict):
        store.commit({"sent_weeks": row("never", "z", "r")})


def test_store_passes_over_a_version_that_was_never_finished(store, spark):
    store.commit({"sent_weeks": spark.createDataFrame([("w", "a", "r")], "week_key string, sent_at string, run_id string")})
    fs, path = store._path("versions", "2")
    fs.create(path, False).close()
    assert store.current()[0] == 1
    assert store.commit({"sent_weeks": spark.createDataFrame([("v", "a", "r")], "week_key string, sent_at string, run_id string")}) == 3
    assert store.read("sent_weeks").count() == 2


def weeks(spark, low, high, said):
    return spark.range(low, high).select(F.format_string("w%07d", "id").alias("week_key"), F.lit(said).alias("sent_at"), F.sha2(F.col("id").cast("string"), 256).alias("run_id"))


def test_store_writes_in_proportion_to_the_commit(store, spark):
    store.commit({"sent_weeks": weeks(spark, 0, 200_000, "old")})
    _, at = store.current()
    (_, base), = at["sent_weeks"]
    for n in range(12):
        store.commit({"sent_weeks": weeks(spark, n * 50, n * 50 + 100, f"new{n:02d}")})
        layers = store.current()[1]["sent_weeks"]
        # the large layer stays the file it was; those above are few and each outweighs the ones after it
        assert layers[0] == at["sent_weeks"][0] and len(layers) <= 4
        sizes = [size for _, size in layers]
        assert all(size >= 4 * sum(sizes[i + 1:]) for i, size in enumerate(sizes)) and sum(sizes[1:]) < base / 20
    rows = {r.week_key: r.sent_at for r in store.read("sent_weeks").where("sent_at <> 'old'").collect()}
    assert rows == {f"w{i:07d}": f"new{min(i // 50, 11):02d}" for i in range(650)} and store.read("sent_weeks").count() == 200_000
    assert store.read("sent_weeks", at).where("sent_at <> 'old'").count() == 0
    plan = store.read("sent_weeks")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_store_merges_layers_by_size(store, spark):
    assert outgrown([5]) == 0 and outgrown([100, 25]) == 1 and outgrown([100, 26]) == 0 and outgrown([1000, 100, 20, 20]) == 1 and outgrown([10_000, 100, 20, 20]) == 1
    layers = [spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1), ("b", 1), (None, 1), ("e", 1)], [("a", 2), ("c", 2), ("c", 3), (None, 2)], [("a", 4), ("d", None)], [])]
    assert sorted((r.k or "", r.v or 0) for r in relational.newest(layers, "k").collect()) == [("", 1), ("", 2), ("a", 4), ("b", 1), ("c", 2), ("c", 3), ("d", 0), ("e", 1)]


def test_store_sees_a_commit_between_its_two_looks(store, spark, monkeypatch):
    other, current, beaten = StateStore(spark, store.root, wait_s=0.2), store.current, []

    def late():
        if not beaten:
            beaten.append(None)
            found = current()
            other.commit({"sent_weeks": weeks(spark, 0, 1, "theirs")})
            return found
        return current()

    monkeypatch.setattr(store, "current", late)
    assert store.commit({"sent_weeks": weeks(spark, 1, 2, "ours")}) == 2
    assert {r.sent_at for r in store.read("sent_weeks").collect()} == {"ours", "theirs"}


def test_vacuum_keeps_what_a_kept_version_names(store, spark):
    for n in range(6):
        store.commit({"sent_weeks": weeks(spark, n, n + 1, f"n{n}")})
    lost = store.write("sent_weeks", weeks(spark, 90, 91, "never named"))
    _, second = store.current()
    store.commit({"sent_weeks": weeks(spark, 6, 7, "n6")})
    fs, path = store._path(lost[0])
    assert store.vacuum(keep=2, grace_s=3600) == 0 and fs.exists(path)
    assert store.vacuum(keep=2, grace_s=-60) > 0 and not fs.exists(path)
    assert store._numbers() == [6, 7] and store.read("sent_weeks").count() == 7 and store.read("sent_weeks", second).count() == 6
    assert store.vacuum(keep=2, grace_s=-60) == 0 and store.commit({"sent_weeks": weeks(spark, 7, 8, "n7")}) == 8


def test_registry(store, spark):
    found = boards(spark, "https://boards.greenhouse.io/coolco/jobs/100", "https://boards.greenhouse.io/CoolCo/jobs/101?x=1", "https://jobs.lever.co/acme/a1", "https://example.com/jobs/1", "https://boards.greenhouse.io/about", None)
    assert jobs.refresh_registry(store, found, at=AT, run_id="r1") == {"raw": 6, "rejected": 3, "accepted": 3, "added": 2, "updated": 1}
    row = store.read("board_registry").where("board_key = 'greenhouse:coolco'").first()
    assert sorted(row.sample_job_ids) == ["100", "101"] and row.active and row.first_seen == AT
    jobs.refresh_registry(store, boards(spark, "https://boards.greenhouse.io/coolco/jobs/102"), at=LATER, run_id="r2")
    row = store.read("board_registry").where("board_key = 'greenhouse:coolco'").first()
    assert (row.first_seen, row.last_seen, len(row.sample_job_ids)) == (AT, LATER, 3) and store.read("board_registry").count() == 2
    assert {r.run_id for r in store.read("runs").collect()} == {"r1", "r2"}
    assert jobs.refresh_registry(store, found.limit(0), at=LATER, run_id="r3")["accepted"] == 0


def test_bounded_lists_of_a_hot_board_equal_a_plain_fold(spark):
    held = [f"{i:04d}" for i in range(480, 505)]
    old = spark.createDataFrame([("g:b", "g", "b", True, "a", "a", "", 2, "", [], held)], "board_key string, ats string, board_token string, active boolean, first_seen string, last_seen string, last_polled string, failure_count long, last_error string, sample_urls array<string>, sample_job_ids array<string>")
    for n in (10, 490, 500, 520, 600):
        refs = spark.range(n).select(F.lit("g:b").alias("board_key"), F.lit("g").alias("ats"), F.lit("b").alias("board_token"), F.lpad(F.col("id").cast("string"), 4, "0").alias("job_id")).withColumn("url", F.concat(F.lit("u"), "job_id"))
        want = list(held)
        for i in range(n):
            if f"{i:04d}" not in want:
                want = (want + [f"{i:04d}"])[-25:]
        got = jobs.merged_boards(old, refs, "b").first()
        assert got.sample_job_ids == want and got.failure_count == 2 and len(got.sample_urls) == 5


def test_polls(store, spark):
    jobs.refresh_registry(store, boards(spark, "https://jobs.lever.co/a/1", "https://jobs.lever.co/b/1"), at=AT, run_id="r")
    polls = spark.createDataFrame([("lever:a", False, "HTTP 500"), ("lever:b", True, None), ("lever:gone", True, None)], "board_key string, ok boolean, error string")
    for most, active in ((2, True), (2, False)):
        store.commit({"board_registry": jobs.polled_boards(store.read("board_registry"), polls, at=LATER, most_failures=most)})
        assert store.read("board_registry").where("board_key = 'lever:a'").first().active is active
    assert [r.board_key for r in jobs.boards_to_poll(store, seed="s", most=5).collect()] == ["lever:b"]


def test_discovery_and_digest(store, spark):
    out = jobs.discover(store, bodies(spark, *JOBS), conditions=CONDITIONS, now=AT, run_id="d1", settings=SETTINGS)
    assert (out["city"], out["evaluated"], out["candidates"], out["included"]) == (4, 2, 2, 1)
    state = {r.stable_key: r for r in store.read("evaluated_jobs").collect()}
    assert state["s1:2"].status == "included" and state["s1:1"].rejection_reason == "not_selected" and state["s1:1"].job.description_text == ""
    assert "condition:policy_ai" in state["s1:2"].job.tags
    monday = "2026-06-22T09:00:00+00:00"
    view = jobs.weekly_digest(store, now=monday, run_id="w1", settings=SETTINGS, recipients=["x"])
    assert view["status"] == "preview" and view["selected"] == 1 and "1. CoolCo - Public policy and venture strategy" in view["message"]
    assert store.read("sent_jobs").count() == 0

    def failing(recipient, message):
        raise OSError

    send = dict(now=monday, settings=SETTINGS, recipients=["x"], dry_run=False)
    assert jobs.weekly_digest(store, run_id="w2", send=failing, **send)["status"] == "send_failed" and store.read("sent_weeks").count() == 0
    assert jobs.weekly_digest(store, run_id="w3", **send)["status"] == "sent" and store.read("seen_jobs").count() == 1
    assert jobs.weekly_digest(store, run_id="w4", **send)["status"] == "already_sent"
    assert jobs.weekly_digest(store, run_id="w5", **(send | {"now": LATER}))["status"] == "outside_send_window"
    assert jobs.weekly_digest(store, run_id="w6", force=True, now=monday, settings=SETTINGS, recipients=["x"])["selected"] == 0


def test_discovery_fetches_details_of_changed_postings_only(store, spark):
    asked = []

    def details(rows):
        found = [(r.source_id, r.external_id) for r in rows.collect()]
        asked.append(sorted(i for _, i in found))
        made = [(s, i, "CoolCo", json.dumps(posting(i, "Policy analyst", "Beijing", "At least 8 years of experience"))) for s, i in found]
        return spark.createDataFrame(made, "source_id string, external_id string, company string, body string")

    run = dict(conditions=CONDITIONS, now=AT, settings=SETTINGS, details=details)
    index = bodies(spark, posting(1, "Policy analyst", "Beijing"), posting(6, "Painter", "Dubai"))
    jobs.discover(store, index, run_id="d1", **run)
    assert asked == [["1", "6"]] and {r.rejection_reason for r in store.read("evaluated_jobs").collect()} == {"conditions_filter:years_experience"}
    jobs.discover(store, index, run_id="d2", **run)
    jobs.discover(store, index, run_id="d3", force=True, **run)
    assert asked[1:] == [[], ["1", "6"]]


def test_ranking_by_a_model_and_its_fallback(spark):
    rows = jobs.normalize(jobs.payloads.greenhouse(bodies(spark, *JOBS).where("adapter = 'greenhouse'")), fetched_at=AT)
    said = '```json {"opportunities": [{"key": "s1:4", "score": 90, "include": true, "why_cool": " fine "}, {"key": "s1:4", "score": 10}, {"key": "no", "score": 99, "include": true}, {"key": "s1:1", "score": 75, "include": false}]}```'
    got = ranking.rank(rows, least=2, most=5, model=lambda shown: said)
    assert [(r.stable_key, r.filled, r.why_cool) for r in got.rows.orderBy("rank").collect()] == [("s1:4", False, "fine"), ("s1:1", True, "")]
    assert ranking.rank(rows, least=0, most=5, model=lambda shown: "sorry").error == "ranker_fallback:ValueError"
    none = ranking.rank(rows, least=0, most=5, model=lambda shown: 1 / 0, fall_back=False)
    assert none.error == "ranker_failed:ZeroDivisionError" and none.rows.count() == 0


def test_fetch(spark):
    class Board(BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/ok": 200, "/same": 304}.get(self.path, 500)
            self.send_response(code)
            self.send_header("ETag", self.headers.get("If-None-Match", "new"))
            self.end_headers()
            if code != 304:
                self.wfile.write(b"caf\xc3\xa9\xff")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Board)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [("a", "lever", "c", base + "/ok", None), ("b", "lever", "c", base + "/same", {"If-None-Match": "e1"}), ("c", "lever", "c", base + "/bad", None), ("d", "lever", "c", None, None), ("e", "lever", "c", "http://127.0.0.1:1/x", None)]
    got = {r.source_id: r for r in fetch_bodies(spark.createDataFrame(rows, "source_id string, adapter string, company string, url string, headers map<string,string>")).collect()}
    server.shutdown()
    assert (got["a"].status, got["a"].body, got["a"].ok) == (200, "café�", True)
    assert (got["b"].status, got["b"].body, got["b"].ok, got["b"].headers["etag"]) == (304, "", True, "e1")
    assert not got["c"].ok and got["c"].error.startswith("HTTP 500: caf") and got["d"].error == "no url" and got["e"].error == "URLError"


def test_settings(tmp_path):
    env = {"SIEVE_HOUR": "7"}
    (tmp_path / ".env").write_text("﻿# note\nSIEVE_HOUR=8\nSIEVE_CITIES='nyc, Sydney'\nSIEVE_REMOTE_OK=\"yes\"\nbroken\n", "utf-8")
    load_env(tmp_path / ".env", env)
    load_env(tmp_path / "absent", env)
    got = Settings.of(env)
    assert (got.hour, got.cities, got.remote_ok, got.most_jobs) == (7, ("New York", "Sydney"), True, 30)
    assert flag({}, "x", True) and not flag({"x": "off"}, "x", True) and listed({"x": "a, ,b"}, "x") == ["a", "b"]
    (tmp_path / "c.json").write_text("﻿{\"a\": 1}", "utf-8")
    assert load_json(None, tmp_path / "none.json", tmp_path / "c.json") == {"a": 1}
    with pytest.raises(FileNotFoundError):
        load_json(tmp_path / "none.json")


def test_stream_of_files_upserts(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"url": "https://jobs.lever.co/a/1"}\n')
    run = lambda: run_available(spark, f"file://{tmp_path}/in", "url string", f"file://{tmp_path}/cp", lambda df, n: jobs.refresh_registry(store, df, at=AT, run_id=f"batch-{n}"))
    run()
    (tmp_path / "in/b.json").write_text('{"url": "https://jobs.lever.co/b/1"}\n')
    run()
    run()
    assert sorted(r.board_key for r in store.read("board_registry").collect()) == ["lever:a", "lever:b"] and store.read("runs").count() == 2


def test_empty_digest():
    text = delivery.digest_text([], week="w", trend="", greeting="Hi", sign_off="Bye")
    assert text == "Hi\n\nNo new roles matched the criteria for the week of w.\n\nBye"
