"""The three jobs over the shared state: refresh the board registry, evaluate postings, send the weekly digest."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions import dates, text, urls
from sieve.functions.vocabulary import ACRONYMS, THEMES
from sieve.operators import delivery, relational
from sieve.operators.postings import normalize  # noqa: F401  part of this module's interface
from sieve.operators.source_rules import source_id
from sieve.plans.discovery import discover, polled_boards  # noqa: F401  both are part of this module's interface
from sieve.plans.shared import last_runs, run_row, staged, state_rows
from sieve.settings import Settings
from sieve.sources import listing, payloads
from sieve.sources.fetch import fetch_bodies, get
from sieve.sources.store import TABLES, StateStore

MOST_URLS, MOST_IDS = 5, 25
BOARDS = ("greenhouse", "lever", "ashby")
# Fixed value: characters of a description that the trend of a digest is read from.
TREND_CHARS = 600


def posting_refs(records: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(url) -> the first record of each posting by URL: (ref_key, board_key, ats, board_token, job_id, url)."""
    refs = records.select("url", urls.posting_ref(F.col("url"), excluded).alias("r")).where("r IS NOT NULL").select("url", "r.*")
    refs = refs.withColumns({"board_key": F.concat_ws(":", "ats", "board_token"), "ref_key": F.concat_ws(":", "ats", "board_token", "job_id")})
    return relational.first_wins(refs, ["ref_key"], ["url"])


def merged_boards(old: DataFrame, refs: DataFrame, at: str) -> DataFrame:
    """Boards of the refs with what the registry knows of them.

    A board's refs are distinct, so the last 3 * MOST_IDS of them give the same bounded lists as all of them would:
    within the first two thirds every value held before is evicted.  No board is gathered beyond that.
    """
    last = relational.first_n(refs, "board_key", [F.desc("url")], 3 * MOST_IDS)
    new = last.groupBy("board_key").agg(F.min("ats").alias("_ats"), F.min("board_token").alias("_token"), F.array_sort(F.collect_list(F.struct("url", "job_id"))).alias("_refs"))
    rows, none = new.join(old, "board_key", "left"), F.array().cast("array<string>")

    def grown(column: str, part: str, most: int):
        return relational.bounded_fifo(F.transform("_refs", lambda r: r[part]), most, F.coalesce(column, none)).alias(column)

    return rows.select(
        "board_key", F.col("_ats").alias("ats"), F.col("_token").alias("board_token"), F.lit(True).alias("active"), F.coalesce("first_seen", F.lit(at)).alias("first_seen"), F.lit(at).alias("last_seen"), text.blank(F.col("last_polled")).alias("last_polled"),
        F.coalesce("failure_count", F.lit(0).cast("long")).alias("failure_count"), text.blank(F.col("last_error")).alias("last_error"), grown("sample_urls", "url", MOST_URLS), grown("sample_job_ids", "job_id", MOST_IDS),
    )


def board_counts(refs: DataFrame, old: DataFrame) -> DataFrame:
    """One row: refs accepted, boards added, and refs of boards known by then, those added in the batch included."""
    boards = relational.attach(refs.groupBy("board_key").agg(F.count("*").alias("n")), old.select("board_key"), "board_key", "known")
    found = boards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.count_if(~F.col("known")).alias("added"))
    return found.withColumn("updated", F.col("accepted") - F.col("added"))


def refresh_registry(store: StateStore, records: DataFrame, *, at: str, run_id: str, excluded: list[str] = (), write: bool = True) -> dict[str, int]:
    """Boards found in crawl records enter the registry.  Counters: raw, accepted, rejected, added, updated.

    An empty table of records changes nothing but the history.
    """
    refs, old = posting_refs(records, excluded), store.read("board_registry")
    raw = records.agg(F.count("*").alias("raw"), F.count_if(urls.posting_ref(F.col("url"), excluded).isNull()).alias("rejected")).first()
    out = {"raw": raw.raw, "rejected": raw.rejected, **board_counts(refs, old).first().asDict()}
    if write:
        changed = {"board_registry": state_rows(merged_boards(old, refs, at), "board_registry"), "runs": run_row(store, run_id, "registry", at, out)}
        store.commit(changed, {"runs": last_runs})
    return out


def refresh_from(store: StateStore, config: dict, *, at: str, run_id: str, conditions: dict | None = None, getter=get, env: dict[str, str] | None = None, write: bool = True) -> dict:
    """Asks the configured providers for posting URLs and refreshes the registry with them.

    ``ok`` is false only if there were errors and no ref was accepted.
    """
    records, errors = listing.found_urls(store.spark, config, conditions, getter, env, lambda df: staged(store, df))
    out = refresh_registry(store, staged(store, records), at=at, run_id=run_id, excluded=[str(d) for d in config.get("exclude_domains") or []], write=write)
    return out | {"provider": config.get("provider") or listing.CRAWL, "errors": errors, "ok": not errors or out["accepted"] > 0}


def poll(store: StateStore, sources: list[dict], *, getter=get, boards: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Answers of the enabled sources and of registry boards (as ``boards_to_poll`` gives them), written once.

    (source_id, adapter, company, board_key, url, status, body, ok, error, elapsed_ms, etag, last_modified).  Requests are conditional on
    what the state knows of the last answer, unless ``force``; a 304 is an answer without postings.  Inline and file
    rows (adapter ``fixture``) are answers too.
    """
    spark, asked, given = store.spark, [], []
    for s in sources:
        if not s.get("enabled", True):
            continue
        name, adapter = source_id(s), str(s.get("adapter") or "").strip().lower()
        company = str(s.get("company") or s.get("name") or name)
        if adapter == "fixture":
            try:
                body, error = json.dumps({"jobs": s["jobs"] or []}) if "jobs" in s else Path(str(s["fixture_path"])).read_text("utf-8-sig") if s.get("fixture_path") else "", ""
            except OSError as e:  # one missing file must not fail the others
                body, error = "", type(e).__name__
            given.append((name, adapter, company, body, error))
        else:
            asked.append((name, adapter, company, str(s.get("url") or "").strip(), str(s.get("board_token") or "")))
    rows = spark.createDataFrame(asked, "source_id string, adapter string, company string, url string, token string")
    known = F.col("adapter").isin(*BOARDS) & ((F.col("token") != "") | (F.col("url") != ""))
    url = F.when(F.col("url") != "", F.col("url")).when(known, urls.board_urls(F.col("adapter"), F.lower("token")))
    rows = rows.select("source_id", "adapter", "company", F.lit(None).cast("string").alias("board_key"), url.alias("url"))
    if boards is not None:
        rows = rows.unionByName(boards.select("source_id", "adapter", "company", "board_key", "url"))
    cache = store.read("source_cache").select("source_id", "etag", "last_modified")
    rows = staged(store, relational.first_wins(rows, ["source_id"], ["url"]).join(cache.limit(0) if force else cache, "source_id", "left"))
    answers = fetch_bodies(rows.withColumn("headers", payloads.conditional_headers(F.col("etag"), F.col("last_modified"))), getter)
    told = answers.join(rows.select("source_id", "board_key"), "source_id").select("source_id", "adapter", "company", "board_key", "url", "status", "body", "ok", "error", "elapsed_ms", *(text.blank(F.try_element_at("headers", F.lit(h))).alias(c) for h, c in (("etag", "etag"), ("last-modified", "last_modified"))))
    inline = spark.createDataFrame([(n, a, c, None, None, 200, b, not e, e, 0, "", "") for n, a, c, b, e in given], "source_id string, adapter string, company string, board_key string, url string, status int, body string, ok boolean, error string, elapsed_ms long, etag string, last_modified string")
    return staged(store, told.unionByName(inline))


def boards_to_poll(store: StateStore, *, seed: str, most: int) -> DataFrame:
    """Active boards as sources, the least recently polled first."""
    boards = store.read("board_registry").where("active AND board_token <> ''").where(F.col("ats").isin(*BOARDS))
    rows = relational.poll_spread(boards, "board_token", F.col("last_polled"), seed, most)
    return rows.select(F.concat_ws("-", F.lit("registry"), "ats", "board_token").alias("source_id"), F.col("ats").alias("adapter"), text.display_name(F.col("board_token"), ACRONYMS).alias("company"), "board_key", urls.board_urls(F.col("ats"), F.col("board_token")).alias("url"))


def report(counters: dict, rows: list[dict] = (), as_json: bool = False) -> tuple[str, int]:
    """(text, exit code) of a run: its counters as JSON or as lines, with up to ten chosen postings; 1 if no ranking was possible."""
    failed = str(counters.get("ranker_error", "")).startswith("ranker_failed")
    if as_json:
        return json.dumps({**counters, "included_jobs": list(rows)}, ensure_ascii=False, indent=2, sort_keys=True, default=str), int(failed)
    lines = [f"{k.replace('_', ' ').capitalize()}: {v if v not in ('', [], None) else 'none'}" for k, v in counters.items()]
    return "\n".join(lines + [f"- {r['company']} - {r['title']} ({r['city']}) score={round(r['score'])}" for r in list(rows)[:10]]), int(failed)


def digest_rows(store: StateStore, settings: Settings, include_sent: bool = False) -> list:
    """Included postings not sent yet, group by group, capped by company and in all: at most ``most_jobs`` rows reach the driver."""
    rows = store.read("evaluated_jobs").where("status = 'included'").select("stable_key", "score", "why_cool", "reason", "groups", "job.*")
    if not include_sent:
        rows = relational.without(rows, store.read("sent_jobs").select("stable_key"), "stable_key")
    company = F.coalesce(text.present(F.lower(F.trim("company"))), F.col("source_id"))
    best = relational.per_group_cap(rows, company, [F.desc("score"), F.desc("fetched_at"), F.asc("stable_key")], settings.most_per_company, settings.most_jobs)
    return delivery.in_groups(best).collect()


def _leading(spark, values: list[str], least: int, most: int) -> list[str]:
    rows = spark.createDataFrame(list(enumerate(values)), "at long, name string")
    return [r.name for r in relational.leading(rows, "name", "at", least, most).collect()]


def trend_of(spark, rows: list) -> str:
    """Sentence on the leading places and themes of the chosen rows (as ``digest_rows`` gives them), bounded by their cap."""

    def says(row, terms) -> bool:
        said = " ".join((str(row[c] or "")[:TREND_CHARS] if c == "description_text" else str(row[c] or "")) for c in ("company", "title", "department", "description_text", "why_cool", "reason")).lower()
        return any(re.search(text.pattern_of(t), said) for t in terms)

    cities = _leading(spark, [r["city"] for r in rows if r["city"]], 2, 3)
    themes = _leading(spark, [name for r in rows for name, terms in THEMES.items() if says(r, terms)], 3, 3) or [g.lower() for g in _leading(spark, [r["group"] for r in rows], 2, 2)]
    lists = spark.createDataFrame([(cities, themes)], "c array<string>, t array<string>")
    return lists.select(delivery.trend_sentence(F.col("c"), F.col("t")).alias("s")).first().s


def weekly_digest(store: StateStore, *, now: str, run_id: str, settings: Settings, recipients: list[str], send=delivery.dry_run, dry_run: bool = True, force: bool = False, greeting: str = "Hello,", sign_off: str = "Best") -> dict:
    """Builds and sends one digest a week.  The state changes only if every recipient got it and it was no dry run."""
    spark = store.spark
    clock = dates.parse_iso(F.lit(now))
    when = spark.range(1).select(dates.week_key(clock, settings.zone).alias("week"), dates.in_send_window(clock, settings.zone, settings.weekday, settings.hour).alias("due")).first()
    if not force and not dry_run and not when.due:
        return {"status": "outside_send_window", "week": when.week}
    if not force and store.read("sent_weeks").where(F.col("week_key") == when.week).head(1):
        return {"status": "already_sent", "week": when.week}
    rows = digest_rows(store, settings)
    week = spark.range(1).select(dates.week_range(dates.monday_of(F.lit(when.week))).alias("w")).first().w
    lines = [{"group": r["group"], "company": r["company"], "title": r["title"], "place": r["city"] or r["location_text"], "why": r["why_cool"] or r["reason"], "url": r["apply_url"] or r["canonical_url"]} for r in rows]
    message = delivery.digest_text(lines, week=week, trend=trend_of(spark, rows) if rows else "", greeting=greeting, sign_off=sign_off)
    out = {"status": "preview", "week": when.week, "selected": len(rows), "message": message}
    if dry_run or not (rows or settings.send_empty):
        return out
    results = delivery.send_all(recipients, message, send)
    if not delivery.all_sent(results):
        return out | {"status": "send_failed", "errors": [r.error for r in results if not r.ok]}
    changes = {"sent_weeks": spark.createDataFrame([(when.week, now, run_id)], TABLES["sent_weeks"][1]), "runs": run_row(store, run_id, "digest", now, {"selected": len(rows)})}
    if rows:
        changes["sent_jobs"] = spark.createDataFrame([(r["stable_key"], now, when.week, run_id, r["company"], r["title"], r["city"], r["canonical_url"]) for r in rows], TABLES["sent_jobs"][1])
        changes["seen_jobs"] = spark.createDataFrame([(r["stable_key"], now, r["company"], r["title"], r["city"], r["canonical_url"], r["content_hash"]) for r in rows], TABLES["seen_jobs"][1])
    store.commit(changes, {"runs": last_runs})
    return out | {"status": "sent"}
