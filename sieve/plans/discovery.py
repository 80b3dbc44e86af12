"""The discovery job: answers of boards in; every posting met is judged, ranked, and recorded with its outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions import dates, text
from sieve.operators import ranking, relational, rules
from sieve.operators.frontier import detail_frontier, detail_token, detail_url
from sieve.operators.postings import POSTING, normalize
from sieve.operators.source_rules import run_places, run_remote, source_rules, with_rules
from sieve.plans.shared import Changes, run_row, staged, state_rows
from sieve.settings import Settings
from sieve.sources import payloads
from sieve.sources.outcomes import read_outcomes
from sieve.sources.store import StateStore

PARSERS = {"greenhouse": payloads.greenhouse, "lever": payloads.lever, "ashby": payloads.ashby, "rss": payloads.rss_raw, "fixture": payloads.fixture, "html_static": payloads.html_raw}
#: What the reasons of a rejection by the conditions begin with, and the reason of one by the source's own filter.
BY_CONDITIONS, BY_SOURCE, UNGROUPED = "conditions_filter:", "hard_filter", "no_role_group"
_CARRIED = ("adapter", "most_details", "include", "exclude", "board_token", "url", "board")


def polled_boards(old: DataFrame, polls: DataFrame, *, at: str, most_failures: int) -> DataFrame:
    """Registry rows of polled boards (board_key, ok, error): success resets failures and revives, too many deactivate."""
    rows = old.join(polls.select("board_key", "ok", "error"), "board_key")
    n = F.when(F.col("ok"), F.lit(0)).otherwise(F.coalesce("failure_count", F.lit(0)) + 1).cast("long")
    active = F.when(F.col("ok"), F.lit(True)).otherwise(F.col("active") & (n < most_failures))
    return state_rows(rows.withColumns({"failure_count": n, "active": active, "last_polled": F.lit(at), "last_error": F.when(F.col("ok"), "").otherwise(F.coalesce(text.present(F.col("error")), F.lit("poll_failed")))}), "board_registry")


def raw_postings(bodies: DataFrame) -> DataFrame:
    """Raw postings of answers with rules, one branch an adapter however many sources there are."""
    out = None
    for adapter, parse in PARSERS.items():
        rows = parse(bodies.where(F.col("ok") & (F.col("adapter") == adapter)))
        out = rows if out is None else out.unionByName(rows)
    facts = bodies.select("source_id", "adapter", "_rules", "url", F.col("board_key").isNotNull().alias("board"))
    named = ("source_name", "cities", "remote", "most_rows", "most_details", "include", "exclude", "board_token")
    return out.join(facts, "source_id").select(*out.columns, "adapter", "url", "board", *(f"_rules.{c}" for c in named))


def judged(jobs: DataFrame, conditions: dict, now: Column) -> DataFrame:
    """Adds ``rejected`` (the first rule that rejects, or null), ``groups`` (ids of the role groups) and ``recent``."""
    metadata = text.haystack(*(F.col(c) for c in ("title", "company", "city", "location_text", "department", "employment_type", "posted_at")), F.array_join("tags", " "))
    full = F.concat_ws(" ", metadata, F.lower("description_text"))
    prefix = F.left("description_text", F.lit(int(conditions.get("role_description_chars") or 0)))
    role = text.haystack(F.col("title"), F.col("department"), F.col("employment_type"), F.array_join("tags", " "), prefix)
    age = dates.age_days(dates.parse_iso(F.col("posted_at")), now)
    groups = conditions.get("role_groups") or []
    reason = rules.rejection(age=age, title=F.col("title"), metadata=metadata, full=full, groups=F.col("_matched"), rules=conditions)
    recent = ~F.coalesce(reason, F.lit("")).isin("missing_posted_date", "not_recent")
    rows = jobs.withColumn("_matched", rules.matched_groups(role, groups))
    return rows.withColumns({"rejected": reason, "groups": F.transform("_matched", lambda g: g["id"]), "recent": recent}).drop("_matched")


def by_source(rows: DataFrame) -> Column:
    """Whether a posting passes its own source's filter: years, then kept-out, then asked-for keywords."""
    said = text.haystack(F.col("title"), F.col("company"), F.col("city"), F.col("location_text"), F.col("department"), F.col("employment_type"), F.left("description_text", F.lit(8000)), F.array_join("tags", " "))
    pattern = lambda c: F.coalesce(F.col(c), F.lit(""))
    out, wanted = (pattern("exclude") != "") & F.rlike(said, pattern("exclude")), (pattern("include") == "") | F.rlike(said, pattern("include"))
    return text.years_allowed(F.concat_ws(" ", said, F.col("description_text"))) & ~out & wanted


def source_results(bodies: DataFrame, met: DataFrame, accepted: DataFrame) -> DataFrame:
    """A row a source: ok, error, elapsed_ms, and the rows fetched and normalized (of a two-step board: accepted)."""
    counts = met.groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_if("kept").alias("kept"))
    passed = accepted.groupBy("source_id").agg(F.count("*").alias("passed"))
    rows = bodies.select("source_id", F.col("_rules.source_name").alias("source_name"), "adapter", "ok", "error", "elapsed_ms").join(counts, "source_id", "left").join(passed, "source_id", "left")
    normalized = F.when(F.col("adapter") == "greenhouse", F.col("passed")).otherwise(F.col("kept"))
    return rows.select("source_id", "source_name", "ok", "error", "elapsed_ms", F.coalesce("fetched", F.lit(0)).alias("fetched_count"), F.coalesce(normalized, F.lit(0)).alias("normalized_count"))


def _complete(bodies: DataFrame) -> DataFrame:
    """With the columns that only ``poll`` gives, null where they are missing."""
    kinds = {"board_key": "string", "url": "string", "elapsed_ms": "long", "etag": "string", "last_modified": "string"}
    return bodies.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in bodies.columns})


def discover(
    store: StateStore, bodies: DataFrame, *, conditions: dict, now: str, run_id: str, settings: Settings, details: Callable[[DataFrame], DataFrame] | None = None, most_details: int | None = None, force: bool = False, model=None,
    write: bool = True, sources: list[dict] = (), defaults: dict | None = None, most_failures: int = 3,
) -> dict:
    """Evaluates the postings of fetched boards (source_id, adapter, company, body) and records each one's outcome.

    * Answers that can't be read are failed polls.  ``sources`` and ``defaults`` are the configuration: places, limits,
      wrappers and keywords of each source.
    * Rows of two-step boards (greenhouse) that the list alone doesn't rule out, and that changed since they were last
      evaluated, make the detail frontier.  ``details`` gets the admitted ones (stable_key, source_id, external_id,
      company, url), each source's first few (``most_details`` for boards without a limit of their own), and returns
      their bodies (source_id, external_id, company, body); one without an answer is judged by the list.  The rest
      stays unrecorded for the next run.  Without ``details`` all are judged by the list.
    * Rejections, polls and the run are recorded in any case; candidates, and the cache that lets boards answer 304,
      only if the ranking didn't fail, so that a later run ranks them.  All of it is one version of the state.
    """
    spark, clock = store.spark, dates.parse_iso(F.lit(now))
    defaults = defaults or {}
    places, remote = run_places(conditions, defaults, settings), run_remote(conditions, defaults, settings)
    limits = {} if most_details is None else {"boards": (500, most_details)}
    bodies = staged(store, read_outcomes(with_rules(_complete(bodies), source_rules(spark, list(sources)), places=places, remote=remote, **limits)))
    raw = raw_postings(bodies)
    met = normalize(raw, fetched_at=now, cities=F.col("cities"), remote_ok=F.col("remote"), kept=F.col("pos") < F.col("most_rows"), keep=_CARRIED)
    met = staged(store, judged(met, conditions, clock))
    kept = met.where("kept")
    two_step, others = kept.where("adapter = 'greenhouse'"), kept.where("adapter <> 'greenhouse'")
    eligible = two_step.where(f"rejected IS NULL OR rejected = '{UNGROUPED}'")
    if not force:
        old = store.read("evaluated_jobs").where(f"source_updated_at <> '' AND NOT coalesce(rejection_reason, '') LIKE '%{UNGROUPED}'").select(F.col("stable_key").alias("_key"), F.col("source_updated_at").alias("_at"))
        eligible = relational.without(eligible, old, F.expr("stable_key = _key AND source_updated_at = _at"))
    left = 0
    if details is not None:
        frontier = staged(store, detail_frontier(relational.first_wins(eligible, ["stable_key"], ["source_id", "pos"]), "most_details", ["pos"]))
        left = frontier.where("NOT admitted").count()
        eligible = _with_details(store, frontier.where("admitted"), details, conditions, clock, now, bodies)
    rows = relational.first_wins(others.unionByName(eligible.select(*others.columns)), ["stable_key"], ["board", "source_id", "pos"])
    rows = staged(store, rows.withColumn("_passes", by_source(rows)).drop("include", "exclude"))
    good = rows.where("rejected IS NULL AND _passes").withColumn("tags", rules.tagged(F.col("tags"), F.col("groups")))
    ruled = rows.where("rejected IS NOT NULL OR NOT _passes").withColumn("why", F.when(F.col("rejected").isNull(), BY_SOURCE).otherwise(F.concat(F.lit(BY_CONDITIONS), "rejected")))
    ranked = ranking.rank(good, least=settings.least_jobs, most=settings.most_jobs, model=model, fall_back=settings.rank_without_model, stage=lambda df: staged(store, df))
    failed = ranked.error.startswith("ranker_failed")
    chosen = ranked.rows.select("stable_key", "score", "reason", "why_cool", "risk_flags")
    entries = staged(store, _entries(relational.attach(good.withColumn("why", F.lit(None).cast("string")).unionByName(ruled), chosen, "stable_key", "_on"), run_id, dates.week_key(clock, settings.zone), now))
    by_rule = entries.where(f"rejection_reason LIKE '{BY_CONDITIONS}%' OR rejection_reason = '{BY_SOURCE}'")
    out = _counters(bodies, met, rows, good, entries, by_rule if failed else entries) | {"left_for_next_run": left, "ranker_error": ranked.error}
    out["errors"] = [f"source_failed:{r['source_id']}:{r['error']}" for r in out["source_results"] if not r["ok"]] + [e for e in (ranked.error,) if e]
    if write:
        changes = Changes({"runs": run_row(store, run_id, "discovery", now, out), "evaluated_jobs": by_rule}, {"evaluated_jobs": relational.without(entries, by_rule.select("stable_key"), "stable_key")})
        if out["boards_polled"]:
            changes.sure["board_registry"] = staged(store, polled_boards(store.read("board_registry"), bodies.where("board_key IS NOT NULL"), at=now, most_failures=most_failures))
        cache = bodies.where("ok AND (etag <> '' OR last_modified <> '')").select("source_id", "etag", "last_modified")
        changes.pending["source_cache"] = cache
        changes.commit(store, succeeded=not failed)
    return out


def _with_details(store, asked, details, conditions, clock, now, bodies) -> DataFrame:
    """Admitted rows as their details say; one whose detail names another place goes, one without a detail stays as it is."""
    told = asked.withColumn("url", detail_url(detail_token(F.col("board_token"), F.col("url")), F.col("external_id"))).select("stable_key", "source_id", "external_id", "company", "url")
    got = details(told)
    read = read_outcomes(got.join(bodies.select("source_id", F.lit("greenhouse").alias("adapter"), "_rules"), "source_id")).where("ok")
    first = payloads.greenhouse(read).where("pos = 0")
    # one row a posting asked for; what belongs to its source comes from its row of the list
    first = staged(store, relational.first_wins(first, ["source_id", "external_id"], ["pos"]))
    same = asked.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"), F.col("source_updated_at").alias("_at"), F.col("pos").alias("_pos"), *_CARRIED)
    rows = first.join(same, F.expr("source_id = _s AND external_id = _e")).drop("_s", "_e", "pos").withColumnRenamed("_pos", "pos")
    rows = rows.join(bodies.select("source_id", "_rules.cities", "_rules.remote", "_rules.source_name"), "source_id")
    full = normalize(rows, fetched_at=now, cities=F.col("cities"), remote_ok=F.col("remote"), kept=F.lit(True), keep=(*_CARRIED, "_at")).where("kept")
    full = full.withColumn("source_updated_at", F.coalesce(text.present(F.col("source_updated_at")), F.col("_at"))).drop("_at")
    unanswered = asked.join(first.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    return unanswered.select(*full.columns, "rejected", "groups", "recent").unionByName(judged(full, conditions, clock))


def _entries(rows: DataFrame, run_id: str, week: Column, now: str) -> DataFrame:
    """Rows (with ``_on``: chosen, and ``why``: the rule that kept a row out, or null) as the state records them."""
    on, why = F.col("_on"), F.col("why")
    # a candidate, and any row of a one-step source, is known by when it was posted
    updated = F.when((F.col("adapter") == "greenhouse") & why.isNotNull(), F.col("source_updated_at")).otherwise(F.col("posted_at"))
    return rows.withColumn("description_text", F.when(on, F.col("description_text")).otherwise("")).select(
        "stable_key", F.when(on, "included").otherwise("rejected").alias("status"), F.lit(run_id).alias("run_id"), week.alias("week_key"), F.lit(now).alias("evaluated_at"), updated.alias("source_updated_at"), F.coalesce("score", F.lit(0.0)).alias("score"),
        text.blank(F.col("reason")).alias("reason"), text.blank(F.col("why_cool")).alias("why_cool"), F.coalesce("risk_flags", ranking.no_flags()).alias("risk_flags"), F.coalesce(why, F.when(on, "").otherwise("not_selected")).alias("rejection_reason"), "groups", F.struct(*POSTING).alias("job"),
    )


def _counters(bodies: DataFrame, met: DataFrame, rows: DataFrame, good: DataFrame, entries: DataFrame, recorded: DataFrame) -> dict:
    """Counts of a run, from what was staged on the way; a row a source and a role group reach the driver."""
    places = met.agg(F.count_if("kept").alias("city"), F.count_if(F.expr("kept AND recent")).alias("recent")).first()
    n = entries.agg(F.count("*").alias("evaluated"), F.count_if(F.col("status") == "included").alias("included")).first()
    candidates, held = good.count(), recorded.agg(F.count_if(F.col("status") == "rejected").alias("n")).first().n
    boards = bodies.where("board_key IS NOT NULL").count()
    groups = good.select(F.explode("groups").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").collect()
    results = [r.asDict() for r in source_results(bodies, met, good).orderBy("source_id").collect()]
    return {
        "city": places.city, "recent": places.recent, "evaluated": n.evaluated, "condition_candidates": rows.where("rejected IS NULL").count(), "candidates": candidates, "included": n.included, "rejected": held,
        "boards_polled": boards, "role_group_counts": {r.g: r["count"] for r in groups}, "source_results": results,
    }
