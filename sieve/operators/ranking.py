"""Selecting postings: by points, or by a model that is handed in, with the points as its fallback."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.text import blank, json_object
from sieve.operators.relational import first_wins, min_fill, top
from sieve.operators.rules import rationale, signal_score

THRESHOLD = 70
#: Postings shown to a model; its answer may name any posting.
SHOWN = 60
MOST_SHOWN_CHARS = 1200
_ANSWER = "struct<opportunities:array<struct<key:string,score:double,include:boolean,scholar_fit_reason:string,why_cool:string,risk_flags:array<string>>>>"


def no_flags():
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Ranked:
    """``rows``: the postings with score, include, reason, why_cool, risk_flags, filled and rank; ``error``: why a model wasn't used."""

    rows: DataFrame
    error: str = ""


def scored(jobs: DataFrame) -> DataFrame:
    """Adds points (uncapped), the capped score, include and the reason."""
    signals = signal_score(title=F.col("title"), company=F.col("company"), department=F.col("department"), employment=F.col("employment_type"), tags=F.array_join("tags", " "), description=F.col("description_text"), city=F.col("city"))
    rows = jobs.withColumn("_signals", signals).withColumns({"points": F.col("_signals.points"), "_why": F.col("_signals.reasons")}).drop("_signals")
    why = rationale(F.col("company"), F.col("city"), F.col("title"), F.col("_why"))
    return rows.withColumns({"score": F.least(F.lit(100.0), "points"), "include": F.col("points") >= THRESHOLD, "reason": why, "why_cool": why, "risk_flags": F.array(F.lit("deterministic_fallback"))}).drop("_why")


def _selected(rows: DataFrame, least: int, most: int) -> DataFrame:
    out = min_fill(rows, "score", "include", [F.asc("stable_key")], least, most, THRESHOLD)
    flags = F.when(F.col("filled"), F.array_append("risk_flags", F.lit("score_threshold_fill"))).otherwise(F.col("risk_flags"))
    return out.withColumn("risk_flags", flags)


def by_points(jobs: DataFrame, least: int, most: int, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``stage`` writes and rereads the scored rows, which the selection reads several times."""
    return _selected(stage(scored(jobs)), least, most)


def compact(**columns: Column | str) -> Column:
    """The columns as one JSON object in their order, the description cut to what a model is shown of it."""
    cut = {n: F.left(c, F.lit(MOST_SHOWN_CHARS)) if n == "description" else c for n, c in columns.items()}
    return F.to_json(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cut.items())))


def outcome(chosen: Column, rejected: Column) -> dict[str, Column]:
    """Status and reason of a posting that the ranking chose or not, and that a rule (or null) kept out before it."""
    why = F.when(rejected.isNotNull(), F.concat(F.lit("conditions_filter:"), rejected)).when(chosen, "").otherwise("not_selected")
    return {"status": F.when(chosen, "included").otherwise("rejected"), "rejection_reason": why}


def shown(jobs: DataFrame) -> list[str]:
    """The best postings by points as JSON, for a prompt; at most SHOWN rows reach the driver."""
    same = {c: c for c in ("title", "company", "city", "location_text", "department", "employment_type", "posted_at")}
    row = compact(key="stable_key", **same, tags=F.slice("tags", 1, 12), description=F.col("description_text"))
    best = top(scored(jobs), [F.desc("points"), F.asc("stable_key")], SHOWN)
    return [r.row for r in best.select(row.alias("row")).collect()]


# Fixed value: what a model is told to return.
ANSWER_SHAPE = '{"opportunities": [{"key": "exact candidate key", "score": 0, "include": true, "scholar_fit_reason": "short reason", "why_cool": "one concise digest-ready line", "risk_flags": []}]}'


def prompt(rows: list[str], criteria: str, least: int, most: int) -> list[dict[str, str]]:
    """Messages that ask a model for one answer per candidate; ``rows`` as ``shown`` gives them."""
    asked = f"Return JSON only.\n\nCriteria:\n{criteria}\n\nCandidates:\n[{', '.join(rows)}]\n\nReturn:\n{ANSWER_SHAPE}\n\n"
    aim = f"One row for every candidate key. Aim for {min(max(0, least), most)}-{most} included rows where enough candidates score {THRESHOLD} or more; include none below {THRESHOLD}."
    return [{"role": "system", "content": "You rank postings for a weekly digest. Return strict JSON only."}, {"role": "user", "content": asked + aim}]


class ChatError(RuntimeError):
    """A model's service didn't answer as agreed."""


def chat_model(url: str, key: str, model: str, criteria: str, least: int, most: int, timeout: float = 90, most_tokens: int = 8000) -> Callable[[list[str]], str]:
    """A ``model`` for ``rank``: posts the prompt to a chat-completion service and returns the first choice's text."""
    if not key.strip():
        raise ChatError("a key is required")

    def ask(rows: list[str]) -> str:
        body = {"model": model, "messages": prompt(rows, criteria, least, most), "temperature": 0.0, "max_tokens": most_tokens, "response_format": {"type": "json_object"}}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key.strip()}", "Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.loads(r.read().decode())["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            raise ChatError(f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:500]}") from e
        except (OSError, ValueError, LookupError, TypeError) as e:
            raise ChatError(f"{type(e).__name__}: {e}"[:500]) from e

    return ask


def answered(jobs: DataFrame, answer: str) -> DataFrame:
    """Postings that a model's answer names, with its scores; unknown keys go, the first of repeated ones stays."""
    spark = jobs.sparkSession
    said = spark.createDataFrame([(answer,)], "said string").select(json_object(F.col("said"), _ANSWER).alias("a"))
    rows = said.select(F.posexplode("a.opportunities").alias("at", "o")).where("o.key IS NOT NULL").select("at", "o.*")
    cut = {"scholar_fit_reason": "reason", "why_cool": "why_cool"}
    flags = F.filter(F.transform(F.coalesce("risk_flags", no_flags()), lambda f: F.left(F.trim(blank(f)), F.lit(120))), lambda f: f != "")
    rows = rows.select("at", F.col("key").alias("stable_key"), F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("include", F.lit(False)) & (F.col("score") >= THRESHOLD)).alias("include"), *(F.left(F.trim(blank(F.col(c))), F.lit(400)).alias(n) for c, n in cut.items()), flags.alias("risk_flags"))
    return jobs.join(F.broadcast(first_wins(rows, ["stable_key"], ["at"]).drop("at")), "stable_key")  # at most one answer of a model


def rank(jobs: DataFrame, *, least: int, most: int, model: Callable[[list[str]], str] | None = None, fall_back: bool = True, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> Ranked:
    """The model's choice; without a model or after its failure the points decide, or nothing is chosen."""
    if model is None:
        return Ranked(by_points(jobs, least, most, stage))
    try:
        said = model(shown(jobs))
        rows = answered(jobs, said)
        if not json_ok(jobs, said):
            raise ValueError("no opportunities in the answer")
    except Exception as e:  # noqa: BLE001  whatever a model's client raises, the policy is the same
        if fall_back:
            return Ranked(by_points(jobs, least, most, stage), f"ranker_fallback:{type(e).__name__}")
        return Ranked(by_points(jobs.limit(0), least, most), f"ranker_failed:{type(e).__name__}")
    return Ranked(_selected(rows, least, most))


def json_ok(jobs: DataFrame, answer: str) -> bool:
    said = jobs.sparkSession.createDataFrame([(answer,)], "said string").select(json_object(F.col("said"), _ANSWER).alias("a"))
    return said.where("a.opportunities IS NOT NULL").head(1) != []


def display_rank(rows: DataFrame, order: list) -> DataFrame:
    """1..n over rows that a cap has bounded already."""
    return rows.withColumn("display_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
