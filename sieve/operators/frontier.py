"""The frontier of detail requests: which postings are worth a second request, and which of them a run may ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.text import present
from sieve.functions.urls import GREENHOUSE_API, path_parts
from sieve.sources.fetch import fetch_bodies, get


def detail_token(token: Column, url: Column) -> Column:
    """A board's token as configured, else from its address; null if neither has one."""
    parts = path_parts(url)
    listed = F.regexp_extract(F.array_join(parts, "/"), "(?:^|/)boards/([^/]+)/jobs(?:/|$)", 1)
    return F.coalesce(present(F.trim(token)), present(listed), F.when(F.lower(url).rlike(r"^https?://[^/]*greenhouse\.io/"), F.get(parts, F.lit(0))))


def detail_url(token: Column, external_id: Column) -> Column:
    """Address of one posting of a board that gives its text apart from its list."""
    return F.concat(F.lit(f"https://{GREENHOUSE_API}/v1/boards/"), token, F.lit("/jobs/"), external_id)


def detail_frontier(eligible: DataFrame, most: Column | str, order: list[Column | str]) -> DataFrame:
    """``eligible`` (source_id, ...) with ``place`` in its source and ``admitted``: whether this run asks for it.

    The rest stays unrecorded, so that the next run meets it again.  A window a source: a board's rows meet in a task,
    and these are as many as a run reads of a board.
    """
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    return eligible.withColumn("place", place).withColumn("admitted", F.col("place") <= (F.col(most) if isinstance(most, str) else most))


def fetch_details(getter: Callable = get) -> Callable[[DataFrame], DataFrame]:
    """A function from admitted rows (stable_key, source_id, external_id, company, url) to their answers.

    An answer has the row's source_id, external_id, company, and body, ok and error.  A retried task asks again.
    """

    def ask(rows: DataFrame) -> DataFrame:
        requests = rows.select(F.col("stable_key").alias("source_id"), F.lit("greenhouse").alias("adapter"), "company", "url", F.lit(None).cast("map<string,string>").alias("headers"))
        told = fetch_bodies(requests, getter).select(F.col("source_id").alias("stable_key"), "body", "ok", "error")
        return rows.select("stable_key", "source_id", "external_id", "company").join(told, "stable_key")

    return ask
