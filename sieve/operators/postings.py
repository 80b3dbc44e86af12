"""Raw postings to normalized ones, by one projection and one filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.dates import parse_date
from sieve.functions.places import PLACES, place_gate
from sieve.functions.text import clean_text, first_present, key_part, stable_hash, stable_key, strip_html

# The most characters of each column.
MOST_CHARS = {"source_id": 120, "source_name": 180, "external_id": 300, "title": 220, "company": 180, "location_text": 300, "canonical_url": 1200, "apply_url": 1200, "department": 180, "employment_type": 120, "salary_text": 240}
MOST_TAG_CHARS = 80
POSTING = ("source_id", "source_name", "external_id", "title", "company", "location_text", "city", "canonical_url", "apply_url", "remote", "department", "employment_type", "posted_at", "description_text", "tags", "salary_text", "content_hash", "fetched_at")


def normalize(raw: DataFrame, *, fetched_at: str, cities=PLACES, remote_ok=False, kept: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 18 columns of a posting, its stable_key, source_updated_at and pos; other places and unnamed rows go.

    ``cities`` and ``remote_ok`` may be columns, each row's own.  With ``kept``, a condition, all rows stay: ``kept`` says
    which are postings, and the others have no text.  Nulls become ""; columns of ``raw`` beyond those known and those of
    ``keep`` are left out.
    """
    have = set(raw.columns)

    def text(name: str, *sources: str):
        found = first_present(*(F.col(s) for s in sources if s in have)) if have & set(sources) else F.lit("")
        return clean_text(found, MOST_CHARS[name]).alias(name)

    gate = place_gate(F.col("location"), cities, remote_ok)
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: clean_text(t, MOST_TAG_CHARS)), lambda t: t != "")
    rows = raw.select(
        text("source_id", "source_id"), text("source_name", "source_name", "source_id"), text("external_id", "external_id", "canonical_url", "apply_url"), text("title", "title"), text("company", "company", "source_name"),
        text("location_text", "location"), gate.alias("gate"), text("canonical_url", "canonical_url", "apply_url"), text("apply_url", "apply_url", "canonical_url"), text("department", "department"),
        text("employment_type", "employment_type"), text("salary_text", "salary_text", "salary"), parse_date(first_present(F.col("posted_at"), F.col("created_at"))).alias("posted_at"),
        parse_date(first_present(F.col("updated_at"), F.col("posted_at"), F.col("created_at"))).alias("source_updated_at"), strip_html(F.col("description_text")).alias("description_text"), tags.alias("tags"), "pos", (F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))).alias("kept"), *(F.col(c).alias(f"_{c}") for c in keep),
    )
    rows = rows.withColumn("kept", F.expr("kept AND gate.allowed AND title <> '' AND company <> '' AND canonical_url <> ''"))
    rows = rows.where("kept") if kept is None else rows.withColumn("description_text", F.when(F.col("kept"), F.col("description_text")).otherwise(""))
    named = {c: F.col(c) for c in ("canonical_url", "company", "external_id", "location_text", "source_id", "title")}
    rows = rows.withColumns({"city": F.col("gate.city"), "remote": F.col("gate.remote"), "fetched_at": F.lit(fetched_at), "content_hash": stable_hash(description_text=F.left("description_text", F.lit(2000)), **named)})
    place = F.when(F.col("city") != "", F.col("city")).otherwise(F.col("location_text"))
    key = stable_key(F.col("source_id"), F.col("external_id"), F.col("canonical_url"), F.col("company"), F.col("title"), place)
    return rows.select(*POSTING, key.alias("stable_key"), "source_updated_at", "pos", *["kept"] * (kept is not None), *(F.col(f"_{c}").alias(c) for c in keep))


def detail_key(external_id):
    """What ties a detail answer to its row of the index."""
    return key_part(external_id)
