"""What is configured of each source, as a relation: a row a source, joined to bodies and postings.

A plan is the same for one source as for thousands.  Sources that nothing is configured of, such as boards of the
registry, take the fallbacks that ``with_rules`` gives them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions.places import canonical_places
from sieve.functions.text import pattern_of, present
from sieve.settings import Settings

# Postings read of a source (of a board, too), and details asked of a source and of a board in a run.
MOST_ROWS, MOST_BOARD_ROWS, MOST_DETAILS, MOST_BOARD_DETAILS = 250, 500, 25, 12
WRAPPER_FIELDS = ("id", "title", "company", "location", "url", "description")
SCHEMA = (
    "source_id string, adapter string, source_name string, company string, board_token string, cities array<string>, remote boolean, most_rows int, most_details int, include string, exclude string, "
    "item_regex string, wrapper_error string, " + ", ".join(f"{f}_regex string" for f in WRAPPER_FIELDS)
)


def source_id(source: dict) -> str:
    return str(source.get("id") or source.get("name") or "source").strip()


def _pattern(words) -> str:
    return "|".join(pattern_of(str(w)) for w in words or [] if str(w).split())


def _wrapper(spark: SparkSession, source: dict) -> tuple[str | None, str, list[str | None]]:
    """(item pattern, error, field patterns): patterns that neither language compiles, or without a group, are an error."""
    item, fields = str(source.get("item_regex") or ""), [str(source[f"{f}_regex"]) if source.get(f"{f}_regex") else None for f in WRAPPER_FIELDS]
    if not item:
        return None, "ValueError", [None] * len(fields)
    java = [p and p.replace("(?P<", "(?<").replace("(?P=", "\\k<") for p in (item, *fields)]
    try:
        for p in filter(None, java):
            spark._jvm.java.util.regex.Pattern.compile(p)
        if any(re.compile(p, re.I | re.S).groups < 1 for p in filter(None, fields)):
            return None, "IndexError", [None] * len(fields)
    except Exception as e:  # noqa: BLE001  a source with a broken pattern fails, the others don't
        return None, type(e).__name__, [None] * len(fields)
    return java[0], "", java[1:]


def source_rules(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A row a configured source, the last of equal ids; cities empty where a source names none."""
    rows = {}
    for s in sources:
        name, adapter = source_id(s), str(s.get("adapter") or "").strip().lower()
        item, error, fields = _wrapper(spark, s) if adapter == "html_static" else (None, "", [None] * len(WRAPPER_FIELDS))
        most = int(s.get("max_jobs_per_source", MOST_BOARD_ROWS if adapter == "greenhouse" else MOST_ROWS))
        details = int(s.get("max_detail_fetches", s.get("max_jobs_per_source", MOST_DETAILS)))
        cities = canonical_places([str(c) for c in s["cities"]]) if s.get("cities") else []
        remote = bool(s["allow_global_remote"]) if "allow_global_remote" in s else None
        rows[name] = (name, adapter, str(s.get("name") or name), str(s.get("company") or ""), str(s.get("board_token") or ""), cities, remote, most, details, _pattern(s.get("include_keywords")), _pattern(s.get("exclude_keywords")), item, error, *fields)
    return spark.createDataFrame(list(rows.values()), SCHEMA)


def target_places(wanted: Column, default: Column, otherwise: Column) -> Column:
    """Places of a run: those of the defaults that are wanted too; the defaults where they share none; either if one is empty."""
    both = F.array_intersect(default, wanted)
    shared = F.when(F.size(both) > 0, both).otherwise(default)
    return F.when((F.size(default) > 0) & (F.size(wanted) > 0), shared).when(F.size(default) > 0, default).when(F.size(wanted) > 0, wanted).otherwise(otherwise)


def _array(names) -> Column:
    return F.array(*(F.lit(n) for n in names)).cast("array<string>")


def run_places(conditions: dict, defaults: dict, settings: Settings) -> Column:
    named = [conditions.get("locations") or conditions.get("cities") or [], defaults.get("cities") or []]
    return target_places(*(_array(canonical_places([str(n) for n in x]) if x else []) for x in named), _array(settings.cities))


def run_remote(conditions: dict, defaults: dict, settings: Settings) -> bool:
    return bool(conditions.get("allow_global_remote", defaults.get("allow_global_remote", settings.remote_ok)))


def with_rules(rows: DataFrame, rules: DataFrame, *, places: Column, remote: bool, boards: tuple[int, int] = (MOST_BOARD_ROWS, MOST_BOARD_DETAILS)) -> DataFrame:
    """``rows`` (source_id, adapter, company, board_key, ...) with their source's rules, the run's own where it has none.

    ``_rules`` is a struct.  Boards of the registry, those with a key, are named by their kind and company.

    As many rows as sources are configured are broadcast, and these are a part of the configuration.
    """
    known = rules.select("source_id", F.struct(*(c for c in rules.columns if c not in ("source_id", "adapter"))).alias("_rules"))
    out = rows.join(F.broadcast(known), "source_id", "left")
    own = F.col("_rules")
    said = {
        "source_name": F.coalesce(present(own["source_name"]), F.when(F.col("board_key").isNotNull(), F.concat(F.lit("Discovered "), F.initcap("adapter"), F.lit(": "), "company")), F.col("source_id")), "cities": F.when(F.size(F.coalesce(own["cities"], _array([]))) > 0, own["cities"]).otherwise(places), "remote": F.coalesce(own["remote"], F.lit(remote)),
        "most_rows": F.coalesce(own["most_rows"], F.lit(boards[0])), "most_details": F.coalesce(own["most_details"], F.lit(boards[1])),
    }
    return out.withColumn("_rules", F.struct(*(v.alias(k) for k, v in said.items()), *(own[c].alias(c) for c in ("company", "board_token", "include", "exclude", "item_regex", "wrapper_error", *(f"{f}_regex" for f in WRAPPER_FIELDS)))))
