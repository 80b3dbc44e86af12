"""Places named in location texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.text import blank, has_keyword
from sieve.functions.vocabulary import ALIASES, PLACES, REMOTE_TERMS


def canonical_places(names: list[str]) -> list[str]:
    """Known places among the names; all of them if none is known."""
    found = {ALIASES[n.strip().lower()] for n in names if n and n.strip().lower() in ALIASES}
    return [p for p in PLACES if p in found] or list(PLACES)


def place_of(location: Column, allowed: list[str] | tuple[str, ...] | Column = PLACES) -> Column:
    """The place of the longest alias that occurs; "" if none does.  ``allowed`` may be an array, each row's own."""
    low = F.lower(blank(location))
    if isinstance(allowed, Column):
        longest = sorted(ALIASES, key=lambda a: -len(a))
        return F.coalesce(*(F.when(F.array_contains(allowed, ALIASES[a]) & has_keyword(low, a), F.lit(ALIASES[a])) for a in longest), F.lit(""))
    aliases = sorted((a for a in ALIASES if ALIASES[a] in allowed), key=lambda a: -len(a))
    return F.coalesce(*(F.when(has_keyword(low, a), F.lit(ALIASES[a])) for a in aliases), F.lit(""))


def is_remote(location: Column) -> Column:
    return F.lower(blank(location)).rlike("|".join(REMOTE_TERMS))


def place_gate(location: Column, allowed: list[str] | tuple[str, ...] | Column = PLACES, remote_ok: bool | Column = False) -> Column:
    """struct(allowed, city, remote); places and flag may be columns."""
    remote_ok = remote_ok if isinstance(remote_ok, Column) else F.lit(remote_ok)
    city, remote = place_of(location, allowed), is_remote(location)
    city = F.when(city != "", city).when(remote & remote_ok, "Remote").otherwise("")
    return F.struct((city != "").alias("allowed"), city.alias("city"), remote.alias("remote"))
