"""Rule cascade, role groups and deterministic scoring as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.text import any_keyword, blank, bound, haystack, keyword_hits, keyword_of, years_allowed
from sieve.functions.vocabulary import BRAND_TERMS, LOW_SIGNAL_TERMS, PLACES, SENIOR_TERMS, SIGNAL_TERMS


def _keys(terms: list[str]) -> Column:
    return F.array(*(F.lit(keyword_of(t)) for t in terms)).cast("array<string>")


def matched_groups(text: Column, groups: list[dict]) -> Column:
    """array of struct(id, label, terms) of the groups that lower-case text matches, in their order; none for null.

    A group matches with every term of ``include_all``, one of ``include_any`` if it has any, and none of
    ``exclude_any``; one without terms to include never does.  ``terms`` are those found.  The text is read once for
    all groups together.
    """
    kind = "array<struct<id:string,label:string,terms:array<string>>>"
    table, terms = [], []
    for g in groups:
        every, some, none = (list(g.get(k) or []) for k in ("include_all", "include_any", "exclude_any"))
        if not every and not some:
            continue
        terms += [*every, *some, *none]
        shown = [F.struct(F.lit(keyword_of(t)).alias("key"), F.lit(t).alias("term")) for t in [*every, *some]]
        columns = {"id": F.lit(g["id"]), "label": F.lit(g.get("label", g["id"])), "every": _keys(every), "some": _keys(some), "none": _keys(none), "shown": F.array(*shown)}
        table.append(F.struct(*(c.alias(n) for n, c in columns.items())))
    if not table:
        return F.array().cast(kind)

    def met(hits: Column) -> Column:
        ok = lambda g: (F.size(F.array_except(g["every"], hits)) == 0) & ((F.size(g["some"]) == 0) | F.arrays_overlap(g["some"], hits)) & ~F.arrays_overlap(g["none"], hits)
        found = lambda g: F.transform(F.filter(g["shown"], lambda t: F.array_contains(hits, t["key"])), lambda t: t["term"])
        return F.transform(F.filter(F.array(*table), ok), lambda g: F.struct(g["id"].alias("id"), g["label"].alias("label"), found(g).alias("terms")))

    return bound(keyword_hits(blank(text), terms), met)


def rejection(*, age: Column, title: Column, metadata: Column, full: Column, groups: Column, rules: dict) -> Column:
    """The first rule that rejects, or null; later rules aren't evaluated where an earlier one rejects.

    ``groups``: what ``matched_groups`` found in the text that roles are looked for in.
    """
    limit = rules.get("posted_within_days") or 0
    missing = F.lit(bool(limit > 0 and not rules.get("allow_missing_posted_date"))) & age.isNull()
    late = F.lit(limit > 0) & age.isNotNull() & ~((age >= -1) & (age <= limit))
    whole = rules.get("exclude_full_text_any") or rules.get("exclude_description_any") or []
    return (
        F.when(missing, "missing_posted_date")
        .when(late, "not_recent")
        .when(any_keyword(F.lower(blank(title)), rules.get("exclude_title_any") or []), "excluded_title_keyword")
        .when(any_keyword(metadata, rules.get("exclude_any") or []), "excluded_keyword")
        .when(any_keyword(full, whole), "excluded_full_text_keyword")
        .when(~years_allowed(full, rules.get("max_years_experience", 5)), "years_experience")
        .when(F.size(groups) == 0, "no_role_group")
    )


def source_allows(text: Column, full: Column, include: list[str], exclude: list[str], most_years: int = 5) -> Column:
    """Filter of one source: years, then excluded, then included keywords."""
    ok = years_allowed(full, most_years) & ~any_keyword(text, exclude)
    return ok & any_keyword(text, include) if include else ok


def _points(terms: dict[str, float], kind: str = "", sign: int = 1) -> Column:
    """Literal table (key, points, weak, reason) of terms; ``weak``: the points where only the context holds a term."""
    row = lambda t, p: F.struct(F.lit(t).alias("key"), F.lit(float(sign * p)).alias("points"), F.lit(max(4.0, p * 0.4)).alias("weak"), F.lit(kind + t).alias("reason"))
    return F.array(*(row(t, p) for t, p in terms.items()))


def _earned(table: Column, points: Callable[[Column], Column]) -> Column:
    """array of struct(points, reason): the table's rows with the points that ``points`` gives them, or null."""
    return F.transform(table, lambda t: F.struct(points(t).alias("points"), t["reason"].alias("reason")))


def signal_score(*, title: Column, company: Column, department: Column, employment: Column, tags: Column, description: Column, city: Column) -> Column:
    """struct(points, reasons), added up in the order of the tables so that doubles agree bit for bit.

    Title, role and context are each read once; the tables are literals that a lambda walks, so the code that a stage
    compiles doesn't grow with them.
    """
    role = haystack(title, department, employment, tags)
    context = haystack(company, F.left(blank(description), F.lit(900)))
    texts = F.struct(
        keyword_hits(role, SIGNAL_TERMS).alias("role"), keyword_hits(context, SIGNAL_TERMS).alias("near"), keyword_hits(F.lower(blank(title)), [*LOW_SIGNAL_TERMS, *SENIOR_TERMS]).alias("title"),
        F.lower(blank(company)).alias("company"), context.alias("context"),
    )

    def earned(x: Column) -> Column:
        holds = lambda hits: lambda t: F.when(F.array_contains(x[hits], t["key"]), t["points"])
        signals = _earned(_points(SIGNAL_TERMS), lambda t: F.when(F.array_contains(x["role"], t["key"]), t["points"]).when(F.array_contains(x["near"], t["key"]), t["weak"]))
        brands = _earned(_points(BRAND_TERMS), lambda t: F.when(brand_hit(x["company"], x["context"], t["key"]), t["points"]))
        minus = [_earned(_points(table, f"{mark}:", -1), holds("title")) for mark, table in (("low-signal", LOW_SIGNAL_TERMS), ("seniority", SENIOR_TERMS))]
        return F.filter(F.concat(signals, brands, *minus), lambda e: e["points"].isNotNull())

    place = F.when(blank(city).isin(*PLACES), 8.0).otherwise(0.0)
    total = lambda found: F.aggregate(found, F.lit(45.0), lambda a, e: a + e["points"]) + place
    return bound(bound(texts, earned), lambda found: F.struct(total(found).alias("points"), F.transform(found, lambda e: e["reason"]).alias("reasons")))


def brand_hit(company: Column, context: Column, term: Column | str) -> Column:
    """A brand occurs anywhere, inside words too, in lower-case texts."""
    return company.contains(term) | context.contains(term)


def tagged(tags: Column, groups: Column) -> Column:
    """The tags and, where they lack it, ``condition:`` with each role group's id."""
    return F.concat(tags, F.array_except(F.transform(groups, lambda g: F.concat(F.lit("condition:"), g)), tags))


def rationale(company: Column, city: Column, title: Column, reasons: Column) -> Column:
    head = F.concat(company, F.lit(" role in "), city, F.lit(": "), title)
    return F.when(F.size(reasons) > 0, F.concat(head, F.lit(" ("), F.array_join(F.slice(reasons, 1, 3), ", "), F.lit(")"))).otherwise(head)


def score_terms(text: Column, terms: dict[str, float], base: float = 0.0) -> Column:
    """Left-folded sum of the weights of the terms that lower-case text holds; ``base`` for null."""
    table = F.array(*(F.struct(F.lit(keyword_of(t)).alias("key"), F.lit(float(p)).alias("points")) for t, p in terms.items()))
    earned = lambda hits: F.aggregate(F.filter(table, lambda t: F.array_contains(hits, t["key"])), F.lit(float(base)), lambda a, t: a + t["points"])
    return bound(keyword_hits(blank(text), terms), earned)
