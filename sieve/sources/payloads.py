"""Parsers of board payloads: a table of bodies in, a table of raw postings out.

A body that can't be parsed gives no rows; nothing raises.  Fetching is the caller's: bodies may come from files, a
crawl, or a DataSource, so that the same parsers run over any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import blank, email, first_present, strip_html
from sieve.operators.relational import first_wins

RAW = ("external_id", "title", "company", "location", "canonical_url", "apply_url", "department", "employment_type", "posted_at", "updated_at", "created_at", "description_text", "salary_text", "tags")

_GREENHOUSE = "struct<id:string,title:string,absolute_url:string,location:struct<name:string>,first_published:string,published_at:string,updated_at:string,departments:array<struct<name:string>>,content:string>"
_LEVER = "struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:string,descriptionPlain:string,description:string,categories:struct<location:string,team:string,commitment:string>>"
_ASHBY = "struct<id:string,title:string,jobUrl:string,url:string,applyUrl:string,location:string,locationName:string,department:string,employmentType:string,publishedAt:string,createdAt:string,descriptionPlain:string,descriptionHtml:string,description:string>"


def without_mark(body: Column) -> Column:
    return F.regexp_replace(body, "^﻿", "")


def _items(df: DataFrame, body: str, kind: str, single: bool) -> DataFrame:
    """One row per element of {jobs: []} or of a bare list; of a lone object with an id too, if ``single``."""
    text = F.trim(without_mark(F.col(body)))
    listed = F.from_json(text, f"array<{kind}>")
    held = F.from_json(text, f"struct<jobs:array<{kind}>,id:string>")
    alone = F.when(held["id"].isNotNull(), F.array(F.from_json(text, kind))) if single else F.lit(None).cast(f"array<{kind}>")
    jobs = F.when(text.startswith("["), listed).otherwise(F.coalesce(held["jobs"], alone))
    return df.select("*", F.posexplode(F.filter(jobs, lambda j: j.isNotNull())).alias("pos", "job"))


def _raw(df: DataFrame, company: Column, fields: dict[str, Column]) -> DataFrame:
    none = F.lit(None).cast("string")
    tags = fields.pop("tags")
    return df.select("source_id", "pos", *(blank(fields.get(c, company if c == "company" else none)).alias(c) for c in RAW[:-1]), F.filter(tags, lambda t: blank(t) != "").alias("tags"))


def greenhouse(bodies: DataFrame) -> DataFrame:
    """(source_id, company, body) -> raw postings."""
    rows, j = _items(bodies, "body", _GREENHOUSE, True), lambda c: F.col(f"job.{c}")
    department = F.get(F.col("job.departments"), F.lit(0))["name"]
    return _raw(rows, F.col("company"), {"external_id": j("id"), "title": j("title"), "location": j("location.name"), "canonical_url": j("absolute_url"), "apply_url": j("absolute_url"), "department": department, "posted_at": first_present(j("first_published"), j("published_at")), "updated_at": j("updated_at"), "description_text": j("content"), "tags": F.array(department)})


def lever(bodies: DataFrame) -> DataFrame:
    rows, j = _items(bodies.where(F.trim(without_mark(F.col("body"))).startswith("[")), "body", _LEVER, False), lambda c: F.col(f"job.{c}")
    team, kind = j("categories.team"), j("categories.commitment")
    return _raw(rows, F.col("company"), {"external_id": j("id"), "title": j("text"), "location": j("categories.location"), "canonical_url": j("hostedUrl"), "apply_url": first_present(j("applyUrl"), j("hostedUrl")), "department": team, "employment_type": kind, "created_at": j("createdAt"), "description_text": first_present(j("descriptionPlain"), j("description")), "tags": F.array(team, kind)})


def ashby(bodies: DataFrame) -> DataFrame:
    rows, j = _items(bodies, "body", _ASHBY, False), lambda c: F.col(f"job.{c}")
    return _raw(rows, F.col("company"), {"external_id": j("id"), "title": j("title"), "location": first_present(j("location"), j("locationName")), "canonical_url": first_present(j("jobUrl"), j("url")), "apply_url": first_present(j("applyUrl"), j("jobUrl"), j("url")), "department": j("department"), "employment_type": j("employmentType"), "posted_at": first_present(j("publishedAt"), j("createdAt")), "description_text": first_present(j("descriptionPlain"), j("descriptionHtml"), j("description")), "tags": F.array(j("department"), j("employmentType"))})


def rss(bodies: DataFrame) -> DataFrame:
    """Items of feeds: (source_id, pos, external_id, title, link, description, published)."""
    kind = "struct<guid:string,link:string,title:string,description:string,pubDate:string>"
    items = F.regexp_extract_all("body", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))
    rows = bodies.select("source_id", F.posexplode(items).alias("pos", "xml")).select("source_id", "pos", F.from_xml("xml", kind).alias("i"))
    return rows.select("source_id", "pos", first_present(F.col("i.guid"), F.col("i.link"), F.col("i.title")).alias("external_id"), blank(F.col("i.title")).alias("title"), blank(F.col("i.link")).alias("link"), blank(F.col("i.description")).alias("description"), blank(F.col("i.pubDate")).alias("published"))


def html_items(bodies: DataFrame, item_regex: str, fields: dict[str, str], keep_item: bool = False) -> DataFrame:
    """User-defined wrapper: each match of the item regex, with group 1 of each field's regex in it."""
    if not item_regex:
        raise ValueError("item_regex is required")
    rows = bodies.select("source_id", F.posexplode(F.regexp_extract_all("body", F.lit("(?is)" + item_regex), F.lit(0))).alias("pos", "item"))
    return rows.select("source_id", "pos", *(F.regexp_extract("item", "(?is)" + p, 1).alias(c) for c, p in fields.items()), *["item"] * keep_item)


def crawl_records(bodies: DataFrame) -> DataFrame:
    """URLs of crawl-index answers: JSON lines (bad ones dropped), an array, {records: []} or one object."""
    kind = "struct<url:string,timestamp:string,status:string,mime:string>"
    text = F.trim(without_mark(F.col("body")))
    listed = F.from_json(text, f"array<{kind}>")
    held = F.from_json(text, f"struct<records:array<{kind}>>")["records"]
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.from_json(x, kind))
    found = F.when(text.startswith("["), listed).otherwise(F.coalesce(held, lines))
    return bodies.select("source_id", F.posexplode(F.filter(found, lambda r: r["url"].isNotNull())).alias("pos", "r")).select("source_id", "pos", "r.*")


def empty_answer(status: Column, detail: Column) -> Column:
    """A 404 that says there are no captures, or that the URL isn't there, is an empty result, not an error."""
    return (status == 404) & F.lower(blank(detail)).rlike("no captures|url not found")


def conditional_headers(etag: Column, modified: Column) -> Column:
    """Request headers from a cached answer's."""
    pairs = F.array(F.when(blank(etag) != "", F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v"))), F.when(blank(modified) != "", F.struct(F.lit("If-Modified-Since").alias("k"), modified.alias("v"))))
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


# Fixed value: the places that a feed's texts are searched for.
_RSS_PLACES = r"(?i)\b(Beijing|Dubai|Shenzhen|Shenzen|New York City|New York|NYC|San Francisco|SF|Sydney)\b"


def rss_raw(bodies: DataFrame) -> DataFrame:
    """Raw postings of feeds; the place is the first that title and description name."""
    items = rss(bodies).join(bodies.select("source_id", "company").distinct(), "source_id")
    place = F.regexp_extract(F.concat_ws(" ", "title", "description"), _RSS_PLACES, 1)
    none = F.array().cast("array<string>")
    return _raw(items, F.col("company"), {"external_id": F.col("external_id"), "title": F.col("title"), "location": place, "canonical_url": F.col("link"), "apply_url": F.col("link"), "posted_at": F.col("published"), "description_text": F.col("description"), "tags": none})


def html_raw(bodies: DataFrame) -> DataFrame:
    """Raw postings by configured wrappers: (source_id, company, body) with ``_rules``, whose patterns are each row's own.

    Each match of ``item_regex`` is an item, with group 1 of each ``<field>_regex`` in it; bodies without one have none.
    """
    items = F.expr("regexp_extract_all(body, concat('(?is)', _rules.item_regex), 0)")
    rows = bodies.where("_rules.item_regex IS NOT NULL").select("source_id", "company", "_rules", F.posexplode(items).alias("pos", "item"))
    names = ("id", "title", "company", "location", "url", "description")
    found = F.array(*(F.expr(f"regexp_extract(item, concat('(?is)', _rules.{n}_regex), 1)") for n in names))
    rows = rows.withColumn("_found", F.transform(found, lambda x: strip_html(x)))
    got = {n: F.get("_found", F.lit(k)) for k, n in enumerate(names)}
    none = F.array().cast("array<string>")
    return _raw(rows, first_present(F.col("_rules.company"), got["company"]), {"external_id": first_present(got["id"], got["url"], got["title"]), "title": got["title"], "location": got["location"], "canonical_url": got["url"], "apply_url": got["url"], "description_text": first_present(got["description"], F.col("item")), "tags": none})


# Other names that inline rows give their fields, in the order they are looked at.
_OTHER_NAMES = {"external_id": ("id",), "location": ("location_text",), "canonical_url": ("apply_url", "url"), "description_text": ("description", "content"), "department": ("team",), "employment_type": ("commitment",), "salary_text": ("salary",)}


def fixture(bodies: DataFrame) -> DataFrame:
    """Raw postings given as they are: {jobs: []} or a bare list of objects with the columns of RAW or their other names."""
    names = list(dict.fromkeys([*RAW[:-1], *(n for more in _OTHER_NAMES.values() for n in more)]))
    kind = "struct<" + ",".join(f"{c}:string" for c in names) + ",tags:array<string>>"
    rows = _items(bodies, "body", kind, False)
    fields = {c: first_present(*(F.col(f"job.{n}") for n in (c, *_OTHER_NAMES.get(c, ())))) for c in RAW[:-1]} | {"company": first_present(F.col("job.company"), F.col("company"))}
    return _raw(rows, F.col("company"), fields | {"tags": F.coalesce(F.col("job.tags"), F.array().cast("array<string>"))})


def recipients(rows: DataFrame, inactive: tuple[str, ...]) -> DataFrame:
    """(email) of a sheet's rows (at, cells), in order, each address once whatever its case, inactive ones left out.

    The first row is a header if it names an e-mail column; without one the first column holds the addresses.
    """
    head = rows.orderBy("at").limit(1).collect()
    names = [str(c or "").strip().lower().replace(" ", "_") for c in head[0]["cells"] or []] if head else []
    column = next((names.index(n) for n in ("email", "email_address", "address") if n in names), None)
    status = names.index("status") if column is not None and "status" in names else None
    cells = rows if column is None else rows.where(F.col("at") > F.lit(head[0]["at"]))
    said = F.lower(F.trim(blank(F.get("cells", F.lit(status))))) if status is not None else F.lit("")
    kept = cells.where(~said.isin(*inactive)).select("at", email(F.get("cells", F.lit(column or 0))).alias("email")).where("email <> ''").withColumn("low", F.lower("email"))
    return first_wins(kept, ["low"], ["at"]).orderBy("at").select("email")
