"""Digest text, message chunks, and sinks behind a protocol; live delivery stays outside the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.dates import iso
from sieve.functions.text import human_join, title_case
from sieve.functions.vocabulary import GROUPS, OTHER_GROUP

MOST_CHARS = 1500


def chunks(body: str, most: int = MOST_CHARS) -> list[str]:
    """Parts of at most ``most`` characters, cut at the last white space of the second half, else hard."""
    rest, out = body.strip(), []
    while len(rest) > most:
        cut = max(rest.rfind(mark, 0, most) for mark in ("\n\n", "\n", " "))
        cut = cut if cut >= most // 2 else most
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [*out, rest] if rest or not out else out


def split_messages(df: DataFrame, id_col: str, text_col: str, most: int = MOST_CHARS) -> DataFrame:
    """(id, chunk, text); an Arrow function, as each cut depends on the one before."""
    schema = pa.schema([(id_col, pa.int64()), ("chunk", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, c in enumerate(chunks(body or "", most))]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, chunk int, text string")


def group_ids(tags: Column) -> Column:
    """Ids of the role groups among a posting's tags, each once."""
    ids = F.transform(F.filter(tags, lambda x: x.startswith("condition:")), lambda x: F.trim(F.substring(x, len("condition:") + 1, 10_000)))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def group_label(ids: Column) -> Column:
    """Label of the first group in the groups' own order, else of the first id, in title case, else the rest's."""
    known = (F.when(F.array_contains(ids, key), label) for key, label in GROUPS.items())
    return F.coalesce(*known, title_case(F.replace(F.get(ids, F.lit(0)), F.lit("_"), F.lit(" "))), F.lit(OTHER_GROUP))


def group_place(label: Column) -> Column:
    """Place of a label in the groups' own order from 1; null for any other."""
    at = F.array_position(F.array(*map(F.lit, GROUPS.values())), label)
    return F.when(at > 0, at.cast("int"))


def in_groups(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranked rows with their ``group``, in order: groups in their own order, any others after them by their best row.

    The rows are those of one digest, so its windows see as few as its cap lets through.
    """
    named = rows.withColumn("group", group_label(F.col("groups")))
    best = F.min(rank).over(Window.partitionBy("group"))
    return named.withColumn("_best", best).orderBy(F.asc_nulls_last(group_place(F.col("group"))), "_best", rank).drop("_best")


def preview_title(now: Column, name: str = "Digest", zone: str = "UTC") -> Column:
    """``name`` preview 2026-06-20 09:30, as a clock in the zone shows it."""
    stamp = F.left(F.translate(iso(F.from_utc_timestamp(now, zone)), "T", " "), F.lit(16))
    return F.concat(F.lit(f"{name} preview "), stamp)


def trend_sentence(cities: Column, themes: Column) -> Column:
    """One of four sentences from the leading places and themes (arrays, empty where none leads)."""
    city = F.concat(F.lit("roles clustered around "), human_join(cities))
    theme = F.concat(F.lit("a noticeable tilt toward "), human_join(themes))
    head = F.lit("This week's list has ")
    return (
        F.when((F.size(cities) > 0) & (F.size(themes) > 0), F.concat(head, city, F.lit(", with "), theme, F.lit(".")))
        .when(F.size(cities) > 0, F.concat(head, city, F.lit(", with a broad mix of role types.")))
        .when(F.size(themes) > 0, F.concat(head, theme, F.lit(".")))
        .otherwise("This week's list is a mixed set of strategy, product, policy, investing, and frontier-tech roles.")
    )


@dataclass(frozen=True)
class Sent:
    recipient: str
    ok: bool
    error: str = ""


def dry_run(recipient: str, message: str) -> Sent:
    return Sent(recipient, True)


def send_all(recipients: list[str], message: str, send: Callable[[str, str], Sent] = dry_run) -> list[Sent]:
    """One result per recipient; a sender's exception is a failed result."""
    out = []
    for r in recipients:
        try:
            out.append(send(r, message))
        except Exception as e:  # noqa: BLE001  a failing recipient must not stop the others
            out.append(Sent(r, False, type(e).__name__))
    return out


def all_sent(results: list[Sent]) -> bool:
    return bool(results) and all(r.ok for r in results)


def missing_settings(settings: dict[str, str], needed: list[str]) -> list[str]:
    """Names of needed settings that are blank: what keeps a provider from being ready."""
    return [n for n in needed if not (settings.get(n) or "").strip()]


def digest_text(rows: list[dict], *, week: str, trend: str, greeting: str, sign_off: str, source_failed: bool = False) -> str:
    """The message: rows (group, company, title, place, why, url), already in order, numbered on across groups."""
    if not rows:
        return "\n".join([greeting, "", f"No new roles matched the criteria for the week of {week}.", "", sign_off])
    out, group = [greeting, "", f"Roles for the week of {week}.", trend, ""], None
    for n, r in enumerate(rows, 1):
        if r["group"] != group:
            group = r["group"]
            out.append(group)
        out.append(f"{n}. {r['company']} - {r['title']}")
        out += [f"   {label}: {r[key]}" for label, key in (("Location", "place"), ("Why it is interesting", "why"), ("Apply", "url")) if r[key]]
        out.append("")
    if source_failed:
        out += ["Note: some sources failed this run; the others were used.", ""]
    return "\n".join([*out, sign_off])
