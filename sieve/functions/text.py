"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.vocabulary import YEARS_LEAST, YEARS_RANGE

#: White space as Python sees it; Java's Unicode class lacks four control characters.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def blank(c: Column) -> Column:
    """The value, "" for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    """The value, null for ""."""
    return F.nullif(blank(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def clean_text(c: Column, most: int = 5000) -> Column:
    """White space collapsed and trimmed, then the first ``most`` code points."""
    return F.left(F.trim(F.regexp_replace(blank(c), SPACE, " ")), F.lit(most))


def key_part(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(clean_text(c, 300)), "[^a-z0-9]+", "-"), F.lit("-"))


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; control escapes in lower-case hex."""
    text = F.to_json(F.struct(*(blank(fields[k]).alias(k) for k in sorted(fields))))
    for code in ("E", "F", "1A", "1B"):
        upper = "\\\\u00" + code.rjust(2, "0")
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*){upper}", "$1\\\\\\\\u00" + code.rjust(2, "0").lower())
    return F.sha2(text, 256)


def stable_key(source_id: Column, external_id: Column, url: Column, company: Column, title: Column, place: Column) -> Column:
    """Key of a posting: its id in its source, else a hash of its URL, else of what it says."""
    named = (key_part(source_id) != "") & (key_part(external_id) != "")
    said = F.lower(F.concat_ws("|", blank(company), blank(title), blank(place)))
    return (
        F.when(named, F.concat_ws(":", key_part(source_id), key_part(external_id)))
        .when(blank(url) != "", F.concat(F.lit("url:"), F.left(F.sha2(blank(url), 256), F.lit(24))))
        .otherwise(F.concat(F.lit("job:"), F.left(F.sha2(said, 256), F.lit(24))))
    )


def strip_html(c: Column, most: int = 12000) -> Column:
    """Entities resolved, scripts, styles and tags dropped, entities resolved again, cleaned."""
    text = unescape(blank(c))
    text = F.regexp_replace(text, r"(?is)<(script|style).*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    return clean_text(unescape(text), most)


#: A reference as HTML reads it: what follows the mark, up to its end or what can't be part of a name.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


#: The names that texts are full of, which are looked at first.
_COMMON = ("lt;", "gt;", "nbsp;", "quot;", "apos;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "ndash;", "mdash;", "bull;", "middot;", "hellip;")


def _table(pairs: dict[str, str]) -> Column:
    """A map that is one constant in a plan, however many entries it has."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _named(reference: Column, names: Iterable[str]) -> Column:
    """Characters of a named reference, null if it isn't among the names."""
    first = [n for n in _COMMON if n in names]
    return F.try_element_at(_table({n: html5[n] for n in [*first, *(n for n in names if n not in first)]}), reference)


def _numbered(number: Column) -> Column:
    """Characters of a numeric reference; null numbers are beyond every code point."""
    windows = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"}
    old = F.try_element_at(_table(windows), number.cast("string"))
    beyond = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    dropped = number.between(1, 8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(beyond, "\ufffd").when((number < 0xA0) & old.isNotNull(), old).when(dropped, "").otherwise(char)


def unescape(c: Column) -> Column:
    """Every character reference of HTML 5 resolved once, those without a semicolon too, as browsers read them.

    A name that is unknown counts as the longest of the old names, those valid without a semicolon, that it begins with.
    """
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    prefix = F.lit("^(?:" + "|".join(old) + ")")

    def resolved(part: Column) -> Column:
        said = F.regexp_extract(part, _REFERENCE, 0)
        number = F.when(said.rlike("^#[xX]"), F.conv(F.regexp_extract(said, "^#[xX]0*([0-9a-fA-F]{1,8});?$", 1), 16, 10)).otherwise(F.regexp_extract(said, "^#0*([0-9]{1,10});?$", 1))
        number = F.when(said.rlike("^#[xX]?0+;?$"), F.lit(0).cast("long")).otherwise(number.try_cast("long"))
        begun = F.regexp_substr(part, prefix)
        plain = F.concat(F.lit("&"), part)
        rest = lambda used: F.substr(part, F.length(used) + 1)
        return (
            F.when(said == "", plain)
            .when(said == "amp;", F.concat(F.lit("&"), rest(said)))
            .when(said.startswith("#"), F.concat(_numbered(number), rest(said)))
            .otherwise(F.coalesce(F.concat(_named(said, html5), rest(said)), F.concat(_named(begun, old), rest(begun)), plain))
        )

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), resolved), ""))

    # bound, so that text and parts are made once however often they are named
    whole = lambda x: F.when(F.contains(x, F.lit("&")), bound(F.split(x, "&", -1), joined)).otherwise(x)
    return bound(c, whole)


def pattern_of(term: str) -> str:
    """Java regex of a keyword between characters other than a-z and 0-9.

    The word comes first and what stands before it is looked at afterwards, so most places fail at one character.
    """
    words = re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", " ".join(term.lower().split()))
    return f"{words}(?<![a-z0-9]{words})(?![a-z0-9])"


def has_keyword(text: Column, term: str) -> Column:
    """Whether the term occurs in lower-case text."""
    return text.rlike(pattern_of(term)) if term.split() else F.lit(False)


def any_keyword(text: Column, terms: Iterable[str]) -> Column:
    """One pass for any number of terms."""
    terms = [pattern_of(t) for t in terms if t.split()]
    return text.rlike("|".join(terms)) if terms else F.lit(False)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value of ``c``, made once a row however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def keyword_of(term: str) -> str:
    """A term as it is looked for: lower-case, one space between its words."""
    return " ".join(term.lower().split())


def _quoted(c: str) -> str:
    return c if re.match("[A-Za-z0-9_ ]", c) else "\\" + c


def _branch(node: dict) -> str:
    """Regex of a trie's strings, longer ones first."""
    ways = [_quoted(c) + _branch(below) for c, below in sorted(node.items()) if c]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")


def keyword_hits(text: Column, terms: Iterable[str]) -> Column:
    """The keywords (see ``keyword_of``) that lower-case text holds, found in one pass over it; null for null.

    At each place where a word begins a trie of all terms finds the longest that stands there, without using up the
    text, so that terms may overlap; shorter ones that begin it are known from the terms alone.
    """
    keys = sorted({k for t in terms if (k := keyword_of(t))})
    if not keys:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    trie: dict = {}
    for k in keys:
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}
    first = "".join(map(_quoted, sorted(trie)))  # most places fail at one look
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?<![a-z0-9])(?=({_branch(trie)})(?![a-z0-9]))"), F.lit(1)))
    begun = {k: [x for x in keys if k.startswith(x) and not re.match("[a-z0-9]", k[len(x):])] for k in keys}
    held = [F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, x)).alias("value")) for k, x in begun.items() if len(x) > 1]
    if not held:
        return found
    also = F.map_from_entries(F.array(*held))
    return F.array_distinct(F.flatten(F.transform(found, lambda k: F.coalesce(F.try_element_at(also, k), F.array(k)))))


def matched_keywords(text: Column, terms: Iterable[str]) -> Column:
    """The terms that occur in lower-case text, in their order."""
    terms = [t for t in terms if t.split()]
    if not terms:
        return F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(keyword_of(t)).alias("key"), F.lit(t).alias("term")) for t in terms))
    return bound(keyword_hits(text, terms), lambda hits: F.transform(F.filter(table, lambda t: F.array_contains(hits, t["key"])), lambda t: t["term"]))


def haystack(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(blank(c) for c in columns)))


def required_years(text: Column) -> Column:
    """Every stated number of years, ranges by both ends, as an array of ints."""
    low = F.regexp_replace(F.lower(blank(text)), SPACE, " ")
    found = [F.regexp_extract_all(low, F.lit(YEARS_RANGE), F.lit(i)) for i in (1, 2)] + [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in YEARS_LEAST]
    return F.transform(F.concat(*found), lambda x: x.cast("int"))


def years_allowed(text: Column, most: int = 5) -> Column:
    return ~F.exists(required_years(text), lambda x: x > most)


def human_join(items: Column) -> Column:
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.concat_ws(" and ", items[0], items[1])).otherwise(F.concat(head, F.lit(", and "), last))


def display_name(token: Column, acronyms: dict[str, str]) -> Column:
    parts = F.filter(F.split(token, "[-_]+"), lambda p: p != "")
    known = F.create_map(*(F.lit(x) for pair in acronyms.items() for x in pair))
    shown = F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, F.lower(p)), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 10_000)))))
    return F.when(F.size(parts) == 0, token).otherwise(F.array_join(shown, " "))


def title_case(c: Column) -> Column:
    """Capitals after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 10_000))), "")


def query_term(c: Column) -> Column:
    text = F.replace(F.regexp_replace(F.trim(blank(c)), r"\s+", " "), F.lit('"'), F.lit(""))
    return F.when(text.rlike(r"\s"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def or_expression(terms: Column) -> Column:
    kept = F.filter(F.transform(terms, query_term), lambda t: t != "")
    return F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(kept, " OR "), F.lit(")")))


def url_quote(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``-._~``."""
    coded = F.url_encode(c)
    for form, strict in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(form), F.lit(strict))
    return coded


def email(c: Column) -> Column:
    """Address of ``Name <a@b>`` or ``mailto:a@b``; "" if it has no name and dotted host."""
    text = F.regexp_replace(F.trim(blank(c)), "(?i)^mailto:", "")
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"<([^<>]*)>", 1), F.lit("")), text)
    return F.when(F.trim(found).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.trim(found)).otherwise("")


def json_object(c: Column, schema: str) -> Column:
    """The outermost object of a text that may be fenced or prefaced, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def whatsapp(c: Column) -> Column:
    return F.when(F.trim(c).startswith("whatsapp:"), F.trim(c)).otherwise(F.concat(F.lit("whatsapp:"), F.trim(c)))


def provider(c: Column, aliases: dict[str, str], default: str) -> Column:
    text = F.lower(F.trim(blank(c)))
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(text == "", default).otherwise(F.coalesce(F.try_element_at(known, text), text))
