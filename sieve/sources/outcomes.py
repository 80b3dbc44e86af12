"""Whether an answer could be read, as data: what a parser would have raised is the error of its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import blank
from sieve.sources.payloads import without_mark

# The adapters, and the errors that a run records of answers that can't be read.
JSON_ADAPTERS, OTHER_ADAPTERS = ("greenhouse", "lever", "ashby", "fixture"), ("rss", "html_static")
NO_JSON, NO_XML, WRONG_SHAPE, WRONG_VALUE = "JSONDecodeError", "ParseError", "AttributeError", "ValueError"


def read_error(adapter: Column, body: Column, wrapper_error: Column) -> Column:
    """The error that reading ``body`` meets; "" if it can be read, though it may hold no postings.

    An object that repeats a key counts as no JSON.
    """
    text = F.trim(without_mark(blank(body)))
    whole = F.try_parse_json(text)
    kind = F.schema_of_variant(whole)
    held = F.coalesce(F.schema_of_variant(F.try_variant_get(whole, "$.jobs", "variant")), F.lit("VOID"))
    rows, nothing = r"^ARRAY<(OBJECT|VOID)", F.lit(False)
    listed, empty = kind.rlike(rows), kind == "OBJECT<>"
    in_object = kind.startswith("OBJECT") & (held.rlike(rows) | (held == "VOID"))
    shape = (
        F.when(adapter == "lever", listed | ~kind.startswith("ARRAY"))
        .when(adapter == "ashby", listed | (kind == "VOID") | (in_object & ((held != "VOID") | empty | F.lower(text).contains('"jobs"'))))
        .when(adapter == "fixture", listed | (in_object & (held != "VOID")))
        .otherwise(listed | in_object)
    )
    json = F.when(whole.isNull(), NO_JSON).when(~F.coalesce(shape, nothing), WRONG_SHAPE).otherwise("")
    xml = F.when(F.from_xml(text, F.lit("_corrupt_record string"), {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull() | ~text.startswith("<"), NO_XML).otherwise("")
    return F.when(adapter.isin(*JSON_ADAPTERS), json).when(adapter == "rss", xml).when(adapter == "html_static", F.coalesce(wrapper_error, F.lit(WRONG_VALUE))).otherwise(WRONG_VALUE)


def read_outcomes(bodies: DataFrame) -> DataFrame:
    """``bodies`` with rules (see ``with_rules``), ok and error now of fetching and reading together.

    A 304 and, for files and inline rows, an empty body hold nothing and are fine.  Bodies without status or ok were
    fetched.
    """
    have = set(bodies.columns)
    fetched = F.coalesce(F.col("ok"), F.lit(False)) if "ok" in have else F.col("body").isNotNull()
    said = blank(F.col("error")) if "error" in have else F.when(fetched, "").otherwise("no body")
    unread = (F.col("status") == 304) if "status" in have else F.lit(False)
    unread = F.coalesce(unread, F.lit(False)) | ((F.col("adapter") == "fixture") & (blank(F.col("body")) == ""))
    error = F.when(~fetched, said).when(unread, "").otherwise(read_error(F.col("adapter"), F.col("body"), F.col("_rules.wrapper_error")))
    return bodies.withColumn("_error", error).withColumns({"ok": F.col("_error") == "", "error": F.col("_error")}).drop("_error")
