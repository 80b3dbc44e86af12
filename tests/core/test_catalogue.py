"""Every registered query against its DuckDB SQL, and functions on odd values."""

import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sieve.functions import dates, places, text, urls
from sieve.operators import delivery, relational, rules
from sieve.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    plain = plain.where(plain.notna(), None)
    return sorted(repr([None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(con.execute(ORACLES[name]).fetchdf())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    assert value(spark, dates.week_range(dates.monday_of(F.lit("2026-W25")))) == "June 15-21, 2026"
    assert value(spark, dates.parse_date(F.lit("1718000000000"))) == "2024-06-10T06:13:20+00:00"
    assert value(spark, text.years_allowed(F.lit("10+ years of experience"))) is False and value(spark, text.years_allowed(F.lit("0-5 years experience"))) is True
    assert value(spark, places.place_of(F.lit("Sydney or San Francisco Bay Area"))) == "San Francisco"
    assert tuple(value(spark, urls.posting_ref(F.lit("https://boards.greenhouse.io/CoolCo/jobs/100?x=1")))) == ("greenhouse", "coolco", "100")
    assert value(spark, urls.posting_ref(F.lit("https://boards.greenhouse.io/about"))) is None
    assert value(spark, text.clean_text(F.lit(None))) == "" and value(spark, text.strip_html(F.lit("<p>a&amp;b</p><script>x</script>"))) == "a&b"


def plain(page):
    """What the reference does to a page, in Python."""
    found = re.sub(r"<(script|style).*?</\1>", " ", html.unescape(page), flags=re.I | re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", found)).split())[:12000]


def on_pages(spark, where, name, pages):
    """Rows of a query and of its SQL over these pages, page 1 first."""
    path = str(where / "pages.parquet")
    spark.createDataFrame([(i, f"https://a.example/{i}", p) for i, p in enumerate(pages, 1)], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    found = [tuple(r) for r in QUERIES[name](spark, str(where)).collect()], con.execute(ORACLES[name]).fetchall()
    return [sorted(rows, key=lambda r: int(r[0])) for rows in found]


BLOCKS = ["a<scripty>b</script>c", "a<StyleSheet x='1'>b</STYLE>c", "a<script2\n>b</script>c<style>d</style>e", "a<scripts>b<script>c</script>d</scripts>e", "a<script>b</style>c</script>d", "<style>a"]


def test_blocks_by_the_letters_they_begin_with(spark, tmp_path):
    rows, sql = on_pages(spark, tmp_path, "strip_html", BLOCKS)
    assert rows == sql == [(i, plain(p)) for i, p in enumerate(BLOCKS, 1)]


def test_blocks_of_normalized_rows(spark, tmp_path):
    pages = [f"<title>t</title>{p}" for p in BLOCKS]
    rows, sql = on_pages(spark, tmp_path, "normalize_rows", pages)
    assert rows == sql and [(r[0], r[-1]) for r in rows] == [(str(i), plain(p)) for i, p in enumerate(pages, 1) if i % 3 != 2]


def test_cap_and_fill(spark):
    jobs = spark.createDataFrame([(1, "A", 9.0), (2, "A", 8.0), (3, "A", 7.0), (4, "B", 6.0), (5, "C", 5.0)], "id int, company string, score double")
    top = relational.per_group_cap(jobs, "company", [F.desc("score"), F.asc("id")], 2, 4)
    assert [(r.company, r["rank"]) for r in top.orderBy("rank").collect()] == [("A", 1), ("A", 2), ("B", 3), ("C", 4)]
    scored = spark.createDataFrame([(1, 94.0, True), (2, 86.0, False), (3, 68.0, False)], "id int, score double, inc boolean")
    assert [(r.id, r.filled) for r in relational.min_fill(scored, "score", "inc", [F.asc("id")], 2, 10).orderBy("rank").collect()] == [(1, False), (2, True)]


def test_chunks_and_sinks():
    body = "a" * 1000 + " " + "b" * 1000
    assert [len(c) for c in delivery.chunks(body)] == [1000, 1000] and delivery.chunks("") == [""]

    def failing(recipient, message):
        raise RuntimeError

    assert [r.error for r in delivery.send_all(["x"], "m", failing)] == ["RuntimeError"] and delivery.all_sent(delivery.send_all(["x"], "m")) and not delivery.all_sent([])


def test_plans_push_limits_down(spark, sf):
    plan = QUERIES["per_company_cap"](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_keywords_in_one_pass(spark):
    """The trie against a regex a term: overlapping terms, terms that begin others, marks, case, nulls, blank terms."""
    terms = ["public", "public policy", "policy", "policy ai", "ai", "c++", "c", "a.b", "Head  of", "é", "", "public policy ai", "art", "der"]
    words = ["public", "policy", "ai", "art", "c++", "c", "a.b", "head of", "é", "aié", "publicity", "der", "-", "ai2", "aXb"]
    draw = random.Random(5)
    texts = ["", None, "public policy ai", "policy  ai", "head of c++c c+++", "x-ai", "éé é"] + [draw.choice([" ", "", "-"]).join(draw.choices(words, k=draw.randrange(9))).lower() for _ in range(400)]
    groups = [{"id": "a", "include_all": ["public", "policy ai"], "exclude_any": ["der", ""]}, {"id": "b", "label": "B", "include_any": ["ai", "c++", ""]}, {"id": "none"}, {"id": "blank", "include_all": ["ai", " "]}]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("t", text.matched_keywords(F.col("t"), terms).alias("k"), rules.matched_groups(F.col("t"), groups).alias("g"), rules.score_terms(F.col("t"), {"ai": 3, "public policy": 0.1, "c": 0.7}, 45).alias("s")).collect()

    def has(said, term):
        key = " ".join(term.lower().split())
        return bool(key) and re.search(rf"(?<![a-z0-9]){re.escape(key)}(?![a-z0-9])", said or "") is not None

    for r in got:
        assert r.k == [t for t in terms if has(r.t, t)], r.t
        want = [("a", "a", ["public", "policy ai"])] * (has(r.t, "public") and has(r.t, "policy ai") and not has(r.t, "der"))
        want += [("b", "B", [t for t in ("ai", "c++") if has(r.t, t)])] * (has(r.t, "ai") or has(r.t, "c++"))
        assert [tuple(g) for g in r.g] == want and r.s == 45.0 + (3.0 if has(r.t, "ai") else 0.0) + (0.1 if has(r.t, "public policy") else 0.0) + (0.7 if has(r.t, "c") else 0.0), r.t
