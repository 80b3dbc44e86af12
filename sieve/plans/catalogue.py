"""Registered queries: every operator on the nearest supplied table, beside the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions import dates, places, text, urls
from sieve.functions.vocabulary import ACRONYMS, BRAND_TERMS, INACTIVE, LOW_SIGNAL_TERMS, SENIOR_TERMS, SIGNAL_TERMS, THEMES
from sieve.operators import delivery, postings, ranking, relational, rules, source_rules
from sieve.plans import discovery, jobs
from sieve.sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def col(name: str):
    return F.col(name)


def utc(name: str):
    return dates.instant(F.col(name))


# Fixed values of the queries: terms of the supplied texts, role groups and a clock.
TERMS = ("the", "and", "die", "der", "le", "de", "license", "token", "public license")
ROLE_GROUPS = [
    {"id": "english", "label": "English", "include_any": ["the", "that"], "exclude_any": ["der"]},
    {"id": "german", "label": "German", "include_all": ["der", "die"]},
    {"id": "licensed", "label": "Licensed", "include_any": ["license", "token"]},
]
NOW = "2001-08-01 00:00:00"


def has(t: str, term: str) -> str:
    """SQL: the keyword between characters other than a-z and 0-9."""
    escaped = "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in term)
    return f"regexp_matches({t}, '(^|[^a-z0-9]){escaped}([^a-z0-9]|$)')"


def any_of(t: str, terms) -> str:
    return "(" + " OR ".join(has(t, x) for x in terms) + ")"


def listed(t: str, terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(t, x)} THEN '{x}' END" for x in terms) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT o_orderkey, round((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400.0, 6) AS age_days FROM orders
    WHERE (epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400.0 BETWEEN -1 AND 60""")
def recency_window(t):
    age = dates.age_days(utc("o_orderdate"), dates.instant(F.lit(NOW)))
    return t("orders").where(dates.recent(age, 60)).select("o_orderkey", F.round(age, 6).alias("age_days"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""")
def per_company_cap(t):
    top = relational.per_group_cap(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 30)
    return top.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) AS cleaned FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", text.clean_text(col("text"), 500).alias("cleaned"))


@query("""SELECT 'customer' AS kind, c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM customer
    UNION ALL SELECT 'part', p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') FROM part""")
def key_part(t):
    a = t("customer").select(F.lit("customer").alias("kind"), col("c_custkey").alias("id"), text.key_part(col("c_name")).alias("key"))
    return a.union(t("part").select(F.lit("part"), "p_partkey", text.key_part(F.concat_ws(" / ", "p_name", "p_brand"))))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pages:' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'url:' || left(sha256(url), 24)
    ELSE 'job:' || left(sha256(lower('|' || url || '|')), 24) END AS stable_key FROM pages""")
def stable_key(t):
    m, none = col("page_id") % 3, F.lit("")
    key = text.stable_key(F.when(m == 0, "pages").otherwise(""), F.when(m == 0, col("page_id").cast("string")).otherwise(""), F.when(m == 1, col("url")).otherwise(""), none, col("url"), none)
    return t("pages").select("page_id", key.alias("stable_key"))


@query("""SELECT p_partkey, sha256(CAST(json_object('brand', p_brand, 'name', p_name, 'type', p_type) AS VARCHAR)) AS content_hash FROM part""")
def content_hash(t):
    return t("part").select("p_partkey", text.stable_hash(type=col("p_type"), name=col("p_name"), brand=col("p_brand")).alias("content_hash"))


_UNESCAPE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


_PLAIN = "left(trim(regexp_replace(" + _UNESCAPE.format("regexp_replace(regexp_replace(regexp_replace(" + _UNESCAPE.format("html") + ", '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g')), 12000)"


@query(f"SELECT page_id, {_PLAIN} AS plain FROM pages")
def strip_html(t):
    return t("pages").select("page_id", text.strip_html(col("html")).alias("plain"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS first_part,
    regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no, CASE page_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats,
    'board' || (page_id % 7) AS board_token, CAST(page_id AS VARCHAR) AS job_id FROM pages""")
def posting_ref_parse(t):
    made = F.when(col("page_id") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/Board"), col("page_id") % 7, F.lit("/jobs/"), col("page_id"))).when(col("page_id") % 3 == 1, F.concat(F.lit("https://jobs.lever.co/board"), col("page_id") % 7, F.lit("/"), col("page_id"))).otherwise(F.concat(F.lit("https://jobs.ashbyhq.com/board"), col("page_id") % 7, F.lit("/application?jobId="), col("page_id")))
    rows = t("pages").select("page_id", "url", urls.posting_ref(made).alias("ref"))
    return rows.select("page_id", urls.host_of(col("url")).alias("host"), F.coalesce(F.get(urls.path_parts(col("url")), F.lit(0)), F.lit("")).alias("first_part"), urls.query_value(col("url"), "page").alias("page_no"), "ref.ats", "ref.board_token", "ref.job_id")


@query("""SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') OR h = 'example.org' OR ends_with(h, '.example.org') AS excluded
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)""")
def domain_exclusion(t):
    return t("pages").select("page_id", urls.domain_excluded(urls.host_of(col("url")), ["example.com", "Example.org"]).alias("excluded"))


@query(f"SELECT doc_id, array_to_string({listed('lower(text)', TERMS)}, ',') AS terms FROM documents")
def keyword_match(t):
    return t("documents").select("doc_id", F.array_join(text.matched_keywords(F.lower("text"), TERMS), ",").alias("terms"))


_L = "lower(text)"
_GROUPS = f"""SELECT doc_id, list_filter([CASE WHEN NOT {has(_L, 'der')} AND {any_of(_L, ['the', 'that'])} THEN 'english' END,
    CASE WHEN {has(_L, 'der')} AND {has(_L, 'die')} THEN 'german' END, CASE WHEN {any_of(_L, ['license', 'token'])} THEN 'licensed' END], lambda x: x IS NOT NULL) AS groups FROM documents"""


@query(f"SELECT id, count(*) AS n FROM (SELECT unnest(groups) AS id FROM ({_GROUPS})) GROUP BY id")
def role_group_counts(t):
    rows = t("documents").select(F.explode(rules.matched_groups(F.lower("text"), ROLE_GROUPS)).alias("g"))
    return rows.groupBy(col("g.id").alias("id")).agg(F.count("*").alias("n"))


@query(f"""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'missing_posted_date' WHEN l.quality = 0 THEN 'not_recent' WHEN {has('d.source', 'src1')} THEN 'excluded_title_keyword'
    WHEN {has("lower(d.source || ' ' || d.lang)", 'es')} THEN 'excluded_keyword' WHEN {has('lower(d.text)', 'token')} THEN 'excluded_full_text_keyword'
    WHEN len(g.groups) = 0 THEN 'no_role_group' ELSE 'accepted' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id) JOIN ({_GROUPS}) g USING (doc_id)""")
def rule_cascade(t):
    rows = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    age = F.when(col("quality") == 1, 1.0).when(col("quality") == 0, 99.0)
    config = {"posted_within_days": 8, "exclude_title_any": ["src1"], "exclude_any": ["es"], "exclude_full_text_any": ["token"]}
    reason = rules.rejection(age=age, title=col("source"), metadata=text.haystack(col("source"), col("lang")), full=F.lower("text"), groups=rules.matched_groups(F.lower("text"), ROLE_GROUPS), rules=config)
    return rows.select("doc_id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


@query("SELECT p_partkey, p_size <= 5 AS allowed FROM part")
def years_requirement(t):
    said = F.when(col("p_partkey") % 3 == 0, F.concat(F.lit("At least "), col("p_size"), F.lit("+ years of relevant experience in "), col("p_name"))).when(col("p_partkey") % 3 == 1, F.concat(F.lit("Experience: "), col("p_size"), F.lit(" yrs"))).otherwise(F.concat(F.lit("1 to "), col("p_size"), F.lit(" years professional experience")))
    return t("part").select("p_partkey", text.years_allowed(said).alias("allowed"))


_WEIGHTS = {"the": 18, "and": 7, "of": 4, "die": 16, "le": 5, "license": 30}


@query("SELECT doc_id, 45.0::DOUBLE + " + " + ".join(f"CASE WHEN {has(_L, k)} THEN {v}::DOUBLE ELSE 0 END" for k, v in _WEIGHTS.items()) + " AS score FROM documents")
def weighted_score(t):
    return t("documents").select("doc_id", rules.score_terms(F.lower("text"), _WEIGHTS, 45).alias("score"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60")
def top_k_stable(t):
    return relational.top(t("documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], ranking.SHOWN)


@query("""WITH y AS (SELECT p_partkey, p_retailprice, false AS filled FROM part WHERE p_size = 50 ORDER BY p_retailprice DESC, p_partkey LIMIT 15),
    n AS (SELECT p_partkey, p_retailprice, true AS filled FROM part WHERE p_size <> 50 AND p_retailprice >= 70 ORDER BY p_retailprice DESC, p_partkey LIMIT 12),
    r AS (SELECT *, row_number() OVER (ORDER BY filled, p_retailprice DESC, p_partkey) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM n))
    SELECT * FROM r WHERE (NOT filled AND rank <= 15) OR rank <= (SELECT least(12, count(*)) FROM part)""")
def min_fill_select(t):
    rows = t("part").select("p_partkey", "p_retailprice", (col("p_size") == 50).alias("included"))
    return relational.min_fill(rows, "p_retailprice", "included", [F.asc("p_partkey")], 12, 15).drop("included")


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, md5(text) AS text_key FROM documents GROUP BY text")
def dedupe_first(t):
    return relational.first_wins(t("documents").select("doc_id", F.md5("text").alias("text_key")), ["text_key"], ["doc_id"])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2000-01-01')")
def anti_seen(t):
    seen = t("orders").where("o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'").select(col("o_custkey").alias("c_custkey"))
    return relational.without(t("customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
    AND l.l_shipdate > o.o_orderdate AND l.l_returnflag <> 'N')""")
def skip_unchanged(t):
    o, l = t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), t("lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    return relational.without(o, l, col("o_orderkey") == col("l_orderkey"), (col("l_shipdate") > col("o_orderdate")) & (col("l_returnflag") != "N")).select("o_orderkey", "o_custkey")


@query(f"""SELECT doc_id, coalesce(s.label, '') AS label FROM documents d LEFT JOIN (VALUES ('src0', 'Zero', 'the'), ('src1', 'One', 'die'), ('src2', 'Two', 'le')) s(source, label, term) USING (source)
    WHERE CASE s.term WHEN 'the' THEN {has('lower(d.text)', 'the')} WHEN 'die' THEN {has('lower(d.text)', 'die')} WHEN 'le' THEN {has('lower(d.text)', 'le')} ELSE true END""")
def source_join(t):
    docs = t("documents").select("doc_id", "source", "text")
    config = docs.sparkSession.createDataFrame([("src0", "Zero", "the"), ("src1", "One", "die"), ("src2", "Two", "le")], "source string, label string, term string")
    low = F.lower("text")
    ok = F.when(col("term") == "the", rules.source_allows(low, F.lit(""), ["the"], [])).when(col("term") == "die", rules.source_allows(low, F.lit(""), ["die"], [])).when(col("term") == "le", rules.source_allows(low, F.lit(""), ["le"], [])).otherwise(True)
    return docs.join(F.broadcast(config), "source", "left").where(ok).select("doc_id", F.coalesce("label", F.lit("")).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN r.k IS NULL THEN 'rejected' ELSE 'included' END AS status, CASE WHEN r.k IS NULL THEN 'not_selected' ELSE '' END AS rejection_reason,
    CASE WHEN r.k IS NULL THEN '' ELSE o_orderpriority END AS description FROM orders LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000) r ON r.k = o_orderkey""")
def evaluated_status(t):
    orders = t("orders")
    picked = orders.where("o_totalprice > 200000").select("o_orderkey")
    said = ranking.outcome(col("_on"), F.lit(None).cast("string"))
    return relational.attach(orders, picked, "o_orderkey", "_on").select("o_orderkey", *(c.alias(n) for n, c in said.items()), F.when(col("_on"), col("o_orderpriority")).otherwise("").alias("description"))


@query("""SELECT conv_id, turn, role, CAST(conv_id % 100 AS DOUBLE) AS score FROM conversations""")
def ranker_rows_join(t):
    conv = t("conversations")
    made = conv.select(F.concat(F.lit("Here you are: ```json "), F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("key"), (col("conv_id") % 100).cast("double").alias("score"))), F.lit("```")).alias("said"))
    answer = made.select(text.json_object(col("said"), "struct<key:string,score:double>").alias("r")).select("r.*")
    return conv.withColumn("key", F.concat_ws(":", "conv_id", "turn")).join(relational.first_wins(answer, ["key"], ["score"]), "key").select("conv_id", "turn", "role", "score")


@query("""SELECT k, arg_max(v, layer) AS v FROM (SELECT p_partkey AS k, p_retailprice AS v, 0 AS layer FROM part UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 2 FROM supplier) GROUP BY k""")
def state_merge(t):
    layers = (("part", "p_partkey", "p_retailprice"), ("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))
    return relational.newest([t(name).select(col(k).alias("k"), col(v).alias("v")) for name, k, v in layers], "k")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
    array_to_string(list_reduce(list([event_type] ORDER BY event_id), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_slice(list_append(acc, x[1]), greatest(1, len(acc) + 2 - 3), len(acc) + 1) END), ',') AS sample FROM events GROUP BY user_id""")
def registry_rollup(t):
    out = relational.board_rollup(t("events"), "user_id", "ts", "event_type", "event_id", 3)
    return out.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")), F.array_join("sample", ",").alias("sample"))


@query("""SELECT count(*) AS accepted, count(DISTINCT user_id) FILTER (NOT known) AS added, count(*) - count(DISTINCT user_id) FILTER (NOT known) AS updated FROM
    (SELECT DISTINCT user_id, event_type, user_id IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02' AND event_type = 'purchase') AS known FROM events WHERE ts >= TIMESTAMP '2024-01-02')""")
def registry_refresh_counts(t):
    # boards that the first day's purchases made known, and refs that came after it
    later = col("ts") >= F.expr("timestamp_ntz'2024-01-02 00:00:00'")
    e = t("events").withColumn("board_key", col("user_id"))
    known = e.where(~later & (col("event_type") == "purchase")).select("board_key").distinct()
    return jobs.board_counts(e.where(later).select("board_key", "event_type").distinct(), known)


@query("""SELECT user_id, CAST(coalesce(n, 0) AS BIGINT) AS failure_count, coalesce(n, 0) < 3 AS active FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN
    (SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN (SELECT user_id, max((ts, event_id)) AS ok FROM events WHERE event_type <> 'error' GROUP BY 1) o USING (user_id)
     WHERE event_type = 'error' AND (o.ok IS NULL OR (ts, event_id) > o.ok) GROUP BY 1) USING (user_id)""")
def failure_streak(t):
    return relational.failure_streak(t("events"), "user_id", ["ts", "event_id"], col("event_type") == "error", 3)


@query("SELECT c_custkey, sha256('seed:' || c_custkey) AS bucket FROM customer ORDER BY c_nationkey, bucket LIMIT 40")
def poll_spread(t):
    return relational.poll_spread(t("customer"), "c_custkey", col("c_nationkey"), "seed", 40).select("c_custkey", "bucket")


@query("""SELECT 'events' AS kind, event_id AS id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai', '%G-W%V') AS week FROM events
    UNION ALL SELECT 'orders', o_orderkey, strftime(o_orderdate, '%G-W%V') FROM orders""")
def week_key(t):
    a = t("events").select(F.lit("events").alias("kind"), col("event_id").alias("id"), dates.week_key(utc("ts"), "Asia/Shanghai").alias("week"))
    return a.union(t("orders").select(F.lit("orders"), "o_orderkey", dates.week_key(utc("o_orderdate"))))


@query("SELECT event_id FROM (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS l FROM events) WHERE isodow(l) = 1 AND hour(l) = 9")
def send_window(t):
    return t("events").where(dates.in_send_window(utc("ts"), "Asia/Shanghai", 0, 9)).select("event_id")


@query("SELECT event_id, 'https://example.com/jobs/' || CAST(json_extract(props, '$.k') AS VARCHAR) AS url FROM events")
def cdx_parse(t):
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('﻿not json\n{"url":"https://example.com/jobs/'), k, F.lit('","status":"200"}'))
    return payloads.crawl_records(t("events").select(col("event_id").alias("source_id"), line.alias("body"))).select(col("source_id").alias("event_id"), "url")


_LOCATION = "CASE n_nationkey % 5 WHEN 0 THEN 'NYC or Sydney, NSW' WHEN 1 THEN 'San Francisco Bay Area (hybrid)' WHEN 2 THEN 'Remote - Shenzen' WHEN 3 THEN n_name || ' remote' ELSE n_name END"
_CITY = "CASE n_nationkey % 5 WHEN 0 THEN 'Sydney' WHEN 1 THEN 'San Francisco' WHEN 2 THEN 'Shenzhen' ELSE '' END"


@query(f"SELECT n_nationkey, {_CITY} AS city FROM nation")
def city_longest_alias(t):
    return t("nation").select("n_nationkey", places.place_of(F.expr(_LOCATION)).alias("city"))


@query("""SELECT r_name, p_type, '(' || CASE WHEN r_name LIKE '% %' THEN '"' || r_name || '"' ELSE r_name END || ' OR ' || CASE WHEN p_type LIKE '% %' THEN '"' || p_type || '"' ELSE p_type END || ')' AS query
    FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part) ORDER BY r_name, p_type LIMIT 50""")
def query_builder(t):
    kinds = t("part").select("p_type").distinct()
    rows = kinds.crossJoin(F.broadcast(t("region").select("r_name"))).orderBy("r_name", "p_type").limit(50)
    return rows.select("r_name", "p_type", text.or_expression(F.array("r_name", "p_type")).alias("query"))


@query("""SELECT k, arg_min(id, pri * 1000000000 + id) AS id FROM (SELECT c_nationkey AS k, c_custkey AS id, 1 AS pri FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 0 FROM supplier) GROUP BY k""")
def union_first_wins(t):
    both = t("customer").select(col("c_nationkey").alias("k"), col("c_custkey").alias("id"), F.lit(1).alias("pri")).unionByName(t("supplier").select(col("s_nationkey").alias("k"), col("s_suppkey").alias("id"), F.lit(0).alias("pri")))
    return relational.first_wins(both, ["k"], ["pri", "id"]).select("k", "id")


@query("""SELECT nation, array_to_string(list_sort(CASE WHEN len(d) = 0 AND len(w) = 0 THEN ['anywhere'] WHEN len(d) = 0 THEN w WHEN len(w) = 0 OR len(list_intersect(d, w)) = 0 THEN d ELSE list_intersect(d, w) END), ',') AS places FROM
    (SELECT c_nationkey AS nation, coalesce(list(DISTINCT c_mktsegment) FILTER (c_acctbal < 0), []) AS w, coalesce(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 9000), []) AS d FROM customer GROUP BY 1)""")
def city_intersect(t):
    named = t("customer").groupBy(col("c_nationkey").alias("nation")).agg(*(F.collect_set(F.when(c, col("c_mktsegment"))).alias(n) for n, c in (("wanted", col("c_acctbal") < 0), ("default", col("c_acctbal") > 9000))))
    places_of = source_rules.target_places(col("wanted"), col("default"), F.array(F.lit("anywhere")))
    return named.select("nation", F.array_join(F.array_sort(places_of), ",").alias("places"))


@query("""SELECT *, CASE label WHEN 'Legal / Regulatory' THEN 2 WHEN 'Policy / AI Governance' THEN 3 WHEN 'Investing / Venture' THEN 4 ELSE 99 END AS ord FROM (SELECT p_partkey,
    CASE p_partkey % 4 WHEN 0 THEN 'Policy / AI Governance' WHEN 1 THEN 'Legal / Regulatory' WHEN 2 THEN CASE WHEN p_size > 25 THEN 'Investing / Venture' ELSE 'My-Own Group' END ELSE 'Other Strong Matches' END AS label FROM part)""")
def group_label(t):
    tags = F.expr("""CASE p_partkey % 4 WHEN 0 THEN array('remote', 'condition:policy_ai') WHEN 1 THEN array('condition:legal_regulatory', 'condition:policy_ai')
        WHEN 2 THEN filter(array('condition:my-own_group', CASE WHEN p_size > 25 THEN 'condition:investing_venture' END), x -> x IS NOT NULL) ELSE array('other', 'condition:') END""")
    label = delivery.group_label(delivery.group_ids(tags))
    return t("part").select("p_partkey", label.alias("label"), F.coalesce(delivery.group_place(label), F.lit(99)).alias("ord"))


_THEMES = {"articles": ("the", "die", "le"), "joins": ("and", "und", "et"), "rights": ("license", "public license")}


@query("SELECT theme, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {any_of(_L, v)} THEN '{k}' END" for k, v in _THEMES.items()) + "], lambda x: x IS NOT NULL)) AS theme FROM documents) GROUP BY theme HAVING count(*) >= 3 ORDER BY n DESC, theme LIMIT 3")
def theme_counts(t):
    found = F.array(*(F.when(text.any_keyword(F.lower("text"), v), F.lit(k)) for k, v in _THEMES.items()))
    rows = t("documents").select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("theme"))
    return relational.leading(rows, "theme", "theme", 3, 3).select("theme", "n")


@query("""SELECT source AS source_id, CASE WHEN source IS NULL THEN 0 ELSE count(*) END AS fetched_count,
    CASE WHEN source IS NULL THEN 0 WHEN source = 'src0' THEN count(*) FILTER (lang = 'en' AND n_chars > 500) ELSE count(*) FILTER (lang = 'en') END AS normalized_count FROM documents GROUP BY source""")
def source_metrics(t):
    met = t("documents").select(col("source").alias("source_id"), F.coalesce(col("lang") == "en", F.lit(False)).alias("kept"), "n_chars")
    two_step = F.when(col("source_id") == "src0", "greenhouse").otherwise("lever")
    answers = met.select("source_id").distinct().withColumns({"adapter": two_step, "ok": F.lit(True), "error": F.lit(""), "elapsed_ms": F.lit(1), "_rules": F.struct(col("source_id").alias("source_name"))})
    return discovery.source_results(answers, met, met.where("kept AND n_chars > 500")).select("source_id", "fetched_count", "normalized_count")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_runs(t):
    return relational.last_runs(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", ["o_orderdate", "o_orderkey"], 50)


@query("""SELECT arg_min(email, k) AS email FROM (SELECT c_custkey AS k, 'User' || (c_custkey % 200) || CASE WHEN c_custkey % 2 = 0 THEN '@Example.com' ELSE '@example.com' END AS email, c_mktsegment AS s FROM customer)
    WHERE s <> 'BUILDING' GROUP BY lower(email)""")
def recipient_rows(t):
    host = F.when(col("c_custkey") % 2 == 0, "@Example.com").otherwise("@example.com")
    rows = t("customer").select("c_custkey", text.email(F.concat(F.lit("Some One <User"), col("c_custkey") % 200, host, F.lit(">"))).alias("email"), F.when(col("c_mktsegment") == "BUILDING", "Unsubscribed").otherwise("active").alias("status"))
    kept = rows.where((col("email") != "") & ~F.lower(F.trim("status")).isin(*INACTIVE)).withColumn("low", F.lower("email"))
    return relational.first_wins(kept, ["low"], ["c_custkey"]).select("email")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS display_rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2) WHERE n <= 30""")
def display_rank(t):
    # the cap before it is the operator's own: numbers run on over the rows that a digest shows
    top = relational.per_group_cap(t("orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 30)
    return ranking.display_rank(top, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_custkey", "display_rank")


_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def stripped(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def last_mark(mark: str, width: int) -> str:
    """SQL: where the mark last starts in the first 1500 characters, from 0; -1 without one."""
    return f"CASE WHEN contains(left(rest, 1500), {mark}) THEN length(left(rest, 1500)) - strpos(reverse(left(rest, 1500)), {mark}) - {width - 1} ELSE -1 END"


_CUT = f"greatest({last_mark('chr(10) || chr(10)', 2)}, {last_mark('chr(10)', 1)}, {last_mark(repr(' '), 1)})"


@query(f"""WITH RECURSIVE c(doc_id, chunk, text, rest) AS (SELECT doc_id, -1, '', {stripped("coalesce(text, '')")} FROM documents
    UNION ALL SELECT doc_id, chunk + 1, CASE WHEN length(rest) > 1500 THEN {stripped("left(rest, cut)")} ELSE rest END, CASE WHEN length(rest) > 1500 THEN {stripped("substr(rest, cut + 1)")} END
    FROM (SELECT *, CAST(CASE WHEN {_CUT} >= 750 THEN {_CUT} ELSE 1500 END AS INT) AS cut FROM c WHERE rest IS NOT NULL AND (rest <> '' OR chunk = -1)))
    SELECT doc_id, chunk, text FROM c WHERE chunk >= 0""")
def message_chunks(t):
    return delivery.split_messages(t("documents"), "doc_id", "text")


@query("""WITH top AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30), r AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM top),
    g AS (SELECT *, CASE WHEN n = min(n) OVER (PARTITION BY o_orderpriority) THEN o_orderpriority || chr(10) ELSE '' END AS head FROM r)
    SELECT 'Hello,' || chr(10) || chr(10) || 'Roles for the week of 15 June.' || chr(10) || 'Large orders lead.' || chr(10) || chr(10) || string_agg(head || n || '. customer ' || o_custkey || ' - order ' || o_orderkey || chr(10)
    || '   Location: ' || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '   Why it is interesting: even' || chr(10) ELSE '' END || '   Apply: https://example.com/' || o_orderkey || chr(10) || chr(10), '' ORDER BY n) || 'Best' AS digest FROM g""")
def digest_lines(t):
    # the message is one text of at most 30 rows, which the driver sends
    top = t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    shown = ranking.display_rank(top, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).orderBy("display_rank").collect()
    rows = [{"group": r.o_orderpriority, "company": f"customer {r.o_custkey}", "title": f"order {r.o_orderkey}", "place": r.o_orderstatus, "why": "" if r.o_orderkey % 2 else "even", "url": f"https://example.com/{r.o_orderkey}"} for r in shown]
    message = delivery.digest_text(rows, week="15 June", trend="Large orders lead.", greeting="Hello,", sign_off="Best")
    return top.sparkSession.createDataFrame([(message,)], "digest string")


@query(f"""SELECT CAST(page_id AS VARCHAR) AS external_id, title, company, canonical_url, location_text, CASE page_id % 3 WHEN 0 THEN 'Sydney' ELSE 'Remote' END AS city, page_id % 3 = 1 AS remote, 'pages:' || page_id AS stable_key,
    sha256(CAST(json_object('canonical_url', canonical_url, 'company', company, 'description_text', left(plain, 2000), 'external_id', CAST(page_id AS VARCHAR), 'location_text', location_text, 'source_id', 'pages', 'title', title) AS VARCHAR)) AS content_hash, plain AS description_text
    FROM (SELECT page_id, left(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), 220) AS title, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS company, left(url, 1200) AS canonical_url,
    CASE page_id % 3 WHEN 0 THEN 'Sydney, NSW' ELSE 'Remote' END AS location_text, {_PLAIN} AS plain FROM pages WHERE page_id % 3 <> 2) WHERE title <> '' AND company <> '' AND canonical_url <> ''""")
def normalize_rows(t):
    none, m = F.lit(None).cast("string"), col("page_id") % 3
    place = F.when(m == 0, "Sydney, NSW").when(m == 1, "Remote").otherwise("Elsewhere")
    raw = t("pages").select(
        F.lit("pages").alias("source_id"), col("page_id").cast("string").alias("external_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), urls.host_of(col("url")).alias("company"), place.alias("location"),
        col("url").alias("canonical_url"), col("html").alias("description_text"), none.alias("posted_at"), none.alias("created_at"), none.alias("updated_at"), F.lit(None).cast("array<string>").alias("tags"), F.lit(0).alias("pos"),
    )
    rows = postings.normalize(raw, fetched_at="2024-06-10T00:00:00+00:00", remote_ok=True)
    return rows.select("external_id", "title", "company", "canonical_url", "location_text", "city", "remote", "stable_key", "content_hash", "description_text")


@query(f"SELECT n_nationkey, ({_CITY}) <> '' OR lower({_LOCATION}) LIKE '%remote%' AS allowed, CASE WHEN ({_CITY}) <> '' THEN ({_CITY}) WHEN n_nationkey % 5 = 3 THEN 'Remote' ELSE '' END AS city, n_nationkey % 5 IN (1, 2, 3) AS remote FROM nation")
def place_gate(t):
    return t("nation").select("n_nationkey", places.place_gate(F.expr(_LOCATION), remote_ok=True).alias("g")).select("n_nationkey", "g.*")


@query(f"""SELECT doc_id, array_to_string({listed('lower(source)', ['src1', 'src2'])}, ',') AS title_terms, array_to_string({listed("lower(source || ' ' || lang)", ['es', 'src3'])}, ',') AS meta_terms,
    array_to_string({listed('lower(text)', ['license', 'token'])}, ',') AS full_terms FROM documents""")
def excluded_terms(t):
    return t("documents").select("doc_id", F.array_join(text.matched_keywords(F.lower("source"), ["src1", "src2"]), ",").alias("title_terms"), F.array_join(text.matched_keywords(text.haystack(col("source"), col("lang")), ["es", "src3"]), ",").alias("meta_terms"), F.array_join(text.matched_keywords(F.lower("text"), ["license", "token"]), ",").alias("full_terms"))


@query("""SELECT d.doc_id, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)""")
def unsent_included(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").where("quality = 1").select("doc_id"), "doc_id")
    return relational.without(rows, t("benchmark").select(col("item_id").alias("doc_id")), "doc_id").orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def match_attach(t):
    return relational.attach(t("documents").select("doc_id", "source"), t("labels").select("doc_id", "quality", "toxic"), "doc_id", "_on").drop("_on")


@query("""SELECT doc_id, CASE WHEN s.k IS NULL THEN '' ELSE 'If-None-Match=' || s.etag END AS headers FROM documents LEFT JOIN (SELECT 'src' || s_suppkey AS k, s_name AS etag FROM supplier) s ON s.k = source""")
def cache_lookup(t):
    cache = t("supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("source"), col("s_name").alias("etag"))
    headers = payloads.conditional_headers(col("etag"), F.lit(None).cast("string"))
    shown = F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return t("documents").select("doc_id", "source").join(cache, "source", "left").select("doc_id", shown.alias("headers"))


@query("""SELECT CAST(user_id AS VARCHAR) AS board_key, CAST(CASE WHEN ok THEN 0 ELSE 3 END AS BIGINT) AS failure_count, ok AS active, '2024-02-01T00:00:00+00:00' AS last_polled, CASE WHEN ok THEN '' ELSE 'errors' END AS last_error
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') <= 10 AS ok FROM events WHERE event_type <> 'signup' GROUP BY 1)""")
def poll_update(t):
    polls = t("events").where("event_type <> 'signup'").groupBy(col("user_id").cast("string").alias("board_key")).agg((F.count_if(col("event_type") == "error") <= 10).alias("ok")).withColumn("error", F.when(~col("ok"), "errors"))
    none = F.lit(None).cast("array<string>")
    boards = t("events").select(col("user_id").cast("string").alias("board_key")).distinct().select("board_key", F.lit("lever").alias("ats"), col("board_key").alias("board_token"), F.lit(True).alias("active"), F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), F.lit("").alias("last_polled"), F.lit(2).cast("long").alias("failure_count"), F.lit("").alias("last_error"), none.alias("sample_urls"), none.alias("sample_job_ids"))
    out = jobs.polled_boards(boards, polls, at="2024-02-01T00:00:00+00:00", most_failures=3)
    return out.select("board_key", "failure_count", "active", "last_polled", "last_error")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem) WHERE b < 60""")
def budget_cut(t):
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return relational.budget_cut(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", 60).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, coalesce(l.l_returnflag, o_orderstatus) AS flag, coalesce(l.l_linenumber, 0) AS line FROM orders LEFT JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_quantity > 10) WHERE rn <= 2) l ON l.l_orderkey = o_orderkey""")
def detail_overlay(t):
    items = t("lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    detail = relational.first_n(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], 2)
    index = t("orders").select("o_orderkey", col("o_orderstatus").alias("flag"), F.lit(0).alias("line"))
    return relational.upsert(index, detail.select(col("l_orderkey").alias("o_orderkey"), col("l_returnflag").alias("flag"), col("l_linenumber").alias("line")), "o_orderkey")


@query("SELECT n_name, count(*) AS n, min(c_custkey) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, first LIMIT 3")
def top_places(t):
    top = relational.leading(t("customer"), "c_nationkey", "c_custkey", 2, 3)
    return top.join(t("nation"), col("c_nationkey") == col("n_nationkey")).select("n_name", "n", "first")


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS included, count(*) FILTER (event_type = 'error') AS rejected, count(*) AS evaluated, bool_or(event_type = 'error') AS any_failed,
    count(*) > 0 AND bool_and(event_type <> 'error') AS all_ok, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1""")
def status_counts(t):
    e = col("event_type")
    return t("events").groupBy("user_id").agg(*relational.tally(e == "purchase", e == "error"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def run_history_merge(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    both = o.where("o_orderkey % 2 = 0").withColumn("pri", F.lit(0)).unionByName(o.where("o_orderkey % 2 = 1").withColumn("pri", F.lit(1)))
    return relational.first_wins(both, ["o_custkey"], ["pri", "o_orderkey"]).drop("pri")


@query("SELECT k, arg_max(v, pri) AS v FROM (SELECT c_custkey AS k, c_name AS v, 0 AS pri FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) GROUP BY k")
def dict_upsert(t):
    held = t("customer").select(col("c_custkey").alias("k"), col("c_name").alias("v"))
    return relational.upsert(held, t("supplier").select(col("s_suppkey").alias("k"), col("s_name").alias("v")), "k")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS parsed FROM orders")
def parse_dates(t):
    ts, m = col("o_orderdate"), col("o_orderkey") % 4
    said = F.when(m == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(m == 2, F.unix_millis(utc("o_orderdate")).cast("string")).otherwise("not a date")
    return t("orders").select("o_orderkey", dates.parse_date(said).alias("parsed"))


@query("SELECT p_partkey, contains(lower(p_name), 'an') AS branded FROM part")
def brand_substring(t):
    return t("part").select("p_partkey", rules.brand_hit(F.lower("p_name"), F.lit(""), "an").alias("branded"))


@query("""SELECT DISTINCT strftime(m, '%G-W%V') AS week, CASE WHEN month(m) = month(m + INTERVAL 6 DAY) THEN strftime(m, '%B ') || day(m) || '-' || day(m + INTERVAL 6 DAY) || strftime(m, ', %Y')
    WHEN year(m) = year(m + INTERVAL 6 DAY) THEN strftime(m, '%B ') || day(m) || ' - ' || strftime(m + INTERVAL 6 DAY, '%B ') || day(m + INTERVAL 6 DAY) || strftime(m, ', %Y')
    ELSE strftime(m, '%B ') || day(m) || strftime(m, ', %Y') || ' - ' || strftime(m + INTERVAL 6 DAY, '%B ') || day(m + INTERVAL 6 DAY) || strftime(m + INTERVAL 6 DAY, ', %Y') END AS label
    FROM (SELECT date_trunc('week', d) AS m FROM (SELECT ts AS d FROM events UNION ALL SELECT o_orderdate FROM orders))""")
def week_range_label(t):
    weeks = t("events").select(dates.week_key(utc("ts")).alias("week")).union(t("orders").select(dates.week_key(utc("o_orderdate")))).distinct()
    return weeks.select("week", dates.week_range(dates.monday_of(col("week"))).alias("label"))


@query("""SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS name, CASE len(w) WHEN 1 THEN w[1] WHEN 2 THEN w[1] || ' and ' || w[2] ELSE array_to_string(w[1:len(w)-1], ', ') || ', and ' || w[len(w)] END AS said
    FROM (SELECT p_partkey, list_filter(string_split_regex(replace(p_name, ' ', '-'), '[-_]+'), lambda x: x <> '') AS w FROM part)""")
def token_display_name(t):
    token = F.replace(col("p_name"), F.lit(" "), F.lit("-"))
    words = F.filter(F.split(token, "[-_]+"), lambda w: w != "")
    return t("part").select("p_partkey", text.display_name(token, ACRONYMS).alias("name"), text.human_join(words).alias("said"))


@query("SELECT p_partkey, array_to_string(list_concat(tags, list_filter(extra, lambda x: NOT list_contains(tags, x))), ',') AS tags FROM (SELECT p_partkey, [p_brand, 'condition:a'] AS tags, ['condition:a', 'condition:' || p_type] AS extra FROM part)")
def tag_enrich(t):
    tags = rules.tagged(F.array("p_brand", F.lit("condition:a")), F.array(F.lit("a"), "p_type"))
    return t("part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("""SELECT p_partkey, 'https://index.example.org/' || p_brand || '?url=' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '%2F%2A&output=json&fl=url%2Ctimestamp%2Cstatus%2Cmime&filter=status%3A200&collapse=urlkey&limit=50' AS url,
    'https://api.lever.co/v0/postings/t' || p_partkey || '?mode=json' AS board_url FROM part""")
def index_url_build(t):
    endpoint = F.concat(F.lit("https://index.example.org/"), "p_brand")
    board = urls.board_urls(F.lit("lever"), urls.board_token(F.concat(F.lit("T"), "p_partkey"), F.lit("")))
    return t("part").select("p_partkey", urls.index_url(endpoint, F.concat("p_name", F.lit("/*")), 50).alias("url"), board.alias("board_url"))


@query("SELECT event_id FROM events WHERE strftime(ts, '%G-W%V') IN (SELECT strftime(ts, '%G-W%V') FROM events WHERE event_type = 'purchase' AND value > 90)")
def week_guard(t):
    e = t("events").withColumn("week", dates.week_key(utc("ts")))
    return e.join(e.where("event_type = 'purchase' AND value > 90").select("week").distinct(), "week", "left_semi").select("event_id")


@query("""SELECT 'registry-greenhouse-' || user_id AS source_id, user_id, CASE WHEN user_id % 2 = 0 THEN 8 ELSE NULL END AS max_detail_fetches FROM (SELECT user_id, max(ts) AS last, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1) WHERE bad < 20 ORDER BY last, sha256('s:' || user_id) LIMIT 40""")
def active_boards(t):
    boards = t("events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(col("event_type") == "error").alias("bad")).where("bad < 20")
    out = relational.poll_spread(boards, "user_id", col("last"), "s", 40)
    return out.select(F.concat(F.lit("registry-greenhouse-"), "user_id").alias("source_id"), "user_id", F.when(col("user_id") % 2 == 0, 8).alias("max_detail_fetches"))


@query("SELECT doc_id, CAST(json_object('description', left(text, 1200), 'lang', lang, 'source', source) AS VARCHAR) AS row FROM documents")
def compact_projection(t):
    return t("documents").select("doc_id", ranking.compact(description=col("text"), lang="lang", source="source").alias("row"))


@query("SELECT p_partkey, p_brand || ' role in ' || p_type || ': ' || p_name || CASE WHEN p_size > 25 THEN ' (big, ' || p_size || ')' ELSE '' END AS why FROM part")
def rationale_text(t):
    reasons = F.when(col("p_size") > 25, F.array(F.lit("big"), col("p_size").cast("string"))).otherwise(F.array().cast("array<string>"))
    return t("part").select("p_partkey", rules.rationale(col("p_brand"), col("p_type"), col("p_name"), reasons).alias("why"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, p_type AS location, p_brand AS department FROM part")
def board_payloads(t):
    name, m = col("p_partkey").cast("string"), col("p_partkey") % 3
    green = F.to_json(F.struct(F.array(F.struct(name.alias("id"), col("p_name").alias("title"), F.struct(col("p_type").alias("name")).alias("location"), F.array(F.struct(col("p_brand").alias("name"))).alias("departments"))).alias("jobs")))
    lever = F.to_json(F.array(F.struct(name.alias("id"), col("p_name").alias("text"), F.struct(col("p_type").alias("location"), col("p_brand").alias("team")).alias("categories"))))
    ashby = F.to_json(F.struct(F.array(F.struct(name.alias("id"), col("p_name").alias("title"), F.lit("").alias("location"), col("p_type").alias("locationName"), col("p_brand").alias("department"))).alias("jobs")))
    parts, out = t("part"), None
    for i, (body, parse) in enumerate(((green, payloads.greenhouse), (lever, payloads.lever), (ashby, payloads.ashby))):
        rows = parse(parts.where(m == i).select(F.lit("s").alias("source_id"), F.lit("c").alias("company"), body.alias("body"))).select("external_id", "title", "location", "department")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, p_type AS description FROM part")
def feed_items(t):
    def tag(name, c):
        return F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))

    body = F.concat(F.lit("<rss><channel><item>"), tag("guid", col("p_partkey")), tag("title", col("p_name")), tag("description", col("p_type")), F.lit("</item></channel></rss>"))
    return payloads.rss(t("part").select(F.lit("s").alias("source_id"), body.alias("body"))).select("external_id", "title", "description")


@query("""SELECT page_id, pos, regexp_extract(item, '(?is)href="([^"]*)"', 1) AS link, regexp_extract(item, '(?is)>([^<]*)</a>', 1) AS label
    FROM (SELECT page_id, unnest(i) AS item, CAST(unnest(range(0, len(i))) AS INT) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li>.*?</li>') AS i FROM pages))""")
def html_wrapper(t):
    out = payloads.html_items(t("pages").select(col("page_id").alias("source_id"), col("html").alias("body")), r"<li>.*?</li>", {"link": 'href="([^"]*)"', "label": ">([^<]*)</a>"})
    return out.withColumnRenamed("source_id", "page_id")


def signal_sql() -> str:
    """DuckDB SQL for the points of made postings, from the same tables of terms."""
    title = "CASE p_size % 3 WHEN 0 THEN 'ai policy lead' WHEN 1 THEN 'sales intern' ELSE 'office keeper' END"
    role, context = f"({title} || ' ' || lower(p_type) || '  ')", "(lower(p_brand) || ' ' || lower(p_name))"
    parts = [f"CASE WHEN {has(role, t)} THEN {float(p)}::DOUBLE WHEN {has(context, t)} THEN {max(4, p * 0.4) * 1.0}::DOUBLE ELSE 0 END" for t, p in SIGNAL_TERMS.items()]
    parts += [f"CASE WHEN contains(lower(p_brand), '{t}') OR contains({context}, '{t}') THEN {float(p)}::DOUBLE ELSE 0 END" for t, p in BRAND_TERMS.items()]
    minus = [f"CASE WHEN {has(title, t)} THEN {float(p)}::DOUBLE ELSE 0 END" for table in (LOW_SIGNAL_TERMS, SENIOR_TERMS) for t, p in table.items()]
    return "45.0::DOUBLE + " + " + ".join(parts) + " - " + " - ".join(minus) + " + CASE WHEN p_size % 2 = 0 THEN 8.0::DOUBLE ELSE 0 END"


@query(f"""WITH s AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS stable_key, {signal_sql()} AS points FROM part),
    c AS (SELECT stable_key, least(100.0::DOUBLE, points) AS score, points >= 70 AS include FROM s),
    y AS (SELECT *, false AS filled FROM c WHERE include ORDER BY score DESC, stable_key LIMIT 30), n AS (SELECT *, true AS filled FROM c WHERE NOT include AND score >= 70 ORDER BY score DESC, stable_key LIMIT 25),
    r AS (SELECT *, row_number() OVER (ORDER BY filled, score DESC, stable_key) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM n))
    SELECT stable_key, score, include, filled, rank, CASE WHEN filled THEN 'deterministic_fallback,score_threshold_fill' ELSE 'deterministic_fallback' END AS flags FROM r WHERE (NOT filled AND rank <= 30) OR rank <= least(25, (SELECT count(*) FROM part))""")
def deterministic_rank(t):
    title = F.expr("CASE p_size % 3 WHEN 0 THEN 'AI policy lead' WHEN 1 THEN 'Sales intern' ELSE 'Office keeper' END")
    city = F.when(col("p_size") % 2 == 0, F.lit(places.PLACES[0])).otherwise("Nowhere")
    none = F.lit("")
    posted = t("part").select(F.lpad(col("p_partkey").cast("string"), 12, "0").alias("stable_key"), title.alias("title"), col("p_brand").alias("company"), col("p_type").alias("department"), none.alias("employment_type"), F.array().cast("array<string>").alias("tags"), col("p_name").alias("description_text"), city.alias("city"))
    out = ranking.by_points(posted, 25, 30)
    return out.select("stable_key", "score", "include", "filled", "rank", F.array_join("risk_flags", ",").alias("flags"))


@query("SELECT doc_id AS id, text, 'documents' AS kind FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def enabled_union(t):
    a = t("documents").where(col("source").isin("src0", "src1")).select(col("doc_id").alias("id"), "text", F.lit("documents").alias("kind"))
    return a.unionByName(t("benchmark").select(col("item_id").alias("id"), "text", F.lit("benchmark").alias("kind")))
