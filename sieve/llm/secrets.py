"""Secret scans, in DataFrame functions only: rule patterns, and Markov models of characters.

The rules are three patterns.  The models are first-order Markov chains over characters, one trained on samples
labelled random (1), one on samples labelled ordinary (0): samples made by a rule, and tokens of the corpus, those in rule
spans (1) and plain words and numbers outside them (0).  A token's score is the mean log-likelihood ratio of its
transitions.  Tokens are runs of key characters not next to a letter or digit; those that score ``least_score`` and
overlap no rule span become spans of kind ``markov``.  A token that scores less, say a key behind a readable prefix, is
searched for runs: the sum of ratios grows from 0 to its highest and ends where it is back at 0 or DROP below that.  A
run, widened to the ``= / _ -`` about it, is a span if it is TOKEN_LEAST long and it or its run scores ``least_score``.
Positions are code points, ends exclusive.  Matches are gathered in blocks of BLOCK, as an array that grows by one is
copied each time: the work grows with the 1.5th power of a text's matches at most.

Nulls: a null text is an empty one, without spans; null ids and repeated rows come back as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rule patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
TOKEN = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-]{16,}(?![\p{L}\p{N}])"
SAMPLED = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-]{8,}(?![\p{L}\p{N}])"
LEAST_SCORE = 0.75
TOKEN_LEAST = 16
# How far a run's sum may fall before it ends, and its least transitions.
DROP, RUN_LEAST = 10.0, 11

BLOCK = 64
#: About as many documents of the corpus give samples to train on, picked by a hash.
SAMPLE_DOCS = 2000

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Ordinary words of four languages, from which identifiers are put together.
ORDINARY = """
about account action address after again agent amount answer archive array author average balance before begin between
binary block border branch buffer button cache cancel change channel check child class client close cluster column
command comment commit common config connection constant content context control counter country create current
customer daily database default delete description detail device directory distance document double download driver
element email enable encode entity error event example exception execute export extra factory field filter first float
folder format function gateway general generate global group handler header height history image import index input
insert instance integer interface internal invoice iterator label language large layer length letter level library limit
listener local location manager mapping master matrix measure member memory message method minute model module month
network number object offset operation option order output package parameter parent parser partition path pattern
payment people pixel place platform point policy position prefix previous price printer process product profile project
property protocol provider public query queue random range reader reason record reference region register release
remote render report request resource response result return review right round route sample schema screen script search
second section select sender sequence server service session setting shape shared signal simple single source special
stack standard start state status storage stream string structure style subject suffix support switch symbol system table
target task template temporary text thread threshold ticket time title total transaction transfer tree trigger type
under union unique update upload user value variable vector version view visible volume warning weight widget width window
worker write year entwicklung verbindung einstellung zeichenkette sprache zwischen geschichte wirtschaft gesellschaft
verantwortung moeglichkeit unterschied entscheidung bedeutung wissenschaft arbeitsplatz informacion desarrollo
administracion conocimiento universidad comunicacion aplicacion siguiente necesario gobierno developpement connaissance
gouvernement environnement utilisateur parametre fonctionnement bibliotheque evenement traitement
""".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(label, text): n random strings (1; base64, hex and capitals from digests) and n ordinary identifiers and numbers (0).

    A rule makes them, so training is the same everywhere and its cost is bounded by ``n``.
    """
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    random = F.expr("CASE id % 3 WHEN 0 THEN b WHEN 1 THEN substring(d, 1, 40) ELSE upper(translate(substring(b, 1, 32), '+/=', 'XYZ')) END")
    ones = rows.select("id", digest.alias("d"), base64.alias("b")).select(F.lit(1).alias("label"), random.alias("text"))
    words = f"split('{' '.join(ORDINARY)}', ' ')"
    pick = [f"element_at({words}, cast(pmod(xxhash64(id, {k}), {len(ORDINARY)}) as int) + 1)" for k in range(4)]
    a, b, c, d = pick
    made = f"""CASE id % 7 WHEN 0 THEN concat_ws('_', {a}, {b}, {c}) WHEN 1 THEN concat({a}, initcap({b}), initcap({c}))
        WHEN 2 THEN concat_ws('-', {a}, {b}, {c}) WHEN 3 THEN upper(concat_ws('_', {a}, {b})) WHEN 4 THEN concat_ws('/', {a}, {b}, {c}, {d})
        WHEN 5 THEN lpad(cast(pmod(xxhash64(id, 9), 10000000000000000L) as string), 16, '0')
        ELSE concat(initcap({a}), {b}, {c}) END"""
    return ones.union(rows.select(F.lit(0), F.expr(made)))


def train(samples: DataFrame, alphabet: str = ALPHABET) -> list[float]:
    """Log-likelihood ratios of transitions, row by row: ln P(b | a, random) - ln P(b | a, ordinary).

    Counted in Spark; what comes to the driver is at most two counts per pair of characters of the alphabet.
    Null texts, null labels and characters outside the alphabet are passed over; unseen transitions count a half.
    """
    chars = samples.where("text IS NOT NULL AND label IN (0, 1)").select("label", F.split("text", "").alias("c"))
    pairs = chars.select("label", F.explode(F.expr("zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> concat(a, b))")).alias("p"))
    counts = {(r["label"], r["p"]): r["n"] for r in pairs.where(F.col("p").rlike(f"^[{alphabet[:-1]}-]{{2}}$")).groupBy("label", "p").agg(F.count("*").alias("n")).collect()}
    rows = [[{b: counts.get((label, a + b), 0) + 0.5 for b in alphabet} for a in alphabet] for label in (0, 1)]
    return [math.log(one[b] / sum(one.values())) - math.log(zero[b] / sum(zero.values())) for zero, one in zip(*rows, strict=True) for b in alphabet]


def corpus_samples(df: DataFrame, *, text_col: str = "text", most_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(label, text) from about ``most_docs`` rows: tokens inside rule spans (1), plain words and numbers outside them (0).

    Rows are picked by a hash of all their columns (but maps), so that of many rows with one text only some are.

    Only letters of one case, a capital before them, or digits count as plain, so keys that no rule finds teach nothing.
    """
    n = df.count()
    texts = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))).alias("spread")).where("text IS NOT NULL")
    texts = texts.where(F.pmod("spread", F.lit(1 << 20)) < F.lit(min(1.0, most_docs / max(n, 1)) * (1 << 20)))
    rows = texts.select(F.expr(f"concat({_found(ASSIGN, 0, ASSIGN_LEAST)}, {_found(ACCESS, 1)}, {_found(HEX, 2)})").alias("base"), F.expr(_found(SAMPLED, 3, text=True)).alias("tokens"))
    # labelled inside the array, bound once, so that no token carries its text's spans along
    labelled = f"transform(z.tokens, t -> named_struct('label', CAST({_overlaps('t', 'z.blocks')} AS int), 'text', t.x))"
    plain = "x -> x.label = 1 OR x.text RLIKE '^([A-Z]?[a-z]+|[A-Z]+|[0-9]+)$'"
    bound = f"transform(array(named_struct('tokens', tokens, 'blocks', {_blocks('base')})), z -> filter({labelled}, {plain}))[0]"
    return rows.select(F.explode(F.expr(bound)).alias("s")).select("s.label", "s.text")


def _quoted(pattern: str) -> str:
    return "r\"" + pattern.replace('"', "\\x22") + "\""


def _found(pattern: str, order: int, least: int = 0, text: bool = False) -> str:
    """SQL for an array of (start, end, kind[, x]) of a pattern's matches, from the lengths of what lies between them."""
    p = _quoted(pattern)
    value = f"regexp_extract_all(text, {p}, 2)" if least else "cast(null as array<string>)"
    kind = "struct<start:bigint,end:bigint,kind:int" + ",x:string" * text + ">"
    span = f"named_struct('start', t.at + length(w.g[i - 1]), 'end', t.at + length(w.g[i - 1]) + length(w.m[i - 1]), 'kind', {order}" + ", 'x', w.m[i - 1]" * text + ")"
    more = f"concat(t.out, array({span}))"
    if least:
        more = f"if(length(w.v[i - 1]) < {least}, t.out, {more})"
    block = f"""aggregate(sequence(k * {BLOCK} + 1, least(size(w.m), (k + 1) * {BLOCK})), named_struct('at', s.at, 'out', cast(array() as array<{kind}>)),
        (t, i) -> named_struct('at', t.at + length(w.g[i - 1]) + length(w.m[i - 1]), 'out', {more}))"""
    blocks = f"""flatten(aggregate(sequence(0, (size(w.m) - 1) div {BLOCK}), named_struct('at', 0L, 'out', cast(array() as array<array<{kind}>>)),
        (s, k) -> transform(array({block}), c -> named_struct('at', c.at, 'out', concat(s.out, array(c.out))))[0], s -> s.out))"""
    # one let-binding, so that each regex runs once
    parts = f"named_struct('m', regexp_extract_all(text, {p}, 0), 'g', split(text, {p}, -1), 'v', {value})"
    return f"CASE WHEN text RLIKE {p} THEN element_at(transform(array({parts}), w -> {blocks}), 1) ELSE cast(array() as array<{kind}>) END"


def _blocks(spans: str) -> str:
    """SQL for the spans in blocks, each with its least start and greatest end."""
    cut = f"transform(if(size({spans}) = 0, cast(array() as array<int>), sequence(0, cast((size({spans}) - 1) div {BLOCK} as int))), k -> slice({spans}, k * {BLOCK} + 1, {BLOCK}))"
    return f"transform({cut}, q -> named_struct('low', array_min(transform(q, b -> b.start)), 'high', array_max(transform(q, b -> b.end)), 'of', q))"


def _overlaps(span: str, blocks: str = "blocks") -> str:
    """SQL for whether a span overlaps one of ``blocks``."""
    return f"exists({blocks}, q -> q.low < {span}.end AND {span}.start < q.high AND exists(q.of, b -> b.start < {span}.end AND {span}.start < b.end))"


def _steps(ratios: tuple[float, ...], alphabet: str, token: str) -> str:
    """SQL for the log-likelihood ratios of a token's transitions."""
    code = [alphabet.find(chr(i)) for i in range(128)]
    codes = f"cast(split('{','.join(map(str, code))}', ',') as array<int>)"
    table = f"cast(split('{','.join(f'{x:.4f}' for x in ratios)}', ',') as array<double>)"
    k = len(alphabet)
    chars = f"transform(split({token}, ''), c -> {codes}[ascii(c)])"
    return f"transform(array({chars}), c -> zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> {table}[a * {k} + b]))[0]"


def _mean(steps: str, first: str = "0", n: str | None = None) -> str:
    """SQL for the mean of ``n`` steps from ``first`` on; of all without ``n``."""
    part = steps if n is None else f"slice({steps}, cast({first} as int) + 1, cast({n} as int))"
    return f"(aggregate({part}, 0D, (s, x) -> s + x) / size({part}))"


def _runs(token: str, steps: str, least_score: float) -> str:
    """SQL for the (a, b) of a token's runs that are spans, from its first character to beyond its last."""
    closed = f"if(s.top > 0 AND s.b - s.a >= {RUN_LEAST}, concat(s.out, array(named_struct('a', s.a, 'b', s.b))), s.out)"
    fresh = "'sum', 0D, 'top', 0D, 'a', s.i + 1, 'b', s.i + 1"
    runs = f"""aggregate({steps}, named_struct('i', 0, 'sum', 0D, 'top', 0D, 'a', 0, 'b', 0, 'out', cast(array() as array<struct<a:int,b:int>>)),
        (s, x) -> CASE WHEN s.sum + x <= 0 OR s.sum + x < s.top - {DROP} THEN named_struct('i', s.i + 1, {fresh}, 'out', {closed})
            WHEN s.sum + x > s.top THEN named_struct('i', s.i + 1, 'sum', s.sum + x, 'top', s.sum + x, 'a', s.a, 'b', s.i + 1, 'out', s.out)
            ELSE named_struct('i', s.i + 1, 'sum', s.sum + x, 'top', s.top, 'a', s.a, 'b', s.b, 'out', s.out) END,
        s -> {closed})"""
    left = f"length(regexp_replace(substring({token}, 1, r.a), '[^=/_-]+$', ''))"
    right = f"r.b + 1 + length(regexp_extract(substring({token}, r.b + 2), '^[^=/_-]*', 0))"
    wide = f"transform({runs}, r -> named_struct('a', {left}, 'b', {right}, 'score', {_mean(steps, 'r.a', 'r.b - r.a')}, 'long', r.b - r.a + 1))"
    good = f"(w.long >= {TOKEN_LEAST} AND w.score >= {least_score} OR {_mean(steps, 'w.a', 'w.b - w.a - 1')} >= {least_score})"
    return f"array_distinct(transform(filter({wide}, w -> w.b - w.a >= {TOKEN_LEAST} AND {good}), w -> named_struct('a', w.a, 'b', w.b)))"


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, least_score: float = LEAST_SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, base, found) of every row and the columns of ``keep``.

    base and found, those of the rules and all: arrays of (start, end, kind) in order, kind a place in KINDS.  Without
    ``samples`` the models train on those made by a rule and on a bounded number of the corpus's own.
    """
    if samples is None:
        samples = labelled_samples(df.sparkSession).union(corpus_samples(df, text_col=text_col))
    ratios = tuple(train(samples))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    base = rows.select(*rows.columns, F.expr(f"array_sort(concat({_found(ASSIGN, 0, ASSIGN_LEAST)}, {_found(ACCESS, 1)}, {_found(HEX, 2)}))").alias("base"), F.expr(_found(TOKEN, 3, text=True)).alias("tokens"))
    whole = "array(named_struct('a', 0, 'b', length(y.x)))"
    parts = f"CASE WHEN {_mean('y.l')} >= {least_score} THEN {whole} ELSE {_runs('y.x', 'y.l', least_score)} END"
    bound = f"transform(transform(array(t.x), x -> named_struct('x', x, 'l', {_steps(ratios, ALPHABET, 'x')})), y -> {parts})[0]"
    spans = f"flatten(transform(tokens, t -> transform({bound}, p -> named_struct('start', t.start + p.a, 'end', t.start + p.b, 'kind', t.kind))))"
    # the blocks are bound, as a column of a projection below would be made again for each span
    extra = f"CASE WHEN size(tokens) > 0 THEN transform(array({_blocks('base')}), blocks -> filter({spans}, p -> NOT {_overlaps('p')}))[0] ELSE array() END"
    return base.select("doc_id", "text", "base", F.expr(f"array_sort(concat(base, {extra}))").alias("found"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def _listed(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')"


def secret_spans(df: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row."""
    count = [F.expr(f"cast(size(filter(found, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return scan(df, **options).select("doc_id", *count, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("found")).alias("spans"))


def redacted(found: str = "found", mark: str = "[secret]") -> str:
    """SQL for the text with each span, or run of overlapping spans, replaced by a mark.

    The text is cut once a block of spans, as cutting walks it from its start.
    """
    spans = "array<struct<start:bigint,end:bigint,kind:int>>"
    inner = f"""aggregate(c.of, named_struct('at', s.at, 'out', cast(array() as array<string>)),
        (t, x) -> CASE WHEN x.start >= t.at THEN named_struct('at', x.end, 'out', concat(t.out, array(substring(c.part, cast(t.at - s.at as int) + 1, cast(x.start - t.at as int)), '{mark}')))
            ELSE named_struct('at', greatest(t.at, x.end), 'out', t.out) END,
        t -> named_struct('at', t.at, 'out', array_join(t.out, '')))"""
    fold = f"""aggregate({_blocks(f"cast({found} as {spans})")}, named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (s, q) -> transform(transform(array(named_struct('of', q.of, 'part', substring(text, cast(s.at as int) + 1, cast(greatest(0L, q.high - s.at) as int)))), c -> {inner}),
            d -> named_struct('at', d.at, 'out', concat(s.out, array(d.out))))[0],
        s -> concat(array_join(s.out, ''), substring(text, cast(s.at as int) + 1)))"""
    return f"CASE WHEN size({found}) = 0 THEN text ELSE {fold} END"
