"""Document fingerprints: consistent weighted sampling, in DataFrame functions only.

A document is its words, each weighted by how often it occurs.  For every sample i and word k hashes of (k, i) give
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with weight S, t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r.
The word with the least a, together with its t, is the sample.  Two documents get the same sample with a probability
equal to their generalised Jaccard similarity, sum of min(S, S') over sum of max(S, S').

The gammas come from tables of quantiles, a cell of which is found by bit operations: a hash's trailing zeros choose the
octave of the tail (2^-1 to 2^-24), five bits the place inside it, so both tails are fine where the least a is decided.
b has 32 bits, so ties stay as rare as before.  A logarithm a sample would cost three times as much as all of this.

``ln a`` (36 bits) and 26 bits of (k, t) share one long, so a sample is one ``min`` of a fixed-width buffer inside
generated code, and the terms of a document are counted before.  A term that weighs as much in a text as in its edit
is sampled once for both.  Nothing but the texts is shuffled by size.

Nulls: a null text is an empty one; a text without words has the one term "".  A null id comes last in descending
order.  Rows that share an id follow one another by text, so each row has one next row, repeated rows too.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for

SAMPLES = 128
#: Samples of one aggregate; the shorter its generated code, the better it is compiled.
AT_ONCE = 8
#: Octaves of a table of quantiles, and cells in each (a power of two).
OCTAVES, CELL_BITS = 24, 5
#: Most cuts of the id range: what the driver holds for neighbours is this many ids.
MOST_CUTS = 65_536
WHITE = "\\u0020\\u0009\\u000a\\u000b\\u000c\\u000d"


def words_of(text: str) -> str:
    """SQL for the words of a text; [''] if it has none."""
    return f"split(trim(BOTH '{WHITE}' FROM {text}), '[\\\\x20\\\\x09-\\\\x0D]+')"


@lru_cache(maxsize=1)
def quantiles() -> tuple[list[float], list[float]]:
    """r exceeded with probability v, and ln of the c not reached with probability v, of Gamma(2, 1), at the middle v of each cell."""
    octave, cell = np.divmod(np.arange(OCTAVES << CELL_BITS), 1 << CELL_BITS)
    v = 2.0 ** -(octave + 1.0) * (1 + (cell + 0.5) / (1 << CELL_BITS))

    def solved(share) -> np.ndarray:
        low, high = np.zeros(len(v)), np.full(len(v), 64.0)
        for _ in range(80):
            x = (low + high) / 2
            less = share(x) < 0
            low, high = np.where(less, x, low), np.where(less, high, x)
        return (low + high) / 2

    r = solved(lambda x: v - (1 + x) * np.exp(-x))
    c = solved(lambda x: -np.expm1(-x) - x * np.exp(-x) - v)
    return r.tolist(), np.log(c).tolist()


def key_of(i: int) -> int:
    """A fixed odd pattern of bits for the i-th hash of a term."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 27) - (1 << 63)


def cell_of(bits: Column) -> Column:
    """The cell of a table that the low 32 bits of a hash choose."""
    low = bits.bitwiseAND(F.lit((1 << OCTAVES - 1) - 1)).bitwiseOR(F.lit(1 << OCTAVES - 1))
    octave = F.bit_count(F.bitwise_not(low).bitwiseAND(low - F.lit(1)))
    return F.shiftleft(octave, CELL_BITS).bitwiseOR(F.shiftrightunsigned(bits, OCTAVES).bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int"))


def sample(i: int) -> Column:
    """ln a and bits of (term, t) of sample i of a group in one long; the least over a document's terms is its sample."""
    h, g = (F.xxhash64(F.col("_g").bitwiseXOR(F.lit(key_of(2 * i + k)))) for k in (0, 1))
    r, ln_c = F.col("_r")[cell_of(h)], F.col("_c")[cell_of(F.shiftrightunsigned(h, 32))]
    b = F.shiftrightunsigned(g, 32).cast("double") * (1.0 / (1 << 32))
    t = F.floor(F.col("_ln") / r + b)
    ln_a = ln_c - r * (t - b) - r
    tag = F.col("_h").bitwiseXOR(t).bitwiseAND(F.lit((1 << 26) - 1))
    return F.shiftleft(((ln_a + 128.0) * float(1 << 28)).cast("long"), 26).bitwiseOR(tag)


def least_samples(terms: DataFrame, keys: list[str], term: str = "term", weight: str = "weight", samples: int = SAMPLES) -> DataFrame:
    """keys, _group and the least of each of its samples, _0 to _7, from rows of keys, term and a weight above 0."""
    # the condition keeps the optimizer from writing a table into every place where it is used
    tables = {}
    for name, table in zip(("_r", "_c"), quantiles(), strict=True):
        listed = ",".join(f"{x!r}D" for x in table)
        tables[name] = F.expr(f"if(_g = 0, array({listed},0D), array({listed}))")
    groups = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // AT_ONCE) - 1))).alias("_group")
    rows = terms.select(*keys, F.xxhash64(term).alias("_h"), F.ln(F.col(weight).cast("double")).alias("_ln"))
    rows = rows.select("*", groups).withColumn("_g", F.xxhash64("_h", "_group")).withColumns(tables)
    return rows.groupBy(*keys, "_group").agg(*(F.min(sample(i)).alias(f"_{i}") for i in range(AT_ONCE)))


def joined(least: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, signature (array of ``samples`` ints) from the groups of least samples."""
    some = least.select(*keys, F.struct("_group", F.array(*(F.shiftright(F.xxhash64(f"_{i}"), 32).cast("int") for i in range(AT_ONCE))).alias("part")).alias("_some"))
    whole = some.groupBy(*keys).agg(F.sort_array(F.collect_list("_some")).alias("_all"))
    return whole.select(*keys, F.slice(F.flatten(F.col("_all.part")), 1, samples).alias("signature"))


def signatures(terms: DataFrame, keys: list[str], term: str = "term", weight: str = "weight", samples: int = SAMPLES) -> DataFrame:
    """keys, signature (array of ``samples`` ints) from rows of keys, term and a weight above 0."""
    return joined(least_samples(terms, keys, term, weight, samples), keys, samples)


def likeness(a: str, b: str) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), x -> x)) / cast(size({a}) as double)")


def written(signature: str) -> Column:
    return F.expr(f"array_join(transform({signature}, x -> lpad(lower(hex(bigint(x) & 4294967295L)), 8, '0')), '')")


def fingerprints(df: DataFrame, *, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    terms = rows.select("doc_id", "row", F.expr(f"explode({words_of('text')})").alias("term")).withColumn("term", F.xxhash64("term")).groupBy("doc_id", "row", "term").agg(F.count("*").alias("weight"))
    return signatures(terms, ["doc_id", "row"], samples=samples).select("doc_id", written("signature").alias("fingerprint"))


def range_of(column: str, cuts: list[float]) -> str:
    """SQL for the number of cuts that a value reaches: first among every n-th cut, then among the n that follow."""
    if not cuts:
        return "0"
    n = math.isqrt(len(cuts)) + 1
    first, every = (f"cast(split('{','.join(map(repr, some))}', ',') as array<double>)" for some in (cuts[::n], cuts))
    rest = f"size(filter(slice({every}, (i - 1) * {n} + 1, {n}), x -> x <= {column}))"
    inside = f"transform(array(size(filter({first}, x -> x <= {column}))), i -> if(i = 0, 0, (i - 1) * {n} + {rest}))"
    return f"({inside})[0]"


def beside_next(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the text of the next row in descending doc_id; after the last comes the first.

    Ids are cut into ranges of like counts, one task each; the first row of every range is also laid at the end of
    the range before it, so no window spans the table.  Columns: part, place, ghost, doc_id, text, next_text.
    """
    n = max(2, buckets_for(df, 1 << 20))
    k = min(MOST_CUTS, n - 2)
    points = [i / (k + 1) for i in range(1, k + 1)]
    cuts = sorted(set(df.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", points, 0.2 / k))) if k else []
    below = F.expr(f"CASE WHEN doc_id IS NULL THEN 0 ELSE 1 + {range_of('cast(doc_id as double)', cuts)} END").cast("int")
    rows = df.select(below.alias("part"), "doc_id", "text")
    heads = sorted(((r["part"], r["id"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("id")).collect()), reverse=True)
    small = [(*head, heads[i - 1][0]) for i, head in enumerate(heads)]  # as many rows as ranges
    small = df.sparkSession.createDataFrame(small, "part int, head long, to int")
    ghosts = rows.join(F.broadcast(small), "part").where("doc_id <=> head").select(F.col("to").alias("part"), "doc_id", "text")
    both = rows.withColumn("ghost", F.lit(False)).union(ghosts.withColumn("ghost", F.lit(True))).repartitionById(len(cuts) + 2, "part")
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumns({"place": F.row_number().over(order), "next_text": F.coalesce(F.lead("text").over(order), F.lit(""))})


def edited_fingerprints(df: DataFrame, *, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edit, whose last third of code points is as many of the next document's first.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    third = "cast(floor(length(text) / 3) as int)"
    edited = f"concat(substring(text, 1, length(text) - {third}), substring(next_text, 1, {third}))"
    rows = beside_next(docs).select("part", "place", "ghost", "doc_id", "text", F.expr(edited).alias("edited"))
    both = rows.select("part", "place", F.expr("explode(if(ghost, array(struct(0 as side, text)), array(struct(0 as side, text), struct(1 as side, edited as text)))) as of"))
    terms = both.select("part", "place", "of.side", F.expr(f"explode({words_of('of.text')})").alias("term")).select("part", "place", "side", F.xxhash64("term").alias("term"))
    terms = terms.groupBy("part", "place", "term").agg(F.sum(F.lit(1) - F.col("side")).alias("n0"), F.sum("side").alias("n1"))
    # 0 the text's own terms, 1 those of the edit, 2 those that weigh the same in both
    sides = "CASE WHEN n0 = n1 THEN array(struct(2 as which, n0 as weight)) WHEN n1 = 0 THEN array(struct(0 as which, n0 as weight)) WHEN n0 = 0 THEN array(struct(1 as which, n1 as weight)) ELSE array(struct(0 as which, n0 as weight), struct(1 as which, n1 as weight)) END"
    terms = terms.select("part", "place", "term", F.expr(f"explode({sides}) as of")).select("part", "place", "term", "of.which", "of.weight")
    least = least_samples(terms, ["part", "place", "which"], samples=samples)
    least = least.withColumn("side", F.expr("explode(if(which = 2, array(0, 1), array(which)))"))
    least = least.groupBy("part", "place", "side", "_group").agg(*(F.min(f"_{i}").alias(f"_{i}") for i in range(AT_ONCE)))
    found = joined(least, ["part", "place", "side"], samples)
    order = Window.partitionBy("part").orderBy("place", "side")
    found = found.withColumns({"e": F.lead("signature", 1).over(order), "n": F.lead("signature", 2).over(order)}).where("side = 0")
    found = found.select(F.col("part").alias("p"), F.col("place").alias("q"), written("signature").alias("fingerprint"), written("e").alias("edited_fingerprint"), likeness("signature", "e").alias("near_edited"), likeness("signature", "n").alias("near_next"))
    facts = rows.where("NOT ghost").select("part", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(found, F.expr("part = p AND place = q")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
