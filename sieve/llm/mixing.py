"""Mixing sources to target weights, in DataFrame functions only: a time-varying curriculum.

Every source has a weight schedule over training time 0..1, here a line from ``start`` to ``end`` times its share.  Its
integral is the source's cumulative demand; inverting it at a document's place in its source gives the document's
training position, and documents are range-sorted by position.  A document read more than once has a place, and so a
position, for every read: the i-th time through, all of its source has gone before it i times.

Targets are a water level: each source gets ``weight * level`` words, capped at ``most_epochs`` times its size, the
level such that the targets make up ``share`` of all words.  Within a source documents follow a hash of id and text;
those before the target's remainder are taken once more than the rest, the one at the edge in part.

Places in a source are prefix sums in two steps, over hash ranges and inside each, so a source that holds a third of
all rows is spread over as many windows as there are ranges.  What is gathered by source alone is one row a source.

Nulls: a null text has size 0; a null source is a source, the last one; a null id is a document like any other.
Repeated rows share the hash and follow in any order, which does not change what any of them takes in sum.  Empty
tables give none; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for

# Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2
#: Relative weight of a source at the start and the end of training, by its place modulo three.
SCHEDULE = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def size_of(text: str) -> Column:
    """Words of a text; 0 for null.  Counts the ends of words without building them."""
    return F.coalesce(F.expr(rf"cast(length(regexp_replace(text, r'[^\x20\x09-\x0D]+[\x20\x09-\x0D]*', '.')) - if(text RLIKE r'^[\x20\x09-\x0D]', length(regexp_extract(text, r'^[\x20\x09-\x0D]+', 0)), 0) as bigint)".replace("text", text)), F.lit(0).cast("long"))


def targets(sizes: DataFrame, *, share: float = SHARE, most_epochs: float = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, ordinal, target) from (source, source_size), one row a source."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("ordinal")
    rows = sizes.select("source", "source_size", place)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight)
    # sources fill up in order of cap / weight; before and after say what is capped and what shares the rest
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "ordinal")
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    level = (F.col("total") * share - F.col("capped") * most_epochs) / F.col("open")
    fits = F.when(level * F.col("weight") <= F.col("source_size") * most_epochs, F.struct(F.col("source_size") / F.col("weight"), "ordinal", level.alias("level")))
    rows = rows.withColumn("fits", fits)
    level = F.min("fits").over(Window.partitionBy())["level"]
    cap = (F.col("source_size") * most_epochs).cast("double")
    return rows.select("source", "source_size", "weight", "ordinal", F.coalesce(F.least(cap, level * F.col("weight")), cap).alias("target"))


def _mixed(df: DataFrame, *, share: float = SHARE, most_epochs: float = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS, schedule: tuple[tuple[float, float], ...] = SCHEDULE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, _reads) of every row, and the columns of ``keep`` as _keep_ and their names.

    _reads has one (read, words, position) for each time the document is read, in order.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("source"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    spread = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("_text", F.lit("")))))
    # a key without null, so that windows and joins share one shuffle
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = rows.select("doc_id", "source", key.alias("key"), size_of("_text").alias("size"), spread.alias("spread"), *(f"_keep_{c}" for c in keep))
    n = buckets_for(df, 64 << 20)
    digits = max(2, len(f"{4 * n:x}"))
    rows = rows.withColumn("part", F.substring("spread", 1, digits))
    parts = rows.groupBy("key", "source", "part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    wanted = targets(sizes, share=share, most_epochs=most_epochs, weights=weights)
    up = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "source", "part", F.coalesce(F.sum("part_size").over(up), F.lit(0)).alias("before"))
    parts = parts.alias("p").join(wanted.alias("t"), F.expr("p.source <=> t.source")).select("p.key", "p.part", "before", "source_size", "target", "ordinal")
    inside = Window.partitionBy("key", "part").orderBy("spread", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.alias("r").join(parts.alias("p"), F.expr("r.key = p.key AND r.part = p.part"))
    start = F.col("before") + F.col("within")

    def epoch(i: int) -> Column:
        left = F.floor("target") - F.col("source_size") * i - start
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))

    # demand(t) = (a t + (b - a) t^2 / 2) / ((a + b) / 2), inverted at the read's share of the target
    a, b = (F.element_at(F.array(*(F.lit(float(s[k])) for s in schedule)), (F.col("ordinal") % len(schedule) + 1).cast("int")) for k in (0, 1))

    def read(i: int) -> Column:
        u = F.least(F.lit(1.0), (start + F.col("source_size") * i) / F.col("target"))
        position = F.when(a == b, u).otherwise((F.sqrt(a * a + (b * b - a * a) * u) - a) / (b - a))
        return F.when(epoch(i) > 0, F.struct(F.lit(i).alias("read"), epoch(i).cast("long").alias("words"), position.alias("position")))

    epochs = range(max(1, -int(-most_epochs // 1)))
    taken = sum((epoch(i) for i in epochs[1:]), epoch(0))
    reads = F.array_compact(F.array(*(read(i) for i in epochs)))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), reads.alias("_reads"), *(f"_keep_{c}" for c in keep))


def _kept(keep: tuple[str, ...]) -> list[Column]:
    return [F.col(f"_keep_{c}").alias(c) for c in keep]


def mix_sources(df: DataFrame, *, keep: tuple[str, ...] = (), every_position: bool = False, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every row, and the columns of ``keep``.

    position is where in training (0..1) the document is first read; null for documents that are not taken.
    ``every_position`` adds positions, those of all its reads.
    """
    every = [F.col("_reads.position").alias("positions")] * every_position
    return _mixed(df, keep=keep, **options).select("doc_id", "size", "source_size", "target", "taken", F.expr("try_element_at(_reads, 1).position").alias("position"), *every, *_kept(keep))


def mixed_reads(df: DataFrame, *, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, size, source_size, target, read, words, position) of every time a row is read, and the columns of ``keep``.

    read counts from 0; words are those taken in this read, less than size where the target ends inside the document.
    """
    return _mixed(df, keep=keep, **options).withColumn("_read", F.explode("_reads")).select("doc_id", "size", "source_size", "target", "_read.read", "_read.words", "_read.position", *_kept(keep))


def in_training_order(mixed: DataFrame, partitions: int, *, untaken: bool = False) -> DataFrame:
    """Documents or reads range-sorted by training position; those that are not taken left out, or last if ``untaken``."""
    order = F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()
    return (mixed if untaken else mixed.where("position IS NOT NULL")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
