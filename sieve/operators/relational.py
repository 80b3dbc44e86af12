"""Row-set operators: first-wins, caps, fills, anti joins, upserts, rollups.

Every operator that depends on order takes it as columns; none uses the order in which rows happen to arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the per-key limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, group: Column | str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; cut before the shuffle too."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def leading(df: DataFrame, value: str, place: str, least: int, most: int) -> DataFrame:
    """(value, n, first): the ``most`` frequent values that occur ``least`` times or more; the first placed wins a tie."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "first").limit(most)


def attach(df: DataFrame, facts: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with the columns of ``facts``, null where it has no row of the key, and whether it has one in ``mark``."""
    rows = df.join(facts.withColumn(mark, F.lit(True)), key, "left")
    return rows.withColumn(mark, F.coalesce(mark, F.lit(False)))


def tally(included: Column, rejected: Column) -> list[Column]:
    """Aggregates of evaluated rows; without rows nothing failed, and yet not all is well."""
    return [
        F.count("*").alias("evaluated"), F.count_if(included).alias("included"), F.count_if(rejected).alias("rejected"),
        F.coalesce(F.bool_or(rejected), F.lit(False)).alias("any_failed"), F.coalesce(F.bool_and(~rejected), F.lit(False)).alias("all_ok"),
    ]


def top(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows in an order that leaves no ties: each task keeps as many, and no more are sorted."""
    return df.orderBy(*order).limit(most)


def per_group_cap(df: DataFrame, group: Column | str, order: list[Column], cap: int, most: int) -> DataFrame:
    """At most ``cap`` rows a group and ``most`` in all, in order, with rank 1..n.

    The cut to ``most`` is a top-k; only its rows are ranked in one place.
    """
    best = top(first_n(df, group, order, cap), order, most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def min_fill(df: DataFrame, score: str, include: str, tie: list[Column], least: int, most: int, threshold: float = 70) -> DataFrame:
    """Included rows by score; if fewer than min(least, most, rows), others from the threshold up fill in, flagged.

    At most ``most`` of each kind can be selected, so both are top-k's before anything is ranked in one place.
    """
    order = [F.col(score).desc(), *tie]
    yes = top(df.where(F.col(include)), order, most).withColumns({"filled": F.lit(False)})
    no = top(df.where(~F.coalesce(F.col(include), F.lit(False)) & (F.col(score) >= threshold)), order, min(least, most)).withColumn("filled", F.lit(True))
    n = df.limit(min(least, most)).count()
    both = yes.unionByName(no).withColumn("rank", F.row_number().over(Window.orderBy("filled", *order)).cast("long"))
    return both.where((~F.col("filled") & (F.col("rank") <= most)) | (F.col("rank") <= n))


def without(df: DataFrame, state: DataFrame, on, residual: Column | None = None) -> DataFrame:
    """Rows whose key the state doesn't hold; with a residual, only where it is true as well."""
    return df.join(state, on if residual is None else on & residual, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key-wise merge; rows of ``new`` win whole."""
    return new.unionByName(old.join(new, key, "left_anti"))


def newest(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of all layers, the last the newest: those of the newest layer that has their key; rows without a key stay.

    The layers above the first are told apart by one window over them alone; the first, the largest, is only probed
    with their keys, which Spark broadcasts where they are few and joins by a shuffle where they are many.
    """
    base, *above = layers
    if not above:
        return base
    rows = above[0].withColumn("_layer", F.lit(0))
    for n, layer in enumerate(above[1:], 1):
        rows = rows.unionByName(layer.withColumn("_layer", F.lit(n)))
    if above[1:]:
        last = F.max("_layer").over(Window.partitionBy(key))
        rows = rows.withColumn("_last", last).where(F.col(key).isNull() | (F.col("_layer") == F.col("_last"))).drop("_last")
    return upsert(base, rows.drop("_layer"), key)


def bounded_fifo(values: Column, most: int, held: Column | None = None) -> Column:
    """Fold: a value present is skipped, else appended, the oldest evicted beyond ``most``."""
    start = held if held is not None else F.array().cast("array<string>")
    return F.aggregate(values, start, lambda s, x: F.when(F.array_contains(s, x), s).otherwise(F.slice(F.array_append(s, x), F.greatest(F.lit(1), F.size(s) + 2 - most), F.lit(most))))


def board_rollup(refs: DataFrame, key: str, at: str, value: str, order: str, most: int) -> DataFrame:
    """first_seen, last_seen and the bounded list of values of each board.

    Values are folded as they come out of the sort, so a board of any size holds ``most`` of them in memory.
    """
    rows = refs.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("string").alias("v"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        board, held, done = None, [], []
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if board is None or k != board:
                    done += [(board, held)] * (board is not None)
                    board, held = k, []
                if v not in held:
                    held = [*held, v][-most:]
            if done:
                yield out(done, batch.schema.field(0))
                done = []
        if board is not None:
            yield out([(board, held)], pa.field("k", board.type))

    def out(done: list, kind: pa.Field) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k.as_py() for k, _ in done], kind.type), pa.array([h for _, h in done], pa.list_(pa.string()))], names=["k", "sample"])

    schema = StructType([rows.schema["k"]]).add("sample", ArrayType(StringType()))
    folded = rows.repartition("k").sortWithinPartitions("k", "o").select("k", "v").mapInArrow(fold, schema)
    seen = refs.groupBy(F.col(key).alias("_k")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return seen.join(folded, F.col("_k").eqNullSafe(F.col("k"))).select(F.col("_k").alias(key), "first_seen", "last_seen", "sample")


def failure_streak(log: DataFrame, key: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Failures since the last success, and whether the board is still polled."""
    at = F.struct(*order)
    marked = log.select(key, at.alias("_at"), failed.alias("_f"))
    ok = marked.where(~F.col("_f")).groupBy(key).agg(F.max("_at").alias("_ok"))
    bad = marked.where("_f")
    since = bad.join(ok, key, "left").where("_ok IS NULL OR _at > _ok").groupBy(key).agg(F.count("*").alias("failure_count"))
    boards = marked.select(key).distinct()
    n = F.coalesce("failure_count", F.lit(0)).cast("long")
    return boards.join(since, key, "left").select(key, n.alias("failure_count"), (n < most).alias("active"))


def poll_spread(boards: DataFrame, token: str, last_polled: Column, seed: str, most: int) -> DataFrame:
    """Least recently polled first, ties spread by hash; a top-k."""
    spread = F.sha2(F.concat(F.lit(seed + ":"), F.col(token).cast("string")), 256)
    return top(boards.withColumn("bucket", spread), [last_polled, "bucket"], most)


def budget_cut(df: DataFrame, group: str, order: list[str], amount: str, budget: float, parts: int = 64) -> DataFrame:
    """Rows of each group while the amounts before them stay under the budget; amounts are 0 or more.

    A group is cut into ranges of the first column of the order, a number, and their sums are added up first, so a large
    group is spread over tasks; ranges that start beyond the budget are left out before any sort.
    """
    x = F.col(order[0]).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = ((high - low) / parts or 1.0) if low is not None else 1.0
    rows = df.withColumn("_part", F.coalesce(F.floor((x - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1)))
    sums = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_at")).agg(F.sum(amount).alias("_sum"))
    up = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", "_at", F.coalesce(F.sum("_sum").over(up), F.lit(0.0)).alias("_start")).where(F.col("_start") < budget)
    rows = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0.0))
    return rows.withColumn("before", before).where(F.col("before") < budget).drop("_part", "_group", "_at", "_start")


def last_runs(runs: DataFrame, key: str, order: list[Column], most: int = 50) -> DataFrame:
    """History without repeated ids (first wins, blanks kept), the last ``most``."""
    named = first_wins(runs.where(f"{key} IS NOT NULL AND cast({key} as string) <> ''"), [key], order)
    return named.unionByName(runs.where(f"{key} IS NULL OR cast({key} as string) = ''")).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]).limit(most)
