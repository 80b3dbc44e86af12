"""Numeric band join: lines meet the items whose price their unit price comes near, over regions of prices.

* A histogram of bounded length (values by their leading BITS bits, heavy bins again by finer ones) tells how many lines
  and items each price range holds, exactly.  From one region of all prices, the region of the heaviest estimated join
  load is split again and again, until none is above ``target`` or there are MOST_REGIONS.
* An item's price lies in one region.  A line goes to each region in whose range, widened by the band, it lies, so lines
  near a border are replicated.
* A region that splitting doesn't lighten, as its lines are within a band or at one price, becomes a grid: its lines
  are dealt round to blocks, each of which meets all of its prices (or, of very many prices, each block of them).
* A cell of the grid, or a region, is one group of rows of bounded size, where DuckDB runs the range join between
  prices and the lines that it first counts by value.  Lines of equal value are told apart again only by the first few
  that can be among somebody's first pairs.

The cells answer for a price, whatever the number of its items: pairs, sums and leading lines of all items' lines.  What
an item's own lines add to that is counted by an equality join and taken off.  Only the histogram, the table of regions
and the prices with more than 1 / HOT_PRICES of the items reach the driver or a broadcast, and these have fixed bounds.

Nulls: lines null in sale, item, quantity or amount, with amounts that aren't finite or quantities under 1, and items
without a finite price never pair; a null line number counts as the least and is an empty text in the checksum.  An item
without an id pairs with all lines in its band.  Repeated lines each count, repeated items each come back.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import join_skewed, staged, trimmed

#: Bins of the first histogram have so many leading bits of a value's distance from the least; at most 2**(BITS-1) * 64 bins.
BITS = 11
#: Estimated rows and value pairs that a cell may hold.
TARGET = 65_536
MOST_REGIONS = 4096
#: A split is taken if its halves' loads together are at most so many times the region's.
MOST_GROWTH = 1.25
#: Distinct prices of a block of a grid.
PRICE_BLOCK = 8192
HOT_PRICES = 1024


def cents(x: Column) -> Column:
    return F.floor(F.lit(100.0) * x.cast("double") + F.lit(0.5)).cast("long")


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x.cast("double")) < F.lit(1e15), F.lit(False))  # NaN is above every number


def line_values(lines: DataFrame) -> DataFrame:
    """(u, item, sale, line, crc) of the lines that may pair; u is the unit price in cents, rounded half up."""
    good = lines.where(F.col("sale_id").isNotNull() & F.col("item_id").isNotNull() & (F.col("quantity") >= 1) & _finite(F.col("amount")))
    q, doubled = F.col("q"), F.col("x")
    rows = good.select(F.col("item_id").cast("long").alias("item"), F.col("sale_id").cast("long").alias("sale"), F.col("line_no").cast("long").alias("line"), F.col("quantity").cast("long").alias("q"), cents(F.col("amount")).alias("a"))
    rows = rows.withColumn("x", 2 * F.col("a") + q)
    text = F.concat_ws(",", "sale", F.coalesce(F.col("line").cast("string"), F.lit("")), "item")
    return rows.select(F.expr("(x - pmod(x, 2 * q)) div (2 * q)").alias("u"), "item", "sale", "line", F.crc32(text).alias("crc"))


def reach(p: int) -> int:
    """The widest gap in cents at which a price still pairs."""
    return max(10, 2 * p // 1000)


REACH = "greatest(10L, (2 * p - pmod(2 * p, 1000)) div 1000)"


def _bin(value: str, least: int, bits: int) -> str:
    """SQL for the lower end of a value's bin: its distance from ``least``, cut to its leading ``bits`` bits."""
    shift = f"greatest(0, length(bin({value} - {least}L)) - {bits})"
    return f"shiftleft(shiftright({value} - {least}L, {shift}), {shift})"


def _width(lo: int, bits: int) -> int:
    return 1 << max(0, lo.bit_length() - bits)


def histogram(values: DataFrame, least: int, target: int) -> list[tuple[int, int, int, int]]:
    """(lower end, width, lines, prices' items) of the bins with rows, by distance from ``least``, in order.

    ``values`` has (v, lines, items).  Bins above ``target`` are counted again by finer bins, while they are wider than
    one value; of these there are at most 4,096, the heaviest.
    """
    done: list[tuple[int, int, int, int]] = []
    rows, bits = values.withColumn("top", F.expr(_bin("v", least, BITS))), BITS
    found = rows.groupBy("top").agg(F.sum("lines").alias("lines"), F.sum("items").alias("items")).collect()
    now = [(r["top"], _width(r["top"], bits), r["lines"], r["items"]) for r in found]
    while True:
        heavy = heapq.nlargest(4096, (b for b in now if b[1] > 1 and b[2] + b[3] > target), key=lambda b: b[2] + b[3])
        finer = {b[0] for b in heavy}
        done += [b for b in now if b[0] not in finer]
        if not heavy:
            return sorted(done)
        marks = values.sparkSession.createDataFrame([(b[0],) for b in heavy], "top long")
        rows, bits = rows.join(F.broadcast(marks), "top").withColumn("top", F.expr(_bin("v", least, bits + BITS - 1))), bits + BITS - 1
        found = rows.groupBy("top").agg(F.sum("lines").alias("lines"), F.sum("items").alias("items")).collect()
        now = [(r["top"], _width(r["top"], bits), r["lines"], r["items"]) for r in found]


def regions(bins: list[tuple[int, int, int, int]], least: int, target: int = TARGET) -> list[dict]:
    """Regions of prices [lo, hi) with the range [wide_lo, wide_hi] of their lines and the blocks of their grid.

    ``bins`` are those of ``histogram``.  Regions are split where their halves' loads come nearest, the heaviest first.
    """
    ends = [least + b[0] for b in bins] + ([least + bins[-1][0] + bins[-1][1]] if bins else [])
    lines, items = [0], [0]
    for b in bins:
        lines.append(lines[-1] + b[2])
        items.append(items[-1] + b[3])

    def measured(a: int, b: int) -> dict:
        lo, hi = ends[a], ends[b]
        wide_lo, wide_hi = lo - reach(lo), hi - 1 + reach(hi - 1)
        first, last = max(0, bisect_left(ends, wide_lo + 1) - 1), min(len(bins), bisect_left(ends, wide_hi + 1))
        near, own = lines[last] - lines[first], items[b] - items[a]
        prices = min(own, hi - lo)
        load = near + own + prices * min(near, 2 * reach(hi - 1) + 1) if own else 0
        return {"a": a, "b": b, "lo": lo, "hi": hi, "wide_lo": wide_lo, "wide_hi": wide_hi, "near": near, "prices": prices, "load": load}

    if not bins:
        return []
    whole = measured(0, len(bins))
    heap, done, tie = [(-whole["load"], 0, whole)], [], 1
    while heap:
        _, _, r = heapq.heappop(heap)
        best = None
        if r["load"] > target and r["b"] - r["a"] > 1 and len(heap) + len(done) + 2 <= MOST_REGIONS:
            low, high = r["a"] + 1, r["b"] - 1
            while low < high:  # the left half's load grows with its end
                mid = (low + high) // 2
                low, high = (mid + 1, high) if measured(r["a"], mid)["load"] < measured(mid, r["b"])["load"] else (low, mid)
            cuts = [(measured(r["a"], c), measured(c, r["b"])) for c in {low, max(r["a"] + 1, low - 1)}]
            best = min(cuts, key=lambda c: max(c[0]["load"], c[1]["load"]))
            if best[0]["load"] + best[1]["load"] > MOST_GROWTH * r["load"]:
                best = None
        if best is None:
            done.append(r)
            continue
        for half in best:
            heapq.heappush(heap, (-half["load"], tie, half))
            tie += 1
    done = sorted((r for r in done if r["prices"] and r["near"]), key=lambda r: r["lo"])
    for k, r in enumerate(done):
        r |= {"region": k, "line_blocks": max(1, -(-r["near"] // target)), "price_blocks": max(1, -(-r["prices"] // PRICE_BLOCK))}
    return done


_JOINED = """
WITH g AS (SELECT u, count(*) AS n, sum(crc) AS crc FROM lines GROUP BY u)
SELECT p, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * abs(u - p)) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS crc
FROM prices JOIN g ON u >= p - reach AND u <= p + reach GROUP BY p
"""
# A line is among an item's first k of other items only if fewer than k lines before it are of other items: so the first
# 2k stand, counting k of an item at most.
_LEADING = """
WITH own AS (SELECT u, item, sale, line FROM lines QUALIFY row_number() OVER (PARTITION BY u, item ORDER BY sale, line NULLS FIRST) <= {k}),
value AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY u ORDER BY sale, line NULLS FIRST, item) <= 2 * {k}),
pair AS (SELECT p, u, item, sale, line, abs(u - p) AS gap FROM prices JOIN value ON u >= p - reach AND u <= p + reach),
few AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY p, item ORDER BY gap, u, sale, line NULLS FIRST) <= {k})
SELECT p, u, item, sale, line FROM few QUALIFY row_number() OVER (PARTITION BY p ORDER BY gap, u, sale, line NULLS FIRST, item) <= 2 * {k}
"""
_CELL = pa.schema([("p", pa.int64()), ("n", pa.int64()), ("gap_sum", pa.int64()), ("crc", pa.int64()), ("u", pa.int64()), ("item", pa.int64()), ("sale", pa.int64()), ("line", pa.int64())])
_CELL_DDL = "p long, n long, gap_sum long, crc long, u long, item long, sale long, line long"


def cell_joiner(first: int):
    """A function from the rows of a cell, those with ``reach`` its prices, to its sums (n not null) and leading lines."""

    def joined(table: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            is_price = table["reach"].is_valid()
            con.register("prices", table.filter(is_price).select(["p", "reach"]))
            con.register("lines", table.filter(table["reach"].is_null()).select(["u", "item", "sale", "line", "crc"]))
            parts = [con.sql(sql).to_arrow_table() for sql in (_JOINED, _LEADING.format(k=first))]
        full = [pa.table({f.name: t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in _CELL}) for t in parts]
        return pa.concat_tables(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(pa.Table.from_batches(list(batches))).to_batches()

    give_back = trimmed(run)
    return lambda table: pa.Table.from_batches(list(give_back(iter(table.to_batches()))), _CELL) if len(table) else _CELL.empty_table()


def price_answers(prices: DataFrame, lines: DataFrame, first: int, target: int) -> DataFrame:
    """(p, n, gap_sum, crc, leading) of each price with pairs; leading: an array of (gap, u, sale, line, item) in order.

    ``prices`` has (p, items), a row a price.
    """
    spark = lines.sparkSession
    values = lines.select(F.col("u").alias("v"), F.lit(1).alias("lines"), F.lit(0).cast("long").alias("items")).union(prices.select("p", F.lit(0), "items"))
    least = values.agg(F.min("v")).first()[0] or 0
    bins = histogram(values, least, target)
    found = regions(bins, least, target)
    # regions by the first histogram's bins: lines look up their bin, then compare with the region's own range
    tops = sorted({_top(lo) for lo, *_ in bins})
    links = []
    for r in found:
        # a bin that begins before the range may reach into it
        at = max(0, bisect_left(tops, r["wide_lo"] - least + 1) - 1)
        while at < len(tops) and tops[at] <= r["wide_hi"] - least:
            links.append((tops[at], r["region"], r["lo"], r["hi"], r["wide_lo"], r["wide_hi"], r["line_blocks"], r["price_blocks"]))
            at += 1
    table = F.broadcast(spark.createDataFrame(links, "top long, region long, lo long, hi long, wide_lo long, wide_hi long, line_blocks long, price_blocks long"))
    dealt = F.pmod(F.col("row"), F.col("line_blocks"))
    of_lines = (
        lines.withColumns({"top": F.expr(_bin("u", least, BITS)), "row": F.monotonically_increasing_id()}).join(table, "top").where("u BETWEEN wide_lo AND wide_hi")
        .select("region", dealt.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("price_blocks") - 1)).alias("j"), "u", "item", "sale", "line", "crc", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("reach"))
    )
    none = [F.lit(None).cast("long").alias(c) for c in ("u", "item", "sale", "line", "crc")]
    of_prices = (
        prices.withColumn("top", F.expr(_bin("p", least, BITS))).join(table, "top").where("p >= lo AND p < hi")
        .select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("line_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("p"), F.col("price_blocks")).alias("j"), *none, "p", F.expr(REACH).alias("reach"))
    )
    joiner = cell_joiner(first)
    columns = ["u", "item", "sale", "line", "crc", "p", "reach"]

    def cell(table: pa.Table) -> pa.Table:
        return joiner(table.select(columns))

    # partitions grow with the cells, so that a task has few of them
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["line_blocks"] * r["price_blocks"] for r in found))
    cells = staged(of_lines.union(of_prices).repartition(count, "region", "i", "j").groupBy("region", "i", "j").applyInArrow(cell, _CELL_DDL))
    sums = cells.where("n IS NOT NULL").groupBy("p").agg(F.sum("n").alias("n"), F.sum("gap_sum").alias("gap_sum"), F.sum("crc").alias("crc"))
    pairs = cells.where("n IS NULL").withColumn("gap", F.expr("abs(u - p)"))
    order = ["gap", "u", "sale", F.col("line").asc_nulls_first(), "item"]
    few = pairs.withColumn("k", F.row_number().over(Window.partitionBy("p", "item").orderBy(*order))).where(F.col("k") <= first)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(*order))).where(F.col("k") <= 2 * first)
    leading = few.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("gap", "u", "sale", "line", "item"))).alias("leading"))
    return sums.join(leading, "p", "left")


def _top(lo: int) -> int:
    """The first histogram's bin of a value."""
    shift = max(0, lo.bit_length() - BITS)
    return lo >> shift << shift


def near_price_pairs(lines: DataFrame, items: DataFrame, *, first: int = 5, target: int = TARGET) -> DataFrame:
    """(item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc): each item's first pairs.

    Ranks begin at 1; an item without pairs has one row of rank 0.  ``target`` bounds what a cell holds, not the result.
    """
    rows = line_values(lines)
    priced = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(_finite(F.col("price")), cents(F.col("price"))).alias("p"))
    prices = staged(priced.where("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("items")))
    answers = staged(prices.join(price_answers(prices, rows, first, target), "p", "left"))
    ids = priced.where("item_id IS NOT NULL AND p IS NOT NULL").distinct()
    own = rows.groupBy("item", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")).withColumnRenamed("item", "item_id")
    own = own.join(ids, "item_id").where(F.expr(f"abs(u - p) <= {REACH}"))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.expr("n * abs(u - p)")).alias("own_gap"), F.sum("crc").alias("own_crc"))
    total = priced.count()
    with_price = join_skewed(priced.where("p IS NOT NULL"), answers, "p", "items", total, part=HOT_PRICES).drop("items")
    both = with_price.unionByName(priced.where("p IS NULL"), allowMissingColumns=True).join(own, ["item_id", "p"], "left")
    mine = F.expr(f"slice(filter(coalesce(leading, array()), x -> NOT (x.item <=> item_id)), 1, {first})")
    counted = [F.expr(f"coalesce({a}, 0L) - coalesce({b}, 0L)").alias(c) for a, b, c in (("n", "own_n", "n_pairs"), ("gap_sum", "own_gap", "gap_sum"), ("crc", "own_crc", "lines_crc"))]
    out = both.select("item_id", F.posexplode_outer(mine).alias("pos", "x"), *counted)
    return out.select("item_id", F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank"), F.col("x.gap").alias("gap"), F.col("x.u").alias("u"), F.col("x.sale").alias("sale_id"), F.col("x.line").alias("line_no"), F.col("x.item").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")
