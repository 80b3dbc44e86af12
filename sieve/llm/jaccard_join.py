"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets under Jaccard distance.

Documents with equal sets are one point.  Points x, y link when num * |x union y| <= den * |x intersect y|, a distance
of at most eps = 1 - num/den.  Regions come in three levels, none of which loses a link:

1. *Size pivots.*  The distance from a set to one that holds it is 1 - |x|/|p|, so by the triangle inequality linked
   sizes differ by a factor of num/den at most.  Sizes between two pivots are a Voronoi cell of the size axis; a cell
   and its upper neighbour are one region, and the documents in the window of both are replicated.
2. *Cells of the universe.*  Within a size region linked sets differ in K shingles at most.  The universe is cut by
   hash into m > K cells, so in at least m - K of them the two projections are at distance 0.  Of its cells a point
   with e empty ones leaves out the m - K - 1 - e that it shares with the most points: the least shared cell in which
   a linked pair agrees is left out by neither, so passages that many documents share tie nothing together.  Points
   that agree in a cell still kept are tied, each group to its pivot, never all pairs; the tied components are closed
   regions.
3. *Document pivots.*  Inside a closed region a pivot's exact distances are computed; a point is expanded only against
   the window |d(x,p) - d(y,p)| <= eps of the points not yet reached, region by region until none is left.  A region
   too large for one task is cut into Voronoi shells about a sampled pivot; shells whose windows touch are joined
   block by block and their links tied once more.

Why not document pivots alone: in this space nearly all documents are at distance 1 from any sampled pivot, so every
window would hold every document (figures in the README).

Nulls: a null or empty text has no shingles and links with nothing; a null id is kept, and a class takes its least
non-null id.  Fewer words than ``words``: the whole sequence is the one shingle.  Repeated rows come back repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import NULL_ID, WordHashes, buckets_for, join_skewed, mix, pack, rolling, staged, trimmed, unpack, unstaged
from sieve.llm.components import components

BASE = 0xC2B2AE3D27D4EB4F
FLUSH_KEYS = 400_000
#: Shingles of the largest region that one task takes (8 bytes each).
REGION_SHINGLES = 1_500_000
DOCUMENT, KEYS, HOT = 0, 1, 2
#: Sampled documents, and how many of them make a key they share hot: its points are dealt to many tasks.
SAMPLE_DOCS, HOT_AMONG = 4000, 40
_ROWS = "bucket int, kind int, doc_id long, v long, n long, sig binary, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("data", pa.binary())])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def shingles(hashes: WordHashes, text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text in lower case (A-Z only)."""
    h = hashes.of(text.lower())
    if not len(h):
        return h
    return np.unique(mix(rolling(h, min(words, len(h)), BASE) + np.uint64(min(words, len(h)))))


@lru_cache(maxsize=None)
def _edges(num: int, den: int) -> tuple[int, ...]:
    """Least sizes of the cells of the size axis, up to 2**40."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return tuple(out)


@lru_cache(maxsize=4096)
def _cells(region: int, num: int, den: int) -> tuple[int, int]:
    """K, the most shingles in which linked sets of a size region differ, and m, the cells of its universe."""
    least = _edges(num, den)
    x = least[region + 1] - 1
    k = (den - num) * (x + x * den // num) // (den + num)
    return k, k + 1 + -(-k // 6)


def region_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Keys of a set, one for each cell of each of its size regions, the region's parity in the last bit; and how many
    cells may be left out, by parity."""
    own = int(np.searchsorted(np.array(_edges(num, den)), len(s), side="right")) - 1
    mixed, out, spare = mix(s), [], [0, 0]
    for region in (own - 1, own):
        if region < 0:
            continue
        k, m = _cells(region, num, den)
        if k == 0:  # linked sets of such sizes are equal
            continue
        cell = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        seed = np.uint64((region * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
        sums = np.add.reduceat(mixed, first)
        keys = [mix(sums ^ mix(cell[first] * np.uint64(0xD6E8FEB86659FD93) + seed))]
        spare[region & 1] = max(0, len(first) - k - 1)
        if m - len(first) >= m - k:  # the cells that agree may all be empty ones
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), cell[first], assume_unique=True)
            keys.append(mix(mix(empty * np.uint64(0xD6E8FEB86659FD93) + seed)))
        out += [key & ~np.uint64(1) | np.uint64(region & 1) for key in keys]
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), spare


def _is_in(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    return hot[at] == key if len(hot) else np.zeros(len(key), bool)


def hot_keys(docs: DataFrame, words: int, num: int, den: int, most_docs: int = SAMPLE_DOCS, among: int = HOT_AMONG) -> np.ndarray:
    """Keys that at least ``among`` of about ``most_docs`` sampled documents share, sorted.

    They only say how points are dealt out: what is found doesn't depend on them.  They are as many at most as the keys
    of ``most_docs / among`` documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist():
                if len(s := shingles(hashes, text, words)):
                    yield pa.record_batch([pa.array(region_keys(s, num, den)[0].view(np.int64))], names=["key"])

    share = min(1.0, most_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("text")
    rows = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= among).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _points(words: int, num: int, den: int, n_buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, owners, spares, held, seen, dealt = WordHashes(), [], [], [], 0, set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys)
            owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
            spare = np.repeat(np.array(spares, np.uint16).reshape(-1, 2), [len(k) for k in keys], axis=0)
            place = np.where(_is_in(key, hot), mix(key ^ owner.view(np.uint64)), key)
            bucket = ((place >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(edge)):
                at = order[edge[b] : edge[b + 1]]
                own = owner[at]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out.append((int(b), KEYS, None, None, None, None, pack(key=key[at], v=own[first], n=np.diff(np.r_[first, len(at)]).astype(np.uint32), even=spare[at[first], 0], odd=spare[at[first], 1])))
            for i in range(0, len(out), 64):
                yield _batch(_SCHEMA, out[i : i + 64])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True):
                    s, dealt = shingles(hashes, text, words), (dealt + 1) % n_buckets
                    if not len(s):
                        out.append((dealt, DOCUMENT, doc_id, None, 0, None, None))
                        continue
                    sig = xxhash.xxh3_128_digest(s.tobytes())
                    v = int.from_bytes(sig[:8], "little", signed=True)
                    out.append((dealt, DOCUMENT, doc_id, v, len(s), sig, None))
                    if sig in seen:
                        continue
                    k, spare = region_keys(s, num, den)
                    if len(k):
                        seen.add(sig)
                        keys.append(k)
                        owners.append(v)
                        spares.append([min(x, 65535) for x in spare])
                        held += len(k)
                yield _batch(_SCHEMA, out)
                if held >= FLUSH_KEYS:
                    yield from flush()
                    keys, owners, spares, held, seen = [], [], [], 0, set()
        if keys:
            yield from flush()

    return run


_TIES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("spare", pa.int32())])


def _share(hot: np.ndarray):
    """Documents as they are; (key, point, points of the key, cells the point may leave out) of keys that points share.

    Of hot keys every point, without the number of points, as a task has a part of them.
    """

    def rows(kind: int, key: np.ndarray, v: np.ndarray, n: np.ndarray, spare: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 10_000):
            part = slice(at, at + 10_000)
            size = len(key[part])
            yield pa.record_batch([pa.array(np.full(size, kind, np.int32)), pa.array(key[part].view(np.int64)), pa.array(v[part]), pa.array(n[part].astype(np.int64)), pa.nulls(size, pa.binary()), pa.array(spare[part].astype(np.int32))], schema=_TIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, spares = [], [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            docs = batch.filter(pa.array(kind == DOCUMENT))
            if docs.num_rows:
                yield pa.record_batch([*(docs.column(i) for i in (1, 2, 3, 4, 5)), pa.nulls(docs.num_rows, pa.int32())], schema=_TIES)
            for data in batch.column(6).drop_null().to_pylist():
                key, v, n, even, odd = unpack(data)
                keys.append(key)
                owners.append(np.repeat(v, n))
                spares.append(np.where(key & np.uint64(1), np.repeat(odd, n), np.repeat(even, n)))
        if not keys:
            return
        key, v = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((v, key))
        key, v, spare = key[order], v[order], np.concatenate(spares)[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])]
        key, v, spare = key[once], v[once], spare[once]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        size, warm = np.repeat(size, size), _is_in(key, hot)
        for kind, these in ((KEYS, (size > 1) & ~warm), (HOT, warm)):
            yield from rows(kind, key[these], v[these], size[these], spare[these])

    return run


def _ties(shared: DataFrame) -> DataFrame:
    """(a, b): pivot and other points of each key, once every point has left out its most shared cells."""
    rows = shared.select("kind", F.col("a").alias("key"), F.col("b").alias("v"), "n", "spare")
    hot = rows.where(f"kind = {HOT}").drop("n")
    # one row a hot key, of which there are as many as a sample's bound allows
    counts = hot.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.where(f"kind = {KEYS}").unionByName(hot.join(F.broadcast(counts), "key"))
    rank = F.row_number().over(Window.partitionBy("v", F.col("key").bitwiseAND(F.lit(1))).orderBy(F.desc("n"), "key"))
    kept = staged(rows.withColumn("rank", rank).where("rank > spare").select("key", "v"))
    pivots = kept.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("most"), F.count("*").alias("points")).where("a < most").select("key", "a", "points")
    out = staged(join_skewed(kept, pivots, "key", "points", kept.count()).where("v <> a").select("a", F.col("v").alias("b")).distinct())
    unstaged(kept)
    return out


def _sets(words: int, wanted: np.ndarray):
    """Shingle sets of documents that the bitmap may want; more than those wanted do no harm."""
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])
    bits = len(wanted) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.column(2).to_numpy() % bits
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True):
                    if len(s := shingles(hashes, text, words)):
                        out.append((doc_id, xxhash.xxh3_128_digest(s.tobytes()), s.tobytes()))
                if out:
                    yield _batch(schema, out)

    return run


def reach(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set (the place of its first member), by exact distances from pivots and their windows."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if den * both >= num * (size[0] + size[1] - both) else 1])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, start = ids.astype(np.int32), np.cumsum(size) - size
    eps = 1 - num / den + 1e-9
    mark = np.zeros(len(flat), bool)
    root, rest = np.full(len(sets), -1), np.arange(len(sets))

    def common(p: int, among: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with those of ``among``."""
        own = ids[start[p] : start[p] + size[p]]
        mark[own] = True
        if len(among) == len(sets):
            hit = np.add.reduceat(mark[ids], start, dtype=np.int64)
        else:
            n = size[among]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(start[among] - first, n)
            hit = np.add.reduceat(mark[ids[at]], first, dtype=np.int64)
        mark[own] = False
        return hit

    far = np.zeros(len(sets))
    while len(rest):
        pivot, rest = rest[0], rest[1:]
        root[pivot], todo = pivot, [pivot]
        if len(rest):
            hit = common(pivot, rest)
            far[pivot], far[rest] = 0, 1 - hit / (size[pivot] + size[rest] - hit)
        while todo and len(rest):
            x = todo.pop()
            near = rest[np.abs(far[rest] - far[x]) <= eps]
            near = near[(num * size[near] <= den * size[x]) & (num * size[x] <= den * size[near])]
            if not len(near):
                continue
            hit = common(x, near)
            new = near[den * hit >= num * (size[x] + size[near] - hit)]
            root[new] = pivot
            todo += new.tolist()
            rest = rest[root[rest] < 0]
    return root


_LINKS = pa.schema([("sig", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _join_regions(num: int, den: int):
    """Rows sorted by region: (region, sig, doc_id, shingles).  Gives (sig, its doc_id, least doc_id it reaches)."""

    def done(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[1])
        roots = reach([np.frombuffer(r[2], np.uint64) for r in rows], num, den) if len(rows) > 1 else [0] * len(rows)
        return _batch(_LINKS, [(r[0], r[1], rows[i][1]) for r, i in zip(rows, roots, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, rows = None, []
        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != region and rows:
                    yield done(rows)
                    rows = []
                region = at
                rows.append(tuple(row))
        if rows:
            yield done(rows)

    return run


def _shells(num: int, den: int):
    """Distance of each row's set to its region's pivot, as a shell of width eps, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shell, hit = [], []
            for s, p in zip(batch.column("shingles").to_pylist(), batch.column("pivot").to_pylist(), strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                shell.append(int((1 - both / union) / (1 - num / den + 1e-9)))
                hit.append(den * both >= num * union)
            yield pa.record_batch([*(batch.column(c) for c in ("region", "sig", "doc_id", "shingles", "n", "pivot_id")), pa.array(shell, pa.int32()), pa.array(hit)], names=["region", "sig", "doc_id", "shingles", "n", "pivot_id", "shell", "hit"])

    return run


def _split(large: DataFrame, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Regions beyond one task: (regions of less size, links found already).

    All that link to a region's pivot are one component, so they need not meet one another.  The rest falls into shells
    about the pivot, cut into blocks by hash; shells that touch meet block by block, where a block holds one of the rest.
    """
    pivots = staged(large.groupBy("region").agg(F.min_by(F.struct("shingles", "doc_id"), F.xxhash64("sig")).alias("p"), F.count("*").alias("points")))
    pivots, total = pivots.select("region", F.col("p.shingles").alias("pivot"), F.col("p.doc_id").alias("pivot_id"), "points"), pivots.agg(F.sum("points")).first()[0]
    rows = join_skewed(large, pivots, "region", "points", total).mapInArrow(_shells(num, den), "region long, sig binary, doc_id long, shingles binary, n long, pivot_id long, shell int, hit boolean")
    rows = staged(rows)
    count = staged(rows.groupBy("region", "shell", "hit").agg(F.ceil(F.sum("n") / F.lit(most / 2)).cast("int").alias("blocks"), F.count("*").alias("points")))
    each = count.select("region", "shell", "hit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    each = each.withColumn("of", F.struct("shell", "hit", "block"))
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, F.expr("a.region = b.region AND (b.shell = a.shell AND b.of >= a.of OR b.shell = a.shell + 1) AND NOT (a.hit AND b.hit)"))
    pairs = pairs.select("a.region", F.xxhash64("a.region", "a.of", "b.of").alias("pair"), F.explode(F.array_distinct(F.array("a.of", "b.of"))).alias("of"))
    pairs = pairs.select("region", "pair", "of.*")
    cut = join_skewed(rows.withColumn("cell", F.xxhash64("region", "shell", "hit")), count.select(F.xxhash64("region", "shell", "hit").alias("cell"), "blocks", "points"), "cell", "points", total)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    parts = cut.join(pairs, ["region", "shell", "hit", "block"]).select(F.col("pair").alias("region"), "sig", "doc_id", "shingles")
    # the rest of a block that meets nobody links with itself
    return parts, rows.select("sig", F.col("doc_id").alias("a"), F.when(F.col("hit"), F.col("pivot_id")).otherwise(F.col("doc_id")).alias("b"))


def _bitmap(ids: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """Which hashes of ids occur, as a bitmap of a fixed 1 MiB whatever the number of ids."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("int")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def jaccard_components(df: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", region_shingles: int = REGION_SHINGLES, hot_sample: tuple[int, int] = (SAMPLE_DOCS, HOT_AMONG)) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    class_id is the least id with the same shingle set, component_id the least id reachable by links.  Without
    shingles both are the row's own id.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = buckets_for(docs, 4 << 20)
    hot = hot_keys(docs, words, num, den, *hot_sample)
    ties = staged(docs.mapInArrow(trimmed(_points(words, num, den, n, hot)), _ROWS).repartitionById(n, "bucket").mapInArrow(trimmed(_share(hot)), "kind int, a long, b long, n long, sig binary, spare int"))
    rows = ties.where(f"kind = {DOCUMENT}").select(F.col("a").alias("doc_id"), F.col("b").alias("v"), "n", "sig")
    classes = staged(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.first("v").alias("v"), F.first("n").alias("n"), F.count("*").alias("copies")))
    edges = _ties(ties.where(f"kind <> {DOCUMENT}"))
    tied = components(edges, "a", "b")
    unstaged(edges)
    wanted = staged(classes.join(tied.select(F.col("vertex").alias("v"), F.col("root").alias("region")), "v").select("region", "sig", F.col("class_id").alias("doc_id"), "n"))
    sets = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 23)).alias("at")).mapInArrow(trimmed(_sets(words, _bitmap(wanted))), "doc_id long, sig binary, shingles binary")
    sets = wanted.join(sets, (wanted.sig == sets.sig) & wanted.doc_id.eqNullSafe(sets.doc_id)).select("region", wanted.sig, wanted.doc_id, "shingles", "n")
    size = staged(wanted.groupBy("region").agg(F.sum("n").alias("shingles"), F.count("*").alias("points")).where(f"shingles > {region_shingles}").select("region"))
    ready, again = sets.select("region", "sig", "doc_id", "shingles"), size.head(1)
    if again:
        sets = staged(sets)
        parts, found = _split(sets.join(size, "region", "left_semi"), num, den, region_shingles)
        ready = sets.join(size, "region", "left_anti").select("region", "sig", "doc_id", "shingles").union(parts)
    links = ready.repartition(n, "region").sortWithinPartitions("region").mapInArrow(trimmed(_join_regions(num, den)), "sig binary, a long, b long")
    if again:
        links = staged(links.unionByName(found))
        roots = components(links.select("a", "b"), "a", "b")
        links = links.select("sig", "a").distinct().join(roots, F.col("a") == F.col("vertex"), "left").select("sig", "a", F.coalesce("root", "a").alias("b"))
    named = staged(classes.join(links.select("sig", F.col("b").alias("root")), "sig", "left").select("sig", "class_id", F.coalesce("root", "class_id").alias("component_id"), "copies"))
    known = rows.where("sig IS NOT NULL")
    found = join_skewed(known, named, "sig", "copies", known.count()).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    found = found.union(rows.where("sig IS NULL").select("doc_id", F.lit(0).cast("long"), "doc_id", "doc_id"))
    return found.select(*(F.col(c) if c == "n_shingles" else F.nullif(F.col(c), F.lit(NULL_ID)).alias(c) for c in found.columns))
