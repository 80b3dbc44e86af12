"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Texts become token ids; a document longer than a sequence is cut into full pieces, the remainder first.  Full pieces
are sequences of their own.  The others are dealt evenly into pools; every pool is evolved by several islands, which
see its lengths only (2 bytes a piece).  An island's individual is a grouping of pieces into bins.  Crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold the same pieces, and puts the pieces
so displaced back by best fit, long ones first; mutation empties the worst bins.  The first individuals are best fit in random orders.  After each epoch an island's elite
migrates to its neighbour.  What the best island of each pool leaves poorly filled is pooled anew, in fewer pools,
until one pool is left or nothing is gained.

A pool holds about ``POOL`` pieces whatever the input, so tasks are bounded and their number grows with the input.

Nulls: a null text is empty and is one piece that holds the end mark; null ids and repeated rows are pieces like any
others.  Equal inputs give equal packings only if rows come in the same order.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import staged, trimmed

SEQUENCE, END_ID = 2048, 0
POOL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16_384, 2, 2, 30, 4
#: Bins filled less than this are pooled anew.
FULL = 0.995
MOST_WORDS = 300_000
# Fixed value: how byte-level pre-tokenizers split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as little-endian bytes, by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer always splits before a single space between two other characters, so a text is the sum of such
    spaced words; each is encoded once while remembered, and the memory is emptied at ``most`` words.  The words that a
    batch of texts brings are merged together by tiktoken, built from the same file: its ranks are the file's ids, which
    follow the merges.
    Other kinds of file, and texts that hold an added token's content, go to the tokenizer itself; texts with other
    white space at a space are merged whole.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.fast = self._merger(path)

    def _merger(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merges != sorted(merges):
            return None
        self.starts = np.zeros(max(ranks.values()) + 1, bool)
        self.starts[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def one(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast and not self.apart(text) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def apart(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def learn(self, words: list[str]) -> None:
        """Remembers words, each with a space before it; encoded at one go, as a word's first token alone starts with a space."""
        ids = np.array(self.fast("".join(f" {w}" for w in words)), np.uint32)
        raw, at = ids.tobytes(), np.flatnonzero(self.starts[ids])
        edge = [*(4 * at).tolist(), len(raw)]
        self.known.update(zip(words, (raw[a:b] for a, b in zip(edge, edge[1:])), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [None if not self.fast or "\0" in t or self.apart(t) else t.split(" ") for t in texts]
        new = set().union(*filter(None, cut)).difference(self.known)
        # a space beside other white space, or at an end of the text, isn't where words are split
        uneven = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        if uneven:
            cut = [w if w and uneven.isdisjoint(w) else None for w in cut]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*filter(None, cut))
        if new := new - uneven:
            self.learn(list(new))
        known = self.known.__getitem__
        return [self.one(t) if w is None else array("I", self.fast(w[0])).tobytes() + b"".join(map(known, w[1:])) for t, w in zip(texts, cut, strict=True)]


def cut(ids: bytes, size: int = SEQUENCE) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; the first is the remainder, if there is one."""
    n, start = len(ids) // 4, 0
    while start < n:
        length = (n - start) % size or size
        yield start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(df: DataFrame, tokenizer: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its end mark included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = Encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = part.column(0).to_pylist()
                coded = encoder.of([t or "" for t in part.column(1).to_pylist()])
                out = [(d, k, *p) for d, x in zip(ids, coded, strict=True) for k, p in enumerate(cut(x + mark, size))]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins open for best fit: their free space, kept sorted."""

    def __init__(self, free: np.ndarray):
        order = np.argsort(free, kind="stable")
        self.free = free[order].tolist()
        self.ids = order.tolist()
        self.n = len(self.ids)

    def put(self, length: int, size: int) -> int:
        """The bin with the least space that takes the length; a new one if there is none."""
        at = bisect_left(self.free, length)
        if at == len(self.free):
            bin_id, left = self.n, size - length
            self.n += 1
        else:
            bin_id, left = self.ids.pop(at), self.free.pop(at) - length
        if left:
            at = bisect_left(self.free, left)
            self.free.insert(at, left)
            self.ids.insert(at, bin_id)
        return bin_id


def _fill(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def _dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def refit(bins: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator, sort: bool = True, blur: float = 8) -> np.ndarray:
    """Pieces with bin -1 put back by best fit, long ones first; all in any order without ``sort``.

    Lengths that differ by less than ``blur`` may change places; at 0 it is best-fit decreasing.
    """
    out = np.full(len(bins), -1, np.int32)
    placed = bins >= 0
    if placed.any():
        out[placed] = _dense(bins[placed])
    free = size - _fill(out[placed], lengths[placed]) if placed.any() else np.empty(0, np.int64)
    loose = np.flatnonzero(~placed)
    loose = loose[np.argsort(-(lengths[loose] + rng.uniform(0, blur, len(loose))), kind="stable")] if sort else rng.permutation(loose)
    keep = np.flatnonzero(free > 0)
    open_bins = Bins(free[keep])
    names, total = keep.tolist(), len(free)
    for i, length in zip(loose.tolist(), lengths[loose].tolist(), strict=True):
        b = open_bins.put(length, size)
        if b >= len(names):
            names.append(total)
            total += 1
        out[i] = names[b]
    return out


def fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> float:
    """Fewer bins are better, and among as many those with the greater mean square of filling."""
    fill = _fill(bins, lengths) / size
    return float((fill**2).mean() - len(fill))


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Child of a with a random half of b's well-filled bins injected whole."""
    fill = _fill(b, lengths)
    good = fill >= np.quantile(fill, 0.5)
    chosen = (good & (rng.random(len(fill)) < 0.5))[b]
    touched = np.zeros(int(a.max()) + 1, bool)
    touched[a[chosen]] = True
    child = np.where(touched[a], -1, a)
    child[chosen] = b[chosen] + int(a.max()) + 1
    return refit(child, lengths, size, rng)


def mutate(a: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """The worst bins and a few random ones emptied and refitted."""
    fill = _fill(a, lengths)
    gone = (fill <= np.quantile(fill, 0.03)) | (rng.random(len(fill)) < 0.03)
    return refit(np.where(gone[a], -1, a), lengths, size, rng)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], *, size: int = SEQUENCE, seed: int = 0, population: int = POPULATION, generations: int = GENERATIONS) -> list[np.ndarray]:
    """An epoch of one island; the population, best first.

    Beside the elites it starts from best fit in random orders and, in its first epoch, from best-fit decreasing, so
    no island ends with more bins than that has.  It stops early at the bound, the lengths' sum over the size.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // size)
    people = list(elites) or [refit(np.full(len(lengths), -1, np.int32), lengths, size, rng, blur=0)]
    while len(people) < population:
        people.append(refit(np.full(len(lengths), -1, np.int32), lengths, size, rng, sort=False))
    people.sort(key=lambda p: -fitness(p, lengths, size))
    for _ in range(generations):
        if int(people[0].max()) + 1 == least:
            break
        a, b = (int(x) for x in rng.choice(len(people), 2, replace=False))
        child = mutate(cross(people[a], people[b], lengths, size, rng), lengths, size, rng)
        people = sorted([*people, child], key=lambda p: -fitness(p, lengths, size))[:population]
    return people


def _pools(pieces: DataFrame, n: int, level: int) -> DataFrame:
    """One row a pool: its pieces as one array; pools are even whatever the ids, as row numbers are dealt out."""
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(n))
    return pieces.withColumn("pool", deal.cast("int")).groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("items"))


def _epoch(size: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pool, island, lengths, elites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(lengths, "<u2").astype(np.int64)
                people = evolve(own, [np.frombuffer(e, "<i4") for e in elites or []], size=size, seed=pool * 1009 + island * 31 + epoch)
                yield pa.record_batch([pa.array([pool], pa.int32()), pa.array([island], pa.int32()), pa.array([lengths]), pa.array([[p.astype("<i4").tobytes() for p in people[:2]]], pa.list_(pa.binary())), pa.array([fitness(people[0], own, size)])], names=["pool", "island", "lengths", "elites", "fitness"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pool, lengths in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield pa.record_batch([pa.array([pool], pa.int32()), pa.array([lengths.values.to_numpy().astype("<u2").tobytes()])], names=["pool", "lengths"])


def _best(pools: DataFrame, size: int, islands: int, epochs: int) -> DataFrame:
    """(pool, bins) of the best island of each pool."""
    lengths = pools.select("pool", F.expr("transform(items, x -> x.length)").alias("l")).mapInArrow(_lengths, "pool int, lengths binary")
    state = lengths.select("pool", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("elites"))
    for epoch in range(epochs):
        # a task takes few islands, so that none waits behind many
        state = staged(state.repartition(max(6, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pool", "island").mapInArrow(_epoch(size, epoch), "pool int, island int, lengths binary, elites array<binary>, fitness double"))
        if epoch < epochs - 1:
            guest = state.select("pool", ((F.col("island") + 1) % islands).alias("island"), F.expr("slice(elites, 1, 1)").alias("guest"))
            state = state.join(guest, ["pool", "island"]).select("pool", "island", "lengths", F.concat("guest", "elites").alias("elites"))
    return state.groupBy("pool").agg(F.max_by(F.element_at("elites", 1), F.struct("fitness", "island")).alias("bins"))


def _placed(size: int, level: int, full: float, last: bool):
    """Pieces with their sequence and offset; those of poorly filled bins, unless it is the last level, without."""
    schema = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pool = batch.column(0)[i].as_py()
                items = pa.StructArray.from_arrays(batch.column(1)[i].values.flatten(), names=["length", "doc_id", "piece", "start", "ids_crc32"])
                bins = np.frombuffer(batch.column(2)[i].as_py(), "<i4")
                length = items.field("length").to_numpy()
                order = np.argsort(bins, kind="stable")
                first = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
                run_up = np.cumsum(length[order]) - length[order]
                offset = np.empty(len(bins), np.int64)
                offset[order] = run_up - np.repeat(run_up[first], np.diff(np.r_[first, len(bins)]))
                poor = np.zeros(len(bins), bool) if last else (_fill(bins, length) < full * size)[bins]
                sequence = (np.int64(level) << 58) | (np.int64(pool) << 30) | bins.astype(np.int64)
                columns = [items.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                columns += [pa.array(np.where(poor, -1, sequence)), pa.array(offset)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def pack(parts: DataFrame, *, size: int = SEQUENCE, pool: int = POOL, islands: int = ISLANDS, epochs: int = EPOCHS, full: float = FULL) -> DataFrame:
    """The pieces with sequence_id and offset."""
    parts = staged(parts)
    done = [parts.where(F.col("length") >= size).select("*", (F.lit(7 << 58) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, level = parts.where(F.col("length") < size), 0
    before = None
    while True:
        n = -(-rest.count() // pool)
        if n == 0:
            break
        last = n == 1 or level == 5 or (before is not None and n > 0.7 * before)
        pools = staged(_pools(rest, n, level))
        out = pools.join(_best(pools, size, islands, epochs), "pool").mapInArrow(_placed(size, level, full, last), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        out = staged(out)
        done.append(out.where("sequence_id >= 0"))
        if last:
            break
        rest, before, level = out.where("sequence_id < 0").drop("sequence_id", "offset"), n, level + 1
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return result
