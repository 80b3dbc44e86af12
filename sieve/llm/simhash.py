"""SimHash near-duplicates: fingerprints at a small Hamming distance, found exactly by a vantage-point tree.

* A fingerprint has a bit set where over half of the text's shingle hashes have it.  Equal fingerprints are one point.
* A tree is built on a bounded sample of the points: a vantage splits a node at a distance into near and far.  Every
  point belongs to one leaf, its shard; where a far point is within ``radius`` of the border, the triangle inequality
  lets it have links to near points, so it visits the near side's shards too.  A link is found where the one point
  belongs and the other belongs or visits.
* In a shard a tree of its own prunes the search by the same bounds down to small leaves, which compare all.  A vantage
  with most of a node within ``radius`` makes those one class: they are linked to it and meet only the others.
* Shards that no vantage lightens, as their points lie close together, are dealt to blocks, and every two blocks meet.

A shard emits the links of a spanning forest, so a group of copies costs its size; components join the shards' forests.

Nulls: null texts and texts without a word have the fingerprint 0, linked like any other; rows with a null id come back,
and a component of such rows only has a null id.  Repeated rows come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import SPACE, join_skewed, staged, trimmed, unstaged
from sieve.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Points a shard should own; at most MOST_SHARDS are cut from a sample of SAMPLE points, then shards grow.  Each doubling
#: of the shards adds about a third to the copies of points, while a shard's points take but 16 bytes each.
SHARD, MOST_SHARDS, SAMPLE = 65_536, 4096, 32_768
#: Points compared with all others of their leaf, and pairs compared at once.
LEAF, BLOCK = 256, 1 << 20
#: A split is taken if the smaller side has this part of the points at least, and this part at most crosses the border.
LEAST_SIDE, MOST_CROSSING = 0.1, 0.6
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text, whose words are read in pieces that share ``size - 1`` words."""
    hashed, ones, n, rest = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def add(words: list[bytes]) -> int:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64, len(starts))
        for k in range(0, len(hashes), 4096):
            ones.__iadd__(np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64))
        return len(hashes)

    for words in _pieces((text or "").encode().lower()):
        rest += words
        if len(rest) >= size:
            n += add(rest)
            rest = rest[1 - size :]
    if not n and rest:
        h = hashed(b" ".join(rest), SEED)
        return h
    return sum(1 << j for j in range(64) if 2 * int(ones[j]) > n)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, fp long")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int, float] | None:
    """(vantage, greatest near distance, part that crosses) of the split with the fewest points within ``radius`` beyond the border."""
    best = None
    for v in points[rng.integers(0, len(points), tries)]:
        upto = np.cumsum(np.bincount(distances(points, v), minlength=65 + radius)) / len(points)
        for mu in range(64):
            if LEAST_SIDE <= upto[mu] <= 1 - LEAST_SIDE:
                crossing = float(upto[min(mu + radius, 64)] - upto[mu])
                # what both sides then hold at most; an even split serves more than a lopsided one
                cost = max(upto[mu] + crossing, 1 - upto[mu])
                if crossing <= MOST_CROSSING and (best is None or cost < best[0]):
                    best = (cost, v, mu, crossing)
    return best and best[1:]


@dataclass(frozen=True)
class Node:
    """A split with its two sides, or, without a vantage, a shard and the number of blocks its points are dealt to."""

    shard: int = -1
    blocks: int = 1
    vantage: np.uint64 | None = None
    mu: int = 0
    near: Node | None = None
    far: Node | None = None


def build(sample: np.ndarray, total: int, radius: int, shard: int = SHARD, most: int = MOST_SHARDS) -> Node:
    """A tree whose shards own about ``shard`` of ``total`` points each, or ``total / most`` if that is more."""
    rng, numbers = np.random.default_rng(7), iter(range(1 << 30))
    share = max(shard, -(-total // most)) * len(sample) / max(total, 1)

    def node(points: np.ndarray) -> Node:
        split = best_split(points, radius, rng) if len(points) > max(share, 16) else None
        if split is None:
            blocks = round(len(points) / share / 2) if share else 1
            return Node(next(numbers), max(1, blocks))
        d = distances(points, split[0])
        return Node(vantage=split[0], mu=split[1], near=node(points[d <= split[1]]), far=node(points[d > split[1]]))

    return node(sample)


def route(tree: Node, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``points``, shard, block, whether it owns): a row a shard that a point belongs to or visits.

    In a shard of several blocks, an owner is sent to the cells (i, j), i <= j, of its own block, visitors to all (i, i).
    """
    out: list[tuple[np.ndarray, int, int, np.ndarray]] = []

    def walk(node: Node, at: np.ndarray, owns: np.ndarray) -> None:
        if not len(at):
            return
        if node.vantage is None:
            g = node.blocks
            if g == 1:
                out.append((at, node.shard, 0, owns))
                return
            own = ((points[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(g)
            for i in range(g):
                for j in range(i, g):
                    take = owns & ((own == i) | (own == j)) | (~owns if i == j else False)
                    out.append((at[take], node.shard, i * g + j, owns[take]))
            return
        d = distances(points[at], node.vantage).astype(np.int64)
        # owners are near or far; far owners and visitors within the radius of the border visit the near side, visitors the far side too
        inside = d <= node.mu
        near = inside | (d <= node.mu + radius)
        walk(node.near, at[near], (owns & inside)[near])
        far = (owns & ~inside) | (~owns & (d > node.mu - radius))
        walk(node.far, at[far], owns[far])

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    return tuple(np.concatenate([np.full(len(o[0]), o[k]) if k in (1, 2) else o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(4))


class Forest:
    """Classes of points, and the links that made them."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def labels(self, at: np.ndarray) -> np.ndarray:
        now = self.up[at]
        while (nxt := self.up[now]).tolist() != now.tolist():
            now = nxt
        self.up[at] = now
        return now

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[k] with b[k]; those of a class already are passed over."""
        new = self.labels(a) != self.labels(b)
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))


def shard_links(points: np.ndarray, owns: np.ndarray, radius: int, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over all links between an owner and any point, as places; points are distinct.

    With ``second``, a mark of points, only links between a marked owner and one that isn't, count.
    """
    forest, rng = Forest(len(points)), np.random.default_rng(11)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(b)))
        for k in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(points[a[k : k + step], None] ^ points[b][None, :]) <= radius)
            forest.link(a[k + x], b[y])

    def search(own: np.ndarray, visit: np.ndarray, inner: bool) -> None:
        """Pairs of owners (if ``inner``), and of an owner and a visitor."""
        stack = [(own, visit, inner)]
        while stack:
            own, visit, inner = stack.pop()
            if not len(own) or not inner and not len(visit):
                continue
            if len(own) <= LEAF:
                compare(own, np.concatenate((own, visit)) if inner else visit)
                continue
            v = points[own[rng.integers(len(own))]]
            d, e = distances(points[own], v), distances(points[visit], v)
            ball = d <= radius
            if inner and 2 * ball.sum() >= len(own):
                # all linked to the vantage, so one class
                center = own[d == 0][0]
                forest.link(np.full(int(ball.sum()), center), own[ball])
                stack.append((own[~ball], np.concatenate((visit, own[ball])), True))
                stack.append((own[ball], visit[e <= 2 * radius], False))
                continue
            split = best_split(points[own], radius, rng, 4)
            if split is None:
                compare(own, np.concatenate((own, visit)) if inner else visit)
                continue
            v, mu, _ = split
            d, e = distances(points[own], v).astype(np.int64), distances(points[visit], v).astype(np.int64)
            near = d <= mu
            crossing = own[~near & (d <= mu + radius)] if inner else own[:0]
            stack.append((own[near], visit[e <= mu + radius], inner))
            stack.append((own[~near], visit[e > mu - radius], inner))
            if len(crossing):  # far owners that may link with near ones
                stack.append((own[near], crossing, False))

    at = np.arange(len(points))
    if second is None:
        search(at[owns], at[~owns], True)
    else:
        search(at[owns & second], at[owns & ~second], False)
    return forest.links


def links(classes: DataFrame, *, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v) of spanning links between distinct fingerprints within ``radius``; ``classes`` has fp, each once."""
    total = classes.count()
    sample = np.array([r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = build(sample, total, radius, shard)
    blocks: dict[int, int] = {}
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.vantage is None:
            blocks[node.shard] = node.blocks
        else:
            todo += [node.near, node.far]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, to, block, owns = route(tree, points, radius)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(points[at].view(np.int64)), pa.array(owns.astype(bool))], names=["shard", "block", "fp", "owns"])

    def found(key: tuple, table: pa.Table) -> pa.Table:
        g = blocks[key[0].as_py()]
        i, j = divmod(key[1].as_py(), g)
        points, owns = table["fp"].to_numpy().view(np.uint64), table["owns"].to_numpy(zero_copy_only=False).astype(bool)
        second = None
        if i != j:
            second = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(g) == i
        pairs = np.array(shard_links(points, owns, radius, second), np.int64).reshape(-1, 2)
        ends = points.view(np.int64)
        return pa.table({"u": pa.array(ends[pairs[:, 0]], pa.int64()), "v": pa.array(ends[pairs[:, 1]], pa.int64())})

    rows = classes.select("fp").mapInArrow(trimmed(routed), "shard int, block int, fp long, owns boolean")
    return rows.groupBy("shard", "block").applyInArrow(found, "u long, v long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint is 16 hexadecimal digits."""
    rows = staged(fingerprints(df, id_col=id_col, text_col=text_col, size=size))
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes, radius=radius, shard=shard))
    tied = classes.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    named = staged(join_skewed(tied, least, "root", "fps", classes.count()).select("fp", "n", "component_id"))
    out = join_skewed(rows, named, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
