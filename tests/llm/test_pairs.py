"""The joins by Hamming distance, spelling and price, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieve.llm import band_join, secrets, simhash, spelling
from tests.llm.test_operators import ODD, near_copies, table


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, radius):
    """The least place that each point reaches by links."""
    up = list(range(len(points)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def brute_near(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots, least = classes(fps, 4), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))


def test_simhash_on_odd_rows(spark):
    assert Counter(map(tuple, simhash.near_duplicates(table(spark)).collect())) == brute_near([r[:2] for r in ODD])


def test_simhash_of_near_copies(spark):
    rows = [r[:2] for r in near_copies()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.near_duplicates(df, shard=16).collect())) == brute_near(rows)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("piece", [1 << 20, 30])
def test_fingerprints_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(2)
    for text in (None, "", " \n", "One", "a B c", "a b c d", "Ä é\x85x   y z", " ".join(rng.choice("abcdefg") for _ in range(500)), " x" * 9):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("centers", [0, 2, 300])
@pytest.mark.parametrize(("shard", "leaf"), [(100, 16), (40, 256), (2000, 32)])
def test_vantage_point_shards_lose_no_link(monkeypatch, centers, shard, leaf):
    """Scattered points, a few dense clusters that no vantage splits, and many small ones."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(centers)
    points = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    if centers:
        near = points[rng.integers(0, centers, 900)]
        for _ in range(6):
            near = np.where(rng.random(900) < 0.5, near ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)), near)
        points = np.unique(np.concatenate((points, near)))
    tree = simhash.build(points[rng.permutation(len(points))[:400]], len(points), 4, shard)
    at, to, block, owns = simhash.route(tree, points, 4)
    blocks, todo = {}, [tree]
    while todo:
        node = todo.pop()
        blocks[node.shard] = node.blocks
        todo += [n for n in (node.near, node.far) if n]
    found = simhash.Forest(len(points))
    for s, b in set(zip(to.tolist(), block.tolist())):
        here = (to == s) & (block == b)
        part, (i, j) = points[at[here]], divmod(b, blocks[s])
        second = None if i == j else ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks[s]) == i
        pairs = simhash.shard_links(part, owns[here].astype(bool), 4, second)
        assert len(pairs) < len(part)
        for a, c in pairs:
            assert int(part[a] ^ part[c]).bit_count() <= 4
            found.link(at[here][[a]], at[here][[c]])
    assert [found.root(i) for i in range(len(points))] == classes(points.tolist(), 4)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_trie_pairs(seed):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    found = list(spelling.trie_pairs(words))
    assert Counter(found) == Counter((i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_apart(words[i], words[j]))


def test_near_words_over_cuts_and_bands(spark):
    """Every pair once each way, however the tries are cut: lengths on both sides of bands, edits at both ends."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(n)) for n in (6, 7, 8, 9, 9, 12, 13, 17, 18, 24, 25, 33, 34, 60)]
    words = set(base)
    for w in base:
        for _ in range(25):
            k = rng.randrange(len(w) + 1)
            words.add(w[:k] + rng.choice(["", "a", "é", "b"]) + w[k + rng.randrange(2) :])
    words = sorted(w for w in words if len(w) >= 6)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").cache()
    want = Counter((a, i + 1, b, j + 1) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b))
    for most in (4096, 20, 1):
        assert Counter(map(tuple, spelling.near_words(df, group_words=most).collect())) == want


def brute_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return Counter(out)


def test_spelling_variants(spark):
    rng = random.Random(5)
    lexicon = ["received", "recieved", "receivd", "Wörterbuch", "Worterbuch", "necessary", "necesary", "neccessary", "neccesary", "ÄÖÜäöü", "straße×"]
    weights = [400, 60, 8, 90, 11, 500, 70, 12, 1, 30, 9]
    rows = [(None if d == 3 else d, " ".join(rng.choices(lexicon, weights, k=120)) if d else None) for d in range(12)] + [(4, "x" * 40_000 + " received"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "form", "cut", "low")})
    found = spelling.spelling_variants(df)
    assert Counter(map(tuple, found.collect())) == brute_spelling(rows)
    chain = {r.word: r.root for r in found.collect()}
    assert chain["receivd"] == "received" and len(chain) > 8
    assert spelling.spelling_variants(df.limit(0)).collect() == []


LINE = "sale_id long, line_no int, item_id long, quantity int, amount double, region string, u string, p string"


def brute_bands(lines, items):
    good = [r for r in lines if None not in (r[0], r[2], r[3], r[4]) and r[3] >= 1 and r[4] == r[4]]
    priced = [((2 * int(np.floor(100 * r[4] + 0.5)) + r[3]) // (2 * r[3]), r) for r in good]
    out = Counter()
    for item, price in items:
        p = int(np.floor(100 * price + 0.5)) if price is not None and price == price else None
        found = [] if p is None else sorted((abs(u - p), u, r[0], -1 if r[1] is None else r[1], r[2]) for u, r in priced if r[2] != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p))
        crc = sum(zlib.crc32(f"{s},{'' if n < 0 else n},{i}".encode()) for _, _, s, n, i in found)
        sums = (len(found), sum(f[0] for f in found), crc)
        for k, f in enumerate(found[:5]):
            out[(item, k + 1, *f[:3], None if f[3] < 0 else f[3], f[4], *sums)] += 1
        if not found:
            out[(item, 0, *[None] * 5, 0, 0, 0)] += 1
    return out


def shop(seed, n=1500):
    """Prices in a crowd, at one hot value, and far apart; a third of the lines of one item; repeated lines and items."""
    rng = random.Random(seed)
    price = lambda: rng.choice([3.0, 3.0, round(rng.uniform(2.8, 3.4), 2), round(rng.uniform(1, 500), 2), round(rng.uniform(900, 901), 2)])
    items = [(i, price()) for i in range(60)] + [(7, 3.0), (7, 3.01), (None, 3.0), (61, None), (62, float("nan")), (63, 1e6)]
    lines = []
    for _ in range(n):
        item, q = rng.choice([7, rng.randrange(60), rng.randrange(60)]), rng.choice([1, 1, 2, 3, 7])
        lines.append((rng.randrange(40), rng.choice([1, 2, None]), item, q, round(price() * q * rng.choice([1, 1, 0.99]), 2), "x", "y", "z"))
    odd = [(None, 1, 3, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 3, None, 3.0), (1, 1, 3, 1, None), (1, 1, 3, 0, 3.0), (1, 1, 3, 1, float("nan")), (1, 1, 3, 1, -3.0)]
    return lines + lines[:50] + [(*r, None, None, None) for r in odd], items


@pytest.mark.parametrize(("seed", "target"), [(1, 65_536), (2, 300), (3, 20)])
def test_band_join(spark, seed, target):
    lines, items = shop(seed)
    left, right = spark.createDataFrame(lines, LINE), spark.createDataFrame(items, "item_id long, price double").withColumn("rank", F.lit("clash"))
    found = band_join.near_price_pairs(left, right, target=target)
    assert Counter(map(tuple, found.collect())) == brute_bands(lines, items)


def test_band_join_of_nothing(spark):
    lines, items = shop(4, 20)
    left, right = spark.createDataFrame(lines, LINE), spark.createDataFrame(items, "item_id long, price double")
    assert band_join.near_price_pairs(left, right.limit(0)).collect() == []
    assert {(r["rank"], r["n_pairs"]) for r in band_join.near_price_pairs(left.limit(0), right).collect()} == {(0, 0)}


def test_regions_split_and_grids():
    """Regions are disjoint, cover every price, hold the target or can't be lightened, and stay few."""
    rng = random.Random(0)
    held = defaultdict(lambda: [0, 0])
    for _ in range(200_000):
        held[rng.choice([300, rng.randrange(280, 330), rng.randrange(200, 40_000)])][0] += 1
    for _ in range(3000):
        held[rng.choice([300, rng.randrange(200, 40_000)])][1] += 1
    bins = sorted((v - 200, 1, *n) for v, n in held.items())
    found = band_join.regions(bins, 200, 5000)
    assert all(a["hi"] <= b["lo"] for a, b in zip(found, found[1:]))
    assert all(any(r["lo"] <= 200 + b[0] < r["hi"] for r in found) for b in bins if b[3])
    assert any(r["line_blocks"] > 5 for r in found) and sum(r["load"] <= 5000 for r in found) > 20
    dealt = sum(r["near"] * r["price_blocks"] for r in found)
    assert dealt < 3 * 200_000 and all(r["near"] / r["line_blocks"] <= 5000 for r in found)


def test_secrets_train_on_a_long_text(spark):
    """Through the default path: each token is labelled without the text's spans beside it."""
    n = 20_000
    df = spark.createDataFrame([(1, "password=abcdef1 " * n), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    assert (rows[1].n_assign, rows[2].n_assign) == (n, 0)


def test_samples_of_a_shared_text_are_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("password=abcdef1 ordinary").alias("text"))
    assert 1000 < secrets.corpus_samples(df).count() < 8000
