"""Spelling variants: words at edit distance one, by a self-join of a prefix-partitioned vocabulary trie.

A trie node's active nodes are those at a distance of at most one.  They are handed down: a child's follow from its
parent's, and where both a node and an active node at distance one end a word, the pair is found.

* An edit leaves the first half of two words alone, or the second.  So the vocabulary has two tries, of the words and of
  the words reversed, each cut at prefixes: what differs before a cut of the one is whole behind a cut of the other.
* Lengths come in bands; a word whose length begins a band visits the band below too, for the words one shorter.  Within
  a band a cut is as deep as its prefix holds more than a bounded number of words, and half its least length at most.
* A cut prefix's words are one group: the trie below it is walked in a task.  A pair is emitted only by the band of its
  shorter word, and by the reversed trie only if the other trie's cut keeps the two words apart: so once.

Words that share a band's half prefix are one group whatever their number.

Nulls: a null text has no runs; a null id counts as an empty one in the rule that damages runs.  Empty vocabularies give
no rows; repeated rows count again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import staged, trimmed, unstaged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Every so-many-th run, by its checksum, loses a code point.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a cut prefix; more where the vocabulary has over 1,024 times as many, so that cuts stay few.
GROUP_WORDS, MOST_GROUPS = 4096, 1024
#: Prefixes deeper than this don't cut.
DEEPEST = 16
#: Tokens remembered with their runs, and words counted before a worker hands them on.
MOST_TOKENS, MOST_COUNTED = 100_000, 150_000


def word_counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, one of ``damaged`` short of a code point; n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, bytes]]] = {}
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{i.as_py()}:".encode() if i.is_valid else b":")
                runs: Counter[tuple[str, bytes]] = Counter()
                for token, n in Counter(text.as_py().split()).items():
                    found = known.get(token)
                    if found is None:
                        found = [(w, w.encode()) for w in (r.translate(LOWER) for r in RUN.findall(token))]
                        if len(token) <= 64:
                            if len(known) >= MOST_TOKENS:
                                known.clear()
                            known[token] = found
                    for pair in found:
                        runs[pair] += n
                for (word, raw), n in runs.items():
                    h = zlib.crc32(raw, start)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) >= MOST_COUNTED:
                    yield out()
        yield out()

    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bands(least: int) -> list[tuple[int, int]]:
    """(least, greatest length) of the bands, each half as long again as the one before; the last has no end."""
    out = []
    while least // 2 < DEEPEST:
        end = max(least, least * 4 // 3)
        out.append((least, end))
        least = end + 1
    return [*out, (least, 1 << 30)]


def trie_pairs(words: list[str], depth: int = 0) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of the words at edit distance one that agree in their first ``depth`` code points; words are distinct.

    Nodes are walked from the cut down; a branch with one word that only its own nodes are near is left.
    """
    kids: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    below: list[int] = [len(words)]
    for i, word in enumerate(words):
        at = 0
        for c in word[depth:]:
            nxt = kids[at].get(c)
            if nxt is None:
                kids[at][c] = nxt = len(kids)
                kids.append({})
                ends.append(-1)
                below.append(0)
            below[nxt] += 1
            at = nxt
        ends[at] = i
    # a node, its parent, and the nodes at distance one that are neither its parent nor its children, which always are
    todo: list[tuple[int, int, list[int]]] = [(0, -1, [])]
    while todo:
        node, parent, active = todo.pop()
        end, own = ends[node], kids[node]
        if end >= 0:
            for v in active:
                if ends[v] > end:
                    yield end, ends[v]
            for v in own.values():
                if ends[v] >= 0:
                    yield min(end, ends[v]), max(end, ends[v])
        for c, child in own.items():
            # its last code point replaced: siblings; all before it edited: what was near the node, and goes on alike
            found = [v for v in own.values() if v != child]
            for v in (*active, *found) if parent < 0 else (*active, *found, parent):
                w = kids[v].get(c)
                if w is not None and w != node:
                    found.append(w)
            if below[child] > 1 or found:
                todo.append((child, node, found))


_PAIRS = "word string, n long, near string, near_n long"


def _group_pairs(key: tuple, table: pa.Table) -> pa.Table:
    reverse, low, high, cut = (k.as_py() for k in key)
    words, counts, other = table["s"].to_pylist(), table["n"].to_pylist(), table["other"].to_pylist()
    out: list[list] = [[], [], [], []]
    for i, j in trie_pairs(words, len(cut)):
        if not low <= min(len(words[i]), len(words[j])) <= high or (reverse and other[i] == other[j]):
            continue
        a, b = (words[i][::-1], words[j][::-1]) if reverse else (words[i], words[j])
        for column, pair in zip(out, ((a, b), (counts[i], counts[j]), (b, a), (counts[j], counts[i]))):
            column.extend(pair)
    return pa.table({"word": pa.array(out[0], pa.string()), "n": pa.array(out[1], pa.int64()), "near": pa.array(out[2], pa.string()), "near_n": pa.array(out[3], pa.int64())})


def near_words(words: DataFrame, *, least_length: int = LEAST_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, near, near_n) of every ordered pair of distinct words at edit distance one.

    ``words`` has (word, n), each word once, none under ``least_length``; it is read several times, so stage it.
    """
    most = max(group_words, -(-words.count() // MOST_GROUPS))
    bands = "array(" + ",".join(f"named_struct('low', {a}, 'high', {b})" for a, b in _bands(least_length)) + ")"
    banded = words.withColumn("b", F.explode(F.expr(f"filter({bands}, b -> length(word) BETWEEN b.low AND b.high + 1)"))).select("word", "n", "b.low", "b.high")
    both = banded.withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("s", F.expr("if(reverse, reverse(word), word)"))
    limit = f"cast(least({DEEPEST}, low div 2) as int)"
    prefixes = both.select("reverse", "low", F.explode(F.expr(f"transform(sequence(0, {limit} - 1), k -> substring(s, 1, k))")).alias("p"))
    # at most MOST_GROUPS * 1.34 prefixes of a length hold so many words
    heavy = [(r["reverse"], r["low"], r["p"]) for r in prefixes.groupBy("reverse", "low", "p").count().where(F.col("count") > most).collect()]
    depths: dict[tuple[bool, int], set[str]] = defaultdict(set)
    for reverse, low, p in heavy:
        depths[reverse, low].add(p)

    def cut(s: str, reverse: bool, low: int) -> str:
        deepest, held = min(DEEPEST, low // 2), depths.get((reverse, low), ())
        k = 0
        while k < deepest and s[:k] in held:
            k += 1
        return s[:k]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))))
            cuts = [cut(s, reverse, low) for low, reverse, s in rows]
            others = [cut(s[::-1], False, low) if reverse else "" for low, reverse, s in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.string()), pa.array(others, pa.string())], names=[*batch.schema.names, "cut", "other"])

    groups = both.select("n", "high", "low", "reverse", "s").mapInArrow(keyed, "n long, high int, low int, reverse boolean, s string, cut string, other string")
    return groups.groupBy("reverse", "low", "high", "cut").applyInArrow(_group_pairs, _PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): from each, forms are followed to the last, by doubling the steps."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        unstaged(before)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_length`` code points and ``least_count`` occurrences.

    ``form`` is the commonest near word (ties: the least) if it occurs ``ratio`` times as often at least, else null.
    """
    counted = word_counts(df, id_col=id_col, text_col=text_col)
    words = staged(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)))
    best = near_words(words, least_length=least_length, group_words=group_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    found = staged(found.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
