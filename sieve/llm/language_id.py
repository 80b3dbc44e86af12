"""Language ID by rank-order profiles.

A profile is the ranking of the most frequent n-grams (one to three letters, a mark for word ends) of a language's
training texts.  A document's own ranking is compared with each profile: an n-gram costs how far out of place it is,
the full depth if the profile lacks it.  The language with the least total wins.

Profiles are learned from at most ``most_docs`` documents per language, picked by a hash of their id (a bound that is a
parameter); prediction reads every text whole.  Text is handled in runs of about half a million code points, so memory
does not follow the partition.  Predictions depend on the text alone: a run's letters are coded in as many bits as they
need, and a run that needs more than 64 bits an n-gram is halved.

Nulls: a null text, or one without letters, is ``und`` with score 0; so is every text if nothing could be learned.
Training skips null texts and null languages.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from sieve.llm.common import trimmed

DEPTH = 300
MOST_DOCS = 4000
RUN = 500_000
UNKNOWN = "und"
_NOTHING = 0x1FFFFF


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def runs(texts: list[str | None], most: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, lower-cased, of about ``most`` code points together; each with the place of its first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").lower())
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count), sorted by document; an n-gram is three 21-bit code points, 0 a word end, 0x1FFFFF nothing."""
    points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 2 for t in texts])
    letter = _letters()[points]
    # what separates words counts beside a letter only, so a text's n-grams don't depend on its neighbours
    keep = letter | np.r_[False, letter[:-1]] | np.r_[letter[1:], False]
    if not keep.any():
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none
    points, doc = np.where(letter, points, 0)[keep], doc[keep]
    found = np.flatnonzero(np.bincount(points)).astype(np.uint32)
    if found[0] != 0:
        found = np.r_[np.uint32(0), found]
    width = len(found).bit_length()  # the last code, of nothing, included
    if len(texts) > 1 and 3 * width + (len(texts) - 1).bit_length() > 64:
        half = len(texts) // 2
        a, b = grams(texts[:half]), grams(texts[half:])
        return np.r_[a[0], b[0] + half], np.r_[a[1], b[1]], np.r_[a[2], b[2]]
    codes = np.zeros(int(found[-1]) + 1, np.uint32)
    codes[found] = np.arange(len(found), dtype=np.uint32)
    code = codes[points].astype(np.uint64)
    last = len(found)
    a, b, c = code[:-2], code[1:-1], code[2:]
    none, s1, s2, s3 = np.uint64(last), np.uint64(width), np.uint64(2 * width), np.uint64(3 * width)
    top = doc << s3 if len(texts) > 1 else np.zeros_like(doc)
    one = (top | code << s2 | none << s1 | none)[code > 0]
    two = (top[:-1] | code[:-1] << s2 | code[1:] << s1 | none)[((code[:-1] > 0) | (code[1:] > 0)) & (doc[:-1] == doc[1:])]
    three = (top[1:-1] | a << s2 | b << s1 | c)[(b > 0) & (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:])]
    keys = np.concatenate([one, two, three])
    del one, two, three, top, code, doc, points
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    keys, count = keys[first], np.diff(np.r_[first, len(keys)])
    wide, low = np.r_[found, np.uint32(_NOTHING)].astype(np.uint64), np.uint64((1 << width) - 1)
    gram = wide[(keys >> s2) & low] << np.uint64(42) | wide[(keys >> s1) & low] << np.uint64(21) | wide[keys & low]
    of = (keys >> s3).astype(np.int64) if len(texts) > 1 else np.zeros(len(keys), np.int64)
    return of, gram, count


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank) of each document's most frequent ones; the larger count first, then the n-gram."""
    if not len(doc):
        return doc, gram, doc
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    top = rank < depth
    return doc[top], gram[top], rank[top]


def learn(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", depth: int = DEPTH, most_docs: int = MOST_DOCS) -> dict[str, list[int]]:
    """lang -> its n-grams in order.  What reaches the driver is ``depth`` n-grams a language."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rate = {r["lang"]: min(1.0, most_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rate:
        return {}
    share = F.create_map(*(F.lit(x) for pair in rate.items() for x in pair))[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for at, part in runs(texts):
                doc, gram, n = grams(part)
                of = langs[at : at + len(part)][doc]
                for lang in sorted(set(of.tolist())):
                    own = of == lang
                    seen, place = np.unique(gram[own], return_inverse=True)
                    yield pa.record_batch([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int64)), pa.array(np.bincount(place, n[own]).astype(np.int64))], names=["lang", "gram", "n"])

    counted = picked.mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= depth).select("lang", "gram", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def _predict(profiles: dict[str, list[int]], depth: int):
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
    place = np.full((len(known) + 1, len(langs)), depth, np.int32)
    for j, lang in enumerate(langs):
        place[np.searchsorted(known, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))

    def of(texts: list[str | None]) -> tuple[list[str], list[float]]:
        tags, scores = [], []
        for _, part in runs(texts):
            doc, gram, rank = ranked(*grams(part), depth)
            tag, score = [UNKNOWN] * len(part), [0.0] * len(part)
            if len(doc) and langs:
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                at = np.where(known[at] == gram, at, len(known))
                there = place[at]
                cost = np.where(there < depth, np.abs(there - rank[:, None]), depth)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                total = np.add.reduceat(cost, first, axis=0) / (depth * np.diff(np.r_[first, len(doc)]))[:, None]
                for d, j, x in zip(doc[first].tolist(), total.argmin(1).tolist(), total.min(1).tolist(), strict=True):
                    tag[d], score[d] = langs[j], max(0.0, 1.0 - x)
            tags += tag
            scores += score
        return tags, scores

    return of


def identify(df: DataFrame, profiles: dict[str, list[int]], *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The rows of ``df`` with ``lang_pred`` and ``score`` (1 less the share of the greatest distance) added or replaced."""
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    of, at = _predict(profiles, depth), rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                tags, scores = of(part.column(at).cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    rows = df.select(*(F.col(f"`{c}`") for c in rest))
    schema = StructType(list(rows.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(trimmed(run), schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether the crc32 of the id as text falls into fold 0; a null id is held out, as nothing says otherwise."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
