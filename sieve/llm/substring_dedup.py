"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every window of ``size`` words of every document is hashed (a 64-bit and a 16-bit polynomial: 80 bits).  Hashes are
dealt to buckets; a bucket finds the smallest document of each hash and answers the windows of larger documents.
Answers and texts meet by document, where repeated windows merge into maximal removal intervals.

Rows are packed: one row holds what one flush of a map task sends to one bucket, so a window costs about 12 bytes.  A
flush sends a hash for its smallest document only and settles larger ones itself, so a passage that a third of the
documents share costs a bucket one entry per flush.

Nulls: a null text has no words; a null id sorts after all ids and comes back as null.  Rows that share an id are one
document for "smaller", yet each row is judged and returned by itself.  A text shorter than ``size`` loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import NULL_ID, WordHashes, buckets_for, mix, pack, rolling, trimmed, unpack

BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FLUSH_WORDS, FLUSH_BYTES = 600_000, 4 << 20
_PACKED = "bucket int, kind int, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
WINDOWS, ANSWERS, TEXTS = 0, 1, 2


def _rows(found: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found), 64):
        part = found[i : i + 64]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = part.column(0).fill_null(NULL_ID).to_pylist()
            yield from zip(ids, part.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), strict=True)


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((mix(values) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parts(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _answers(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Windows to remove, by the bucket of their document."""
    out = []
    for b, rows in _parts(_bucket(ids.view(np.uint64), n), n):
        rows = rows[np.lexsort((at[rows], marks[rows], ids[rows]))]
        doc, mark, pos = ids[rows], marks[rows], at[rows]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
        first = np.flatnonzero(new)
        step = np.diff(pos.astype(np.int64), prepend=0)
        step[first] = pos[first]
        out.append((b, ANSWERS, pack(doc=doc[first], mark=mark[first], n=np.diff(np.r_[first, len(rows)]).astype(np.uint32), step=step.astype(np.uint32))))
    return out


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    doc, mark, n, step, *rest = unpack(data)
    first = np.cumsum(n.astype(np.int64)) - n
    total = np.cumsum(step.astype(np.int64))
    at = total - np.repeat(total[first] - step[first], n)
    return np.repeat(doc, n), np.repeat(mark, n), at.astype(np.uint32), rest


def _groups(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and for each place of it the smallest document of its hash."""
    order = np.lexsort((g, h))
    hs, gs = h[order], g[order]
    first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])])
    least = np.minimum.reduceat(doc[order], first)
    return order, np.repeat(least, np.diff(np.r_[first, len(h)]))


def _hash_windows(size: int, n: int):
    def flush(docs: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: d[0])
        words = np.concatenate([d[2] for d in docs])
        counts = np.array([len(d[2]) - size + 1 for d in docs])
        starts = np.cumsum([0, *(len(d[2]) for d in docs[:-1])])
        at = np.concatenate([np.arange(c, dtype=np.uint32) for c in counts])
        where = np.repeat(starts, counts) + at
        h = mix(rolling(words, size, BASE_1)[where])
        g = (mix(rolling(mix(words ^ np.uint64(BASE_2)), size, BASE_2)[where]) >> np.uint64(48)).astype(np.uint16)
        doc = np.repeat(np.array([d[0] for d in docs], np.int64), counts)
        mark = np.repeat(np.array([d[1] for d in docs], np.uint32), counts)
        order, least = _groups(h, g, doc)
        late = np.zeros(len(h), bool)
        late[order] = doc[order] > least
        out = _answers(doc[late], mark[late], at[late], n) if late.any() else []
        keep = np.flatnonzero(~late)
        for b, rows in _parts(_bucket(h[keep], n), n):
            rows = keep[rows]
            d, m, p = doc[rows], mark[rows], at[rows]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (m[1:] != m[:-1])])
            step = np.diff(p.astype(np.int64), prepend=0)
            step[first] = p[first]
            out.append((b, WINDOWS, pack(doc=d[first], mark=m[first], n=np.diff(np.r_[first, len(rows)]).astype(np.uint32), step=step.astype(np.uint32), h=h[rows], g=g[rows])))
        yield from _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, held = WordHashes(), [], 0
        for doc_id, text in _documents(batches):
            if len(words := hashes.of(text)) >= size:
                docs.append((doc_id, xxhash.xxh32_intdigest(text), words))
                held += len(words)
            if held >= FLUSH_WORDS:
                yield from flush(docs)
                docs, held = [], 0
        if docs:
            yield from flush(docs)

    return run


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, marks, ats, hs, gs = [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == ANSWERS:
                    yield from _rows([(row["bucket"], ANSWERS, row["data"])])
                    continue
                doc, mark, at, (h, g) = _read(row["data"])
                for into, x in ((docs, doc), (marks, mark), (ats, at), (hs, h), (gs, g)):
                    into.append(x)
        if not docs:
            return
        doc, h, g = (np.concatenate(x) for x in (docs, hs, gs))
        order, least = _groups(h, g, doc)
        late = order[doc[order] > least]
        del h, g, least, order
        if len(late):
            yield from _rows(_answers(doc[late], np.concatenate(marks)[late], np.concatenate(ats)[late], n))

    return run


def _pack_texts(n: int):
    def flush(docs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids = np.array([d[0] for d in docs], np.int64)
        out = []
        for b, rows in _parts(_bucket(ids.view(np.uint64), n), n):
            own = [docs[r] for r in rows]
            body = zstandard.compress(b"".join(d[1] for d in own), 3)
            out.append((b, TEXTS, pack(doc=ids[rows], n=np.array([len(d[1]) for d in own], np.uint32), body=np.frombuffer(body, np.uint8))))
        yield from _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0
        for doc_id, text in _documents(batches):
            docs.append((doc_id, text))
            held += len(text) + 64
            if held >= FLUSH_BYTES:
                yield from flush(docs)
                docs, held = [], 0
        if docs:
            yield from flush(docs)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(size: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", _SPANS)] + [("kept_text", pa.string())] * with_text)

    def of(doc_id: int, text: bytes, starts: np.ndarray | None) -> tuple:
        words = text.split()
        spans, kept = [], words
        if starts is not None:
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(starts.astype(np.int64) + size, len(words)), -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = list(compress(words, keep.tolist()))
            turn = np.flatnonzero(np.diff(np.r_[True, keep, True]))
            spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
        body = b" ".join(kept)
        return (None if doc_id == NULL_ID else doc_id, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), spans, *[body.decode()] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, marks, ats, blocks = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == TEXTS:
                    blocks.append(row["data"])
                else:
                    for into, x in zip((docs, marks, ats), _read(row["data"])[:3], strict=True):
                        into.append(x)
        found: dict[tuple[int, int], np.ndarray] = {}
        if docs:
            doc, mark, at = (np.concatenate(x) for x in (docs, marks, ats))
            order = np.lexsort((mark, doc))
            doc, mark, at = doc[order], mark[order], at[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
            found = dict(zip(zip(doc[first].tolist(), mark[first].tolist(), strict=True), np.split(at, first[1:]), strict=True))
        for block in blocks:
            ids, n, body = unpack(block)
            text, end = zstandard.decompress(body.tobytes()), np.cumsum(n.astype(np.int64))
            out = []
            for i, a, b in zip(ids.tolist(), (end - n).tolist(), end.tolist(), strict=True):
                own = text[a:b]
                out.append(of(i, own, found.get((i, xxhash.xxh32_intdigest(own))) if found else None))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def remove_repeated_windows(df: DataFrame, *, size: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Words covered by a window that also starts in a document with a smaller id, removed.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), removed (maximal intervals of
    word positions) and, if asked for, kept_text.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = buckets_for(docs, 4 << 20)
    answers = docs.mapInArrow(trimmed(_hash_windows(size, n)), _PACKED).repartitionById(n, "bucket").mapInArrow(trimmed(_count(n)), _PACKED)
    texts = docs.mapInArrow(trimmed(_pack_texts(n)), _PACKED)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>" + ", kept_text string" * with_text
    return answers.union(texts).repartitionById(n, "bucket").mapInArrow(trimmed(_remove(size, with_text)), out)
