"""Shared pieces: word hashing, packed shuffle rows, staged tables."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside the ASCII white space; ``bytes.split()`` cuts there.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Ids of rows whose id is null sort after every other id.
NULL_ID = (1 << 63) - 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text, which is cut at white space every MiB to bound the list of words."""
        if len(text) <= 1 << 20:
            return self.of_part(text)
        parts, at = [], 0
        while at < len(text):
            cut = SPACE.search(text, at + (1 << 20))
            end = cut.start() if cut else len(text)
            parts.append(self.of_part(text[at:end]))
            at = end
        return np.concatenate(parts)

    def of_part(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose end the memory it freed goes back to the system, as a worker lives on after its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return whole


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp value of each window of ``size`` hashes: sum of h[i+j] * base**(size-1-j) modulo 2**64."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, b = h[:n].copy(), np.uint64(base)
    for j in range(1, size):
        out *= b
        out += h[j : j + n]
    return out


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes; what shrinks is compressed, random bits are stored."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        small = raw if a.dtype == np.uint64 or len(raw) < 64 else zstandard.compress(raw, 1)
        packed = len(small) < len(raw)
        kind = a.dtype.str.encode()
        out += [bytes([packed, len(kind)]), kind, len(small if packed else raw).to_bytes(4, "little"), small if packed else raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        packed, k = data[at], data[at + 1]
        kind = data[at + 2 : at + 2 + k].decode()
        size = int.from_bytes(data[at + 2 + k : at + 6 + k], "little")
        raw = data[at + 6 + k : at + 6 + k + size]
        out.append(np.frombuffer(zstandard.decompress(raw) if packed else raw, kind))
        at += 6 + k + size
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on this machine.

    Raises RuntimeError on a cluster without one: a machine's own folder would be read back in part or not at all.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sieve/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstaged(*frames: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer expects the input to hold; 0 for plans whose size it doesn't know, such as plain RDDs."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else 0


def buckets_for(df: DataFrame, bytes_each: int = 12 << 20) -> int:
    """Buckets that hold about as much each whatever the input; the shuffle partitions at least, and for unknown sizes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // bytes_each))


#: Keys with more than this part of all rows are hot; there are as many at most.
HOT_PART = 4096


def join_skewed(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", part: int = HOT_PART) -> DataFrame:
    """``left`` joined by ``key`` with ``right``, which has one row a key and says in ``rows`` how many ``left`` has of it.

    ``total`` bounds the sum of ``rows``.  Keys that hold more than ``total / part`` of them are ``part`` at most, so they
    are broadcast whatever the input, and no task takes a hot key's rows; the others are shuffled.
    """
    hot, cold = right.where(F.col(rows) * part > total), right.where(F.col(rows) * part <= total)
    first = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.unionByName(rest)


def perhaps_among(df: DataFrame, values: DataFrame, column: str, mark: str, bits: int = 1 << 23) -> DataFrame:
    """``df`` with a boolean ``mark``: false where ``column`` is surely none of ``values``.

    What is broadcast is a bitmap of hashes, ``bits / 8`` bytes (1 MiB) whatever the number of values; the more values,
    the more rows are marked that need not be.
    """
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    parts = values.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / 32768).alias("_part")).agg(F.bitmap_construct_agg((F.col("_at") % 32768).cast("int")).alias("_bits"))
    rows = df.withColumns({"_at": at, "_part": F.floor(at / 32768)}).join(F.broadcast(parts), "_part", "left")
    byte = "cast(conv(hex(substring(_bits, cast(_at % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.withColumn(mark, F.expr(f"coalesce(getbit({byte}, cast(_at % 8 as int)) = 1, false)")).drop("_at", "_part", "_bits")
