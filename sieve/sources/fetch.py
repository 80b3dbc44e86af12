"""GET requests as a table operation: a table of requests in, a table of answers out; failures are rows."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answer = tuple[int, dict[str, str], str, str]
_SCHEMA = "source_id string, adapter string, company string, url string, status int, headers map<string,string>, body string, ok boolean, error string, elapsed_ms long"
_FIELDS = pa.schema([("source_id", pa.string()), ("adapter", pa.string()), ("company", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("elapsed_ms", pa.int64())])
ERROR_CHARS = 400


def get(url: str, headers: dict[str, str], timeout: float = 30) -> Answer:
    """(status, headers by lower-case name, text, error).  304 is an answer without a body, not an error."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace"), ""
    except urllib.error.HTTPError as e:
        detail = "" if e.code == 304 else f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:ERROR_CHARS]}"
        return e.code, {k.lower(): v for k, v in e.headers.items()}, "", detail
    except Exception as e:  # noqa: BLE001  one unreachable board must not fail the scan
        return 0, {}, "", type(e).__name__


def fetch_bodies(requests: DataFrame, getter: Callable[[str, dict[str, str]], Answer] = get, tasks: int | None = None) -> DataFrame:
    """(source_id, adapter, company, url, headers) -> answers.  Dealt by URL; one answer in memory at a time.

    A null URL is a failed answer; null headers are none.  A retried task asks again, so use it for reads only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, adapter, company, url, headers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began = time.monotonic()
                status, answered, body, error = getter(url, dict(headers or {})) if url else (0, {}, "", "no url")
                row = (source, adapter, company, url, status, list(answered.items()), body, not error, error, round((time.monotonic() - began) * 1000))
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, _FIELDS.types, strict=True)], schema=_FIELDS)

    n = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select("source_id", "adapter", "company", "url", F.col("headers").cast("map<string,string>")).repartition(n, "url").mapInArrow(run, _SCHEMA)
