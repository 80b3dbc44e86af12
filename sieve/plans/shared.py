"""What the jobs share: rows as the state holds them, runs, tables written once, and changes that wait for a ranking."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sieve.operators import relational
from sieve.sources.store import TABLES, StateStore

MOST_RUNS = 50


def state_rows(df: DataFrame, table: str) -> DataFrame:
    return df.select(*re.findall(r"(?:^|, )(\w+) ", TABLES[table][1]))


def run_row(store: StateStore, run_id: str, kind: str, at: str, counters: dict) -> DataFrame:
    return store.spark.createDataFrame([(run_id, kind, at, json.dumps(counters, sort_keys=True))], TABLES["runs"][1])


def last_runs(runs: DataFrame) -> DataFrame:
    return relational.last_runs(runs, "run_id", ["at", "run_id"], MOST_RUNS)


def staged(store: StateStore, rows: DataFrame) -> DataFrame:
    """Rows written once beside the state and read back, as several reads follow; survives lost executors."""
    path = f"{store.root.rstrip('/')}/staged/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


@dataclass
class Changes:
    """A run's changes in two phases: some stand whatever comes, some only once the run has succeeded.

    Until ``commit`` nothing is visible; it makes what is admitted visible together, in one version.  Withheld rows are
    as if the run had never met them, so the next run does.
    """

    sure: dict[str, DataFrame] = field(default_factory=dict)
    pending: dict[str, DataFrame] = field(default_factory=dict)

    def commit(self, store: StateStore, succeeded: bool) -> int:
        changes = dict(self.sure)
        for table, rows in self.pending.items() if succeeded else ():
            changes[table] = changes[table].unionByName(rows) if table in changes else rows
        return store.commit(changes, {"runs": last_runs})
