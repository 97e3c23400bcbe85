"""A feed of changed files as keyed state: repeats of a path fold, own writes are told from others'.

Who writes a file leaves a ticket first: the path and the digest of what is written.  A change is
passed on when its path has been quiet for a while, as one row with the last state.  It was an own
write if a ticket since the path's last change has just that digest; the ticket is spent either way.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.ship import ship
from quarry.plans.stored import cut, new_path
from quarry.registry import query
from quarry.sources.tables import table

FEED = "path string, seq long, op string, hash string, external boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Fold(StatefulProcessor):
    """State of a path: the change that waits, and the ticket that is open."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "seq long, op string, hash string, at long")
        self.ticket = handle.getValueState("ticket", "hash string")

    def _pass_on(self, path: str) -> tuple:
        seq, op, digest, _ = self.waiting.get()
        own = op != "unlink" and self.ticket.exists() and self.ticket.get()[0] == digest
        self.waiting.clear()
        self.ticket.clear()
        return path, seq, op, digest, not own

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            if self.waiting.exists() and r.at > self.waiting.get()[3] + self.quiet:
                out.append(self._pass_on(key[0]))
            digest = r.hash if isinstance(r.hash, str) else None
            if r.op == "ticket":
                self.ticket.update((digest,))
            elif not self.waiting.exists() or r.at >= self.waiting.get()[3]:  # one that comes late is not the last state
                self.waiting.update((int(r.seq), r.op, digest, int(r.at)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.waiting.exists():
            self.handle.registerTimer(self.waiting.get()[3] + self.quiet)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame([self._pass_on(key[0])] if self.waiting.exists() else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "seq", "op", "hash", "external"])


@contextlib.contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB, as state with timers needs."""
    was = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, was)


def fold_changes(changes: DataFrame, quiet_ms: int = 1_000, late: str = "1 minute") -> DataFrame:
    """path, seq, op, hash, external of a stream of (path, op, seq, hash, ts), in append mode.

    ``op`` is add, change, unlink or ticket.  Changes of a path with pauses of at most ``quiet_ms``
    fold into the last of them by time and seq.  Paths that stay quiet pass on when the
    watermark, ``late`` behind the latest row, has gone by.  Null paths are left out.
    """
    ship(changes.sparkSession)
    rows = changes.where(F.col("path").isNotNull()).select(F.col("path").cast("string").alias("path"), "op", F.col("seq").cast("long").alias("seq"), F.col("hash").cast("string").alias("hash"), "ts", F.unix_millis("ts").alias("at"))
    return rows.withWatermark("ts", late).groupBy("path").transformWithStateInPandas(Fold(quiet_ms), FEED, "append", "eventTime")


_CHANGES = "SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, epoch_ms(ts) AS ms, CASE event_type WHEN 'error' THEN 'unlink' WHEN 'purchase' THEN 'ticket' WHEN 'signup' THEN 'ticket' ELSE 'change' END AS op, CAST(event_id % 3 AS VARCHAR) AS hash FROM events"
_QUIET = 3_600_000
_FEED_SQL = f"""WITH c AS ({_CHANGES}), w AS (SELECT * FROM c WHERE op <> 'ticket'),
  g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY path ORDER BY ms, seq) <= {_QUIET} THEN 0 ELSE 1 END AS edge FROM w),
  s AS (SELECT *, sum(edge) OVER (PARTITION BY path ORDER BY ms, seq) AS k FROM g),
  l AS (SELECT path, k, max_by(seq, (ms, seq)) AS seq, max_by(op, (ms, seq)) AS op, max_by(hash, (ms, seq)) AS hash, max(ms) + {_QUIET} AS due FROM s GROUP BY 1, 2),
  d AS (SELECT *, coalesce(lag(due) OVER (PARTITION BY path ORDER BY k), -1) AS before FROM l)
  SELECT path, seq, op, hash, coalesce(op = 'unlink' OR hash <> (SELECT max_by(t.hash, (t.ms, t.seq)) FROM c t WHERE t.op = 'ticket' AND t.path = d.path AND t.ms <= d.due AND t.ms > d.before), true) AS external FROM d"""


@query("x9_change_tickets", _FEED_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches of events as changes and tickets; the first is followed by a restart."""
    from quarry.streaming.events import run

    path = new_path(spark, "changes")
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "unlink").when(F.col("event_type").isin("purchase", "signup"), "ticket").otherwise("change")
    rows = cut(e.select(F.col("user_id").cast("string").alias("path"), op.alias("op"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("string").alias("hash"), F.col("ts").cast("timestamp").alias("ts")))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    # A row a year later moves the watermark past all that waits; its own path never passes on.
    tail = rows.limit(1).select(F.lit("~").alias("path"), F.lit("change").alias("op"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("hash"), F.lit(last).cast("timestamp").alias("ts") + F.expr("INTERVAL 365 DAYS"))
    middle = first + (last - first) / 2
    parts = [rows.where(F.col("ts") <= F.lit(middle)), rows.where(F.col("ts") > F.lit(middle)), tail.toDF(*rows.columns)]
    outs = []
    with large_state(spark):
        for k, part in enumerate(parts):
            part.write.parquet(f"{path}/in/part={k}")
            changes = spark.readStream.schema(rows.schema).parquet(f"{path}/in/part=*")
            outs.append(run(fold_changes(changes, _QUIET), "append", checkpoint=f"{path}/state"))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])
