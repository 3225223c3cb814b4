"""Feedback counters kept as state that ends by itself.

Two forms of "every write renews a counter, which ends after so long without one":

* ``renewed_counts`` lives by the clock: a counter's state is kept for ``ttl`` after its last write and is then gone, whatever the
  feedback's own times are. It emits the counters that a batch has touched.
* ``kept_sessions`` lives by event time: open sessions are state, a timer stands at the end of each, and when the watermark passes it the
  session is emitted and forgotten. On the same feedback its rows are those of ``counters.sessions``, but that a gap of exactly the
  length ends a session, as an expiry does (``session_window`` joins what touches).

Feedback that arrives together is first put together task by task, so a finding with very many rows sends a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revsieve.plans.shipping import ship
from revsieve.schemas import FEEDBACK_TYPES
from revsieve.streaming.counters import RETENTION, timed

ship(__name__)

KINDS = FEEDBACK_TYPES[:4]
COUNTS = ["total_count", *[f"{k}_count" for k in KINDS]]
COUNT_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession, by_clock: bool = False):
    """Streams started inside keep their state in the store that such operators need.

    State that lives by the clock always asks for one more batch, so such a stream only runs batches that have data; else it
    would never reach the end of the available input.
    """
    wanted = {PROVIDER: ROCKS} | ({NO_DATA: "false"} if by_clock else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def micros(duration: str) -> int:
    return int(pd.Timedelta(duration).value // 1000)


def put_together(feedback: DataFrame, gap: str) -> DataFrame:
    """Runs of feedback on a finding, as far as a task holds them: first and last time (microseconds) and counts."""
    step = micros(gap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["analysis_result_id", "at"], kind="stable")
            new = (rows["analysis_result_id"] != rows["analysis_result_id"].shift()) | (rows["at"] - rows["at"].shift() >= step)
            out = rows.assign(run=new.cumsum(), **{f"{k}_count": (rows["feedback_type"] == k).astype("int64") for k in KINDS})
            grouped = out.groupby("run", sort=False)
            sums = grouped[[f"{k}_count" for k in KINDS]].sum()
            sums.insert(0, "total_count", grouped.size().astype("int64"))
            sums.insert(0, "last_at", grouped["at"].max())
            sums.insert(0, "first_at", grouped["at"].min())
            sums.insert(0, "analysis_result_id", grouped["analysis_result_id"].first())
            yield sums.reset_index(drop=True)

    named = timed(feedback).where("analysis_result_id IS NOT NULL AND ts IS NOT NULL")
    narrow = named.select("analysis_result_id", F.unix_micros("ts").alias("at"), F.coalesce("feedback_type", F.lit("")).alias("feedback_type"))
    return narrow.mapInPandas(run, f"analysis_result_id string, first_at bigint, last_at bigint, {COUNT_SCHEMA}")


class RenewedCounts(StatefulProcessor):
    """Counters of a finding; the store drops them when their time is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", COUNT_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.counts.get() if self.counts.exists() else None
        sums = list(known) if known is not None else [0] * len(COUNTS)
        for part in rows:
            sums = [a + int(b) for a, b in zip(sums, part[COUNTS].sum())]
        self.counts.update(tuple(sums))
        yield pd.DataFrame([[key[0], *sums]], columns=["analysis_result_id", *COUNTS])

    def close(self) -> None:
        pass


def renewed_counts(feedback: DataFrame, ttl: str = RETENTION) -> DataFrame:
    """Running counters of the findings that a batch touches (update mode); a counter ends ``ttl`` after its last write."""
    return put_together(feedback, ttl).groupBy("analysis_result_id").transformWithStateInPandas(
        RenewedCounts(micros(ttl) // 1000), f"analysis_result_id string, {COUNT_SCHEMA}", "Update", "ProcessingTime")


class KeptSessions(StatefulProcessor):
    """Open sessions of a finding, with a timer at the end of each."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"first_at bigint, last_at bigint, {COUNT_SCHEMA}")

    def _end_ms(self, session) -> int:
        return -(-(session[1] + self.gap) // 1000)

    def _keep(self, sessions: list[list[int]]) -> None:
        if sessions:
            self.open.put([tuple(s) for s in sessions])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [list(s) for s in self.open.get()]
        before = {self._end_ms(s) for s in known}
        for part in rows:
            known += [[int(x) for x in r] for r in part[["first_at", "last_at", *COUNTS]].itertuples(index=False)]
        merged: list[list[int]] = []
        for s in sorted(known):
            if merged and s[0] < merged[-1][1] + self.gap:
                last = merged[-1]
                merged[-1] = [last[0], max(last[1], s[1]), *(a + b for a, b in zip(last[2:], s[2:]))]
            else:
                merged.append(s)
        after = {self._end_ms(s) for s in merged}
        for gone in before - after:
            self.handle.deleteTimer(gone)
        for new in after - before:
            self.handle.registerTimer(new)
        self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions = [list(s) for s in self.open.get()]
        done = [s for s in sessions if self._end_ms(s) <= now]
        if done:
            self._keep([s for s in sessions if self._end_ms(s) > now])
            yield pd.DataFrame([[key[0], s[0], s[1] + self.gap, *s[2:]] for s in done],
                               columns=["analysis_result_id", "start_at", "end_at", *COUNTS])

    def close(self) -> None:
        pass


def kept_sessions(feedback: DataFrame, gap: str = RETENTION, delay: str = "1 hour") -> DataFrame:
    """Sessions that the watermark has ended, as ``counters.sessions`` gives them.

    Feedback older than the watermark is left out; what arrives together and belongs to one run counts as late by its last time.
    """
    runs = put_together(feedback, gap).withColumn("last", F.timestamp_micros("last_at")).withWatermark("last", delay)
    out = runs.groupBy("analysis_result_id").transformWithStateInPandas(
        KeptSessions(micros(gap)), f"analysis_result_id string, start_at bigint, end_at bigint, {COUNT_SCHEMA}", "Append", "EventTime")
    return out.select("analysis_result_id", F.timestamp_micros("start_at").alias("start"), F.timestamp_micros("end_at").alias("end"), *COUNTS)
