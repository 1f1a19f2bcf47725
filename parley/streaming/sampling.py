"""Tail sampling of a running stream of spans: which traces to export is known only once a failed span may have come.

Spans of traces within the ratio go through at once, without state. Any other span waits in
the state of its trace, in a bucket of traces, until a forced span of that trace comes, before or after it; from then on the trace's
spans go through. What waits lies in pieces on the executors' disks and is given
out piece by piece, so a trace of any size needs no memory of its size. With ``wait_ms`` a trace is forgotten once
the watermark has passed its last span by that time; a forced span that comes within it still rescues all of its trace.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.constants import SAMPLE_RATE
from parley.operators.sampling import within_ratio
from parley.streaming.rewrite import BUCKETS, STATE_STORE

#: Spans of a bucket that wait in memory while a batch comes, before they go to the state.
ROWS_WAITING = 20_000
#: Spans wait as JSON text; times keep all their digits.
WHOLE_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class TailSampler(StatefulProcessor):
    """One key holds the traces of a bucket. Rows hold (trace_id, force_sample, ts_ms, row): ``row`` is the whole span as JSON text."""

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getMapState("trace", "trace_id string", "forced boolean, timer long, pieces long")
        self.spans = handle.getMapState("spans", "trace_id string, piece long", "rows string")
        self.due = handle.getMapState("due", "time long", "traces array<string>")

    def _given_out(self, trace: str, at: dict[str, Any]) -> Iterator[pd.DataFrame]:
        """The pieces that wait, one after the other; they leave the state."""
        for n in range(at["pieces"]):
            yield pd.DataFrame({"row": json.loads(self.spans.getValue((trace, n))[0])})
            self.spans.removeKey((trace, n))
        at["pieces"] = 0

    def _put(self, waiting: dict[str, list[str]], known: dict[str, dict[str, Any]]) -> None:
        for trace, rows in waiting.items():
            self.spans.updateValue((trace, known[trace]["pieces"]), (json.dumps(rows),))
            known[trace]["pieces"] += 1
        waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, Any]] = {}
        waiting: dict[str, list[str]] = {}
        n_waiting, any_trace = 0, self.trace.exists()
        for frame in rows:
            out: list[str] = []
            for trace, force, ts, row in zip(*(frame[n].tolist() for n in ("trace_id", "force_sample", "ts_ms", "row"))):
                at = known.get(trace)
                if at is None:
                    old = self.trace.getValue((trace,)) if any_trace else None
                    at = known[trace] = dict(zip(("forced", "timer", "pieces"), old or (False, 0, 0)), latest=0)
                if ts == ts and ts is not None:
                    at["latest"] = max(at["latest"], int(ts))
                if force and not at["forced"]:
                    at["forced"] = True
                    yield from self._given_out(trace, at)
                    held = waiting.pop(trace, [])
                    n_waiting -= len(held)
                    out.extend(held)
                if at["forced"]:
                    out.append(row)
                else:
                    waiting.setdefault(trace, []).append(row)
                    n_waiting += 1
            if out:
                yield pd.DataFrame({"row": out})
            if n_waiting > ROWS_WAITING:
                self._put(waiting, known)
                n_waiting = 0
        self._put(waiting, known)
        due: dict[int, list[str]] = {}
        for trace, at in known.items():
            if self.wait_ms is not None and at["latest"] + self.wait_ms > at["timer"]:
                at["timer"] = at["latest"] + self.wait_ms
                due.setdefault(at["timer"], []).append(trace)
            self.trace.updateValue((trace,), (at["forced"], at["timer"], at["pieces"]))
        for when, traces in due.items():
            old = self.due.getValue((when,))
            self.due.updateValue((when,), ([*(old[0] if old is not None else []), *traces],))
            self.handle.registerTimer(when)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        listed = self.due.getValue((fired,))
        for trace in dict.fromkeys(listed[0] if listed is not None else []):
            at = self.trace.getValue((trace,))
            if at is not None and at[1] == fired:  # else its timer has moved since
                for n in range(at[2]):
                    self.spans.removeKey((trace, n))
                self.trace.removeKey((trace,))
        self.due.removeKey((fired,))
        return iter(())

    def close(self) -> None:
        pass


def sample_live(spans: DataFrame, rate: float = SAMPLE_RATE, ts: str = "ts", wait_ms: int | None = 600_000, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Spans of sampled traces of a streaming DataFrame, the same as ``operators.sampling.sampled_spans`` gives for the recorded spans.

    Without ``wait_ms`` traces are kept for good, for a run over what is available now. A span without a trace is a trace of its own. ``buckets`` must stay the same for a checkpoint.
    """
    spark = spans.sparkSession
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    given = spans if wait_ms is None else spans.withWatermark(ts, lateness)
    forced = F.coalesce(F.col("force_sample"), F.lit(False))
    chosen = F.coalesce(within_ratio(F.col("trace_id"), rate), F.lit(False))
    at_once = given.where(chosen | (F.col("trace_id").isNull() & forced))
    rest = given.where(~chosen & F.col("trace_id").isNotNull()).select(
        F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).alias("bucket"), F.col("trace_id").cast("string").alias("trace_id"), forced.alias("force_sample"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"), F.to_json(F.struct(*spans.columns), WHOLE_TIMES).alias("row"), ts,
    )
    mode = "None" if wait_ms is None else "EventTime"
    told = rest.groupBy("bucket").transformWithStateInPandas(TailSampler(wait_ms), "row string", "Append", mode)
    kept = told.select(F.from_json("row", spans.schema, WHOLE_TIMES).alias("s")).select("s.*")
    return at_once.select(*spans.columns).unionByName(kept)
