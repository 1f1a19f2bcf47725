"""Live rewriting of chunk streams with state per stream.

Streams are dealt over ``BUCKETS`` keyed groups by a hash of their id, so that rows go to and from
Python for many streams at once. Each stream has its own state in its bucket: where the scanner stands and the running
counters (an entry), chunks that came before their turn (one entry for those of a batch), and the text of a call that
is still open (one entry for that of a batch). A batch touches only the entries of the streams that come in it. Chunks are taken in the order of ``seq``; chunks seen
before are skipped. What they say is worked out by the same function as in the recorded
replay (``transducer.tell``).

Timers watch each stream: a missing chunk is reported once the stream has waited
``gap_ms`` for it, with the number of chunks it holds back; a silent stream is ended after
``idle_ms``, the chunks it still holds included. State is bounded: a stream that holds
more than ``most_waiting`` chunks gives the missing one up, reports it and goes on. An
ended stream stays known for ``keep_ms``, so that chunks sent again do not begin it anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.constants import CHUNK_OBJECT
from parley.functions.ids import stable_id
from parley.functions.tags import call_record
from parley.operators.replay import chunk_fields
from parley.operators.transducer import State, tell
from parley.schemas import CHUNK_CHOICE

#: Keeps the state of all streams on the executors' disks, with a change log in the checkpoint.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Groups of streams that go through the state operator together: what it costs a group, it costs many streams once.
BUCKETS = 1024
INPUT = ("stream_id", "seq", "role", "content", "finish_reason", "has_delta", "done", "rest", "delta_rest")
OUTPUT = (
    "seq long, out_no long, kind string, role string, content string, "
    "reasoning_content string, call_index long, call_body string, "
    "finish_reason string, completion_tokens long, output_length long, waiting long, rest string, delta_rest string"
)
_AT = (
    "held string, open_tag string, skip_space boolean, segment long, calls long, pending boolean, next_seq long, tools long, tokens long, "
    "length long, outputs long, waiting long, rest string, ended boolean, gap_timer long, idle_timer long, reported boolean, pieces long, parts long"
)
_CHUNK = "role string, content string, finish_reason string, has_delta boolean, done boolean, rest string, delta_rest string"
_AT_NAMES = [part.split()[0] for part in _AT.split(", ")]
_CHUNK_NAMES = [part.split()[0] for part in _CHUNK.split(", ")]
_OUTPUT_NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
_FRESH: dict[str, Any] = {
    **State()._asdict(), "next_seq": 0, "tools": 0, "tokens": 0, "length": 0, "outputs": 0, "waiting": 0, "rest": None, "ended": False,
    "gap_timer": 0, "idle_timer": 0, "reported": False, "pieces": 0, "parts": 0,
}
_FIELD_OF = {"content": "content", "error": "content", "passthrough": "content", "reasoning": "reasoning_content", "tool_call": "call_body"}


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    record = dict(pairs)
    if len(record) < len(pairs):
        raise ValueError("a key occurs twice")
    return record


def _reject(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def _kind_of_call(body: str) -> str:
    """The rule of ``functions.tags.call_record``: a call is one JSON object with a name; other JSON is an error, the rest was text."""
    try:
        record = json.loads(body, object_pairs_hook=_unique, parse_constant=_reject)
    except ValueError:
        return "content"
    return "tool_call" if isinstance(record, dict) and record.get("name") is not None else "error"


def _known(value: Any) -> Any:
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


class _Run:
    """One stream while a batch or timer works on it."""

    def __init__(self, at: dict[str, Any], body: list[str]):
        self.at, self.body, self.rows = at, body, []

    def take(self, chunks: list[tuple[int, dict[str, Any]]]) -> None:
        """Consecutive chunks; a ``done`` one ends the stream behind itself."""
        at = self.at
        ended = chunks[-1][1]["done"]
        texts = [c["content"] or "" for _, c in chunks]
        if any(texts) or ended:
            said, state = tell(State(*(at[n] for n in State._fields)), texts, ended)
            at.update(state._asdict())
        else:
            said = []
        own: list[list[tuple[str, str]]] = [[] for _ in range(len(chunks) + 1)]
        for s in said:
            if s.kind == "part":
                self.body.append(s.text)
                continue
            kind, text = s.kind, s.text
            if s.kind in ("call", "close"):
                if s.kind == "close":
                    text = "".join(self.body).strip()
                    self.body.clear()
                kind = _kind_of_call(text)
            if text:
                own[s.chunk].append((kind, text))
        for (seq, c), outs in zip(chunks, own):
            self.say(seq, c, outs)
        last_seq, last = chunks[-1]
        # A row that only marks the end has no place of its own: what was held takes it.
        bare = last["done"] and last["content"] is None and last["finish_reason"] is None
        behind = {"role": None, "finish_reason": None, "content": "", "has_delta": True, "done": False, "rest": at["rest"], "delta_rest": None}
        if own[-1]:
            self.say(last_seq + (not bare), behind, own[-1])
        at["next_seq"], at["ended"] = last_seq + 1, at["ended"] or ended

    def say(self, seq: int, c: dict[str, Any], outs: list[tuple[str, str]]) -> None:
        at, rows = self.at, []
        for kind, text in outs:
            called = kind == "tool_call"
            rows.append({"kind": kind, "role": None if called else c["role"], _FIELD_OF[kind]: text, "call_index": at["tools"] if called else None})
            at["tools"] += called
        marks_end = c["done"] and c["content"] is None and c["finish_reason"] is None
        if not rows and not marks_end and (c["content"] is None or c["finish_reason"]):
            # A chunk without text, or a finishing one that says nothing, is handed on as it came.
            rows.append({"kind": "passthrough", "role": c["role"], "content": c["content"], "delta_rest": c["delta_rest"]})
        if c["finish_reason"] and rows:
            changed = at["tools"] and (c["content"] is not None or c["has_delta"])
            rows[-1]["finish_reason"] = "tool_calls" if changed else c["finish_reason"]
        if not marks_end:
            at["rest"] = c["rest"]
        for row in rows:
            self.count(seq, row, c["rest"])

    def count(self, seq: int, row: dict[str, Any], rest: str | None) -> None:
        """Number an output and attach the running usage counters."""
        at, said = self.at, row.get("content") or ""
        at["tokens"] += bool(said)
        at["length"] += len(said)
        at["outputs"] += 1
        self.rows.append({**row, "seq": seq, "out_no": at["outputs"] - 1, "completion_tokens": at["tokens"], "output_length": at["length"], "rest": rest})

    def report(self, waiting: int) -> None:
        """A row (kind ``gap``) for the missing chunk; it is no output of the stream and has no number."""
        self.rows.append({"kind": "gap", "seq": self.at["next_seq"], "waiting": waiting, "completion_tokens": self.at["tokens"], "output_length": self.at["length"]})


class StreamRewriter(StatefulProcessor):
    """One key holds the streams of a bucket: rows go in and out together, state is kept by stream."""

    def __init__(self, gap_ms: int | None, idle_ms: int | None, keep_ms: int | None, most_waiting: int, key_type: Any):
        self.gap_ms, self.idle_ms, self.keep_ms, self.most_waiting, self.key_type = gap_ms, idle_ms, keep_ms, most_waiting, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stream = f"stream_id {self.key_type.simpleString()}"
        self.at = handle.getMapState("at", stream, _AT)
        self.waiting = handle.getMapState("waiting", f"{stream}, piece long", "chunks string")
        self.call = handle.getMapState("call_parts", f"{stream}, part long", "text string")
        self.gone = handle.getMapState("gone", stream, "next_seq long", self.keep_ms)
        if self.gap_ms is not None or self.idle_ms is not None:
            self.due = handle.getMapState("due", "time long", f"streams array<{self.key_type.simpleString()}>")

    def _load(self, stream: Any, any_at: bool = True, any_gone: bool = True) -> _Run | None:
        """The stream as it stands; none if it has ended. ``any_at`` and ``any_gone`` tell whether the bucket has any open and any ended streams."""
        row = self.at.getValue((stream,)) if any_at else None
        if row is None and any_gone and self.gone.containsKey((stream,)):
            return None
        at = dict(zip(_AT_NAMES, row)) if row is not None else dict(_FRESH)
        body = [self.call.getValue((stream, n))[0] for n in range(at["parts"])] if at["pending"] else []
        run = _Run(at, body)
        run.stored, run.before, run.parts, run.pieces = row is not None, list(body), at["parts"], at["pieces"]
        run.held, run.came, run.kept = {}, {}, True
        for n in range(run.pieces):
            run.held.update((seq, dict(zip(_CHUNK_NAMES, fields))) for seq, *fields in json.loads(self.waiting.getValue((stream, n))[0]))
        return run

    def _advance(self, run: _Run, over_gaps: bool = False) -> None:
        """Take what is next of the chunks that are held."""
        held, at = run.held, run.at
        while held and not at["ended"]:
            seq = at["next_seq"]
            if over_gaps and seq not in held:
                seq = min(held)
            chunks = []
            while seq in held:
                chunks.append((seq, held.pop(seq)))
                run.kept = run.kept and run.came.pop(seq, None) is not None
                if chunks[-1][1]["done"]:
                    break
                seq += 1
            if not chunks:
                break
            run.take(chunks)

    def _timer(self, run: _Run, stream: Any, name: str, when: int, due: dict[int, list]) -> None:
        """Move a timer; 0 for none. A timer of the bucket that finds its streams moved on does nothing."""
        at = run.at
        # Two timers of a stream must differ, as they are told apart by their times.
        when += bool(when) and when in (at["gap_timer"], at["idle_timer"])
        at[name] = when
        if when:
            due.setdefault(when, []).append(stream)

    def _register(self, due: dict[int, list]) -> None:
        for when, streams in due.items():
            old = self.due.getValue((when,))
            self.due.updateValue((when,), ([*(old[0] if old is not None else []), *streams],))
            self.handle.registerTimer(when)

    def _store(self, stream: Any, run: _Run) -> None:
        at = run.at
        if at["ended"]:
            self.gone.updateValue((stream,), (at["next_seq"],))
            if run.stored:
                self.at.removeKey((stream,))
            for n in range(run.pieces):
                self.waiting.removeKey((stream, n))
            for n in range(run.parts):
                self.call.removeKey((stream, n))
            return
        # What waited before stays as it is stored, unless some of it has been taken.
        add, first = (run.came, run.pieces) if run.kept else (run.held, 0)
        if add:
            rows = [(seq, *(c[n] for n in _CHUNK_NAMES)) for seq, c in add.items()]
            self.waiting.updateValue((stream, first), (json.dumps(rows),))
        at["pieces"] = first + bool(add)
        for n in range(at["pieces"], run.pieces):
            self.waiting.removeKey((stream, n))
        begun, first = len(run.before), run.parts
        if run.body[:begun] != run.before:  # another call than the one whose parts are stored
            begun = first = 0
        if len(run.body) > begun:
            self.call.updateValue((stream, first), ("".join(run.body[begun:]),))
        at["parts"] = first + (len(run.body) > begun)
        for n in range(at["parts"], run.parts):
            self.call.removeKey((stream, n))
        self.at.updateValue((stream,), tuple(at[n] for n in _AT_NAMES))

    def _frame(self, told: list[tuple[Any, dict[str, Any]]]) -> Iterator[pd.DataFrame]:
        if told:
            columns = {n: pd.Series([r.get(n) for _, r in told], dtype=object) for n in _OUTPUT_NAMES}
            yield pd.DataFrame({"stream_id": pd.Series([s for s, _ in told], dtype=object), **columns})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        runs: dict[Any, _Run | None] = {}
        any_at, any_gone = self.at.exists(), self.gone.exists()
        for frame in rows:
            came: dict[Any, dict[int, dict[str, Any]]] = {}
            for stream, seq, *fields in zip(*(frame[n].tolist() for n in ("stream_id", "seq", *_CHUNK_NAMES))):
                own = came.setdefault(stream, {})
                if int(seq) not in own:
                    own[int(seq)] = dict(zip(_CHUNK_NAMES, map(_known, fields)))
            told: list[tuple[Any, dict[str, Any]]] = []
            for stream, own in came.items():
                if stream not in runs:
                    runs[stream] = self._load(stream, any_at, any_gone)
                run = runs[stream]
                if run is None or run.at["ended"]:
                    continue
                fresh = {seq: c for seq, c in own.items() if seq >= run.at["next_seq"] and seq not in run.held}
                run.held.update(fresh)
                run.came.update(fresh)
                self._advance(run)
                if len(run.held) > self.most_waiting and not run.at["ended"]:
                    run.report(len(run.held))
                    self._advance(run, over_gaps=True)
                run.at["waiting"] = len(run.held)
                told.extend((stream, row) for row in run.rows)
                run.rows.clear()
            yield from self._frame(told)
        due: dict[int, list] = {}
        for stream, run in runs.items():
            if run is not None:
                if not run.at["ended"]:
                    self._set_timers(run, stream, timerValues, due)
                self._store(stream, run)
        self._register(due)

    def _set_timers(self, run: _Run, stream: Any, timers: Any, due: dict[int, list]) -> None:
        at, gap = run.at, bool(run.at["waiting"])
        now = timers.getCurrentProcessingTimeInMs() if self.gap_ms is not None or self.idle_ms is not None else 0
        if self.gap_ms is not None:
            if not gap:
                at["reported"] = False
            if gap and not at["gap_timer"] and not at["reported"]:
                self._timer(run, stream, "gap_timer", now + self.gap_ms, due)
            elif not gap and at["gap_timer"]:
                self._timer(run, stream, "gap_timer", 0, due)
        if self.idle_ms is not None:
            self._timer(run, stream, "idle_timer", now + self.idle_ms, due)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        listed = self.due.getValue((fired,))
        told: list[tuple[Any, dict[str, Any]]] = []
        for stream in dict.fromkeys(listed[0] if listed is not None else []):
            run = self._load(stream)
            if run is None or fired not in (run.at["gap_timer"], run.at["idle_timer"]):
                continue
            if fired == run.at["gap_timer"]:
                run.at.update(gap_timer=0, reported=True)
                run.report(run.at["waiting"])
            else:
                run.at["idle_timer"] = 0
                if run.held:
                    run.report(len(run.held))
                    self._advance(run, over_gaps=True)
                    run.at["waiting"] = 0
                if not run.at["ended"]:
                    run.take([(run.at["next_seq"], {"role": None, "content": None, "finish_reason": None, "has_delta": True, "done": True, "rest": None, "delta_rest": None})])
            self._store(stream, run)
            told.extend((stream, row) for row in run.rows)
        if listed is not None:
            self.due.removeKey((fired,))
        yield from self._frame(told)

    def close(self) -> None:
        pass


def rewrite_live(
    chunks: DataFrame, gap_ms: int | None = 30_000, idle_ms: int | None = 600_000, keep_ms: int | None = 600_000, most_waiting: int = 10_000, buckets: int = BUCKETS
) -> DataFrame:
    """Rewrite a streaming DataFrame of flat chunks into output chunks, and reports of missing chunks (kind ``gap``).

    ``chunks``: stream_id, seq, content, done, and where given role, finish_reason, has_delta, rest and delta_rest. Without any
    times only ``done`` rows end a stream and no missing chunk is reported before ``most_waiting`` chunks wait for it. That
    is the way for a run over what is available now: timers would keep such a run going. The session needs ``STATE_STORE``. ``buckets`` must stay the same for a checkpoint.
    """
    spark = chunks.sparkSession
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    timed = not gap_ms is idle_ms is keep_ms is None
    key = chunks.schema["stream_id"].dataType
    given = chunks.where(F.col("stream_id").isNotNull() & F.col("seq").isNotNull())
    told = (
        given.select(F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).alias("bucket"), "stream_id", *chunk_fields(given), F.coalesce("done", F.lit(False)).alias("done"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            StreamRewriter(gap_ms, idle_ms, keep_ms, most_waiting, key), f"stream_id {key.simpleString()}, {OUTPUT}", "Append",
            "ProcessingTime" if timed else "None",
        )
    )
    # Name and arguments of calls are read by the same expression as in the recorded replay.
    call = call_record(F.col("call_body"))
    named = ["stream_id", *(c for c in _OUTPUT_NAMES if c != "call_body")]
    place = named.index("call_index") + 1
    handed = {"rest": F.try_parse_json("rest").alias("rest"), "delta_rest": F.try_parse_json("delta_rest").alias("delta_rest")}
    columns = [handed.get(c, F.col(c)) for c in named[place:] if c not in handed or c in chunks.columns]
    return told.select(*named[:place], call["name"].alias("call_name"), call["arguments"].alias("call_arguments"), *columns)


def as_chunks(outputs: DataFrame, created: Column, model: Column) -> DataFrame:
    """Nested chunk records of the output rows, one id per stream."""
    call = F.struct(
        F.col("call_index").cast("int").alias("index"),
        stable_id("call", F.col("stream_id"), F.col("call_index")).alias("id"),
        F.lit("function").alias("type"),
        F.struct(F.col("call_name").alias("name"), F.col("call_arguments").alias("arguments")).alias("function"),
    )
    delta = F.struct(
        "role", "content", "reasoning_content",
        F.when(F.col("kind") == "tool_call", F.array(call)).alias("tool_calls"),
    )
    choice = F.struct(
        F.lit(0).alias("index"), delta.alias("delta"), F.lit(None).cast("string").alias("logprobs"), "finish_reason"
    )
    return outputs.where("kind <> 'gap'").select(
        "stream_id",
        F.col("out_no").alias("seq"),
        stable_id("chatcmpl", F.col("stream_id")).alias("id"),
        F.lit(CHUNK_OBJECT).alias("object"),
        created.cast("long").alias("created"),
        model.alias("model"),
        F.array(choice).cast(f"array<{CHUNK_CHOICE}>").alias("choices"),
    )
