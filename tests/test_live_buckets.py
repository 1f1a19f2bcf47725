"""Many streams go through the state operator in one call, each with its own state."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql.types import StringType

from parley.streaming.rewrite import StreamRewriter


class Map(dict):
    def exists(self):
        return bool(self)

    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


def rewriter(**times):
    states, timers = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, Map()), registerTimer=timers.append)
    own = StreamRewriter(times.get("gap_ms"), times.get("idle_ms"), None, 100, StringType())
    own.init(handle)
    return own, states, timers


def chunk(stream, seq, content, done=False):
    return {"stream_id": stream, "seq": seq, "role": None, "content": content, "finish_reason": None, "has_delta": True, "done": done, "rest": None, "delta_rest": None}


CLOCK = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)


def feed(own, rows):
    return list(own.handleInputRows((0,), iter([pd.DataFrame(rows)]), CLOCK))


def test_streams_of_a_bucket_share_frames_and_keep_apart():
    own, states, _ = rewriter()
    streams = [f"s{i}" for i in range(50)]
    first = feed(own, [chunk(s, q, t) for s in streams for q, t in ((2, "</thi"), (0, f"<think>a{s}"))])
    assert len(first) == 1 and len(first[0]) == 50
    assert len(states["at"]) == len(states["waiting"]) == 50 and not states["gone"]
    again = feed(own, [chunk(s, 4, "end", True) for s in streams[:25]])
    assert again == [] and len(states["waiting"]) == 75
    last = feed(own, [chunk(s, q, t) for s in streams[:25] for q, t in ((3, "nk>"), (1, "b"), (1, "twice"))])
    assert len(last) == 1
    for s in streams[:25]:
        said = [f[f.stream_id == s] for f in (*first, *last)]
        texts = [t for f in said for t in zip(f.kind, f.reasoning_content, f.content) if t[0] != "passthrough"]
        assert texts == [("reasoning", f"a{s}", None), ("reasoning", "b", None), ("content", None, "end")]
    assert set(states["gone"]) == {(s,) for s in streams[:25]}
    assert set(k[0] for k in states["waiting"]) == {k[0] for k in states["at"]} == set(streams[25:])
    assert feed(own, [chunk("s0", 0, "sent again")]) == []


def test_open_calls_and_timers_of_a_bucket():
    own, states, timers = rewriter(gap_ms=10, idle_ms=100)
    feed(own, [chunk(s, q, t) for s in ("a", "b") for q, t in ((0, "<tool_call>{"), (2, '"f"}</tool_call>'))])
    feed(own, [chunk("a", 1, '"name": ')])
    assert timers == [1010, 1100, 1101]
    gaps = list(own.handleExpiredTimer((0,), CLOCK, SimpleNamespace(getExpiryTimeInMs=lambda: 1010)))
    assert [(r.stream_id, r.kind, r.seq, r.waiting) for r in gaps[0].itertuples()] == [("b", "gap", 1, 1)]
    ended = list(own.handleExpiredTimer((0,), CLOCK, SimpleNamespace(getExpiryTimeInMs=lambda: 1100)))
    # The idle timer of "a" has moved since.
    assert {r.stream_id for r in ended[0].itertuples()} == {"b"} and set(states["gone"]) == {("b",)}
    rest = list(own.handleExpiredTimer((0,), CLOCK, SimpleNamespace(getExpiryTimeInMs=lambda: 1101)))
    assert rest == [] and set(states["gone"]) == {("a",), ("b",)}
    assert not states["at"] and not states["waiting"] and not states["call_parts"]


def test_traces_of_a_bucket_share_frames_and_keep_apart():
    from parley.streaming.sampling import TailSampler

    states, timers = {}, []
    own = TailSampler(10)
    own.init(SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, Map()), registerTimer=timers.append))
    traces = [f"t{i}" for i in range(40)]

    def spans(force, ts, name):
        return pd.DataFrame([{"trace_id": t, "force_sample": force(t), "ts_ms": ts, "row": f"{t}-{name}"} for t in traces])

    assert list(own.handleInputRows((0,), iter([spans(lambda t: False, 5, "a")]), CLOCK)) == []
    out = list(own.handleInputRows((0,), iter([spans(lambda t: t < "t2", 7, "b"), spans(lambda t: False, 7, "c")]), CLOCK))
    forced = [t for t in traces if t < "t2"]
    assert sorted(r for f in out for r in f["row"]) == sorted(f"{t}-{n}" for t in forced for n in "abc")
    assert timers == [15, 17] and {k[0] for k in states["spans"]} == set(traces) - set(forced)
    list(own.handleExpiredTimer((0,), CLOCK, SimpleNamespace(getExpiryTimeInMs=lambda: 15)))
    assert len(states["trace"]) == 40
    list(own.handleExpiredTimer((0,), CLOCK, SimpleNamespace(getExpiryTimeInMs=lambda: 17)))
    assert not states["trace"] and not states["spans"] and not states["due"]
