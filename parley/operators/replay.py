"""Replay of recorded chunk streams: content, reasoning and tool calls in order.

A stream is text cut into chunks, and tags may be cut anywhere. The replay
works on blocks of consecutive chunks so that a very long stream spreads over
many tasks; no row of a result depends on where the blocks end:

1. chunks are grouped by (stream, block), the one time that their text moves;
2. each block becomes a small map from what may be held before it to the state
   behind it (``transducer``), and a prefix scan over the maps, on two levels,
   finds the state at the begin of every block;
3. one pass over each block, knowing that state, tells what its chunks say; it
   is written once, and everything else is read from it;
4. calls are judged; only those that go beyond a block have their parts brought
   together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.constants import CALL_OPEN, THINK_OPEN
from parley.functions.ids import stable_id
from parley.functions.tags import call_record
from parley.functions.text import bind, strip
from parley.operators.ordered import ROWS_OUT, fold_in_order, map_rows
from parley.operators.prefix import BLOCK_ROWS, block_of, running_sums
from parley.operators.transducer import Outcome, State, after, compose, moves, tell
from parley.session import written

STREAM_BLOCK = ["stream_id", "block"]
#: Blocks whose maps are joined by one task of the scan's first level.
SPAN_BLOCKS = 256

_MAP = "which binary, outcomes array<struct<held:int,tags:long,first:int,last:int,closed:long,opens:boolean,lead:boolean,tail:boolean>>"
_STATE = "held string, open_tag string, skip_space boolean, segment long, calls long, pending boolean"
_SAID = "array<struct<at:long,segment:long,kind:string,text:string,call:long>>"


def unusable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that no replay can place: without a stream or without a place in it. They belong into a quarantine table."""
    return chunks.where(F.col("stream_id").isNull() | F.col("seq").isNull())


def chunk_fields(chunks: DataFrame) -> list[Column]:
    """The fields of a chunk, with what a table lacks; what is only handed on goes as JSON text."""
    types = {f.name: f.dataType.typeName() for f in chunks.schema}

    def or_else(name: str, value: Column) -> Column:
        given = F.col(name) if name in types else value
        return (F.to_json(name) if types.get(name) == "variant" else given).alias(name)

    none = F.lit(None).cast("string")
    return [
        F.col("seq").cast("long").alias("seq"), "content", or_else("role", none), F.nullif(or_else("finish_reason", none), F.lit("")).alias("finish_reason"),
        F.coalesce(or_else("has_delta", F.lit(True)), F.lit(True)).alias("has_delta"), or_else("rest", none), or_else("delta_rest", none),
    ]


def text_blocks(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(stream_id, block, pieces): up to ``block_rows`` chunks in order; a chunk that was sent twice counts once."""
    # Stated, as what follows is work on every chunk: merging small partitions would leave it to few tasks.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        chunks.where(F.col("stream_id").isNotNull() & F.col("seq").isNotNull())
        .select("stream_id", block_of("seq", block_rows).cast("long").alias("block"), F.struct(*chunk_fields(chunks)).alias("piece"))
        # Stated here so that every use of the blocks has the same filters and shares one shuffle.
        .where("block is not null")
        .repartition(parts, *STREAM_BLOCK)
        .groupBy(*STREAM_BLOCK)
        .agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        .withColumn("pieces", F.filter("pieces", lambda p, i: (i == 0) | (p["seq"] != F.get("pieces", i - 1)["seq"])))
    )


def _packed(map_: list[Outcome]) -> tuple[bytes, list[dict[str, Any]]]:
    """A map as its different outcomes and which of them each held text has."""
    different = list(dict.fromkeys(map_))
    return bytes(different.index(o) for o in map_), [o._asdict() for o in different]


def _unpacked(row: dict[str, Any]) -> list[Outcome]:
    outcomes = [Outcome(**o) for o in row["outcomes"]]
    return [outcomes[i] for i in row["which"]]


def block_states(blocks: DataFrame, span_blocks: int = SPAN_BLOCKS) -> DataFrame:
    """The state each block begins in, and whether it is the first and the last of its stream.

    Maps of blocks are joined for each span of blocks; a pass over the spans of a stream gives the states they begin in, a pass over
    the blocks of a span those of the blocks. No task sees all blocks of a stream, and what moves is a small row for each block.
    """
    stream = f"stream_id {blocks.schema['stream_id'].dataType.simpleString()}"

    def maps(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        for r in rows:
            yield r["stream_id"], r["span"], r["block"], *_packed(moves(r["text"]))

    text = F.array_join(F.transform("pieces", lambda p: p["content"]), "")
    keyed = blocks.select("stream_id", F.floor(F.col("block") / span_blocks).alias("span"), "block", text.alias("text"))
    each = map_rows(keyed, maps, f"{stream}, span long, block long, {_MAP}")

    def whole(key: tuple, rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        yield *key, *_packed(compose(map(_unpacked, rows)))

    def begins(key: tuple, rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        state, row = State(), next(rows, None)
        first = True
        while row is not None:
            following = next(rows, None)
            yield *key, row["span"], *state, first, following is None
            state, row, first = after(state, _unpacked(row)), following, False

    def inside(key: tuple, rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        start, row = next(rows), next(rows, None)
        state, first = State(*(start[n] for n in State._fields)), start["is_first"]
        while row is not None:
            following = next(rows, None)
            yield key[0], row["block"], *state, first, start["is_last"] and following is None
            state, row, first = after(state, _unpacked(row)), following, False

    ends = "is_first boolean, is_last boolean"
    spans = fold_in_order(each, ["stream_id", "span"], ["block"], whole, f"{stream}, span long, {_MAP}")
    starts = fold_in_order(spans, ["stream_id"], ["span"], begins, f"{stream}, span long, {_STATE}, {ends}")
    # The row without a block comes first and holds the span's state.
    both = starts.unionByName(each, allowMissingColumns=True)
    return fold_in_order(both, ["stream_id", "span"], ["block"], inside, f"{stream}, block long, {_STATE}, {ends}")


_PIECE = ["seq", "content", "role", "finish_reason", "has_delta", "rest", "delta_rest"]
_BY_CHUNK = "block long, seq long, content string, role string, finish_reason string, has_delta boolean, rest string, delta_rest string"


def _chunk_teller(schema: pa.Schema):
    """Batches of blocks (state, and a list for each field of their chunks) to batches of ``schema``, column by column:
    values are never gathered into a record for each chunk."""
    said_type = schema.field("said").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(2 + len(_PIECE))]
        offsets: list[int] = [0]
        told_: list[list] = [[] for _ in range(5)]

        def made() -> pa.RecordBatch:
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(told_, said_type.value_type)], fields=list(said_type.value_type))
            said = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=said_type)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), said], schema=schema)

        for batch in batches:
            get = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for i in range(batch.num_rows):
                stream, block = get["stream_id"][i], get["block"][i]
                fields = [get[n][i] for n in _PIECE]
                seqs, contents, finishes = fields[0], fields[1], fields[3]
                state, n = State(*(get[name][i] for name in State._fields)), len(seqs)
                said, _ = tell(state, [c or "" for c in contents], get["is_last"][i])
                behind = (seqs[-1] + 1, "", None, None, True, fields[5][-1], None)
                at = 0
                for k in range(n + 1):
                    begun = at
                    while at < len(said) and said[at].chunk == k:
                        at += 1
                    if at == begun and (k == n or (contents[k] is not None and finishes[k] is None)):
                        continue
                    for column, value in zip(columns, (stream, block, *((f[k] for f in fields) if k < n else behind))):
                        column.append(value)
                    for s in said[begun:at]:
                        for column, value in zip(told_, s[1:]):
                            column.append(value)
                    offsets.append(len(told_[0]))
                if len(columns[0]) >= ROWS_OUT:
                    yield made()
                    columns, offsets, told_ = [[] for _ in columns], [0], [[] for _ in told_]
        if columns[0]:
            yield made()

    return run


def _block_teller(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
    for row in rows:
        state, texts = State(*(row[n] for n in State._fields)), [p["content"] or "" for p in row["pieces"]]
        said, _ = tell(state, texts, row["is_last"], by_chunk=False)
        behind = after(state, moves("".join(texts)))
        open_ends = [*([] if row["is_first"] else [state.segment]), *([] if row["is_last"] else [behind.segment])]
        outs = [{"at": s.at, "segment": s.segment, "kind": s.kind, "text": s.text, "call": s.call} for s in said]
        flushed = behind.held if row["is_last"] and behind.held and behind.open_tag != CALL_OPEN else None
        kind = "reasoning" if behind.open_tag == THINK_OPEN else "content"
        yield row["stream_id"], row["block"], row["pieces"][0]["seq"], outs, open_ends, flushed, kind


def told(chunks: DataFrame, block_rows: int = BLOCK_ROWS, by_chunk: bool = True) -> DataFrame:
    """What streams say, calls not yet judged, written once: a row for each chunk that says or hands on something, or for each block."""
    blocks = text_blocks(chunks, block_rows)
    # Texts stay where they are; the small side comes to them.
    located = blocks.hint("merge").join(block_states(blocks), STREAM_BLOCK)
    stream = f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}"
    if not by_chunk:
        own = f"seq long, said {_SAID}, open_ends array<long>, flushed string, flushed_kind string"
        return written(map_rows(located, _block_teller, f"{stream}, block long, {own}"), "told")
    schema = f"{stream}, {_BY_CHUNK}, said {_SAID}"
    fields = [F.col(f"pieces.{n}").alias(n) for n in _PIECE]
    listed = located.select(*STREAM_BLOCK, *State._fields, "is_last", *fields)
    return written(listed.mapInArrow(_chunk_teller(to_arrow_schema(StructType.fromDDL(schema))), schema), "told")


def _of_kind(said: str, *kinds: str) -> Column:
    return F.exists(said, lambda o: o["kind"].isin(*kinds))


def _parts(told_: DataFrame) -> DataFrame:
    """Parts of calls that go beyond a block, and where such calls close."""
    rows = told_.where(_of_kind("said", "part", "close")).select(*STREAM_BLOCK, F.explode("said").alias("o")).select(*STREAM_BLOCK, "o.*")
    return rows.where("kind in ('part', 'close')")


def call_marks(told_: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each block of a stream at or behind its first valid call, and each that closes an earlier block's call: the text of that call,
    the valid calls (number and chunk) of the block, and how many there are in earlier blocks."""
    parts = _parts(told_)
    closes = parts.where("kind = 'close'").select("stream_id", "call", F.col("block").alias("closed_in"))
    # A call that never closes is lost, so its text need not meet anywhere.
    late = (
        parts.where("kind = 'part'")
        .join(closes, ["stream_id", "call"], "right")
        .groupBy("stream_id", "call", "closed_in")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("texts"))
        .select("stream_id", F.col("closed_in").alias("block"), strip(F.array_join(F.transform("texts", lambda t: t["text"]), "")).alias("late_body"))
    )
    calls = told_.where(_of_kind("said", "call", "close")).select(*STREAM_BLOCK, "seq", F.explode("said").alias("o")).where("o.kind in ('call', 'close')")
    judged = calls.join(late, STREAM_BLOCK, "left").withColumn("body", F.when(F.col("o.kind") == "close", F.col("late_body")).otherwise(F.col("o.text")))
    ok = call_record(F.col("body"))["ok"]
    # A row for each block, so that the count of valid calls goes on over blocks without any.
    valid = judged.groupBy(*STREAM_BLOCK).agg(
        F.max("late_body").alias("late_body"), F.sort_array(F.collect_list(F.when(ok, F.struct(F.col("o.call").alias("call"), "seq")))).alias("valid")
    )
    blocks = told_.select(*STREAM_BLOCK).distinct().join(valid, STREAM_BLOCK, "left")
    blocks = blocks.withColumn("valid", F.coalesce("valid", F.array().cast("array<struct<call:bigint,seq:bigint>>")))
    summed = running_sums(blocks, ["stream_id"], "block", {"valid_until": F.size("valid").cast("long")}, block_rows)
    marks = summed.select(*STREAM_BLOCK, "late_body", "valid", (F.col("valid_until") - F.size("valid")).alias("valid_before"))
    return written(marks.where("valid_before > 0 or size(valid) > 0 or late_body is not null"), "marks")


def _judged(said: Column) -> Column:
    """What is said with calls judged: kind, text, call_index, name, arguments; a call that is no JSON is content, one of nothing is left out."""

    def judge(o: Column) -> Column:
        body = F.when(o["kind"] == "close", F.col("late_body")).otherwise(o["text"])
        record = F.when(o["kind"].isin("call", "close"), call_record(body))
        number = F.array_position(F.transform("valid", lambda v: v["call"]), o["call"])

        def row(r: Column) -> Column:
            return F.struct(
                o["segment"].alias("segment"),
                F.when(r["ok"], F.lit("tool_call")).when(r["is_json"], F.lit("error")).when(r.isNotNull(), F.lit("content")).otherwise(o["kind"]).alias("kind"),
                F.when(~F.coalesce(r["ok"], F.lit(False)), body).alias("text"),
                r.isNotNull().alias("is_call"),
                F.when(r["ok"], F.col("valid_before") + number - 1).alias("call_index"),
                r["name"].alias("name"),
                r["arguments"].alias("arguments"),
            )

        return bind(record, row)

    spoken = F.filter(said, lambda o: o["kind"] != "part")
    return F.filter(F.transform(spoken, judge), lambda o: (o["kind"] == "tool_call") | (F.length(o["text"]) > 0))


def _call_id() -> Column:
    return F.when(F.col("call_index").isNotNull(), stable_id("call", F.col("stream_id"), F.col("call_index")))


def replay_streams(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Everything the streams say, in order of (segment, part) within each stream.

    ``chunks`` has ``stream_id, seq, content``; ``seq`` counts up from 0.
    ``kind`` is content, reasoning, tool_call, or error for a call that is JSON
    but names no function. A call that is no JSON comes back as content. Each
    stretch between tags is one row, wherever blocks end.
    """
    rows = told(chunks, block_rows, by_chunk=False)
    said = rows.join(call_marks(rows, block_rows), STREAM_BLOCK, "left").select(*STREAM_BLOCK, "open_ends", F.explode(_judged(F.col("said"))).alias("o"))
    said = said.select(*STREAM_BLOCK, (~F.col("o.is_call") & F.array_contains("open_ends", F.col("o.segment"))).alias("goes_on"), "o.*")
    columns = ["stream_id", "segment", F.when(F.col("is_call"), 0).otherwise(1).alias("part"), "kind", "text", "call_index", _call_id().alias("call_id"), "name", "arguments"]
    whole = said.where("not goes_on").select(*columns)
    # Only stretches that go beyond a block have to meet.
    met = said.where("goes_on").groupBy("stream_id", "segment", "kind").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("texts"))
    met = met.select("stream_id", "segment", F.lit(1).alias("part"), "kind", F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("text"))
    return whole.unionByName(met, allowMissingColumns=True)


def stream_calls(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The tool calls of each stream with their ordinal, and the bodies that were none."""
    rows = told(chunks, block_rows, by_chunk=False).where(_of_kind("said", "part", "close", "call"))
    said = rows.join(call_marks(rows, block_rows), STREAM_BLOCK, "left").select("stream_id", F.explode(_judged(F.col("said"))).alias("o"))
    return said.select("stream_id", "o.*").where("is_call").select("stream_id", "segment", "kind", "text", "call_index", _call_id().alias("call_id"), "name", "arguments")


def held_tails(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The started tag each stream ends on, given out when the stream ends: as content, or as reasoning inside
    a think block. Inside an open call it belongs to the call, which is lost."""
    ends = told(chunks, block_rows, by_chunk=False).where("flushed is not null")
    return ends.select("stream_id", "flushed", F.col("flushed_kind").alias("kind"))


def lost_tails(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Length of the text lost in a call that never closed, per stream that has one."""
    parts = _parts(told(chunks, block_rows, by_chunk=False)).select("stream_id", "call", "kind", F.length("text").alias("chars"))
    closes = parts.where("kind = 'close'").select("stream_id", "call")
    lost = parts.where("kind = 'part'").join(closes, ["stream_id", "call"], "left_anti")
    return lost.groupBy("stream_id").agg(F.sum("chars").alias("dropped_tail"))


def _reason() -> Column:
    """The finish reason of a chunk, ``tool_calls`` once its stream made a call; a chunk without a delta keeps what it came with."""
    called = (F.col("valid_before") > 0) | F.exists("valid", lambda v: v["seq"] <= F.col("seq"))
    changed = F.coalesce(called, F.lit(False)) & (F.col("has_delta") | F.col("content").isNotNull())
    return F.when(F.col("finish_reason").isNotNull() & changed, F.lit("tool_calls")).otherwise(F.col("finish_reason"))


def finish_reasons(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Finish reason of each finishing chunk, ``tool_calls`` once the stream made a call."""
    rows = told(chunks, block_rows)
    ends = rows.where("finish_reason is not null").join(call_marks(rows, block_rows), STREAM_BLOCK, "left")
    return ends.select("stream_id", "seq", _reason().alias("finish_reason"))


def output_chunks(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What each chunk of a recorded stream turns into: 0 to n rows (stream_id, seq, part, kind, text, role,
    finish_reason, call_index, name, arguments), the same as the live rewriting gives.

    ``chunks``: stream_id, seq, role, content, finish_reason, and if given has_delta, rest and delta_rest (variants, see
    ``sources.chunks.flat_chunks``). A chunk without content, and a
    finishing one that says nothing, is handed on (kind ``passthrough``). What a
    stream still holds at its end comes behind its last chunk. Where chunks carry ``rest``, all that comes from a chunk carries it on, and
    what is handed on carries ``delta_rest`` too.
    """
    rows = told(chunks, block_rows)
    judged = rows.join(call_marks(rows, block_rows), STREAM_BLOCK, "left").withColumns({"outs": _judged(F.col("said")), "reason": _reason()})
    each = judged.select("*", F.posexplode_outer("outs").alias("part", "o")).withColumn("said_any", F.col("o").isNotNull())
    each = each.where(F.col("said_any") | F.col("content").isNull() | F.col("finish_reason").isNotNull())
    handed = [F.try_parse_json("rest").alias("rest")] if "rest" in chunks.columns else []
    if "delta_rest" in chunks.columns:
        handed.append(F.try_parse_json(F.when(~F.col("said_any"), F.col("delta_rest"))).alias("delta_rest"))
    is_last = F.coalesce(F.col("part") == F.size("outs") - 1, F.lit(True))
    return each.select(
        "stream_id", "seq", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("o.kind", F.lit("passthrough")).alias("kind"),
        F.when(F.col("said_any"), F.col("o.text")).otherwise(F.col("content")).alias("text"),
        F.when(~F.col("o.kind").eqNullSafe("tool_call"), F.col("role")).alias("role"),
        F.when(is_last, F.col("reason")).alias("finish_reason"), "o.call_index", "o.name", "o.arguments", *handed,
    )


def passthrough_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that say nothing themselves: no content at all, or empty content that finishes."""
    return chunks.where(
        F.col("content").isNull() | ((F.length("content") == 0) & (F.length("finish_reason") > 0))
    )


def stamp_streams(chunks: DataFrame, model_id: str | None = None) -> DataFrame:
    """One id per stream, and the model name when one is given."""
    model = F.coalesce(F.nullif(F.lit(model_id), F.lit("")), F.col("model")) if model_id else F.col("model")
    return chunks.withColumn("id", stable_id("chatcmpl", F.col("stream_id"))).withColumn("model", model)


def stream_totals(outputs: DataFrame) -> DataFrame:
    """Per stream: how much content and reasoning, how many calls. Sums combine before the shuffle."""

    def chars(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.length("text"))), F.lit(0)).cast("long")

    return outputs.groupBy("stream_id").agg(
        chars("content").alias("content_chars"),
        chars("reasoning").alias("reasoning_chars"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls"),
        F.count_if(F.col("kind") == "error").alias("bad_calls"),
    )
