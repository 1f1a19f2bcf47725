r"""Chat transcripts as training windows of a token budget, each with the mask of what the loss counts.

A turn is written as ``### role: text</turn>`` and a newline. A backslash is put before
every backslash, before a ``#`` behind another ``#`` and before the ``/`` of ``</turn>``,
in roles before ``:`` as well; so no control string is left inside a text, and dropping
those backslashes gives it back. Sums of turn tokens over a conversation choose the
windows, which begin and end between turns: a window takes the next turns that fit
beside what it repeats, at least one. From the second window on it repeats the
conversation's first turn, if that is a system turn, and before its new turns the longest
stretch of turns just before them that has at most ``history`` tokens and leaves room for
the first new turn. The loss mask holds the texts of the assistant's new turns only, so
each is a target once. A turn that is longer than the budget stands in a window
with no history, whole; nothing is cut or dropped.

Turns go by ``turn``, null first, ties by role and text; null roles and texts count as
empty; repeated rows count each. Rows without a ``conv_id`` form one conversation. Empty
tables give no windows. Extra columns may have any name; they are not read.

Text is shuffled once, by conversation, and sorted there by Spark, which spills; a task then
passes over its turns in order and holds one window, its history and a bounded
stretch of turns ahead, never a conversation. A long conversation thus takes time in one task, not memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import words_in

HEAD, MID, END = "### ", ": ", "</turn>\n"
SPECIAL = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
SPECIAL_IN_ROLE = re.compile(r"\\|:|(?<=#)#|(?<=<)/(?=turn>)")
ESCAPED = re.compile(r"\\(.)", re.S)
ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.S)
#: What the marks around a turn cost.
MARKS = 3
AHEAD_TURNS, AHEAD_CHARS = 4096, 1 << 22


def escape(text: str, special: re.Pattern[str] = SPECIAL) -> str:
    return special.sub(r"\\\g<0>", text) if "\\" in text or "##" in text or ":" in text or "</turn>" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(window: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a window, as they were given."""
    for turn in window.split(END)[:-1]:
        role = ROLE.match(turn, len(HEAD))
        yield unescape(role[1]), unescape(turn[role.end() :])


def turn_tokens(text: Column) -> Column:
    """Words of a text and the marks of its turn."""
    return F.size(words_in(text)) + MARKS


class _Conversation:
    """The turns of one conversation that are still to be written, behind the history they may repeat."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.new, self.made, self.begun, self.chars = 0, 0, False, 0

    def add(self, role: str, text: str, tokens: int) -> None:
        if not self.begun and role == "system":
            self.system = role, text, tokens
        self.begun = True
        self.turns.append((role, text, tokens))
        self.chars += len(text)

    def cut(self, ended: bool) -> Iterator[tuple]:
        """Windows that are sure: all of them once the conversation has ended, else those that no later turn can join."""
        sums = np.concatenate([[0], np.cumsum([t[2] for t in self.turns])]).astype(np.int64)
        start = self.new
        while start < len(self.turns):
            kept = self.system if self.made else None
            room = self.budget - (kept[2] if kept else 0)
            spare = max(0, min(self.history, room - self.turns[start][2]))
            # The system turn is repeated in its own place, not as history.
            first = 1 if self.system and self.turns[0] is self.system else 0
            old = max(min(first, start), int(np.searchsorted(sums, sums[start] - spare)))
            stop = max(start + 1, int(np.searchsorted(sums, sums[old] + room, "right")) - 1)
            if stop == len(self.turns) and not ended:
                break
            yield self.write(kept, self.turns[old:stop], start - old, int(sums[stop] - sums[old]))
            self.made += 1
            start = stop
        drop = int(np.searchsorted(sums, sums[start] - self.history)) if not ended else 0
        self.turns, self.new = self.turns[drop:], start - drop
        self.chars = sum(len(t[1]) for t in self.turns[self.new :])

    def write(self, kept, turns: list, repeated: int, tokens: int) -> tuple:
        if kept:
            turns, repeated, tokens = [kept, *turns], repeated + 1, tokens + kept[2]
        pieces, spans, at = [], [], 0
        for i, (role, text, _) in enumerate(turns):
            head, body = f"{HEAD}{escape(role, SPECIAL_IN_ROLE)}{MID}", escape(text)
            at += len(head)
            if role == "assistant" and i >= repeated:
                spans.append({"start": at, "stop": at + len(body)})
            at += len(body) + len(END)
            pieces += [head, body, END]
        return self.key, self.made, "".join(pieces), repeated, tokens, spans


WINDOW = "window long, text string, repeated int, tokens long, loss array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """``turns``: (conv_id, turn, role, text). Returns (conv_id, window, text, repeated, tokens, loss): ``repeated`` turns stand
    at the window's begin, ``loss`` has the places of target texts in code points. ``tokens`` counts a turn's tokens, the words and
    marks unless given. All windows of a conversation come in one partition, in order."""
    text = F.coalesce("text", F.lit(""))
    cost = turn_tokens(text) if tokens is None else tokens
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), cost.cast("long").alias("tokens"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(part.split()[0] for part in WINDOW.split(", "))]
        now: _Conversation | None = None

        def out(key_type: pa.DataType, made: list[tuple]) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int32(), pa.int64(), _SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            made = []
            for key, role, body, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now.key:
                    if now:
                        made += now.cut(ended=True)
                    now = _Conversation(key, budget, history)
                now.add(role, body, tokens)
                if len(now.turns) - now.new >= AHEAD_TURNS or now.chars >= AHEAD_CHARS:
                    made += now.cut(ended=False)
            if made:
                yield out(batch.schema.types[0], made)
        if now and (made := list(now.cut(ended=True))):
            yield out(batch.schema.types[0], made)

    return rows.mapInArrow(write, f"conv_id {kind}, {WINDOW}")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the windows of each conversation, as they came from ``windows``: a row for each conversation
    with its turns (each once), a digest of them and of all text under the loss mask, and the characters of all windows."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(part.split()[0] for part in DIGEST.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, counts, digest = False, None, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())

        def row() -> tuple:
            return key, counts[0], digest[0].hexdigest(), counts[1], digest[1].hexdigest(), counts[2]

        def out(key_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows = []
            for owner, text, repeated, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and owner != key:
                    rows.append(row())
                    counts, digest = [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                begun, key = True, owner
                for i, (role, said) in enumerate(parse(text)):
                    if i >= repeated:
                        counts[0] += 1
                        digest[0].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    target = unescape(text[span["start"] : span["stop"]])
                    counts[1] += len(target)
                    digest[1].update(target.encode())
                counts[2] += len(text)
            if rows:
                yield out(batch.schema.types[0], rows)
        if begun:
            yield out(batch.schema.types[0], [row()])

    return formatted.select("conv_id", "text", "repeated", "loss").mapInArrow(read, f"conv_id {kind}, {DIGEST}")
