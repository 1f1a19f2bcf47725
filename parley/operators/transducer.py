"""The tag scanner as a transducer whose blocks compose.

What a stretch of a stream does depends on little of what came before it: the started tag
that is held back (one of ``HELD``), which tag is open, and whether white space is
skipped. So a stretch is a map from each held text to an ``Outcome``: what is held behind
it, and how it moves the open tag, the skipping and the counts on. Maps of neighbouring
stretches join into the map of both, in any grouping, which lets the states at the
begin of all blocks of a stream be found by a prefix scan instead of one pass.

``tell`` then says what the chunks of a stretch turn into, given the state at its begin. Recorded
and live streams both use it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

from parley.constants import CALL_CLOSE, CALL_OPEN, TAGS, THINK_OPEN
from parley.functions.tags import PARTIAL_TAGS, SCAN, TAG_BODY

HELD = ("", *PARTIAL_TAGS)
_PLACE = {h: i for i, h in enumerate(HELD)}
_TOKENS = re.compile(SCAN.replace("\\z", "\\Z"))
_TAGS = frozenset(TAGS)
NO_TAG = -1
_OPEN, _CLOSE = TAGS.index(CALL_OPEN), TAGS.index(CALL_CLOSE)


class Outcome(NamedTuple):
    """What a stretch does after one held text: held behind it (place in ``HELD``), its tags (places in ``TAGS``), calls closed
    that it opened, whether a call tag stays open behind its last close, visible text before its first and behind its last tag."""

    held: int
    tags: int
    first: int
    last: int
    closed: int
    opens: bool
    lead: bool
    tail: bool


class State(NamedTuple):
    """Where a stream stands: ``pending`` tells that a call was opened since the last one closed."""

    held: str = ""
    open_tag: str | None = None
    skip_space: bool = False
    segment: int = 0
    calls: int = 0
    pending: bool = False


def outcome(text: str) -> Outcome:
    """The outcome of a text with nothing held before it."""
    tokens = _TOKENS.findall(text)
    held = tokens.pop() if tokens and tokens[-1] in _PLACE else ""
    tags, closed, opens, lead, tail = [], 0, False, False, False
    for token in tokens:
        if token not in _TAGS:
            tail = tail or not token.isspace()
            lead = lead or (not tags and tail)
            continue
        tag = TAGS.index(token)
        if tag == _CLOSE and tags and tags[-1] == _OPEN:
            closed, opens = closed + 1, False
        opens = opens or tag == _OPEN
        tags.append(tag)
        tail = False
    first, last = (tags[0], tags[-1]) if tags else (NO_TAG, NO_TAG)
    return Outcome(_PLACE[held], len(tags), first, last, closed, opens, lead, tail)


def join(a: Outcome, b: Outcome) -> Outcome:
    """The outcome of ``a`` and then ``b``, where ``b`` is the one for what ``a`` holds."""
    crossing = a.last == _OPEN and b.first == _CLOSE
    closed = b.closed + crossing
    return Outcome(
        b.held, a.tags + b.tags, a.first if a.tags else b.first, b.last if b.tags else a.last, a.closed + closed,
        b.opens or (a.opens and not closed), a.lead or (not a.tags and b.lead), b.tail or (not b.tags and a.tail),
    )


def moves(text: str) -> list[Outcome]:
    """The map of a text: its outcome for each held text.

    A character that is in no tag decides what was held, so that only the text up to the first such one is scanned for each.
    """
    head = len(text) - len(text.lstrip(TAG_BODY)) + 1
    if head > len(text):
        return [outcome(h + text) for h in HELD]
    rest = outcome(text[head:])
    return [join(outcome(h + text[:head]), rest) for h in HELD]


def compose(maps: Iterable[list[Outcome]]) -> list[Outcome]:
    whole: list[Outcome] = []
    for each in maps:
        whole = [join(a, each[a.held]) for a in whole] if whole else each
    return whole


def after(state: State, map_: list[Outcome]) -> State:
    """The state behind a stretch that begins in ``state``."""
    o = map_[_PLACE[state.held]]
    crossing = state.open_tag == CALL_OPEN and o.first == _CLOSE
    closed = o.closed + crossing
    skip = not o.tail if o.tags else state.skip_space and not o.lead
    open_tag = TAGS[o.last] if o.tags else state.open_tag
    return State(HELD[o.held], open_tag, skip, state.segment + o.tags, state.calls + closed, o.opens or (state.pending and not closed))


class Said(NamedTuple):
    """A piece of what chunks say: ``chunk`` is the place of the chunk in the stretch (one behind the last for what an ended stream still
    held), ``at`` the place in the stretch's text. ``kind``: content, reasoning, call (a whole one, its text stripped), part (of a
    call that goes beyond the stretch), close (of a call that began before the stretch)."""

    chunk: int
    at: int
    segment: int
    kind: str
    text: str | None
    call: int | None


def tell(state: State, texts: list[str], ended: bool, by_chunk: bool = True) -> tuple[list[Said], State]:
    """What consecutive chunks say, in order, and the state behind them.

    By chunk, a piece ends with its chunk and before each ``<`` token; else only with its segment. A token that begins with ``<``
    belongs to the chunk that holds its last character.
    """
    text = "".join(texts)
    ends = list(accumulate(map(len, texts)))
    held, opened, skip, segment, calls, pending = state
    tokens = _TOKENS.findall(held + text)
    place = -len(held)
    held = tokens.pop() if tokens and tokens[-1] in _PLACE else ""
    flushed = held if ended else ""
    out: list[Said] = []
    body: list[str] = []
    grown: list[str] = []
    row: tuple | None = None
    opens = False

    def close_row() -> None:
        nonlocal row
        if row:
            out.append(Said(row[0], row[1], segment, row[2], "".join(grown), None))
            grown.clear()
            row = None

    for token in [*tokens, flushed] if flushed else tokens:
        start, place = place, place + len(token)
        special = token[0] == "<"
        if special and by_chunk:
            close_row()
        if token in _TAGS:
            close_row()
            segment += 1
            if token == CALL_CLOSE and opened == CALL_OPEN:
                k, whole = bisect_left(ends, place), "".join(body)
                if pending and whole:
                    out.append(Said(k, place - 1, segment, "part", whole, calls))
                out.append(Said(k, place, segment, "close" if pending else "call", None if pending else whole.strip(), calls))
                calls, pending, opens = calls + 1, False, False
                body = []
            opens = opens or token == CALL_OPEN
            opened, skip = token, True
            continue
        while start < place:
            k = bisect_left(ends, place if special else start + 1)
            k = k if by_chunk else 0
            stop = min(place, ends[k]) if by_chunk and not special else place
            part = token[len(token) - (place - start) : len(token) - (place - stop)]
            at, start = start, stop
            part = part.lstrip() if skip else part
            if part and opened == CALL_OPEN:
                body.append(part)
            elif part:
                k = len(texts) if by_chunk and token is flushed else k
                if row and row[0] != k:
                    close_row()
                row = row or (k, at, "reasoning" if opened == THINK_OPEN else "content")
                grown.append(part)
            skip = skip and not part
    close_row()
    if body:
        out.append(Said(max(len(texts) - 1, 0), len(text), segment, "part", "".join(body), calls))
    return out, State("" if flushed else held, opened, skip, segment, calls, pending or opens)
