"""What a stream says, worked out from positions in its whole text.

The text is cut into tokens first, then into segments between tags; only then is
each piece given to the chunk that holds its last character.
"""

import bisect
import json
import os

TAGS = ["<think>", "</think>", "<tool_call>", "</tool_call>"]
LONGEST = max(map(len, TAGS))


def tokens_of(text):
    """(start, stop, sort): sort is a tag, 'plain', 'broken' (a started tag and what broke it) or 'held' (started at the very end)."""
    at, out = 0, []
    while at < len(text):
        angle = text.find("<", at)
        angle = len(text) if angle < 0 else angle
        if angle > at:
            out.append((at, angle, "plain"))
        if angle == len(text):
            break
        same = max(len(os.path.commonprefix([text[angle : angle + LONGEST], t])) for t in TAGS)
        stop = angle + same
        if text[angle:stop] in TAGS:
            out.append((angle, stop, text[angle:stop]))
        elif stop == len(text):
            out.append((angle, stop, "held"))
        else:
            stop += 1
            out.append((angle, stop, "broken"))
        at = stop
    return out


def no_repeats(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ValueError("a key twice")
    return dict(pairs)


def no_constant(name):
    raise ValueError(name)


def judge(body):
    """('content' | 'error' | 'tool_call', record) of a call's text."""
    try:
        record = json.loads(body, object_pairs_hook=no_repeats, parse_constant=no_constant)
    except ValueError:
        return "content", None
    return ("tool_call", record) if isinstance(record, dict) and record.get("name") is not None else ("error", record)


def told(text):
    """In order: (kind, [(start, stop, opens a row)...]) for what is spoken and (kind, body, place, record) for closed calls, and the length of what is lost."""
    segments = [[None, 0, []]]
    for start, stop, sort in tokens_of(text):
        if sort in TAGS:
            segments.append([sort, stop, []])
        else:
            segments[-1][2].append((start, stop, sort != "plain"))
    out, call = [], ""
    for k, (tag, place, tokens) in enumerate(segments):
        before = segments[k - 1][0] if k else None
        if tag == "</tool_call>" and before == "<tool_call>":
            body, call = call.strip(), ""
            kind, record = judge(body)
            if kind == "tool_call" or body:
                out.append((kind, body, place, record))
        skip = 0
        if tag:
            whole = "".join(text[a:b] for a, b, _ in tokens)
            skip = len(whole) - len(whole.lstrip())
        kept = []
        for a, b, opens in tokens:
            cut = min(skip, b - a)
            skip -= cut
            if b - a > cut:
                kept.append((a + cut, b, opens))
        if tag == "<tool_call>":
            call += "".join(text[a:b] for a, b, _ in kept)
        elif kept:
            out.append(("reasoning" if tag == "<think>" else "content", kept))
    return out, len(call)


def say(chunks):
    """Events (kind, text, call_index, name, arguments) of a list of chunk texts, and the length of the lost tail."""
    text, events, n = "".join(chunks), [], 0
    parts, lost = told(text)
    for part in parts:
        if len(part) == 2:
            events.append((part[0], "".join(text[a:b] for a, b, _ in part[1]), None, None, None))
        elif part[0] == "tool_call":
            given = part[3].get("arguments", {})
            events.append(("tool_call", None, n, part[3]["name"], given if isinstance(given, str) else json.dumps(given, separators=(",", ":"))))
            n += 1
        else:
            events.append((part[0], part[1], None, None, None))
    return merge(events), lost


def merge(events):
    """Join neighbouring text of the same kind."""
    joined = []
    for e in events:
        if joined and e[0] in ("content", "reasoning") and joined[-1][0] == e[0]:
            joined[-1] = (e[0], joined[-1][1] + e[1], None, None, None)
        else:
            joined.append(e)
    return joined


def rewrite(chunks):
    """Output rows (seq, kind, text, role, finish_reason) of a stream of chunks (role, content, finish_reason)."""
    texts = [t or "" for _, t, _ in chunks]
    text, ends, total = "".join(texts), [], 0
    for t in texts:
        total += len(t)
        ends.append(total)
    held = [t[0] for t in tokens_of(text) if t[2] == "held"]
    seq_of = lambda stop: bisect.bisect_left(ends, stop)  # noqa: E731 - the first chunk that reaches so far
    rows = [[] for _ in range(len(chunks) + 1)]
    calls = [0] * (len(chunks) + 1)
    for part in told(text)[0]:
        if len(part) == 4:
            kind, body, place, record = part
            named = kind == "tool_call"
            seq = seq_of(place)
            rows[seq].append([kind, record["name"] if named else body, None if named else chunks[seq][0]])
            calls[seq] += named
            continue
        last = None
        for a, b, opens in part[1]:
            while a < b:
                if held and a == held[0]:
                    seq, stop = len(chunks), b
                elif opens:
                    seq, stop = seq_of(b), b
                else:
                    seq = seq_of(a + 1)
                    stop = min(b, ends[seq])
                if last == seq and not opens:
                    rows[seq][-1][1] += text[a:stop]
                else:
                    rows[seq].append([part[0], text[a:stop], chunks[seq][0] if seq < len(chunks) else None])
                last, a = seq, stop
    out, made = [], 0
    for seq, (role, content, finish) in enumerate(chunks):
        made += calls[seq]
        finish = ("tool_calls" if made else finish) if finish else None
        own = rows[seq]
        if not own and (content is None or finish):
            own = [["passthrough", content, role]]
        out += [(seq, *r, finish if k == len(own) - 1 else None) for k, r in enumerate(own)]
    return out + [(len(chunks), *r, None) for r in rows[-1]]
