import hashlib
import random

import pytest

from parley.llm import chat_format
from parley.llm.chat_format import digests, escape, parse, unescape, windows

NASTY = ["\\### Assistant: </turn> ok", "####", "#", "<</turn>", "</turn", "\\", "\\\\/", "###a: b", "</turn>\n### x: y", "", "é\U0001f600 \n\t#", "<\\/turn>", ": :"]
SCHEMA = "conv_id long, turn long, role string, text string, window long, loss int"


def plain(rows, budget, history):
    """The same windows by one loop for each choice: conversation -> [(turns, repeated)]."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    talks: dict = {}
    for conv, _, role, text in order:
        talks.setdefault(conv, []).append((role or "", text or ""))
    cost = lambda t: len(t[1].split()) + 3
    out = {}
    for conv, turns in talks.items():
        made, start = [], 0
        while start < len(turns):
            kept = [turns[0]] if start and turns[0][0] == "system" else []
            room = budget - sum(map(cost, kept))
            old = start
            while old > (1 if turns[0][0] == "system" else 0):
                held = sum(map(cost, turns[old - 1 : start]))
                if held > history or held > room - cost(turns[start]):
                    break
                old -= 1
            stop = start + 1
            while stop < len(turns) and sum(map(cost, turns[old : stop + 1])) <= room:
                stop += 1
            made.append((kept + turns[old:stop], len(kept) + start - old))
            start = stop
        out[conv] = made
    return out, talks


def check(spark, rows, budget=40, history=15):
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)
    made = windows(df, budget, history)
    want, talks = plain(rows, budget, history)
    seen: dict = {}
    for r in made.collect():
        assert r["window"] == len(seen.setdefault(r["conv_id"], []))
        turns = list(parse(r["text"]))
        seen[r["conv_id"]].append((turns, r["repeated"]))
        said = [text for i, (role, text) in enumerate(turns) if role == "assistant" and i >= r["repeated"]]
        assert [unescape(r["text"][s["start"] : s["stop"]]) for s in r["loss"]] == said
        assert r["text"].count("</turn>") == len(turns) and r["text"].count("###") == len(turns)
        assert r["tokens"] <= budget or len(turns) - r["repeated"] == 1
    assert seen == want
    got = {r["conv_id"]: tuple(r)[1:] for r in digests(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    size = lambda w: sum(len(f"### {escape(r, chat_format.SPECIAL_IN_ROLE)}: {escape(t)}</turn>\n") for r, t in w)
    for conv, turns in talks.items():
        targets = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got.pop(conv) == (len(turns), sha(whole), len(targets), sha(targets), sum(size(w) for w, _ in want[conv]))
    assert not got


@pytest.mark.parametrize("text", NASTY)
def test_escapes_come_back(text):
    assert unescape(escape(text)) == text
    assert "###" not in escape(text) and "</turn>" not in escape(text)
    window = "".join(f"### {escape(t, chat_format.SPECIAL_IN_ROLE)}: {escape(t)}</turn>\n" for t in [text, *NASTY])
    assert list(parse(window)) == [(t, t) for t in [text, *NASTY]]


def test_windows_and_digests(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 30])):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "system", None, "a: b\\", "##"])
            rows.append((conv, turn, role, rng.choice([None, *NASTY, " ".join("w" * rng.randint(1, 30))])))
    rows += [(None, 1, "user", "who"), (None, 0, "assistant", "me"), (50, None, "assistant", "b"), (50, None, "assistant", "a"), (50, 3, "user", "x")]
    rows += [(51, 0, "assistant", "twice")] * 2 + [(52, 0, "system", "long " * 60), (52, 1, "user", "long " * 20), (52, 2, "assistant", "y"), (53, 0, None, None)]
    check(spark, rows)
    check(spark, rows, budget=6, history=0)
    check(spark, rows, budget=10_000, history=500)


def test_long_conversation_in_stretches(spark):
    rng = random.Random(5)
    rows = [(1, t, "system" if t == 0 else rng.choice(["user", "assistant"]), "w " * rng.randint(0, 12)) for t in range(9_500)]
    check(spark, rows, budget=120, history=50)


def test_very_long_text(spark):
    check(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "word \\ " * 900_000), (1, 2, "user", "r"), (1, 3, "assistant", "s")])


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(windows(df)).count() == 0
