"""Maps of stretches join in any grouping, and lead to the states that a pass over the whole text finds."""

import random

from brute import rewrite, say
from test_replay import soup

from parley.operators.transducer import HELD, State, after, compose, moves, tell


def test_maps_compose_in_any_grouping():
    rng = random.Random(1)
    for _ in range(300):
        texts = soup(rng)
        said, whole = tell(State(), texts, False)
        cut = rng.randint(0, len(texts))
        assert after(State(), moves("".join(texts))) == whole
        assert after(after(State(), moves("".join(texts[:cut]))), moves("".join(texts[cut:]))) == whole
        if texts:
            assert after(State(), compose(moves(t) for t in texts)) == whole
            assert compose([compose(moves(t) for t in texts[:cut]), *(moves(t) for t in texts[cut:])] if cut else [moves(t) for t in texts]) == compose(moves(t) for t in texts)
        first, middle = tell(State(), texts[:cut], False)
        assert tell(middle, texts[cut:], False)[1] == whole


def test_a_map_has_an_outcome_for_each_held_text():
    assert len(moves("")) == len(HELD) and [HELD[o.held] for o in moves("")] == list(HELD)
    by = dict(zip(HELD, moves("nk>")))
    assert by["<thi"].tags == 1 and by[""].tags == by["<t"].tags == 0


def test_chunks_one_by_one_say_what_the_whole_says():
    rng = random.Random(2)
    for _ in range(300):
        texts = soup(rng)
        state, rows, kept = State(), [], ""
        for i, text in enumerate(texts):
            said, state = tell(state, [text], i == len(texts) - 1)
            for p in said:
                if p.kind == "part":
                    kept += p.text
                elif p.kind == "close":
                    rows.append((i, "call", kept.strip()))
                    kept = ""
                else:
                    rows.append((i + p.chunk, p.kind, p.text))
        want = [(seq, kind, text) for seq, kind, text, _, _ in rewrite([(None, t, None) for t in texts])]
        spoken = [r for r in rows if r[1] != "call"]
        assert spoken == [r for r in want if r[1] in ("content", "reasoning")] or any(r[1] == "call" for r in rows)
        whole = tell(State(), texts, True, by_chunk=False)[0]
        assert "".join(p.text for p in whole if p.kind == "reasoning") == "".join(t for k, t, *_ in say(texts)[0] if k == "reasoning")


def test_letters_of_tags_only_take_linear_time():
    texts = ["<t"] * 200_000
    assert after(State(), compose(moves("".join(texts[i : i + 4096])) for i in range(0, len(texts), 4096))) == tell(State(), texts, False)[1]
