import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from parley.llm import packing, tokens
from parley.llm.near_dedup import learn_weights

from .helpers import corpus, mixed_rows, text


def test_tokens_are_those_of_the_tokenizer():
    rng = random.Random(8)
    t = tokens.Tokens(tokens.default_path())
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\nb", "a \nb", "a\n b", "a\n\nb", "a\n\n\nb", "a\n", "a\n\n", "a\n ", "\n", "\n\na", "\ta\t b", "a \t b", "x\x01y",
           "l'eau d'été it's don't", "a b   c", "12 34abc!? *** ###", "é" * 50, "<|endoftext|> x", "ab\r\ncd", "a \n\n b", " x", "ends with space "]
    odd += [text(rng, g) for g in ("en", "fr", "de")]
    odd += ["".join(rng.choice(" \n\t ab,'") for _ in range(12)) for _ in range(500)]
    for x, (ids, _) in zip(odd, t.of(odd)):
        assert ids.tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_every_id_lies_in_one_piece_without_padding(spark):
    rows = mixed_rows(9, 80)
    docs = corpus(spark, rows)
    out = packing.pack(docs, window=256, shard_bytes=40_000).collect()
    t = tokens.Tokens(tokens.default_path())
    want = defaultdict(list)
    for i, x, _, _ in rows:
        want[i].append([*t.tokenizer.encode(x or "", add_special_tokens=False).ids, 1])
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for i, texts in want.items():
        pieces = sorted(x for p in got[i] for x in zip(range(p[0], p[0] + p[3]), p[1]))
        assert pieces == sorted(x for ids in texts for x in enumerate(ids))
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0 and at < 256


def indexed(texts, head, tail, mean_length):
    words = packing.Words(head, tail)
    numbers = [np.array(words.of_text(b" ".join(t).decode()), np.int64) for t in texts]
    return packing.Index(numbers, words.idf(), mean_length)


def test_a_seed_draws_its_like():
    rng = random.Random(10)
    topics = [[f"t{k}w{i}".encode() for i in range(30)] for k in range(6)]
    texts = [rng.choices(topics[i % 6], k=40) for i in range(60)]
    index = indexed(texts, {w: 3.0 for topic in topics for w in topic}, 3.0, 40)
    order = packing.arrange([20] * 60, index, window=200)
    assert sorted(order) == list(range(60))
    same = sum(a % 6 == b % 6 for a, b in zip(order, order[1:]))
    assert same > 45


def test_neighbours_against_all_scores():
    rng = random.Random(11)
    texts = [[b"w%d" % rng.randint(0, 40) for _ in range(rng.randint(0, 30))] for _ in range(50)]
    head = {b"w%d" % i: 1 + i / 10 for i in range(40)}
    index = indexed(texts, head, 5.0, 15)
    norm = [packing.K1 * (1 - packing.B + packing.B * len(t) / 15) for t in texts]
    weight = lambda w, i: head.get(w, 5.0) * texts[i].count(w) * (packing.K1 + 1) / (texts[i].count(w) + norm[i])
    for seed in range(50):
        used = np.zeros(50, bool)
        used[seed] = True
        own = [w for w in set(texts[seed]) if sum(w in t for t in texts) > 1]
        asked = sorted(own, key=lambda w: -weight(w, seed))[: packing.QUERY_WORDS]
        want = {i: sum(weight(w, i) for w in asked if w in texts[i]) for i in range(50) if i != seed}
        got = index.neighbours(seed, used).tolist()
        if len(own) <= packing.QUERY_WORDS:
            assert set(got) == {i for i, s in want.items() if s > 0}
            assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))


def test_long_seeds_are_asked_by_all_their_words():
    rng = random.Random(13)
    texts = [[b"w%d" % rng.randint(0, 400) for _ in range(rng.randint(40, 300))] for _ in range(60)]
    texts += [[b"w%d" % i for i in range(100)], [b"w0", b"only"]]
    head = {b"w%d" % i: 0.5 + i / 100 for i in range(400)}
    index = indexed(texts, head, 5.0, 150)
    for seed in range(len(texts)):
        used = np.zeros(len(texts), bool)
        used[seed] = True
        want = {}
        for i, t in enumerate(texts):
            norm = packing.K1 * (1 - packing.B + packing.B * len(t) / 150)
            want[i] = sum(head.get(w, 5.0) * t.count(w) * (packing.K1 + 1) / (t.count(w) + norm) for w in set(texts[seed]))
        got = index.neighbours(seed, used).tolist()
        assert set(got) == {i for i, s in want.items() if s > 0 and i != seed}
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))


def shards_of(docs, **bounds):
    weights = learn_weights(docs.select("text"))
    return packing.dealt(docs.select("doc_id", "text"), weights.head, **bounds).collect()


def test_like_documents_share_a_shard(spark):
    rng = random.Random(12)
    rows, group = [], {}
    for k in range(120):  # three exact copies and three near copies of each text
        words = text(rng, rng.choice(["en", "de", "fr"]), 60).split()
        for c in range(6):
            own = words if c < 3 else [*words[:-1], f"x{k}y{c}"]
            group[len(rows)] = k
            rows.append((len(rows), " ".join(own), "en", "s"))
    rng.shuffle(rows)
    size = sum(len(r[1]) for r in rows)
    got = shards_of(corpus(spark, rows), shard_bytes=size // 20)
    assert len({r["shard"] for r in got}) > 12 and len(got) == len(rows)
    where = defaultdict(list)
    for r in got:
        where[group[r["doc_id"]]].append(r["shard"])
    pairs = [a == b for s in where.values() for i, a in enumerate(s) for b in s[:i]]
    assert sum(pairs) > 0.75 * len(pairs)  # by a hash of id and text: one in twenty


def test_repeated_rows_are_split(spark):
    rows = [(None, None, None, None)] * 3000 + [(7, "one two", "en", "s")] * 3000 + [(i, f"w{i}", "en", "s") for i in range(100)]
    got = shards_of(corpus(spark, rows), shard_rows=500)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) > 8 and max(sizes.values()) < 1200


def test_empty_table(spark):
    assert packing.pack(corpus(spark, [])).count() == 0
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == packing.pack(corpus(spark, [(1, None, None, None)])).selectExpr("crc32(ids) AS c").first()["c"]
