import random

from parley.llm import line_dedup as ld
from pyspark.sql import functions as F

from .helpers import SCHEMA, corpus, mixed_rows, text
from .test_near_dedup import grouped


def rows_with_shared_lines(seed):
    rng = random.Random(seed)
    common = [text(rng, "en", 30, 1) for _ in range(4)] + ["short", "The end."]
    rows = mixed_rows(seed, 15)
    for i in range(40):
        lines = [text(rng, "de", rng.randint(2, 30), 1) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(common)
            if rng.random() < 0.6 and len(line) > 60:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            lines.insert(rng.randint(0, len(lines)), line)
        rows.append((100 + i, "\n".join(lines + [""] * rng.randint(0, 2)), "de", "s"))
    return rows


def brute(spark, rows, least=0.8):
    keys = {}
    for r in corpus(spark, rows).select("doc_id", "text", ld.document_key().alias("key")).collect():
        keys[r["doc_id"], r["text"]] = r["key"]
    lines = sorted({line for _, t, *_ in rows for line in (t or "").split("\n") if line.strip()})
    sets = {x: ld.shingles_of(x) for x in lines}
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root, first = grouped(pairs, lines), {}
    for i, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                at = (i is None, i or 0, keys[i, t], p)
                first[root[line]] = min(first.get(root[line], at), at)
    out = {}
    for i, t, *_ in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if not x.strip() or first[root[x]] == (i is None, i or 0, keys[i, t], p)]
        out[i, keys[i, t]] = None if t is None else "\n".join(kept)
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = rows_with_shared_lines(seed)
        docs = corpus(spark, rows)
        want = brute(spark, rows)
        before = docs.withColumn("doc_key", ld.document_key()).withColumn("lines", F.lit(1)).withColumn("places", F.lit(2))
        got = ld.dedup_lines(before)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc_key", "places", "lines"]
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["text"] == want[r["doc_id"], r["doc_key"]], r["doc_id"]
            if r["text"] is not None:
                assert r["lines"]["n_kept"] == len(r["text"].split("\n")) or r["lines"]["n_kept"] == 0 == len(r["text"])
            else:
                assert r["lines"] is None


def test_signatures_do_not_depend_on_neighbours():
    lines = ["a", "a longer line of some words", "é" * 9, "x" * 10, "another line, longer than the others by far"]
    together = ld.signatures(lines)
    assert all((together[i] == ld.signatures([x])[0]).all() for i, x in enumerate(lines))


def test_texts_are_read_once_for_signatures_candidates_and_places_each(spark, monkeypatch):
    asked, lines_of = [], ld.lines_of
    monkeypatch.setattr(ld, "lines_of", lambda docs: asked.append(docs) or lines_of(docs))
    gone = ld.dropped_lines(corpus(spark, rows_with_shared_lines(3)))
    assert gone.count() > 0 and len(asked) == 3


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
