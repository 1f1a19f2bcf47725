import random

import numpy as np
from parley.llm import language_id
from pyspark.sql import functions as F

from .helpers import SCHEMA, SYLLABLES, corpus, text


def test_held_out_accuracy_and_und(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, g, rng.choice([8, 60])), g, "s") for i in range(400) for g in [rng.choice(list(SYLLABLES))]]
    docs = corpus(spark, rows + [(900, None, "en", None), (901, "", "de", "s"), (902, "12 345 !?", "fr", "s"), (903, "une " * 60_000, None, "s"), rows[0], rows[0]])
    model = language_id.learn(docs.filter("doc_id % 4 <> 2").select("text", "lang"))
    out = language_id.identify(docs.withColumn("score", F.lit(7)).withColumn("x", F.lit(1)), model)
    assert out.columns == [*docs.columns, "x", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    held = [got[i] for i in range(400) if i % 4 == 2]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[903]["lang_pred"] in SYLLABLES
    assert out.count() == docs.count()


def test_families_hold_close_languages():
    centres = np.array([[1, 0, 0.1], [0, 1, 0], [1, 0.1, 0], [0.1, 1, 0]], float)
    families = language_id.families_of(centres, 2)
    assert families[0] == families[2] != families[1] == families[3]


def test_nothing_to_learn_from_and_one_language(spark):
    docs = corpus(spark, [(1, "some text", None, None), (2, None, "en", None)])
    model = language_id.learn(docs.select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    one = language_id.learn(corpus(spark, [(1, "some text", "xx", None)]).select("text", "lang"))
    assert sorted(r["lang_pred"] for r in language_id.identify(docs, one).collect()) == ["und", "xx"]
    assert language_id.identify(spark.createDataFrame([], SCHEMA), one).count() == 0


def test_repeats_of_one_text_count_once_and_do_not_meet_in_one_task(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, g, 20), g) for i in range(120) for g in [sorted(SYLLABLES)[i % len(SYLLABLES)]]]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang")
    copies = once.filter(F.xxhash64("text") % 2 == 0)
    for _ in range(3):
        copies = copies.unionByName(copies)
    a, b = language_id.learn(once), language_id.learn(once.unionByName(copies), per_language=4000)
    assert a.languages == b.languages and a.families == b.families and np.array_equal(a.weights, b.weights)
    few = language_id.learn(once, most_rows=len(SYLLABLES))
    assert set(few.languages) <= set(a.languages) and few.weights.shape[0] == a.weights.shape[0]


def test_a_prediction_recomputed_feature_by_feature(spark):
    """Counts letter pairs and triples one by one and applies the machines by name."""
    rng = random.Random(9)
    rows = [(text(rng, g, 20), g) for _ in range(60) for g in sorted(SYLLABLES)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    n = max(model.families) + 1
    for g in sorted(SYLLABLES):
        said = text(rng, g, 15)
        letters = b"  " + bytes(int(language_id.LETTERS[b]) for b in said.encode()) + b"  "
        letters = bytearray(letters)
        for i in range(1, len(letters)):
            if letters[i - 1] == 0xC3 and 0x80 <= letters[i] < 0x9F:
                letters[i] += 0x20
        counts: dict[int, int] = {}
        for i in range(len(letters) - 2):
            pair, triple = letters[i] << 8 | letters[i + 1], letters[i] << 16 | letters[i + 1] << 8 | letters[i + 2]
            for code, blank in ((pair + (1 << 28), pair == 0x2020), (triple, triple == 0x202020)):
                if not blank:
                    slot = (code * 0x9E3779B1 % (1 << 32)) >> 18
                    counts[slot] = counts.get(slot, 0) + 1
        total = sum(counts.values())
        margin = [sum((c / total) ** 0.5 * float(model.weights[s, k]) for s, c in counts.items()) + float(model.weights[-1, k]) for k in range(model.weights.shape[1])]
        family = max(range(n), key=lambda f: margin[f])
        votes = {lang: 0.0 for lang, f in zip(model.languages, model.families) if f == family}
        for k, (i, j) in enumerate(model.pairs):
            if model.families[i] == family:
                votes[model.languages[i if margin[n + k] > 0 else j]] += 1
        best = [lang for lang in votes if votes[lang] == max(votes.values())]
        assert model.predict([said.encode()])[0][0] in best
