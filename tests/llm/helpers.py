"""Small corpora with the cases that the operators must handle."""

import random

SYLLABLES = {"en": "the er on an re he in ed nd ha at en es of or".split(), "de": "en er ch ei sch ie ge st ver heit ung keit der die".split(),
             "fr": "ou eau aux le la tion ment qu et re ai eu ois ez".split(), "es": "os as ar que cion mente el la do ada es ez io illo".split()}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(rng: random.Random, lang: str = "en", n: int = 80, lines: int = 4) -> str:
    out = [words(rng, lang, max(1, n // lines)) for _ in range(lines)]
    return "\n".join(" ".join(line) for line in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    """rows of (doc_id, text, lang, source)"""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


def mixed_rows(seed: int = 1, n: int = 60):
    """Plain, null, empty and very long texts, exact and near copies, repeated rows, null ids and sources."""
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.choice(list(SYLLABLES)), rng.choice([1, 5, 40, 150])), rng.choice(["en", "de", None]), f"s{i % 5}") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "s0"), (n + 2, " \n\t ", "de", None), (None, text(rng), "en", "s1")]
    rows += [(n + 3, text(rng, "fr", 20_000, 50), "fr", "s1"), rows[0], rows[0], (n + 4, rows[1][1], "en", "s9")]
    near = rows[3][1].split(" ")
    rows += [(n + 5 + k, " ".join([*near[:-1], f"x{k}"]), "en", "s2") for k in range(3)]
    return rows
