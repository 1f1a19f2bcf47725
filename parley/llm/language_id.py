"""Language identification by hierarchical discrimination.

A text is described by its letter pairs and triples (of UTF-8 bytes, lower case,
anything but letters as one space), hashed into ``FEATURES`` slots; the vector is
the square root of the relative frequencies and so has length 1. A first linear
support vector machine for each family decides the language family; families are
groups of languages whose mean vectors are close. Within the family, one linear
support vector machine for each pair of languages votes.

Learning uses a bounded sample: about ``per_language`` different labelled texts of
each language, at most twice that, and at most about ``most_rows`` of all languages
together (chosen by a hash of the text, so that repeats of one count once). Prediction
covers every text as a whole, however long. Null texts and texts without a letter are ``und``
with score 0, as is every text where nothing could be learned. The score is the
product of the logistic margins of the family and of the winner's weakest pair; of two
languages with the same votes the first by name wins. Repeated rows have the same
prediction; an empty table gives an empty one. Other columns are kept, those named
``lang_pred`` or ``score`` replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import release, small_batches

FEATURES = 1 << 14
STEEP = 12.0  # of the logistic curve over margins


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for b in range(128):
        if chr(b).isalpha():
            table[b] = ord(chr(b).lower())
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all letter pairs and triples, and the number of the text of each."""
    joined = LETTERS[np.frombuffer(b"  " + b"   ".join(texts) + b"  ", np.uint8)]
    high = joined[1:]
    high[(joined[:-1] == 0xC3) & (high >= 0x80) & (high < 0x9F)] += 0x20  # Latin capitals with marks
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(joined) - 2]
    a = joined.astype(np.uint32)
    pair = a[:-2] << 8 | a[1:-1]
    triple = pair << 8 | a[2:]
    blank_pair, blank = pair == 0x2020, triple == 0x202020
    slot = lambda code: (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    owner = np.concatenate([owner[~blank_pair], owner[~blank]])
    return np.concatenate([slot(pair[~blank_pair] + np.uint32(1 << 28)), slot(triple[~blank])]).astype(np.int64), owner


def vectors_of(texts: list[bytes]) -> np.ndarray:
    slots, owner = codes_of(texts)
    counts = np.bincount(owner * FEATURES + slots, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def support_vector_machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 1e-4) -> np.ndarray:
    """Weights and, last, bias of a linear machine; y is +1 or -1. Sub-gradient steps over all rows, the later half averaged."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b, n = np.zeros_like(w), 0.0, 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for t in range(rounds):
        bad = y * (x @ w + b) < 1
        step = 20.0 / (1 + 0.05 * t)
        pull = np.where(bad, share * y, 0).astype(np.float32)
        w = w * (1 - step * c) + step * (pull @ x)
        b += 0.05 * step * float(pull.sum())
        if t >= rounds // 2:
            mean_w, mean_b, n = mean_w + w, mean_b + b, n + 1
    return np.append(mean_w / n, mean_b / n).astype(np.float32)


def families_of(centres: np.ndarray, n_families: int) -> list[int]:
    """Merge the two closest groups (by mean cosine of their languages) until ``n_families`` are left."""
    groups = [[i] for i in range(len(centres))]
    unit = centres / np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    near = unit @ unit.T
    while len(groups) > max(1, n_families):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[i] += groups.pop(j)
    out = [0] * len(centres)
    for g, members in enumerate(groups):
        for m in members:
            out[m] = g
    return out


class Model:
    """Languages, the family of each, and the weights of all machines as the columns of one matrix."""

    def __init__(self, languages: list[str], families: list[int], pairs: list[tuple[int, int]], weights: np.ndarray):
        self.languages, self.families, self.pairs, self.weights = languages, families, pairs, weights

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        n_families = max(self.families) + 1
        margins = vectors_of(texts) @ self.weights[:-1] + self.weights[-1]
        family = margins[:, :n_families]
        by = np.sort(family, axis=1)
        chosen = family.argmax(1)
        sure = 1 / (1 + np.exp(-STEEP * (by[:, -1] - by[:, -2]) / 2)) if n_families > 1 else np.ones(len(texts))
        votes = np.where(np.asarray(self.families)[None, :] == chosen[:, None], 0.0, -1e9)
        weakest = np.full(votes.shape, np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, n_families + k]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            votes[:, i] += 1e-3 * np.tanh(m)
            votes[:, j] -= 1e-3 * np.tanh(m)
            weakest[:, i] = np.minimum(weakest[:, i], m)
            weakest[:, j] = np.minimum(weakest[:, j], -m)
        winner = votes.argmax(1)
        score = sure / (1 + np.exp(-np.minimum(50, STEEP * weakest[np.arange(len(texts)), winner])))
        return [self.languages[i] for i in winner], np.clip(score, 0, 1).astype(float).tolist()


def fit(langs: list[str], texts: list[bytes]) -> Model:
    """A model of labelled texts."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], [], [], np.zeros((FEATURES + 1, 0), np.float32))
    y = np.array([languages.index(x) for x in langs])
    x = np.vstack([vectors_of(texts[i : i + 128]) for i in range(0, len(texts), 128)])
    centres = np.vstack([x[y == i].mean(0) for i in range(len(languages))])
    families = families_of(centres, int(np.ceil(np.sqrt(len(languages)))))
    family = np.array(families)[y]
    machines = [support_vector_machine(x, np.where(family == f, 1, -1)) for f in range(max(families) + 1)]
    pairs = [(i, j) for i, j in combinations(range(len(languages)), 2) if families[i] == families[j]]
    for i, j in pairs:
        rows = (y == i) | (y == j)
        machines.append(support_vector_machine(x[rows], np.where(y[rows] == i, 1, -1)))
    return Model(languages, families, pairs, np.stack(machines, axis=1))


def learn(labelled: DataFrame, per_language: int = 400, most_rows: int = 8_000) -> Model:
    """``labelled``: text, lang. The sample is drawn and freed of repeats in Spark; one task gets at most ``2 * most_rows`` texts and one for each language."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count()  # a row for each language
    share = F.least(F.lit(per_language), F.greatest(F.lit(1), F.floor(F.lit(most_rows) / F.count("*").over(Window.partitionBy()))))
    counts = counts.select(F.col("lang").alias("of"), "count", share.alias("share"))
    chosen = rows.withColumn("draw", F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30)))
    # A row for each language the model will tell apart, so no larger than the model; texts stay where they are.
    chosen = chosen.join(F.broadcast(counts), F.col("lang") == F.col("of"))
    chosen = chosen.filter(F.col("draw") < F.col("share") * F.lit(float(1 << 30)) / F.col("count"))
    chosen = chosen.groupBy("lang", "text").agg(F.first("draw").alias("draw"), F.first("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    chosen = chosen.withColumn("place", place).filter(F.col("place") <= 2 * F.col("share")).select("lang", "text", "draw")

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lang", "draw", "text"])
        model = fit(frame["lang"].tolist(), [t.encode("utf-8", "replace") for t in frame["text"]])
        pairs = [x for p in model.pairs for x in p]
        return pd.DataFrame({"languages": [model.languages], "families": [model.families], "pairs": [pairs], "weights": [model.weights.tobytes()]})

    learned = chosen.groupBy().applyInPandas(train, "languages array<string>, families array<int>, pairs array<int>, weights binary").first()
    if learned is None:
        return fit([], [])
    pairs = list(zip(learned["pairs"][::2], learned["pairs"][1::2]))
    weights = np.frombuffer(learned["weights"], np.float32).reshape(FEATURES + 1, -1)
    return Model(list(learned["languages"]), list(learned["families"]), pairs, weights)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("_spoken"))
    at = keep.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spoken = batch.column(at), np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool)
            langs, scores = ["und"] * len(spoken), [0.0] * len(spoken)
            todo = np.flatnonzero(spoken)
            for group in in_groups(todo, texts):
                for i, lang, score in zip(group, *model.predict([texts[int(i)].as_py().encode("utf-8", "replace") for i in group])):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )
        release()

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(label, f"{kinds}, lang_pred string, score double")


def in_groups(rows: np.ndarray, texts: pa.Array, most_rows: int = 48, most_bytes: int = 250_000) -> Iterator[list[int]]:
    """Rows in groups of bounded size; a longer text is a group of its own."""
    group, held = [], 0
    for i in rows.tolist():
        size = len(texts[i].as_buffer()) if hasattr(texts[i], "as_buffer") and texts[i].as_buffer() is not None else 0
        if group and (len(group) >= most_rows or held + size > most_bytes):
            yield group
            group, held = [], 0
        group.append(i)
        held += size
    if group:
        yield group
