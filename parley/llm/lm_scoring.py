"""Scores of texts under a log-bilinear language model trained with noise-contrastive estimation.

Tokens are the words of a text in lower case (A-Z), cut at ASCII white space, and one
end. The model predicts a class from the two tokens before: the ``SHORT`` most
frequent words are classes of their own, every other word falls into one of
``ENDINGS`` classes by its last two bytes, the end is a class. Each of the two
positions has its own table of context vectors (for the most frequent words and
the endings of the rest); their sum, times the vector of a class, plus its bias is
its score. Within an ending, words follow their counts (plus a half; one share for
all unseen words), so the probabilities of all words add up to 1.

Training: every task runs stochastic steps over the texts of its part, with noise
drawn from class frequencies; the parameters of all tasks are averaged by tokens
in a tree. Everything that is learned covers all texts given. For scoring, scores
are normalised exactly: exp(score) is a product over the two positions, so one
matrix product gives the sum over all classes for all pairs of contexts at once.

Counts of words: the ``HEAD`` most frequent are known to every task; rarer words
of a text are looked up by a join. Null texts count as empty: one token, the end.
Rows are told apart by place, so repeated rows are scored each. Without any
training text, every token is unseen and the score equals the base.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import settle
from parley.llm.vocabulary import most_frequent, word_counts, words_of

HEAD, SHORT, ENDINGS, CONTEXT_WORDS, DIM = 65_536, 4096, 256, 1536, 24
END, CLASSES = SHORT + ENDINGS, SHORT + ENDINGS + 1
CONTEXTS = 1 + CONTEXT_WORDS + ENDINGS  # the first stands before every text
BATCH, NOISE, RATE, BUFFER = 4096, 32, 0.15, 1 << 17


def ending_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class Lexicon:
    """What every task knows of words: class, context and count of the head; class and context of any other by its ending."""

    def __init__(self, head: list[tuple[bytes, int]], endings: dict[int, tuple[int, int]], total: int, distinct: int, texts: int):
        """``head``: by falling count; ``endings``: count and number of all words by ending, head included; ``texts``: how often the end occurs."""
        self.total, self.distinct, self.texts = total, distinct, texts
        self.number = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([n for _, n in head], np.float64)
        ends = np.array([ending_of(w) for w, _ in head], np.int64)
        rank = np.arange(len(head))
        self.classes = np.where(rank < SHORT, rank, SHORT + ends)
        self.contexts = np.where(rank < CONTEXT_WORDS, 1 + rank, 1 + CONTEXT_WORDS + ends)
        self.in_ending = np.zeros((ENDINGS, 2))
        for g, (n, v) in endings.items():
            self.in_ending[g] = n, v
        short = rank < SHORT
        np.subtract.at(self.in_ending, ends[short], np.stack([counts[short], np.ones(short.sum())], 1))
        self.base_of_all = math.log10(total + 0.5 * (distinct + 1))
        self.of_ending = np.log10(self.in_ending[:, 0] + 0.5 * (self.in_ending[:, 1] + 1))
        self.base = np.log10(counts + 0.5) - self.base_of_all
        self.inner = np.where(short, 0.0, np.log10(counts + 0.5) - self.of_ending[ends])
        sizes = np.concatenate([np.zeros(SHORT), self.in_ending[:, 0], [texts]])
        sizes[: min(SHORT, len(head))] = counts[:SHORT]
        self.frequency = (sizes + 0.5) / (sizes + 0.5).sum()

    @classmethod
    def of(cls, values: dict) -> Lexicon:
        """A lexicon from the values of another."""
        lexicon = cls.__new__(cls)
        vars(lexicon).update(values)
        return lexicon

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Counter]:
        """Classes of all tokens, contexts of all words, numbers of the head words, and the other words with their counts."""
        number = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        other = np.flatnonzero(number < 0)
        rare = [words[i] for i in other.tolist()]
        ends = np.fromiter(map(ending_of, rare), np.int64, len(rare))
        classes, contexts = np.full(len(words) + 1, END), np.zeros(len(words), np.int64)
        if len(self.classes):
            classes[:-1], contexts[:] = self.classes[number], self.contexts[number]
        classes[other], contexts[other] = SHORT + ends, 1 + CONTEXT_WORDS + ends
        return classes, contexts, number[number >= 0], Counter(rare)


def before(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts one and two places before each token, the end included."""
    return np.concatenate([[0], contexts]), np.concatenate([[0, 0], contexts[:-1]]) if len(contexts) else np.zeros(1, np.int64)


class Parameters:
    def __init__(self, frequency: np.ndarray):
        rng = np.random.default_rng(3)
        self.first = rng.normal(0, 0.1, (CONTEXTS, DIM)).astype(np.float32)
        self.second = rng.normal(0, 0.1, (CONTEXTS, DIM)).astype(np.float32)
        self.classes = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.bias = np.log(frequency).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first.ravel(), self.second.ravel(), self.classes.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray) -> Parameters:
        p = cls.__new__(cls)
        a, b, c = CONTEXTS * DIM, 2 * CONTEXTS * DIM, 2 * CONTEXTS * DIM + CLASSES * DIM
        p.first, p.second = flat[:a].reshape(CONTEXTS, DIM), flat[a:b].reshape(CONTEXTS, DIM)
        p.classes, p.bias = flat[b:c].reshape(CLASSES, DIM), flat[c:]
        return p


class Trainer:
    """Noise-contrastive steps with row-wise adaptive rates."""

    def __init__(self, frequency: np.ndarray, seed: int):
        self.p, self.rng = Parameters(frequency), np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * frequency).astype(np.float32)
        self.cumulated = np.cumsum(frequency)
        self.speed = {k: np.full(len(getattr(self.p, k)), 1e-6, np.float32) for k in ("first", "second", "classes")}
        self.bias_speed = np.full(CLASSES, 1e-2, np.float32)

    def move(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, at = np.add.reduceat(gradient[order], starts, axis=0), rows[starts]
        speed = self.speed[name]
        speed[at] += (total * total).mean(1)
        getattr(self.p, name)[at] += RATE * total / np.sqrt(speed[at])[:, None]

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), CLASSES - 1)
        r, q, qn = p.first[c1] + p.second[c2], p.classes[w], p.classes[noise]
        true = (r * q).sum(1) + p.bias[w] - self.log_noise[w]
        false = r @ qn.T + (p.bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        pull = up[:, None] * q + down @ qn
        self.move("first", c1, pull)
        self.move("second", c2, pull)
        self.move("classes", np.concatenate([w, noise]), np.concatenate([up[:, None] * r, down.T @ r]))
        bias = np.bincount(w, up, CLASSES) + np.bincount(noise, down.sum(0), CLASSES)
        self.bias_speed += bias.astype(np.float32) ** 2
        p.bias += (RATE * bias / np.sqrt(self.bias_speed)).astype(np.float32)

    def run(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for i in range(0, len(w), BATCH):
            at = order[i : i + BATCH]
            self.step(c1[at], c2[at], w[at])


def train(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Parameters averaged over all tasks by their tokens; only one set reaches the driver."""
    # Plain values: a broadcast object would need this package on every worker.
    shared = texts.sparkSession.sparkContext.broadcast(vars(lexicon))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Lexicon.of(shared.value), 0
        trainer = Trainer(known.frequency, 1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                classes, contexts, _, _ = known.read(words_of(text))
                held.append((*before(contexts), classes))
                size += len(classes)
                if size >= BUFFER:
                    trainer.run(*map(np.concatenate, zip(*held)))
                    seen, held, size = seen + size, [], 0
        if held:
            trainer.run(*map(np.concatenate, zip(*held)))
        seen += size
        if seen:
            yield pa.RecordBatch.from_pydict({"tokens": [float(seen)], "parameters": pa.array([(trainer.p.flat() * np.float32(seen)).tobytes()], pa.binary())})

    def add(a: tuple[float, bytes | None], b: tuple[float, bytes | None]) -> tuple[float, bytes | None]:
        if a[1] is None or b[1] is None:
            return a if b[1] is None else b
        return a[0] + b[0], (np.frombuffer(a[1], np.float32) + np.frombuffer(b[1], np.float32)).tobytes()

    told = texts.mapInArrow(learn, "tokens double, parameters binary").rdd
    tokens, total = told.map(lambda r: (r["tokens"], bytes(r["parameters"]))).treeAggregate((0.0, None), add, add, depth=3)
    return Parameters(lexicon.frequency).flat() if total is None else np.frombuffer(total, np.float32) / np.float32(tokens)


def log_sums(p: Parameters) -> np.ndarray:
    """Logarithm of the sum over all classes of exp(score), for every pair of contexts."""
    a, b = p.first @ p.classes.T + p.bias, p.second @ p.classes.T
    top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
    return np.log(np.maximum(np.exp(a - top_a) @ np.exp(b - top_b).T, 1e-30)) + top_a + top_b.T


class Scorer:
    def __init__(self, flat: np.ndarray, sums: np.ndarray):
        p = Parameters.of(flat)
        self.first, self.second, self.sums = p.first @ p.classes.T + p.bias, p.second @ p.classes.T, sums

    def log10(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> float:
        """Sum of normalised log probabilities, base 10."""
        return float((self.first[c1, w] + self.second[c2, w] - self.sums[c1, c2]).sum(dtype=np.float64) / math.log(10))


_SCORERS: dict[int, Scorer] = {}


MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, text: str, is_training: str) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score; learned from the rows where ``is_training`` holds.
    Columns of these names are replaced; others may have any name."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(is_training)).select(F.coalesce(text, F.lit("")).alias("text"))
    counts = settle(word_counts(texts))
    n_texts = texts.count()
    by_ending = counts.groupBy(F.expr(f"crc32(substring(word, -2, 2)) % {ENDINGS}").alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    endings = {int(r["g"]): (r["n"], r["v"]) for r in by_ending.collect()}
    total, distinct = sum(n for n, _ in endings.values()) + n_texts, sum(v for _, v in endings.values()) + (n_texts > 0)
    lexicon = Lexicon(most_frequent(counts, HEAD), endings, total, distinct, n_texts)
    flat = train(texts, lexicon) if n_texts else Parameters(lexicon.frequency).flat()
    shared = spark.sparkContext.broadcast((vars(lexicon), flat, log_sums(Parameters.of(flat)).astype(np.float32)))

    keep = [c for c in docs.columns if c not in (text, is_training)]
    # The rest of a row goes as one struct, so that its columns may have any names.
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    rows = docs.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    word = pa.struct([("word", pa.binary()), ("g", pa.int32()), ("times", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, parameters, sums = shared.value
        known = Lexicon.of(values)
        scorer = _SCORERS.get(id(sums))
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[id(sums)] = Scorer(parameters, sums)
        end_base = math.log10(known.texts + 0.5) - known.base_of_all
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ends, words, times = [0], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                classes, contexts, numbers, rare = known.read(words_of(value))
                scored = scorer.log10(*before(contexts), classes) + float(known.inner[numbers].sum())
                facts = (len(classes), len(numbers) + (known.texts > 0), float(known.base[numbers].sum()) + end_base, scored)
                for column, fact in zip(out, facts):
                    column.append(fact)
                ends.append(len(rare))
                words += rare
                times += rare.values()
            fields = [pa.array(words, pa.binary()), pa.array(map(ending_of, words), pa.int32()), pa.array(times, pa.int32())]
            rare_words = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(word)))
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), rare_words]
            names = [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "rare"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    kinds += ", n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, g: int, times: int>>"
    told = settle(rows.mapInArrow(read, kinds))
    rare = told.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.g", "r.times")
    of_ending = F.element_at(F.array(*[F.lit(float(x)) for x in lexicon.of_ending]), F.col("g") + 1)
    rare = rare.join(counts, "word", "left")
    seen = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (seen - F.lit(lexicon.base_of_all))).alias("more_base"),
        F.sum(F.col("times") * (seen - of_ending)).alias("more_score"),
    )
    told = told.drop("rare").join(sums, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return told.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in keep if c not in MADE],
        "n_tokens",
        plus("n_known", "more_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        plus("base_score", "more_base"),
        plus("score", "more_score"),
    )
