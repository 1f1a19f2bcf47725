"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (lower case, cut at ASCII white space); a text of
fewer words is one shingle. Its weight in a text is its count there times the mean
inverse document frequency of its words. Document frequencies are counted over all
texts; the ``HEAD`` most frequent words have their own, all rarer words share that
of the rarest of these. Signatures sample shingles in proportion to weight; bands
of samples are buckets; candidates are verified by their weighted Jaccard
similarity. Linked texts form classes (transitively).

Exact copies are one item from the start. Null and empty texts are one class;
texts without words are copies or nothing. Every row gets the smallest id of its
class; a class of rows without any id gives null. Texts are told apart by a 64-bit hash.
A text of any length is read as a whole, as one cell; repeated rows are in one class.
An empty table gives an empty one. Other columns are kept whatever their names, but
for ``near``, which is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import checkpointed, release, settle
from parley.llm.linking import cached, classes, find_links, sieve, sifted, similarity
from parley.llm.vocabulary import most_frequent, word_counts, words_of

HEAD, SHINGLE, ROWS, BANDS, MIN_SIMILARITY = 65_536, 5, 3, 11, 0.8
TABLE = 1 << 16  # entries of each table of random numbers
CHUNK = 1 << 12  # shingles sampled at once
P = np.uint64(0x9E3779B97F4A7C15)


class Weights:
    """Hash and inverse document frequency of words; words seen before are known by a number."""

    def __init__(self, head: dict[bytes, float], tail: float, most_known: int = 600_000):
        self.head, self.tail, self.most_known = head, tail, most_known
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes, self.idf = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12)

    def add(self, word: bytes) -> int:
        n = self.number[word] = len(self.number)
        if n >= len(self.hashes):
            self.hashes, self.idf = np.concatenate([self.hashes, np.zeros(n, np.uint64)]), np.concatenate([self.idf, np.zeros(n)])
        self.hashes[n], self.idf[n] = xxhash.xxh64_intdigest(word), self.head.get(word, self.tail)
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.most_known:
            self.clear()
        number = self.number
        at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            known = number.get(words[i])
            at[i] = self.add(words[i]) if known is None else known
        return self.hashes[at], self.idf[at]


def weighted_shingles(text: str | None, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and their weights."""
    hashes, idf = weights.of(words_of(text))
    size = min(SHINGLE, len(hashes))
    if not size:
        return hashes, idf
    n = len(hashes) - size + 1
    mixed, mean = np.full(n, np.uint64(size)), np.zeros(n)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + n]) * P
        mixed ^= mixed >> np.uint64(29)
        mean += idf[i : i + n]
    shingles, first, count = np.unique(mixed, return_index=True, return_counts=True)
    return shingles, count * (mean[first] / size)


class Sampler:
    """Consistent weighted samples; the same shingle and weight give the same draws in every text."""

    def __init__(self, samples: int = ROWS * BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.odd = (rng.integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        r = rng.gamma(2, 1, TABLE)
        log_c = np.log(rng.gamma(2, 1, TABLE))
        self.r, self.per_r, self.rest, self.beta = (x.astype(np.float32) for x in (r, 1 / r, log_c - r, rng.random(TABLE)))

    def sample(self, shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash for each sample: of the chosen shingle and its step."""
        best = np.full(len(self.odd), np.inf)
        chosen = np.zeros(len(self.odd), np.uint64)
        for start in range(0, len(shingles), CHUNK):
            h, w = shingles[start : start + CHUNK], np.log(weight[start : start + CHUNK]).astype(np.float32)
            at = ((h[None, :] * self.odd[:, None]) >> np.uint64(48)).astype(np.intp)
            beta = self.beta.take(at)
            step = self.per_r.take(at)
            step *= w
            step += beta
            np.floor(step, step)
            value = np.subtract(beta, step, beta)
            value *= self.r.take(at)
            value += self.rest.take(at)
            i = value.argmin(1)
            rows = np.arange(len(i))
            low = value[rows, i]
            new = low < best
            best[new] = low[new]
            chosen[new] = (h[i] * P + step[rows, i].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[new]
        return chosen


def bands_of(samples: np.ndarray) -> np.ndarray:
    """A bucket for each band of ``ROWS`` samples."""
    rows = samples.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * P
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def learn_weights(texts: DataFrame) -> Weights:
    """Document frequencies over all rows; ``HEAD`` of them come back, the rest share one."""
    counts = settle(word_counts(texts, once_per_text=True))
    head = most_frequent(counts, HEAD)
    rows = texts.count()
    idf = {w: math.log(1 + rows / n) for w, n in head}
    return Weights(idf, math.log(1 + rows / head[-1][1]) if head else 1.0)


def near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with ``near``, a struct: text_id, class_id (smallest id of
    the class) and keep (whether the row is the one that stays: the smallest id, of equal ids the smallest text hash)."""
    text_id = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    weights = learn_weights(texts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            ids, buckets = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles, weight = weighted_shingles(text, weights)
                if len(shingles):
                    ids.append(i)
                    buckets.append(bands_of(sampler.sample(shingles, weight)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "buckets"])
        weights.clear()
        release()

    signed = docs.select(text_id.alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, "id long, buckets array<long>")
    signed = settle(signed.groupBy("id").agg(F.first("buckets").alias("buckets")))
    members = signed.select("id", F.explode("buckets").alias("bucket"))

    def texts_of(ids: DataFrame) -> DataFrame:
        rows = docs.select(text_id.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        return sifted(rows, sieve(ids)).join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))

    def compare(a: list, text_a: list, b: list, text_b: list) -> list[float]:
        of = cached(lambda text: weighted_shingles(text, weights), 256)
        return [similarity(of(i, x), of(j, y)) for i, x, j, y in zip(a, text_a, b, text_b)]

    roots = classes(find_links(members, texts_of, compare, lambda text: weighted_shingles(text, weights), min_similarity))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_id.alias("text_id"))
    known = docs.select("doc_id", text_id.alias("id")).groupBy("id").agg(F.min("doc_id").alias("first_id"))
    known = checkpointed(known.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    heads = known.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "id")).alias("head"))
    known = known.join(heads, "root").select(F.col("id").alias("of"), F.col("head.first_id").alias("class_id"), F.col("head.id").alias("head_text"))
    rows = rows.join(known, F.col("text_id") == F.col("of"))
    keep = (F.col("text_id") == F.col("head_text")) & F.col("doc.doc_id").eqNullSafe(F.col("class_id"))
    near = F.struct("text_id", "class_id", keep.alias("keep"))
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "near"], near.alias("near"))


def survivors(near: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` that stay, one of each class. Rows that are the same in id and text are marked alike; one of them stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in near.columns]).alias("doc")
    rows = near.filter("near.keep").select(whole, F.xxhash64("doc_id", "near.text_id").alias("id"))
    again = checkpointed(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    rows = sifted(rows, sieve(again), flag="again").withColumn("of", F.col("doc.doc_id"))
    once = rows.filter("again").dropDuplicates(["of", "id"])
    return rows.filter("not again").unionByName(once).select(*[F.col(f"doc.`{c}`").alias(c) for c in near.columns])
