"""Hard negatives of anchors: rows of another label whose inner product lies in a window below that of a positive.

Anchors and rows meet in tiles of bounded size. The products of a tile come from
Strassen's recursive multiplication of int64 matrices, padded with zeros to sides
that halve evenly; its sums wrap, so a product that fits into a long is exact. A
tile whose products may not fit is multiplied in whole numbers of any length by the
same recursion; a score beyond a long then counts as the nearest long.

Two passes: the first keeps a heap of the best rows of an anchor's own label, the
second, knowing each positive's window, a heap of rows of other labels for each
positive. Heaps of sub-tiles merge inside a task, heaps of tasks in a window that
cuts to the heap's size before it shuffles. No tile or heap is capped: every anchor
meets every row in both passes.

Every component x becomes floor(256 * x), x as double. Rows with a null id or label,
and vectors that are null or hold null or non-finite components, take no part.
Vectors of different lengths are never compared; vectors without components score 0.
Rows that share an anchor's id are its own, neither positives nor negatives; of
several anchor rows with one id the least (label, vector) asks. Other repeated rows
count each. Ties go to the smaller id. An anchor without positives, a positive with
an empty window and empty tables give no rows. Extra columns may have any name;
they are not read. Labels are compared by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import parts_for

LEAF = 8
TILE = (512, 1024)
LONG = np.iinfo(np.int64)


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(x, ((0, -x.shape[0] % rows), (0, -x.shape[1] % columns)))


def _recurse(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    (h, k), w = np.array(a.shape) // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :w], b[:k, w:], b[k:, :w], b[k:, w:]
    m1 = _recurse(a11 + a22, b11 + b22, depth - 1)
    m2 = _recurse(a21 + a22, b11, depth - 1)
    m3 = _recurse(a11, b12 - b22, depth - 1)
    m4 = _recurse(a22, b21 - b11, depth - 1)
    m5 = _recurse(a11 + a12, b22, depth - 1)
    m6 = _recurse(a21 - a11, b11 + b12, depth - 1)
    m7 = _recurse(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * h, 2 * w), a.dtype)
    out[:h, :w], out[:h, w:] = m1 + m4 - m5 + m7, m3 + m5
    out[h:, :w], out[h:, w:] = m2 + m4, m1 - m2 + m3 + m6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product of two integer matrices, by halves down to sides of about ``leaf``."""
    rows, columns, least = a.shape[0], b.shape[1], min(*a.shape, b.shape[1])
    depth = max(0, int(np.log2(least / leaf))) if least else 0
    side = 1 << depth
    return _recurse(_padded(a, side, side), _padded(b, side, side), depth)[:rows, :columns]


def products(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices (as doubles), as int64."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2.0**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**62:
        return strassen(a.astype(np.int64), b.astype(np.int64).T, leaf)
    whole = np.frompyfunc(int, 1, 1)
    exact = strassen(whole(a).astype(object), whole(b).astype(object).T, leaf)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


class Heaps:
    """For each of ``n`` owners the ``k`` best (score, id), higher scores first, then smaller ids; heaps of parts merge exactly."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.full = k, np.full(n, LONG.min), np.zeros(n, bool)
        self.owner = self.score = self.id = np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take in a tile: a row of scores for each owner, an id for each column."""
        allowed = allowed & (scores >= self.least[:, None])
        if scores.shape[1] > self.k:
            seen = np.where(allowed, scores, LONG.min)
            at = scores.shape[1] - self.k
            allowed &= scores >= np.partition(seen, at, axis=1)[:, at][:, None]
        owner, column = np.nonzero(allowed)
        self.merge(owner, scores[owner, column], ids[column])

    def merge(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -1 - score, owner))  # -1 - x turns the order of longs around without overflow
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.least[self.owner[last]] = self.score[last]


def _tiles(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Sub-tiles of one block of anchors and one of rows, with their products."""
    a, b = (np.floor(np.stack(x["v"].to_numpy()).astype(np.float64) * 256) for x in (left, right))
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            own, met = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            yield own, met, products(a[own], b[met])


def _codes(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers that are equal where the labels are."""
    codes = pd.factorize(pd.concat([left, right]))[0]
    return codes[: len(left)], codes[len(left) :]


def _positives(k: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        anchors, ids, parts = left["id"].to_numpy(), right["id"].to_numpy(), []
        if len(left) and len(right):
            mine, theirs = _codes(left["label"], right["label"])
            heaps = Heaps(0, k)
            for own, met, scores in _tiles(left, right):
                if met.start == 0:
                    heaps = Heaps(scores.shape[0], k)
                heaps.offer(scores, ids[met], (mine[own, None] == theirs[None, met]) & (anchors[own, None] != ids[None, met]))
                if met.stop >= len(right):
                    parts.append((anchors[own][heaps.owner], heaps.id, heaps.score))
        columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "positive_score"), columns)))

    return meet


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives(k: int, low: int, high: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            anchors, ids = left["id"].to_numpy(), right["id"].to_numpy()
            mine, theirs = _codes(left["label"], right["label"])
            asked = [[(p["place"], *_window(p["score"], low, high)) for p in found] for found in left["found"]]
            most = max(map(len, asked))
            grid = np.array([[*a, *[(0, 1, 0)] * (most - len(a))] for a in asked], np.int64).reshape(len(left), most, 3)
            heaps: list[Heaps] = []
            for own, met, scores in _tiles(left, right):
                if met.start == 0:
                    heaps = [Heaps(scores.shape[0], k) for _ in range(most)]
                other = (mine[own, None] != theirs[None, met]) & (anchors[own, None] != ids[None, met])
                for i, heap in enumerate(heaps):
                    heap.offer(scores, ids[met], other & (scores >= grid[own, i, 1][:, None]) & (scores <= grid[own, i, 2][:, None]))
                    if met.stop >= len(right):
                        parts.append((anchors[own][heap.owner], grid[own, i, 0][heap.owner], heap.id, heap.score))
        columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("anchor_id", "place", "negative_id", "negative_score"), columns)))

    return meet


def _ready(df: DataFrame) -> DataFrame:
    """(id, label, v, n) of the rows that take part; a label becomes its text."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    named = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"), finite.alias("ok"))
    return named.filter("id is not null and label is not null and v is not null and ok").select("id", "label", "v", F.size("v").alias("n"))


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, row_block: int = 8192, anchor_block: int = 2048
) -> DataFrame:
    """Both tables: (vec_id, label, embedding). Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A negative's score n and its positive's score p satisfy low * p <= 100 * n <= high * p.
    """
    rows = _ready(rows)
    asked = _ready(anchors).groupBy("id").agg(F.min(F.struct("label", "v", "n")).alias("a")).select("id", "a.*")
    row_blocks, anchor_blocks = parts_for(rows.count(), row_block), parts_for(asked.count(), anchor_block)
    # Dealt by place, not by value, so that repeated rows spread.
    rows = rows.withColumn("rb", F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)).cast("int"))
    rows = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(anchor_blocks)).cast("int"))
        return df.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).groupBy("ab", "rb", "n")

    def best(df: DataFrame, keys: list[str], score: str, who: str, k: int, name: str) -> DataFrame:
        place: Column = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), who))
        return df.withColumn(name, place).filter(F.col(name) <= k)

    schema = "anchor_id long, positive_id long, positive_score long"
    near = dealt(asked).cogroup(rows.groupBy("ab", "rb", "n")).applyInPandas(_positives(positives), schema)
    near = best(near, ["anchor_id"], "positive_score", "positive_id", positives, "place")
    found = F.collect_list(F.struct("place", F.col("positive_score").alias("score"), "positive_id")).alias("found")
    asked = asked.join(near.groupBy(F.col("anchor_id").alias("id")).agg(found), "id")
    schema = "anchor_id long, place long, negative_id long, negative_score long"
    hard = dealt(asked).cogroup(rows.groupBy("ab", "rb", "n")).applyInPandas(_negatives(negatives, low, high), schema)
    hard = best(hard, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    named = asked.select(F.col("id").alias("anchor_id"), F.inline("found")).withColumnRenamed("score", "positive_score")
    return hard.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
