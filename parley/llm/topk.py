"""Exact search for the rows with the highest inner product, by multi-resolution segment statistics.

A vector is cut into segments; each is described by its mean and its deviation.
For two vectors, the squared distance is at least the sum over segments of
length * ((difference of means)^2 + (difference of deviations)^2). Since the
inner product is half of both squared norms less half of the squared distance,
the same statistics bound it from above by the sum of
length * (product of means + product of deviations). The bound is taken with few
segments first, then with more for what is left; what survives both gets the
exact product in whole numbers.

Every component becomes floor(256 * x). Rows with a null id, and vectors that
are null or hold null or non-finite components, take no part. Vectors of
different lengths are never compared. Rows that share a query's id are its own
and no candidates; of several query rows with one id the smallest vector asks.
Ties go to the smaller id. Products must stay below 2^53. Repeated rows are candidates
each. An empty table, of rows or of queries, gives an empty one; further columns are not read.

Queries and rows meet in blocks of bounded size; a block keeps ``k`` rows for
each query, so what is shuffled after the comparison is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import parts_for

RESULT = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that a dot product of two rows is the upper bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([length, length]))


def best_in_block(q_ids, q, x_ids, x, k: int, levels: tuple[int, ...]) -> tuple[list, list, list]:
    """For each query the k rows of highest inner product, all that tie for the last place included."""
    at, who, scores = [], [], []
    q_levels = [segment_statistics(q, s) for s in levels]
    x_levels = [segment_statistics(x, s) for s in levels]
    slack = 1e-9 * np.sqrt((q * q).sum(1)).max(initial=1) * np.sqrt((x * x).sum(1)).max(initial=1) + 1e-6
    for i in range(len(q)):
        left = np.flatnonzero(x_ids != q_ids[i])
        if not len(left):
            continue
        bound = x_levels[0][left] @ q_levels[0][i]
        first = left[np.argpartition(-bound, min(k, len(left)) - 1)[:k]]
        least = np.partition(x[first] @ q[i], 0)[0] if len(first) >= k else -np.inf
        for a, b in zip(q_levels, x_levels):
            left = left[b[left] @ a[i] >= least - slack]
        exact = x[left] @ q[i]
        if len(left) > k:
            enough = np.partition(exact, len(exact) - k)[len(exact) - k]
            left, exact = left[exact >= enough], exact[exact >= enough]
            order = np.lexsort((x_ids[left], -exact))[:k]
            left, exact = left[order], exact[order]
        at += [q_ids[i]] * len(left)
        who += x_ids[left].tolist()
        scores += exact.astype(np.int64).tolist()
    return at, who, scores


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, levels: tuple[int, ...] = (4, 16), row_block: int = 8192, query_block: int = 1024
) -> DataFrame:
    """Both tables: (vec_id, embedding). Returns query_id, rank (from 1), vec_id, score."""

    def ready(df: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        df = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double"))
        return df.select(F.col("vec_id").cast("long").alias("id"), whole.alias("v")).withColumn("n", F.size("v"))

    rows = ready(vectors)
    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.size("v"))
    row_blocks, query_blocks = parts_for(rows.count(), row_block), parts_for(asked.count(), query_block)
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).cast("int"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right) or not left["n"].iloc[0]:
            found = ([], [], []) if not len(left) or not len(right) else _all_zero(left["id"], right["id"], k)
        else:
            found = best_in_block(
                left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k, levels
            )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)), dtype="int64")

    met = asked.groupBy("qb", "rb", "n").cogroup(rows.groupBy("qb", "rb", "n")).applyInPandas(compare, RESULT)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_zero(q_ids, x_ids, k: int) -> tuple[list, list, list]:
    """Vectors without components: every product is 0, the smallest ids win."""
    small = np.sort(x_ids.to_numpy())
    pairs = [(q, x) for q in q_ids for x in small[small != q][:k]]
    return [p[0] for p in pairs], [p[1] for p in pairs], [0] * len(pairs)
