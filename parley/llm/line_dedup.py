"""Fuzzy line dedup: of lines that are the same or nearly so, the first stays.

A line is what stands between newlines. Its shingles are all runs of ``SHINGLE``
characters; a shorter line is one shingle. MinHash signatures in high-recall bands
give candidates, their exact Jaccard similarity decides, and distributed union-find
makes components. One line of each component stays: the first by document id, then
by text hash and place. Blank lines (nothing but white space) stay as they are.

Null texts stay null. Rows that are the same in id and text count as one document
and keep the same lines. Null ids come last. A document may lose all its lines; it
stays with an empty text. An empty table gives an empty one; a text of any length is
one cell. Other columns are kept whatever their names, but for ``lines``, which is replaced.

Texts do not move as a whole: signatures and places do, and of texts only the
lines that are candidates and the documents that may lose a line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import checkpointed, settle, small_batches
from parley.llm.linking import classes, find_links, sieve, sifted

SHINGLE, ROWS, BANDS, MIN_SIMILARITY = 10, 3, 8, 0.8
CHUNK = 1 << 17  # characters hashed at once: arrays of them stay in the cache
PAIRS = 4096  # pairs compared at once
BLANK = " \t\n\x0b\f\r"


def _coefficients(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(1 << 20, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


ODD, FLIP = _coefficients()


def rolled(codes: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each run of SHINGLE codes, modulo 2 ** 32 or 2 ** 64."""
    h = codes[: len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        h *= codes.dtype.type(base)
        h += codes[i : i + len(h)]
    return h


def laid_out(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all lines, one line after the other, each padded to a shingle at least; lengths before and after padding."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    if (lengths < SHINGLE).any():
        lines = [x.ljust(SHINGLE, "\0") for x in lines]
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), lengths, np.maximum(lengths, SHINGLE)


def signatures(lines: list[str]) -> np.ndarray:
    """MinHash values, one row of ROWS * BANDS for each line; lines must not be empty."""
    codes, _, padded = laid_out(lines)
    h = rolled(codes * np.uint32(0x9E3779B1), 0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    # Every other stretch holds the shingles that cross into the next line, which do not count.
    stops = np.cumsum(padded)
    stretches = np.stack([stops - padded, stops - SHINGLE + 1], axis=1).ravel()[:-1]
    out = np.empty((ROWS * BANDS, len(lines)), np.uint32)
    mixed = np.empty_like(h)
    for k in range(ROWS * BANDS):
        np.bitwise_xor(h, FLIP[k], mixed)
        mixed *= ODD[k]
        out[k] = np.minimum.reduceat(mixed, stretches)[::2]
    return out.T


def buckets_of(signature: np.ndarray) -> np.ndarray:
    p = np.uint64(0x9E3779B97F4A7C15)
    rows = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = (out ^ rows[:, :, i]) * p
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def shingles_of(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def hashed_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, one line after the other, and how many each line has; lines must not be empty."""
    codes, lengths, padded = laid_out(lines)
    h = rolled(codes.astype(np.uint64), 0x9E3779B97F4A7C15)
    own = np.ones(len(codes), bool)  # shingles that cross into the next line do not count
    own[(np.cumsum(padded)[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    counts = padded - SHINGLE + 1
    h = h[own[: len(h)]]
    h += np.repeat(np.minimum(lengths, SHINGLE).astype(np.uint64) << np.uint64(32), counts)  # padding is no text
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, counts


def features_of(line: str) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.unique(hashed_shingles([line])[0])
    return hashes, np.ones(len(hashes))


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of each pair, for up to 4,096 at once: 51 bits of a hash tell the shingles of one pair apart."""
    n = len(left)
    key, counts = hashed_shingles(left + right)
    key >>= np.uint64(13)
    key <<= np.uint64(1)
    pair = np.arange(n, dtype=np.uint64) << np.uint64(52)
    key |= np.repeat(np.concatenate([pair, pair | np.uint64(1)]), counts)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    starts = np.searchsorted(key, pair)
    sizes = np.diff(starts, append=len(key))
    met = np.zeros(len(key), bool)
    np.equal(key[1:] ^ key[:-1], np.uint64(1), met[1:])  # the shingle of the left line, then that of the right one
    both = np.add.reduceat(met, starts, dtype=np.int64)
    return both / (sizes - both)


def compare(a: list, text_a: list, b: list, text_b: list) -> list[float]:
    """Similarity of each pair, a bounded number of characters at once."""
    out, start, size = [], 0, 0
    for i, (x, y) in enumerate(zip(text_a, text_b), 1):
        size += len(x) + len(y) + 2 * SHINGLE
        if size > CHUNK or i - start == PAIRS or i == len(a):
            out += similarities(text_a[start:i], text_b[start:i]).tolist()
            start, size = i, 0
    return out


def document_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, place, line, id) of all lines that are not blank."""
    rows = docs.select(document_key().alias("key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rows.filter(F.ltrim("line", F.lit(BLANK)) != "").withColumn("id", F.xxhash64("line"))


def dropped_lines(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(key, places) of the lines that go, for each document that loses any."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, times, size = {}, Counter(), 0
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                times[i] += 1
                if i not in held:
                    held[i] = line
                    size += len(line)
                if size > CHUNK:
                    yield signed_batch(held, times)
                    held, times, size = {}, Counter(), 0
            if held:
                yield signed_batch(held, times)

    def signed_batch(held: dict[int, str], times: Counter) -> pa.RecordBatch:
        buckets = buckets_of(signatures(list(held.values())))
        columns = [pa.array(held, pa.int64()), pa.array([times[i] for i in held], pa.int64()), *(pa.array(b) for b in buckets.T)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", *names])

    # Buckets are columns of their own: values of fixed size combine in a hash table, lists would have to be sorted.
    names = [f"b{i}" for i in range(BANDS)]
    signed = lines_of(docs).select("id", "line").mapInArrow(sign, "id long, n long, " + ", ".join(f"{b} long" for b in names))
    signed = settle(signed.groupBy("id").agg(F.sum("n").alias("n"), *[F.first(b).alias(b) for b in names]))
    members = signed.select("id", F.explode(F.array(*names)).alias("bucket"))

    def texts_of(ids: DataFrame) -> DataFrame:
        rows = sifted(lines_of(docs).select("id", "line"), sieve(ids))
        return rows.join(ids, "id", "left_semi").groupBy("id").agg(F.first("line").alias("text"))

    roots = classes(find_links(members, texts_of, compare, features_of, min_similarity))
    # Only lines that stand twice or are linked can lose a place; theirs are written once, without texts.
    again = signed.select("id", "n").join(roots, "id", "left").filter("n > 1 or root is not null")
    again = checkpointed(again.select("id", F.coalesce("root", "id").alias("root")))
    places = settle(sifted(lines_of(docs).select("key", "doc_id", "place", "id"), sieve(again)).join(again, "id").drop("id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place"))
    stays = places.groupBy("root").agg(first.alias("stays")).select("root", F.col("stays.key").alias("stay_key"), F.col("stays.place").alias("stay_place"))
    gone = places.join(stays, "root").filter((F.col("key") != F.col("stay_key")) | (F.col("place") != F.col("stay_place")))
    return gone.groupBy("key").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with the text that stays and ``lines``, a struct: n_lines, n_kept."""
    small_batches(docs.sparkSession)
    gone = checkpointed(dropped_lines(docs, min_similarity))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), document_key().alias("key"))
    rows = sifted(rows, sieve(gone, "key"), "key", flag="maybe")
    cut = rows.filter("maybe").join(gone.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").drop("of")
    rows = cut.unionByName(rows.filter("not maybe").withColumn("places", F.lit(None).cast("array<int>")))
    lines = F.split("doc.text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.coalesce("places", F.array().cast("array<int>")), i))
    n = F.octet_length("doc.text") - F.octet_length(F.replace("doc.text", F.lit("\n"), F.lit(""))) + 1  # text is not cut up for it
    text = F.when(F.col("places").isNull(), F.col("doc.text")).otherwise(F.concat_ws("\n", kept))
    counted = F.struct(n.alias("n_lines"), (n - F.coalesce(F.size("places"), F.lit(0))).alias("n_kept"))
    columns = [text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "lines"]
    return rows.select(*columns, F.when(F.col("doc.text").isNotNull(), counted).alias("lines"))
