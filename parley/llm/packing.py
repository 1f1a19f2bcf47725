"""Lexical retrieval packing: similar documents share a training sequence.

Documents are dealt out to shards of bounded size by content: each has a key of
``DRAWS`` words, drawn in proportion to inverse document frequency and alike for
like texts (MinHash), and a shard is a range of keys. Copies lie next to each
other; documents that share few words mostly do not, and a seed finds only what
lies in its shard (README has measured shares). Behind the words a key has a hash of
id and text and the number of a repeated row, so no group is bound to one shard. A shard
is an inverted index with BM25 weights; inverse document frequencies are those of
the whole corpus. The first document of a window is its seed: the index returns
the unused documents that are most like it, and these fill the window one after
the other. What no longer fits goes on in the next window and is its seed. Where
the index has no more neighbours, the next unused document is taken.

A document is the ids of its text and then id ``END``. Windows are full, so there is
no padding; only the last ids of a shard do not fill one and are cut into sequences
whose lengths are powers of two, which need none either.

Null texts are empty: one id, the end. Repeated rows are packed each. A document
may be cut anywhere; every id lies in exactly one piece, however long it is. An empty
table gives an empty one. Only ``doc_id`` and ``text`` are read, whatever else a row holds.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import checkpointed, release
from parley.llm.linking import sieve, sifted
from parley.llm.near_dedup import learn_weights
from parley.llm.tokens import MOST_PIECES, Tokens, as_text, default_path, tokens_at
from parley.llm.vocabulary import words_of

WINDOW, END, SHARD_BYTES, SHARD_ROWS = 2048, 1, 8_000_000, 20_000
DRAWS, BOUND_SAMPLES = 3, 64
K1, B = 1.2, 0.75
QUERY_WORDS = sys.maxsize  # a seed asks by all its words


class Words:
    """Numbers of the words of a shard. Pieces of tokens stand for their words, so a text need not be cut twice."""

    def __init__(self, head: dict[bytes, float], tail: float):
        self.head, self.tail, self.number = head, tail, {}

    def of_text(self, text: str) -> list[int]:
        return [self.number.setdefault(w, len(self.number)) for w in words_of(text)]

    def of_pieces(self, texts: list[list[int] | np.ndarray], tokens: Tokens) -> list[np.ndarray]:
        arrays = [t for t in texts if isinstance(t, np.ndarray)]
        seen = np.unique(np.concatenate([np.zeros(0, np.int64), *arrays]))
        wanted, table = np.zeros(len(tokens.number) + 1, bool), np.zeros(len(tokens.number) + 1, np.int64)
        wanted[seen] = True
        for n, piece in zip(seen.tolist(), compress(tokens.number, wanted)):  # pieces stand in the order of their numbers
            table[n] = self.number.setdefault(as_text(piece).strip().lower().encode("utf-8", "surrogatepass"), len(self.number))
        blank = self.number.get(b"", -1)
        made = [table[t] if isinstance(t, np.ndarray) else np.array(t, np.int64) for t in texts]
        return [t[t != blank] for t in made]

    def idf(self) -> np.ndarray:
        return np.fromiter((self.head.get(w, self.tail) for w in self.number), np.float64, len(self.number))


class Index:
    """An inverted index of one shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean_length: float):
        """``texts``: the numbers of the words of each document; ``idf``: by number."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        n_words = max(1, len(idf))
        pairs = np.repeat(np.arange(len(texts)), length) * n_words + np.concatenate([np.zeros(0, np.int64), *texts])
        pairs, tf = np.unique(pairs, return_counts=True)
        document, word = pairs // n_words, pairs % n_words
        self.starts = np.searchsorted(document, np.arange(len(texts) + 1))
        norm = K1 * (1 - B + B * length / max(1.0, mean_length))
        self.weight = (idf[word] * tf * (K1 + 1) / (tf + norm[document])).astype(np.float32) if len(word) else np.zeros(0, np.float32)
        self.word = word
        order = np.argsort(word, kind="stable")
        self.posting, self.posting_weight = document[order], self.weight[order]
        self.ends = np.cumsum(np.bincount(word, minlength=n_words))
        self.begins = self.ends - np.bincount(word, minlength=n_words)
        self.n = len(texts)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling likeness to the seed, asked by all its words that other documents have too."""
        own = slice(self.starts[seed], self.starts[seed + 1])
        words = self.word[own]
        words = words[(self.ends[words] - self.begins[words]) > 1]
        if not len(words):
            return np.zeros(0, np.int64)
        begins, lengths = self.begins[words], self.ends[words] - self.begins[words]
        at = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        score = np.bincount(self.posting[at], self.posting_weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def arrange(lengths: list[int], index: Index, window: int = WINDOW) -> list[int]:
    """The order in which the documents of a shard fill its windows."""
    n = len(lengths)
    used, order, room, following = np.zeros(n, bool), [], 0, 0
    waiting: list[int] = []
    for _ in range(n):
        while waiting and used[waiting[-1]]:
            waiting.pop()
        if waiting:
            doc = waiting.pop()
        else:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        order.append(doc)
        room -= lengths[doc]
        if room <= 0:  # the document opens a window, or ends in a later one than it began
            room = window - (-room) % window if room else 0
            waiting = index.neighbours(doc, used)[::-1].tolist() if room else []
    return order


def sequences(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents laid end to end; the rest behind the last full window is cut by powers of two."""
    total = sum(lengths)
    sizes = [window] * (total // window)
    rest = total % window
    while rest:
        sizes.append(1 << (rest.bit_length() - 1))
        rest -= sizes[-1]
    out, sequence, offset = [], 0, 0
    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            size = min(length - start, sizes[sequence] - offset)
            out.append((doc, start, size, sequence, offset))
            start, offset = start + size, offset + size
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0
    return out


class Keys:
    """Keys of content: the words of the least random value, an exponential variate over the word's weight. Words outside the head,
    most of which no other document has, are drawn only where a text has no others."""

    def __init__(self, head: dict[bytes, float]):
        self.number = {w: n for n, w in enumerate(head)}
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, head), np.uint64, len(head))
        self.values = self.draws(list(head)) / np.fromiter(head.values(), np.float64, len(head))[:, None]

    @staticmethod
    def draws(words: list[bytes]) -> np.ndarray:
        even = np.array([[xxhash.xxh64_intdigest(w, k + 1) for k in range(DRAWS)] for w in words], np.float64).reshape(-1, DRAWS)
        return -np.log((even + 1) / 2.0**64)

    def of(self, text: str | None) -> bytes:
        words = set(words_of(text))
        if not words:
            return bytes(8 * DRAWS)
        at = [n for n in map(self.number.get, words) if n is not None]
        if at:
            return self.hashes[np.array(at)[self.values[at].argmin(0)]].astype(">u8").tobytes()
        others = list(words)
        least = self.draws(others).argmin(0)
        return b"".join(xxhash.xxh64_digest(others[i]) for i in least)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (a hash of both) and again: 0, or the number of a row that occurs more than once. The same in every run."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    again = checkpointed(rows.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row").alias("id")))
    if again.isEmpty():
        return rows.withColumn("again", F.lit(0))
    rows = sifted(rows, sieve(again), "row", flag="_again")
    groups = rows.filter("_again").groupBy("doc_id", "text", "row").agg(F.count("*").alias("n"))
    each = groups.select("doc_id", "text", "row", F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("again"))
    return rows.filter("not _again").select("doc_id", "text", "row", F.lit(0).alias("again")).unionByName(each)


def dealt(docs: DataFrame, head: dict[bytes, float], shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, text and shard: ranges of the keys of content, of about ``shard_bytes`` or ``shard_rows`` each. A sample of the
    keys, in proportion to size, gives the bounds; a few dozen for each shard come back, whatever the size of its documents."""
    known = docs.sparkSession.sparkContext.broadcast(head)
    rows = numbered(docs)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        keys = Keys(known.value)
        for batch in batches:
            texts, row, again = (batch.column(c).to_pylist() for c in ("text", "row", "again"))
            yield batch, [keys.of(t) + (r + (1 << 63)).to_bytes(8, "big") + n.to_bytes(4, "big") for t, r, n in zip(texts, row, again)]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("times")], names=["key", "times"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(shard_bytes) + F.lit(1 / shard_rows)
    even = F.pmod(F.xxhash64("row", "again"), F.lit(1 << 20)) / F.lit(1 << 20)
    times = F.floor(size * BOUND_SAMPLES + even).cast("int")
    drawn = rows.withColumn("times", times).filter("times > 0").mapInArrow(sample, "key binary, times int").collect()
    drawn = sorted((bytes(r["key"]), r["times"]) for r in drawn)
    bounds, held = [], 0
    for key, n in drawn:
        if held >= BOUND_SAMPLES:
            bounds.append(key)
            held = 0
        held += n
    ranges = docs.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in keyed(batches):
            shard = pa.array([bisect_right(ranges.value, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), shard], names=["doc_id", "text", "shard"])

    return rows.mapInArrow(deal, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, shard int")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text of ``docs`` -> a row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    weights = learn_weights(docs.select("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, rows = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    known = docs.sparkSession.sparkContext.broadcast((weights.head, weights.tail, total / max(1, rows) / 6))

    def fill(table: pa.Table) -> pa.Table:
        tokens = tokens_at(path or default_path())
        shard = table.column("shard")[0].as_py() if table.num_rows else 0
        table = table.sort_by("doc_id")  # the same order in every run
        texts = [t or "" for t in table.column("text").to_pylist()]
        ids = []
        words = Words(*known.value[:2])
        numbers = []
        for i in range(0, len(texts), 256):
            for text, (own, pieces) in zip(texts[i : i + 256], tokens.of(texts[i : i + 256])):
                ids.append(np.append(own, np.uint32(END)))
                numbers.append(words.of_text(text) if pieces is None else pieces)
        numbers, idf = words.of_pieces(numbers, tokens), words.idf()
        doc_ids = table.column("doc_id")
        del table, texts, words  # the index needs memory of its own
        if len(tokens.number) > MOST_PIECES:
            tokens.clear()
        index = Index(numbers, idf, known.value[2])
        del numbers
        order = arrange(list(map(len, ids)), index, window)
        del index
        release()
        pieces = sequences([len(ids[d]) for d in order], window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        doc = np.array(order)[doc]
        names = doc_ids.take(pa.array(doc))
        data = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        tokens_of = np.fromiter(map(len, ids), np.int64, len(ids))[doc]
        return pa.table({
            "doc_id": names, "start": start, "length": length, "doc_tokens": tokens_of,
            "sequence_id": (np.int64(shard) << 32) + sequence, "offset": offset, "ids": pa.array(data, pa.binary()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt(docs.select("doc_id", "text"), weights.head, shard_bytes).groupBy("shard").applyInArrow(fill, kinds)
