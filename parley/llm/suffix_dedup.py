"""Removal of repeated passages, exact to the byte, by sorting suffixes deep and shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in any document. Texts are UTF-8 bytes; null texts are empty; matches do not
cross documents; strings are judged on the input.

Which suffixes to sort: the string of ``ANCHOR`` bytes with the least hash in every
window of ``LENGTH`` bytes is an anchor. Two equal windows have the same anchor at
the same place, so it is enough to compare places whose anchors are equal. Places
with one anchor are a group; the bytes around a place that a window
could take in are its context. Equal contexts are one: where a context stands at two
places, all of it is repeated, at every place of it (periodic texts and copies have few contexts at many places). Only one of
each context is cut out and sorted with the others of its anchor. Suffixes to the right of the anchors are sorted by multikey
quicksort to a shallow depth and beyond it by blind tries, as are the bytes to the
left, read backwards. Where two contexts agree on l bytes to the left and r to the
right with l + r >= LENGTH, windows repeat; runs of common prefixes in both orders
tell for every shift of the window whether it has a partner. Nothing is compared
in pairs.

Texts that occur several times as a whole are one text in the groups; each of
their copies is repeated entirely (from ``LENGTH`` bytes on). Groups of more than
``WIDE`` different contexts are not gathered in a task: their windows are hashed and counted
instead, shift by shift. Texts are told apart by a 64-bit hash, contexts by 128 bits.

Texts shorter than ``LENGTH`` bytes keep everything; a text of any length is one cell.
Repeated rows are copies, each treated alike. An empty table gives an empty one. Other
columns are kept whatever their names, but for ``repeats``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import checkpointed, settle
from parley.llm.linking import sieve, sifted

LENGTH, ANCHOR, SHALLOW, WIDE = 400, 50, 64, 100_000
CHUNK = 1 << 22  # bytes hashed at once
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, np.uint64(BASE)), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: list[np.ndarray] = []


def anchors_of(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a text."""
    window = length - anchor + 1
    hashes, places = [], []
    for start in range(0, max(0, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - start), start)
        n = len(part)
        if not _TABLES or len(_TABLES[0]) < n:
            _TABLES[:] = _powers(max(1 << 16, n))
        up, down = _TABLES[0][:n], _TABLES[1][:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up)])
        h = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << 23) - 1)  # of equal hashes the leftmost counts
        keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m = -(-len(keyed) // window) * window
        blocks = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[: len(keyed)] = keyed
        blocks = blocks.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(keyed) - window + 1
        at = np.unique((np.minimum(behind[:count], ahead[window - 1 : window - 1 + count]) & low).astype(np.int64))
        hashes.append(h[at].view(np.int64))
        places.append(at + start)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    low, high = start, min(len(a), len(b))
    if a[start:high] == b[start:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """A Patricia trie that keeps branching characters only; an insertion compares with one string."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # a leaf is a list of equal strings; a node is (depth, {character: child})

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        s = self.strings[i]
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            character = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(character) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        mine = s[depth] if depth < len(s) else -1
        theirs = other[depth] if depth < len(other) else -1
        above = None
        for above_next in path:
            if above_next[0] > depth:
                break
            if above_next[0] == depth:
                above_next[1][mine] = [i]
                return
            above = above_next
        below = self.root
        if above is not None:
            character = s[above[0]] if above[0] < len(s) else -1
            below = above[1][character]
        split = (depth, {theirs: below, mine: [i]})
        if above is None:
            self.root = split
        else:
            above[1][character] = split

    def in_order(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before)."""
        stack: list[tuple[object, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                yield node[0], shared
                for i in node[1:]:
                    yield i, len(self.strings[i])
                continue
            children = sorted(node[1].items())
            for k in range(len(children) - 1, -1, -1):
                stack.append((children[k][1], node[0] if k else shared))


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (the first: 0)."""
    order: list[int] = []
    prefixes: list[int] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    step = 8
    while stack:
        group, depth, shared = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            prefixes.append(shared)
            continue
        if depth >= shallow or len(group) <= 3:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            for k, (i, prefix) in enumerate(trie.in_order()):
                order.append(i)
                prefixes.append(prefix if k else shared)
            continue
        # Multikey quicksort on pieces of ``step`` bytes: smaller, equal, larger than the piece of the middle string.
        pivot = strings[group[len(group) // 2]][depth : depth + step]
        less, same, more = [], [], []
        for i in group:
            piece = strings[i][depth : depth + step]
            (less if piece < pivot else more if piece > pivot else same).append(i)
        parts = [(p, d) for p, d in ((less, depth), (same, depth + step if len(pivot) == step else shallow), (more, depth)) if p]
        for k in range(len(parts) - 1, -1, -1):
            stack.append((*parts[k], shared if k == 0 else -1))
    for k in range(1, len(order)):  # borders between parts of a quicksort step
        if prefixes[k] < 0:
            prefixes[k] = common(strings[order[k - 1]], strings[order[k]])
    return order, prefixes


def repeated_windows(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, most_left: int = LENGTH - ANCHOR) -> list[tuple[int, int, int]]:
    """(member, least shift, largest shift) of the windows of ``length`` that start ``shift`` bytes before the anchor and have a partner.

    ``lefts`` are read backwards from the anchor, ``rights`` forwards with it. All
    windows take in the anchor, so those of a member cover one span of bytes.
    """
    n = len(lefts)
    if n == 2:
        r = common(*rights)
        left = min(common(*lefts), most_left)
        low = max(0, length - r)
        return [(0, low, left), (1, low, left)] if low <= left else []
    r_order, r_prefix = deep_shallow(rights)
    l_order, l_prefix = deep_shallow(lefts)
    turns = {0} | {p + 1 for p in l_prefix[1:]} | {length - p for p in r_prefix[1:]}
    turns = sorted(t for t in turns if 0 <= t <= most_left)
    r_order, l_order, r_prefix, l_prefix = map(np.asarray, (r_order, l_order, r_prefix, l_prefix))
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    # A string may agree with others in its order only as far as it is long enough itself.
    sizes = np.fromiter(map(len, rights), np.int64, n), np.fromiter(map(len, lefts), np.int64, n)
    least, largest = np.full(n, most_left + 1), np.full(n, -1)
    for low, behind in zip(turns, [*turns[1:], most_left + 1]):
        if r_prefix[1:].max(initial=0) < length - low or (low and l_prefix[1:].max(initial=0) < low):
            continue
        r_class[r_order] = np.cumsum(r_prefix < length - low)
        l_class[l_order] = np.cumsum(l_prefix < low) if low else 1
        both = r_class * (n + 2) + l_class
        long_enough = (sizes[0] >= length - low) & (sizes[1] >= low)
        _, inverse, count = np.unique(both[long_enough], return_inverse=True, return_counts=True)
        found = np.flatnonzero(long_enough)[count[inverse] > 1]
        least[found] = np.minimum(least[found], low)
        largest[found] = behind - 1
    return [(i, int(least[i]), int(largest[i])) for i in np.flatnonzero(largest >= 0).tolist()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """``texts`` (key, text) -> (key, spans array<struct<start, stop>>): the bytes that go, for each text that loses any."""
    anchor = min(ANCHOR, max(1, length // 2))
    most_left = length - anchor

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64())]
        names = ["anchor", "c", "d", "key", "back", "ahead", "places"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own: dict[tuple, list[int]] = {}
                for anchor_hash, x in zip(*(v.tolist() for v in anchors_of(data, length, anchor))):
                    back, ahead = min(x, most_left), min(length, len(data) - x)
                    context = xxhash.xxh3_128_digest(data[x - back : x + ahead], back)
                    own.setdefault((anchor_hash, context, back, ahead), []).append(x)
                for (anchor_hash, context, back, ahead), places in own.items():
                    c, d = int.from_bytes(context[:8], "little", signed=True), int.from_bytes(context[8:], "little", signed=True)
                    for column, value in zip(out, (anchor_hash, c, d, key, back, ahead, places)):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    long_texts = texts.filter(F.octet_length("text") >= length)
    anchors = settle(long_texts.mapInArrow(mark, "anchor long, c long, d long, key long, back int, ahead int, places array<long>"))
    at, times = F.struct("key", F.col("places")[0].alias("place")), F.max(F.size("places"))
    twice = (F.col("a") != F.col("b")) | (F.col("times") > 1)
    shared = anchors.groupBy("anchor").agg(F.min(at).alias("a"), F.max(at).alias("b"), times.alias("times")).filter(twice).select("anchor")
    met = sifted(anchors, sieve(checkpointed(shared), "anchor"), "anchor")
    contexts = met.groupBy("anchor", "c", "d", "back", "ahead").agg(F.min(at).alias("a"), F.max(at).alias("b"), times.alias("times"))
    contexts = checkpointed(contexts.select("anchor", "c", "d", "back", "ahead", "a", twice.alias("twice")))
    several = checkpointed(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    firsts = contexts.join(several, "anchor").select("anchor", "c", "d", "n", "a.key", "a.place")
    by_text = checkpointed(firsts.groupBy("key").agg(F.collect_list(F.struct("anchor", "c", "d", "n", "place")).alias("places")))
    held = sifted(long_texts, sieve(by_text, "key"), "key").groupBy("key").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        names = ["anchor", "c", "d", "n", "before", "after"]
        for batch in batches:
            # Places stay in Arrow until their text is at hand; a batch may hold very many.
            lists, texts = batch.column(1), batch.column(0)
            ends, places = lists.offsets.to_pylist(), lists.values
            rows: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                data = texts[i].as_py().encode("utf-8", "surrogatepass")
                own = places.slice(ends[i], ends[i + 1] - ends[i])
                for *told, x in zip(*(own.field(f).to_pylist() for f in ("anchor", "c", "d", "n", "place"))):
                    for column, value in zip(rows, (*told, data[max(0, x - most_left) : x], data[x : x + length])):
                        column.append(value)
                    if len(rows[0]) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=names)
                        rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=names)

    around = held.join(by_text, "key").select("text", "places")
    around = around.mapInArrow(cut, "anchor long, c long, d long, n long, before binary, after binary")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "d", "back", "ahead"]
        found: list[list[int]] = [[] for _ in names]
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                for i, low, high in repeated_windows([g[2][::-1] for g in group], [g[3] for g in group], length, most_left):
                    for column, value in zip(found, (group[i][0], group[i][1], high, length - low)):
                        column.append(value)
            group.clear()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, [pa.int64()] * 2 + [pa.int32()] * 2)], names=names)

        now = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for anchor_hash, *row in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                    if anchor_hash != now:
                        close()
                        now = anchor_hash
                    group.append(tuple(row))
            if len(found[0]) > 10_000:
                yield told()
                found = [[] for _ in names]
        close()
        yield told()

    if several.filter(F.col("n") > wide).isEmpty():
        gathered, spread = around, None
    else:
        around = settle(around)
        gathered, spread = around.filter(F.col("n") <= wide), around.filter(F.col("n") > wide)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = gathered.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(find, "c long, d long, back int, ahead int")
    if spread is not None:
        repeated = repeated.unionByName(counted_windows(spread, length, most_left))
    repeated = checkpointed(repeated.unionByName(contexts.filter("twice").select("c", "d", "back", "ahead")))
    # Each repeated context back to all its places, a list of spans for each text and context.
    members = sifted(anchors, sieve(repeated, "c"), "c").select("c", "d", "key", "places").join(repeated, ["c", "d"])
    span = F.transform("places", lambda p: F.struct((p - F.col("back")).alias("start"), (p + F.col("ahead")).alias("stop")))
    copies = texts.groupBy("key").agg(F.count("*").alias("rows"), F.first(F.octet_length("text")).alias("size"))
    copies = copies.filter((F.col("rows") > 1) & (F.col("size") >= length))
    entire = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    spans = members.select("key", span.alias("some")).unionByName(copies.select("key", entire.alias("some")))
    return spans.groupBy("key").agg(F.flatten(F.collect_set("some")).alias("spans"))


def counted_windows(around: DataFrame, length: int, most_left: int) -> DataFrame:
    """The part of each context of very large groups whose windows occur in another, by counting their hashes for every shift."""
    rows = around.select("anchor", "c", "d", F.length("before").alias("left"), F.concat("before", "after").alias("bytes"))
    rows = rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(most_left))))
    rows = rows.filter((F.col("shift") <= F.col("left")) & (F.length("bytes") - F.col("left") + F.col("shift") >= length))
    window = F.substring("bytes", F.col("left") - F.col("shift") + 1, F.lit(length))
    rows = rows.select("anchor", "shift", "c", "d", F.xxhash64(window).alias("h"), F.xxhash64(window, F.lit(1)).alias("g"))
    many = rows.groupBy("anchor", "shift", "h", "g").count().filter("count > 1").drop("count")
    met = rows.join(many, ["anchor", "shift", "h", "g"]).groupBy("c", "d").agg(F.max("shift").alias("back"), (length - F.min("shift")).alias("ahead"))
    return met.select("c", "d", F.col("back").cast("int"), F.col("ahead").cast("int"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """``docs`` with ``repeats``, a struct for each row: n_bytes, spans (start, stop of what went) and kept (the remaining bytes)."""
    texts = docs.select(text_key(text).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spans = checkpointed(repeated_spans(texts, length, wide))
    columns = [c for c in docs.columns if c != "repeats"]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    rows = docs.select(whole, text_key(text).alias("of"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("bytes"))
    rows = sifted(rows, sieve(spans, "key"), "of", flag="maybe")
    touched = rows.filter("maybe").join(spans, F.col("of") == F.col("key"), "left").select("doc", "bytes", "spans")
    none = F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("spans")
    clean = rows.filter("not maybe").select("doc", "bytes", none)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, own in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                data = value.as_py().encode("utf-8", "surrogatepass")
                gone = merged([(s["start"], s["stop"]) for s in own.as_py() or []])
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else data
                out.append({"n_bytes": len(data), "spans": [{"start": a, "stop": b} for a, b in gone], "kept": kept})
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, kind)], names=[*batch.schema.names[:-2], "repeats"])

    both = touched.unionByName(clean).select(*[F.col(f"doc.`{c}`").alias(c) for c in columns], "bytes", "spans")
    kinds = ", ".join(f"`{c}` {t}" for c, t in both.dtypes[:-2])
    return both.mapInArrow(remove, f"{kinds}, repeats struct<n_bytes: long, spans: array<struct<start: long, stop: long>>, kept: binary>")
