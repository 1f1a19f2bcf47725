"""Links between similar things: buckets, verified pairs, classes.

An item is known by a 64-bit id. Items that share a bucket are candidates. A bucket
is never expanded into all pairs. Every member is first compared with a few
representatives of its bucket, those that share most buckets with others; linked
items form classes. Of what is no representative then only pairs of different classes
are open. In a bucket of up to ``SMALL`` open members those outside its largest class
meet all members of other classes. In a larger one both sides are dealt into blocks of
bounded size, and each pair of blocks is one cell of a group of its own: an inverted
index of their features finds every link between different classes, and leaves out
only what cannot be one. So items that share a bucket and are similar enough always are
in one class, however large the bucket is, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import checkpointed, parts_for, settle

SLOTS, WORD_BITS = 1 << 24, 64
REPRESENTATIVES = 6
#: Open members that a bucket may have for its loose members to meet all others as pairs of rows; larger ones go by blocks.
SMALL = 32
#: About how many members and characters of text a block has.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
#: About how many edges of the graph of links a task holds.
PART_EDGES = 20_000


def sieve(ids: DataFrame, column: str = "id") -> DataFrame:
    """(_sieve_word, _sieve_bits): 2^24 bits, at most 262,144 rows whatever the number of ids, set where an id falls."""
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")
    rows = ids.select(slot.alias("slot"))
    mask = F.expr(f"shiftleft(1L, slot % {WORD_BITS})")
    return rows.groupBy((F.col("slot") / WORD_BITS).cast("int").alias("_sieve_word")).agg(F.bit_or(mask).alias("_sieve_bits"))


def sifted(rows: DataFrame, words: DataFrame, column: str = "id", flag: str | None = None) -> DataFrame:
    """The rows whose id may be among those of the sieve; with ``flag``, all rows and that as a column. Nothing is shuffled."""
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")
    rows = rows.withColumn("_sieve_slot", slot).withColumn("_sieve_at", (F.col("_sieve_slot") / WORD_BITS).cast("int"))
    hit = F.coalesce(F.expr(f"(shiftright(_sieve_bits, _sieve_slot % {WORD_BITS}) & 1) = 1"), F.lit(False))
    met = rows.join(F.broadcast(words), F.col("_sieve_at") == F.col("_sieve_word"), "left")
    met = met.withColumn(flag, hit) if flag else met.filter(hit)
    return met.drop("_sieve_slot", "_sieve_at", "_sieve_word", "_sieve_bits")


def classes(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): every linked id with the smallest id of its class.

    Distributed union-find by turns of large and small stars. Stars of any size
    are cut down by a minimum per node, which combines before the shuffle. It ends as soon
    as all edges lead from a node that has one edge to one that has none. Edges stand in as
    many parts as their number asks for, so that the driver keeps account of few tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("end"))
        ends = ends.groupBy("end.id").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
        rows, between = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up")))).first()
        parts = parts_for(rows, PART_EDGES)
        edges = edges.coalesce(parts)
        if not between:
            break
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = checkpointed(edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))).coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: (ids a, texts a, ids b, texts b) -> similarity of each pair
Compare = Callable[[list, list, list, list], list[float]]
#: text -> sorted hashes of its distinct features, and their weights
Features = Callable[[str], tuple[np.ndarray, np.ndarray]]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of smaller over sum of larger weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def compared(pairs: DataFrame, payload: DataFrame, compare: Compare) -> DataFrame:
    """The pairs (a, b) with their ``similarity``. ``payload``: (id, text), one row for each id. Pairs of one b come one after the other."""
    left = payload.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = payload.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ta, b, tb = (batch.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(compare(a, ta, b, tb), pa.float64())], names=["a", "b", "similarity"]
            )

    return met.mapInArrow(run, "a long, b long, similarity double")


def cached(of: Callable, most: int = 1000) -> Callable:
    """``of(text)`` remembered by id; for use inside a task."""
    ready: dict = {}

    def get(i: int, text: str):
        if i not in ready:
            if len(ready) >= most:
                ready.clear()
            ready[i] = of(text)
        return ready[i]

    return get


def links_of_cell(ids: list, roots: list, texts: list, asks: np.ndarray, told: np.ndarray, loose: np.ndarray, features: Features, least: float) -> list[tuple[int, int]]:
    """Links between different classes of one cell, as many as join them: of each item that ``asks`` with those that are ``told``.

    Overlap is bounded by what an item shares with any other of the cell, so most pairs that are no links are never counted.
    """
    made = [features(t) for t in texts]
    size = np.array([w.sum() for _, w in made])
    length = np.fromiter((len(h) for h, _ in made), np.int64, len(made))
    owner, weight = np.repeat(np.arange(len(made)), length), np.concatenate([w for _, w in made]).astype(float)
    _, word, held = np.unique(np.concatenate([h for h, _ in made]), return_inverse=True, return_counts=True)
    shared = np.bincount(owner[held[word] > 1], weight[held[word] > 1], len(made))
    order = np.argsort(word, kind="stable")
    posting, posting_weight = owner[order], weight[order]
    ends, starts = np.cumsum(held), np.cumsum(length) - length
    label = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    number = np.array(ids, np.int64)
    out = []
    for q in np.flatnonzero(asks).tolist():
        # Two that both ask are compared once.
        may = told & (label != label[q]) & (~loose | (number < number[q]))
        may &= np.minimum(shared[q], shared) * (1 + 1e-9) >= least / (1 + least) * (size[q] + size)
        if not may.any():
            continue
        words, own = word[starts[q] : starts[q] + length[q]], weight[starts[q] : starts[q] + length[q]]
        n = held[words]
        at = np.repeat(ends[words] - np.cumsum(n), n) + np.arange(n.sum())
        low = np.bincount(posting[at], np.minimum(posting_weight[at], np.repeat(own, n)), len(made))
        found = np.flatnonzero(may & (low >= (least - 1e-9) * (size[q] + size - low)))
        for y in found[np.argsort(-low[found], kind="stable")].tolist():
            if label[y] != label[q] and similarity(made[q], made[y]) >= least:
                label[label == label[y]] = label[q]
                out.append((ids[q], ids[y]))
    return out


def met_in_blocks(open_: DataFrame, payload: DataFrame, features: Features, least: float) -> DataFrame:
    """Links (a, b) that join different classes of a bucket. ``open_``: (bucket, id, root, loose); every loose member meets all of other classes."""
    rows = open_.join(payload.select("id", "text"), "id").withColumn("chars", F.length("text").cast("long"))
    blocks = lambda when: F.ceil(F.greatest(F.sum(when.cast("long")) / BLOCK_ROWS, F.sum(F.when(when, F.col("chars")).otherwise(0)) / BLOCK_CHARS))
    sizes = rows.groupBy("bucket").agg(blocks(F.col("loose")).cast("int").alias("n_asking"), blocks(F.lit(True)).cast("int").alias("n_told"))
    rows = rows.join(sizes, "bucket")
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "id", "root", "loose", "text"]
    asking = rows.filter("loose").withColumn("i", own("n_asking", 17)).select(*columns, "i", each("n_told").alias("j"), F.lit(True).alias("asks"))
    told = rows.withColumn("j", own("n_told", 19)).select(*columns, each("n_asking").alias("i"), "j", F.lit(False).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        ids, roots, texts = (table.column(c).to_pylist() for c in ("id", "root", "text"))
        asks, loose = (table.column(c).to_numpy() for c in ("asks", "loose"))
        at = {}  # an item that asks and is told stands once
        for k, i in enumerate(ids):
            at.setdefault(i, []).append(k)
        first = [k[0] for k in at.values()]
        asking = np.array([any(asks[k] for k in ks) for ks in at.values()], bool)
        told = np.array([not all(asks[k] for k in ks) for ks in at.values()], bool)
        found = links_of_cell(list(at), [roots[k] for k in first], [texts[k] for k in first], asking, told, loose[first], features, least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return asking.unionByName(told).groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long")


def find_links(members: DataFrame, texts: Callable[[DataFrame], DataFrame], compare: Compare, features: Features, least: float) -> DataFrame:
    """Links (a, b) between items that share a bucket and are at least ``least`` similar: all that it takes to join what such pairs join.

    ``members``: (bucket, id), distinct and cheap to read twice. ``texts(ids)`` gives (id, text) of the ids asked for.
    ``compare`` gives the ``similarity`` of the ``features`` of texts.
    """
    heads = settle(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = settle(sifted(members, sieve(heads, "bucket"), "bucket").join(heads, "bucket"))
    known = settle(shared.groupBy("id").agg(F.sum("n").alias("met")))
    payload = settle(texts(known.select("id")))
    # Of each of REPRESENTATIVES hash classes the member that meets most others; the state of a bucket stays small.
    kind = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(REPRESENTATIVES))
    order = F.shiftleft(F.least("met", F.lit((1 << 31) - 1)), 32) + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 32))
    ordered = shared.join(known, "id").select("bucket", "id", kind.alias("kind"), order.alias("order"))
    others = [F.max_by("id", F.when(F.col("kind") == i, F.col("order"))) for i in range(REPRESENTATIVES)]
    reps = ordered.groupBy("bucket").agg(F.array_compact(F.array(*others)).alias("reps"))
    shared = settle(shared.join(reps, "bucket"))
    star = shared.select("id", F.explode("reps").alias("rep")).filter("id <> rep")
    star = star.select(F.greatest("id", "rep").alias("a"), F.least("id", "rep").alias("b")).distinct()
    first = checkpointed(compared(star, payload, compare).filter(F.col("similarity") >= least).select("a", "b"))

    # Representatives have met all of their bucket.
    held = shared.filter((F.col("n") > 2) & ~F.array_contains("reps", F.col("id"))).select("bucket", "id")
    held = held.join(classes(first), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = held.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    main = sizes.groupBy("bucket").agg(F.max_by("root", "of_root").alias("main"), F.count("*").alias("kinds"), F.sum("of_root").alias("n")).filter("kinds > 1")
    mixed = settle(held.join(main, "bucket").select("bucket", "id", "root", (F.col("root") != F.col("main")).alias("loose"), "n"))
    few = mixed.filter(F.col("n") <= SMALL)
    x = few.filter("loose").select("bucket", F.col("id").alias("x"), F.col("root").alias("xr"))
    y = few.select("bucket", F.col("id").alias("y"), F.col("root").alias("yr"), "loose")
    pairs = x.join(y, "bucket").filter((F.col("xr") != F.col("yr")) & (~F.col("loose") | (F.col("x") > F.col("y"))))
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    second = checkpointed(compared(pairs, payload, compare).filter(F.col("similarity") >= least).select("a", "b"))
    third = checkpointed(met_in_blocks(mixed.filter(F.col("n") > SMALL).drop("n"), payload, features, least))
    return first.unionByName(second).unionByName(third)
