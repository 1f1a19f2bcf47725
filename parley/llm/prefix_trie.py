"""The trie of conversations by their turns, with statistics of each node's conversations and subtree.

A conversation is cut into blocks of ``BLOCK`` turns, and each block's digest continues the
digest of all blocks before it, so equal digests mean equal beginnings. Conversations are
grouped by (digest of what came before, block) first: a group of copies, or a beginning that a
third of all conversations share, is one row for each block after Spark's partial sums. Only
where such a beginning goes on in several ways are its different blocks taken apart into
turns and their common beginnings summed; a block that has no sibling gives its nodes as it is.

Sums over whole subtrees need no walk. A node belongs to its smallest member, and a
conversation that owns a node owns all nodes behind it on its path. So the nodes that a
conversation does not own are its first ones; with their words, ``skipped``, each member but the
smallest saves in a node's subtree its skipped words less those before the node. Leaves
are counted by their owners. Both are sums over members, made like the number of members.

A turn is its role and text, null as empty, told by 128 bits of SHA-256; texts never leave the scan. Ties of ``turn`` go by
that digest; repeated rows count each. Rows without a ``conv_id`` are in no conversation. A
conversation without turns ends in the root; an empty table has no nodes, not even a
root. Extra columns may have any name; they are not read. Chains of digests and the lists of those that end
in a node are made in one pass over sorted narrow rows, in memory that does not grow with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import settle, words_in

BLOCK = 4
WIDTH = 16
ROOT = bytes(WIDTH)


def _short(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 2 * WIDTH))


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, content, words) of turns (conv_id, turn, role, text): ``place`` counts from 0, ``content`` tells role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.size(words_in(text)).cast("long").alias("words")
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "content")) - 1
    return rows.withColumn("place", place.cast("long")).select("conv_id", "place", "content", "words")


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, level, chain, block, words, before, ended): ``chain`` tells all turns before the block, ``block`` holds the
    contents of its turns, ``before`` the words of all earlier turns; ``ended`` marks the last block of a conversation."""
    names = ["conv_id", "level", "chain", "block", "words", "before", "ended"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, level, behind, contents, words, before = None, 0, ROOT, [], [], 0

        def close(ended: bool) -> None:
            made.append((conv, level, behind, b"".join(contents), words, before, ended))

        for batch in batches:
            for key, content, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != conv:
                    if contents:
                        close(ended=True)
                    conv, level, behind, contents, words, before = key, 0, ROOT, [], [], 0
                elif len(contents) == size:
                    close(ended=False)
                    behind = hashlib.sha256(behind + b"".join(contents)).digest()[:WIDTH]
                    before, level, contents, words = before + sum(words), level + 1, [], []
                contents.append(content)
                words.append(n)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)
                made = []
        if contents:
            close(ended=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "content", "words")
    return ordered.mapInArrow(chain, "conv_id long, level long, chain binary, block binary, words array<long>, before long, ended boolean")


def _key(turns: int | Column | None = None) -> Column:
    """The key of the node behind the first ``turns`` turns of a block, all of them unless given."""
    part = F.col("block") if turns is None else F.substring("block", F.lit(1), turns * WIDTH)
    return _short(F.concat("chain", part))


NODE = ["key", "parent", "depth", "before"]


def _rolled(members: DataFrame, values: list[str], size: int) -> DataFrame:
    """Nodes below the root with their smallest member, its own ``values`` (as ``own_...``), how many members, and the members' sums.

    ``members``: blocks of conversations, with the values of the conversation."""
    kind = ["chain", "block", "level", "words", "before"]

    def summed(count: Column, own: str) -> list[Column]:
        least = [F.min_by(f"{own}{v}", "conv_id").alias(f"own_{v}") for v in values]
        return [count.alias("n_convs"), *least, *(F.sum(v).alias(v) for v in values), F.min("conv_id").alias("conv_id")]

    grouped = members.groupBy(*kind).agg(*summed(F.count("*"), ""))
    siblings = grouped.groupBy("chain").agg(F.count("*").alias("kinds"))
    marked = grouped.join(siblings, "chain").withColumn("j", F.explode(F.sequence(F.lit(1), F.size("words"))))
    earlier = F.aggregate(F.slice("words", F.lit(1), F.col("j") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    # The key of the node above is this one's of one turn less; behind a whole block it is the chain itself.
    apart = marked.select(
        "kinds", _key(F.col("j")).alias("key"), F.when(F.col("j") == 1, F.col("chain")).otherwise(_key(F.col("j") - 1)).alias("parent"),
        (F.col("level") * size + F.col("j")).alias("depth"), (F.col("before") + earlier).alias("before"), "n_convs", *(f"own_{v}" for v in values), *values, "conv_id",
    )
    alone = apart.filter("kinds = 1").drop("kinds")
    split = apart.filter("kinds > 1").groupBy(*NODE).agg(*summed(F.sum("n_convs"), "own_"))
    return alone.unionByName(split)


def _end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the comma-joined ids of the conversations that end in a node, in numerical order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), pa.string()])], names=["key", "ends_sha256"])

        for batch in batches:
            rows = []
            for key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        rows.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if rows:
                yield out(rows)
        if now is not None:
            yield out([(now, digest.hexdigest())])

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "conv_id").mapInArrow(read, "key binary, ends_sha256 string")


def nodes(rows: DataFrame, conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """``rows`` as ``hashed`` gives them (``place`` may leave gaps), ``conversations``: (conv_id), each once, those without
    turns included. Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    cut = settle(blocks(rows, size))
    total = F.col("before") + F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    ends = cut.filter("ended").select("conv_id", _key().alias("key"), total.alias("total"))
    whole = conversations.select("conv_id").join(ends, "conv_id", "left").select(
        "conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"), F.coalesce("total", F.lit(0)).alias("total")
    )

    def with_root(below: DataFrame, of: DataFrame, values: list[str]) -> DataFrame:
        tops = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")]
        for v in values:
            tops += [F.sum(v).alias(v), F.min_by(v, "conv_id").alias(f"own_{v}")]
        root = of.agg(*tops).filter("n_convs > 0").withColumns(
            {"key": F.lit(ROOT), "parent": F.lit(None).cast("binary"), "depth": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}
        )
        return below.unionByName(root)

    first = with_root(_rolled(cut, [], size), conversations, [])
    first = settle(first.select("key", "parent", "depth", "before", "conv_id"))
    children = first.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    owned = first.join(children, "key", "left").groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("skipped"), F.max(F.col("n_children").isNull().cast("long")).alias("n_leaves")
    )
    told = whole.join(owned, "conv_id", "left").select(
        "conv_id", "key", F.coalesce("skipped", "total").alias("skipped"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves")
    )
    values = ["skipped", "n_leaves"]
    rolled = with_root(_rolled(cut.drop("ended").join(told.drop("key"), "conv_id"), values, size), told, values)
    above = first.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("skipped") - F.col("own_skipped") - (F.col("n_convs") - 1) * F.col("before")
    return (
        rolled.join(children, "key", "left")
        .join(above, "parent", "left")
        .join(_end_lists(told.select("key", "conv_id")), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
            saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
