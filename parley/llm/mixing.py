"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a queue in shuffled order. Its virtual
finish time is the number of words its source has sent up to and with it,
divided by the source's target. All queues are sorted together by finish time
and cut at the total budget, so that every source is served in proportion to its
target. A source whose target is above its size goes round again, at most
``max_repeats`` times.

Null texts have no words. Null sources are one source, the last. Documents
without words take part with size 0. Rows that are the same in id and text stand
in the queue as one and share their fate. Empty tables give empty results.

Only the ids of the order, sizes and sources are shuffled, never texts. The sums
before a document are taken in two levels (4,096 parts of every source by the
first letters of the order key), so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import WORD, checkpointed


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def turn_key(doc_id: Column, text: Column) -> Column:
    """The place in the shuffled order: the same on every run."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, source_size) -> with ``target``: shares of the total by weight, none above ``max_repeats`` sizes.

    One row for each source. Sources are sorted by the share at which they are
    full; up to the first that is not full at the level the others leave, all are.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("most", max_repeats * F.col("source_size"))
    ranked = ranked.withColumn("full_at", F.col("most") / F.col("weight"))
    by_full = W.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("most").over(by_full.rowsBetween(W.unboundedPreceding, 0)) - F.col("most"))
    after = F.sum("weight").over(by_full.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", left / after)
    level = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, source and any further columns) with ``mix``, a struct of the decision for each row:
    size, source_size, target, copies (how often the mix takes the row), taken (copies times size)."""
    spark = docs.sparkSession
    turn = turn_key(F.col("doc_id"), F.col("text"))
    lines = docs.select("source", word_count(F.col("text")).alias("size"), turn.alias("turn"))
    lines = lines.groupBy("source", "turn", "size").agg(F.count("*").alias("rows"))
    lines = checkpointed(lines.select("source", "turn", (F.col("size") * F.col("rows")).alias("size")))
    sizes = lines.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, max_repeats))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    part = F.substring("turn", 1, 3)
    sums = lines.groupBy("source", part.alias("part")).agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(W.partitionBy("source").orderBy("part")) - F.col("sum")
    sums = sums.select(F.col("source").alias("of"), F.col("part").alias("at"), before.alias("before"))
    within = F.sum("size").over(W.partitionBy("source", "part").orderBy("turn"))
    queue = lines.withColumn("part", part).withColumn("within", within)
    queue = queue.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    queue = queue.join(
        targets.withColumnRenamed("source", "of_target"), F.col("source").eqNullSafe(F.col("of_target"))
    ).filter("target > 0")
    sent = F.col("round") * F.col("source_size") + F.col("before") + F.col("within")
    queue = (
        queue.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long"))))
        .withColumn("sent", sent)
        .filter(F.col("sent") - F.col("size") < F.col("target"))  # the others start after their source is served
        .select("source", "round", "turn", "size", (F.col("sent") / F.col("target")).alias("finish"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queue = queue.repartitionByRange(parts, "finish", F.col("source").asc_nulls_last(), "round", "turn")
    queue = checkpointed(queue.withColumn("slice", F.spark_partition_id()))
    slices = queue.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    start = F.sum("slice_size").over(W.orderBy("slice")) - F.col("slice_size")
    slices = slices.select("slice", "slice_size", start.alias("start"))  # one row for each partition
    queue = queue.join(F.broadcast(slices), "slice").filter(F.col("start") <= budget)
    in_slice = W.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "round", "turn")
    whole = queue.filter(F.col("start") + F.col("slice_size") <= budget).drop("slice_size")
    cut = queue.filter(F.col("start") + F.col("slice_size") > budget)
    cut = cut.filter(F.col("start") <= budget).withColumn("run", F.col("start") + F.sum("size").over(in_slice))
    served = whole.select("source", "round", "turn").unionByName(cut.filter(F.col("run") <= budget).select("source", "round", "turn"))
    last = served.groupBy("source").agg(F.max(F.struct("round", "turn")).alias("last"))
    plan = targets.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    plan = checkpointed(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "last"))

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    row = row.select(
        "doc",
        F.col("doc.source").alias("doc_source"),
        word_count(F.col("doc.text")).alias("size"),
        turn_key(F.col("doc.doc_id"), F.col("doc.text")).alias("turn"),
    )
    row = row.join(plan, F.col("doc_source").eqNullSafe(F.col("plan_source")), "left")
    copies = F.coalesce(F.col("last.round") + (F.col("turn") <= F.col("last.turn")).cast("long"), F.lit(0).cast("long"))
    decided = F.struct("size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    kept = [c for c in docs.columns if c != "mix"]
    return row.select(*[F.col(f"doc.`{c}`").alias(c) for c in kept], decided.alias("mix"))
