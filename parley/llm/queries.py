"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm import chat_format, fingerprints, hard_negatives, html_text, language_id, line_dedup, lm_scoring, mixing, near_dedup, packing, prefix_trie, suffix_dedup, topk
from parley.llm.common import read, remainder
from parley.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", "near.class_id", "near.keep")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = language_id.learn(docs.filter(~F.col("held_out")).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "repeats.*")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    spans = F.size("spans").cast("long").alias("n_spans")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), spans, F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 1).withColumn("trains", ~F.col("held_out"))
    return lm_scoring.score(docs, "text", "trains")


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    table = fingerprints.lexicon(docs)
    pairs = fingerprints.with_next(docs).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited"), 256)})
    texts = {"fingerprint": F.col("text"), "edited_fingerprint": F.col("edited")}
    prints = fingerprints.with_fingerprints(pairs, texts, table).drop("text", "next_text", "edited")
    following = F.lead("fingerprint").over(W.partitionBy("home").orderBy("place"))
    prints = prints.withColumn("next_fingerprint", F.coalesce(following, F.col("fingerprint"))).filter(~F.col("guest"))
    near = lambda c: fingerprints.likeness(F.col("fingerprint"), F.col(c))
    prints = prints.withColumns({"near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint")})
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_kept", "text")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat_format.digests(chat_format.windows(turns.unionByName(extra)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.hashed(read(spark, sf_dir, "conversations"))
    convs = turns.select("conv_id").distinct()
    taken = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), remainder(F.col("conv_id"), 4).alias("h"))
    heads = turns.filter("place < 3").withColumnRenamed("conv_id", "base")
    shared = taken.join(heads, "base").filter("place < h").select("conv_id", "place", "content", "words")
    own = turns.filter(F.col("place") >= remainder(F.col("conv_id"), 4))
    return prefix_trie.nodes(shared.unionByName(own), convs)


def llm_queries() -> dict[str, Query]:
    own = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def llm_sql() -> dict[str, str]:
    return dict(SQL)
