"""Queries over texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import words
from parley.operators import embeddings as V
from parley.operators.inference import arithmetic_encoder, encode_texts
from parley.plans.derive import SQL_SPACE, WS, table
from parley.plans.registry import query

_WORDS = f"CASE WHEN trim(text, '{WS}') = '' THEN [] ELSE regexp_split_to_array(trim(text, '{WS}'), '{SQL_SPACE}+') END"


@query(
    "token_truncation",
    f"""SELECT doc_id, least(n, 256)::BIGINT AS kept, greatest(n - 256, 0)::BIGINT AS cut, md5(array_to_string(l[1:256], ' ')) AS kept_hash,
     256::BIGINT AS mask_width, least(n, 256)::BIGINT AS mask_ones
     FROM (SELECT doc_id, l, len(l) AS n FROM (SELECT doc_id, {_WORDS} AS l FROM documents))""",
)
def token_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("all"))
    kept = tokens.withColumn("tokens", V.truncate_tokens(F.col("all"))).withColumn(
        "mask", V.attention_mask(F.col("tokens"), 256)
    )
    return kept.select(
        "doc_id",
        F.size("tokens").cast("long").alias("kept"),
        (F.size("all") - F.size("tokens")).cast("long").alias("cut"),
        F.md5(F.array_join("tokens", " ")).alias("kept_hash"),
        F.size("mask").cast("long").alias("mask_width"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m).alias("mask_ones"),
    )


@query(
    "mean_pooling",
    """SELECT doc, dim::BIGINT AS dim, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS v FROM (
      SELECT vec_id // 5 AS doc, CASE WHEN vec_id % 5 < 3 AND vec_id % 35 < 30 THEN 1 ELSE 0 END AS m,
       unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY doc, dim""",
)
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("doc"),
        F.expr("CASE WHEN vec_id % 5 < 3 AND vec_id % 35 < 30 THEN 1 ELSE 0 END").alias("mask"),
        F.col("embedding").alias("vec"),
    )
    pooled = V.mean_pool(tokens, "doc", "vec", "mask")
    return pooled.select("doc", F.posexplode("vec").alias("dim", "v")).select(
        "doc", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v")
    )


@query(
    "l2_normalisation",
    """SELECT vec_id, dim::BIGINT AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-9), 6) + 0.0 AS v FROM (
      SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE * (vec_id % 7) AS x FROM embeddings)""",
)
def l2_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every seventh vector is the zero vector.
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)).alias("vec")
    )
    unit = scaled.select("vec_id", F.posexplode(V.l2_normalise(F.col("vec"))).alias("dim", "v"))
    return unit.select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + 0.0).alias("v"))


_ENCODED_SQL = f"""tokens AS (
 SELECT doc_id, unnest(l[1:256]) AS t FROM (SELECT doc_id, {_WORDS} AS l FROM documents)),
codes AS (SELECT doc_id, unicode(t) * 31 + unicode(right(t, 1)) * 7 + length(t) AS c FROM tokens),
means AS (SELECT doc_id, d, avg((c * d) % 97 / 97.0::DOUBLE - 0.5) AS x
 FROM (SELECT doc_id, c, unnest(range(1, 17)) AS d FROM codes) GROUP BY doc_id, d),
vectors AS (SELECT doc_id, d - 1 AS dim, CAST(CAST(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-9) AS FLOAT) AS DOUBLE) AS v FROM means)"""


@query(
    "batch_encoding",
    f"""WITH {_ENCODED_SQL} SELECT documents.doc_id, 16::BIGINT AS dims, round(coalesce(sum(v * v), 0), 4) AS squared_length,
     round(coalesce(sum(v * (dim + 1)), 0), 3) AS weighted FROM documents LEFT JOIN vectors USING (doc_id) GROUP BY documents.doc_id""",
)
def batch_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "documents").select(
        "doc_id", encode_texts(F.col("text"), arithmetic_encoder(), 256).alias("vec")
    )
    long = vectors.select("doc_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy("doc_id").agg(
        F.count("*").alias("dims"),
        F.round(F.sum(F.col("v") * F.col("v")), 4).alias("squared_length"),
        F.round(F.sum(F.col("v") * (F.col("dim") + 1)), 3).alias("weighted"),
    )


@query(
    "embedding_response",
    f"""WITH inputs AS (
      SELECT doc_id AS request_id, unnest(CASE doc_id % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 1, 2] ELSE [] END) AS index,
       unnest(CASE doc_id % 3 WHEN 0 THEN [text] WHEN 1 THEN [text, '', lang] ELSE [] END) AS text FROM documents),
     codes AS (SELECT request_id, index, unicode(w) * 31 + unicode(right(w, 1)) * 7 + length(w) AS c
      FROM (SELECT request_id, index, unnest(l[1:256]) AS w FROM (SELECT request_id, index, {_WORDS} AS l FROM inputs))),
     places AS (SELECT request_id, index, c % 16 AS dim, sum(1 - c // 16 % 2 * 2)::DOUBLE AS v FROM codes GROUP BY ALL),
     lengths AS (SELECT request_id, index, sqrt(sum(v * v)) AS n FROM places GROUP BY ALL)
     SELECT i.request_id, i.index::BIGINT AS index, 'served' AS model, d.dim::BIGINT AS dim,
      round(CAST(coalesce(p.v, 0) / greatest(coalesce(l.n, 0), 1e-9) AS FLOAT)::DOUBLE, 5) + 0.0 AS v
     FROM inputs i CROSS JOIN (SELECT unnest(range(16)) AS dim) d
     LEFT JOIN places p ON p.request_id = i.request_id AND p.index = i.index AND p.dim = d.dim
     LEFT JOIN lengths l ON l.request_id = i.request_id AND l.index = i.index""",
)
def embedding_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.plans.request_queries import _embedding_requests

    texts = V.indexed_inputs(_embedding_requests(spark, sf_dir))
    rows = V.embedding_response(texts.withColumn("embedding", V.hashing_vector(F.col("text"))), "served")
    long = rows.select("request_id", F.col("index").cast("long").alias("index"), "model", F.posexplode("embedding").alias("dim", "v"))
    return long.withColumns({"dim": F.col("dim").cast("long"), "v": F.round(F.col("v").cast("double"), 5) + 0.0})
