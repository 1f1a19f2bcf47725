"""Embedding rows: truncate, pool, normalise, number."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import MAX_TOKENS_PER_TEXT, NORM_FLOOR
from parley.functions.text import words


def truncate_tokens(tokens: Column, max_length: int = MAX_TOKENS_PER_TEXT) -> Column:
    return F.slice(tokens, 1, max_length)


def attention_mask(tokens: Column, width: int | Column) -> Column:
    """Ones for tokens, zeros up to ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(w - F.size(tokens), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), missing))


def mean_pool(token_vectors: DataFrame, key: str, vector: str, mask: str, floor: float = NORM_FLOOR) -> DataFrame:
    """Masked mean of the token vectors of each key, as ``array<double>``.

    Whole vectors are summed in the JVM and combine before the shuffle, so a key with very many tokens sends one row
    for each task. Vectors of a key must be of one length; a null mask counts as 0, a null component as 0.
    """
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    scaled = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * F.col("_weight"))
    rows = token_vectors.where(F.size(vector) > 0).select(key, weight.alias("_weight"), vector)
    # Weights are in the vectors: a summary of nothing but zero weights would have no sum.
    sums = rows.groupBy(key).agg(Summarizer.sum(array_to_vector(scaled)).alias("_sum"), F.sum("_weight").alias("_total"))
    return sums.select(key, F.transform(vector_to_array("_sum"), lambda v: v / F.greatest(F.col("_total"), F.lit(floor))).alias(vector))


def hashing_vector(text: Column, dims: int = 16, max_length: int = MAX_TOKENS_PER_TEXT) -> Column:
    """A text's unit vector without a model: each word adds 1 or -1 to the place that its first and last letters and its length choose."""
    from parley.functions.text import bind

    def code(w: Column) -> Column:
        return (F.ascii(w) * 31 + F.ascii(F.right(w, F.lit(1))) * 7 + F.length(w)).cast("long")

    def sums(codes: Column) -> Column:
        def place(d: Column) -> Column:
            return F.aggregate(F.filter(codes, lambda c: c % dims == d), F.lit(0.0), lambda n, c: n + 1 - F.floor(c / dims) % 2 * 2)

        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), place)

    return l2_normalise(bind(F.transform(truncate_tokens(words(text), max_length), code), sums))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalise(vector: Column, floor: float = NORM_FLOOR) -> Column:
    """Vector divided by its length; the zero vector stays zero."""
    from parley.functions.text import bind

    return bind(
        F.greatest(norm(vector), F.lit(floor)),
        lambda n: F.transform(vector, lambda x: x.cast("double") / n),
    )


def indexed_inputs(requests: DataFrame, inputs: str = "input") -> DataFrame:
    """One row per input text with its ordinal; an empty list gives no row."""
    return requests.select("request_id", F.posexplode(inputs).alias("index", "text"))


def embedding_response(vectors: DataFrame, model_id: str) -> DataFrame:
    """Response rows; the model is the one configured, whatever the request named."""
    return vectors.select(
        "request_id",
        F.col("index").cast("int").alias("index"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.lit(model_id).alias("model"),
    )


def embedding_attributes(requests: DataFrame, inputs: str = "input") -> DataFrame:
    """What an embedding span says about its request; no output count for no input."""
    count = F.size(inputs).cast("long")
    return requests.withColumns(
        {
            "input_count": count,
            "input_content_length": F.aggregate(inputs, F.lit(0).cast("long"), lambda n, t: n + F.length(t)),
            "output_count": F.nullif(count, F.lit(0).cast("long")),
        }
    )
