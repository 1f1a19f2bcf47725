"""Model calls in batches: embeddings and chat answers.

The model comes from the caller as a function that builds it; it is built once
per Python worker. Spark partitions the rows and passes them as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, FloatType

from parley.constants import MAX_TOKENS_PER_TEXT, NORM_FLOOR
from parley.functions.text import WHITESPACE

Predict = Callable[[np.ndarray], np.ndarray]


def encode_texts(text: Column, make_predict: Callable[[], Predict], batch_size: int = 256) -> Column:
    """One vector per text from a batch model."""
    return predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )(text)


def pooled(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean and L2 normalisation of (batch, token, dimension) model output."""
    weights = mask[:, :, None].astype(np.float32)
    mean = (token_vectors * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), NORM_FLOOR)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), NORM_FLOOR)


def onnx_encoder(
    model_path: str, tokenizer_path: str, max_length: int = MAX_TOKENS_PER_TEXT
) -> Callable[[], Predict]:
    """Encoder from an exported sentence model and its tokenizer file.

    Both paths must be readable on every executor, on shared storage or shipped
    with the job.
    """

    def make() -> Predict:
        from onnxruntime import InferenceSession
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_length=max_length)
        tokenizer.enable_padding(length=None)
        session = InferenceSession(model_path, providers=["CPUExecutionProvider"])
        wanted = {i.name for i in session.get_inputs()}

        def predict(texts: np.ndarray) -> np.ndarray:
            batch = tokenizer.encode_batch([str(t) for t in texts.ravel()])
            ids = np.array([e.ids for e in batch], dtype=np.int64)
            mask = np.array([e.attention_mask for e in batch], dtype=np.int64)
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return pooled(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], mask)

        return predict

    return make


def arithmetic_encoder(dims: int = 16, max_length: int = MAX_TOKENS_PER_TEXT) -> Callable[[], Predict]:
    """A stand-in for a model: token vectors follow from the letters of the token.

    Good enough to check batching, pooling and normalising without model files.
    """

    def make() -> Predict:
        steps = np.arange(1, dims + 1, dtype=np.int64)

        def code(token: str) -> int:
            return ord(token[0]) * 31 + ord(token[-1]) * 7 + len(token)

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((texts.size, dims), dtype=np.float64)
            for row, text in enumerate(texts.ravel()):
                tokens = [t for t in str(text).strip(WHITESPACE).split() if t][:max_length]
                if tokens:
                    codes = np.array([code(t) for t in tokens], dtype=np.int64)
                    out[row] = (np.outer(codes, steps) % 97 / 97.0 - 0.5).mean(axis=0)
            length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), NORM_FLOOR)
            return (out / length).astype(np.float32)

        return predict

    return make


Generate = Callable[[pd.DataFrame], pd.DataFrame]


def generate_completions(requests: DataFrame, make_generate: Callable[[], Generate], schema: str) -> DataFrame:
    """Apply a chat backend to every request, one Arrow batch at a time.

    ``make_generate`` builds the backend; it takes and returns a batch and must
    keep a row for each request. Nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generate()
        for batch in batches:
            yield generate(batch)

    return requests.mapInPandas(run, schema)


def echo_backend() -> Callable[[], Generate]:
    """A stand-in for a chat model that thinks aloud and repeats the prompt."""

    def make() -> Generate:
        def generate(batch: pd.DataFrame) -> pd.DataFrame:
            prompt = batch["prompt"].fillna("")
            return pd.DataFrame(
                {
                    "request_id": batch["request_id"],
                    "content": "<think>" + prompt.str.len().astype(str) + " characters</think>\n\n" + prompt,
                    "finish_reason": "stop",
                }
            )

        return generate

    return make
