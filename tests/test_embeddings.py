import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import embeddings as V
from parley.operators.inference import (
    arithmetic_encoder,
    echo_backend,
    encode_texts,
    generate_completions,
    onnx_encoder,
    pooled,
)


def test_mean_pool_and_norm_like_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for doc in range(20):
        n = 3000 if doc == 0 else int(rng.integers(1, 9))
        vecs, mask = rng.normal(size=(n, 8)), rng.integers(0, 2, size=n)
        if doc == 1:
            mask[:] = 0
        want[doc] = (vecs * mask[:, None]).sum(axis=0) / max(mask.sum(), 1e-9)
        rows += [(doc, v.tolist(), int(m)) for v, m in zip(vecs, mask)]
    df = spark.createDataFrame(rows, "doc int, vec array<double>, mask int")
    out = V.mean_pool(df, "doc", "vec", "mask")
    for r in out.select("doc", "vec", V.l2_normalise(F.col("vec")).alias("unit")).collect():
        assert np.allclose(r.vec, want[r.doc])
        assert np.allclose(r.unit, want[r.doc] / max(np.linalg.norm(want[r.doc]), 1e-9))


def test_truncate_and_mask(spark):
    df = spark.createDataFrame([([str(i) for i in range(300)],), (["a"],), ([],)], "t array<string>")
    rows = df.select(V.truncate_tokens(F.col("t")).alias("k")).select("k", V.attention_mask(F.col("k"), 256).alias("m")).collect()
    assert [len(r.k) for r in rows] == [256, 1, 0] and all(len(r.m) == 256 for r in rows)
    assert [sum(r.m) for r in rows] == [256, 1, 0]


def test_batch_encoding_does_not_depend_on_batches(spark):
    texts = [f"word{i} and more" for i in range(50)] + ["", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    out = {r.i: r.v for r in df.select("i", encode_texts(F.col("t"), arithmetic_encoder(), 7).alias("v")).collect()}
    whole = arithmetic_encoder()()(np.array(texts, dtype=object))
    assert np.allclose([out[i] for i in range(len(texts))], whole)
    assert np.allclose(np.linalg.norm(whole[:50], axis=1), 1) and not whole[50:].any()


def test_generation_keeps_every_request(spark):
    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(100)], "request_id string, prompt string").repartition(4)
    out = generate_completions(df, echo_backend(), "request_id string, content string, finish_reason string").collect()
    assert {r.request_id: r.content for r in out} == {str(i): f"<think>{len(f'p{i}')} characters</think>\n\np{i}" for i in range(100)}


def _field(number: int, payload) -> bytes:
    """One protocol-buffer field: a varint, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def tiny_model(table: np.ndarray) -> bytes:
    """An exported model whose token vectors are the rows of ``table``."""

    def value(name: str, kind: int, *dims: str) -> bytes:
        shape = b"".join(_field(1, _field(2, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    weights = b"".join(_field(1, int(d)) for d in table.shape) + _field(2, 1) + _field(8, "table") + _field(9, table.astype("<f4").tobytes())
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "hidden") + _field(4, "Gather")
    graph = (_field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, value("input_ids", 7, "b", "s"))
             + _field(12, value("hidden", 1, "b", "s", "h")))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_exported_model(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    vocab = {"[PAD]": 0, "[UNK]": 1, "red": 2, "green": 3, "blue": 4}
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tok.json"))
    table = np.random.default_rng(0).normal(size=(5, 6)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(tiny_model(table))
    texts = ["red green", "blue", "red red what blue green red", "green"]
    make = onnx_encoder(str(tmp_path / "m.onnx"), str(tmp_path / "tok.json"), max_length=4)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    out = df.select("i", encode_texts(F.col("t"), make, 2).alias("v")).orderBy("i").collect()
    for r, text in zip(out, texts):
        ids = [vocab.get(w, 1) for w in text.split()][:4]
        mean = table[ids].mean(axis=0)
        assert np.allclose(r.v, mean / np.linalg.norm(mean), atol=1e-5), text
    zero = pooled(np.ones((1, 2, 3), dtype=np.float32), np.zeros((1, 2), dtype=np.int64))
    assert not zero.any()
