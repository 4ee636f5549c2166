"""The BERT embedder on a small random model, against token-by-token loops; no model is downloaded or trained."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bert
from tessera.functions.embedding import Fallback, embed_column

tokenizers = pytest.importorskip("tokenizers")
WORDS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "red", "green", "apple", "dog", "##s", "a", "the", "runs"]
CONFIG = {"hidden_size": 12, "num_hidden_layers": 2, "num_attention_heads": 3, "intermediate_size": 20, "max_position_embeddings": 16, "vocab_size": len(WORDS), "layer_norm_eps": 1e-12}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("models") / "bert"
    base.mkdir()
    rng = np.random.default_rng(1)
    d, i = CONFIG["hidden_size"], CONFIG["intermediate_size"]
    shapes = {"embeddings.word_embeddings.weight": (len(WORDS), d), "embeddings.position_embeddings.weight": (16, d), "embeddings.token_type_embeddings.weight": (2, d)}
    norms = ["embeddings.LayerNorm"]
    for k in range(2):
        at = f"encoder.layer.{k}"
        for p in ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"):
            shapes |= {f"{at}.{p}.weight": (d, d), f"{at}.{p}.bias": (d,)}
        shapes |= {f"{at}.intermediate.dense.weight": (i, d), f"{at}.intermediate.dense.bias": (i,), f"{at}.output.dense.weight": (d, i), f"{at}.output.dense.bias": (d,)}
        norms += [f"{at}.attention.output.LayerNorm", f"{at}.output.LayerNorm"]
    tensors = {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in shapes.items()}
    for n in norms:
        tensors |= {f"{n}.weight": rng.uniform(0.5, 1.5, d).astype(np.float32), f"{n}.bias": rng.normal(0, 0.1, d).astype(np.float32)}
    header, data = {"__metadata__": {"format": "pt"}}, b""
    for k, v in tensors.items():
        header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [len(data), len(data) + v.nbytes]}
        data += v.tobytes()
    head = json.dumps(header).encode()
    (base / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + data)
    (base / "config.json").write_text(json.dumps(CONFIG))
    t = tokenizers.Tokenizer(tokenizers.models.WordPiece({w: k for k, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.post_processor = tokenizers.processors.TemplateProcessing("[CLS] $A [SEP]", special_tokens=[("[CLS]", 2), ("[SEP]", 3)])
    t.save(str(base / "tokenizer.json"))
    return base


def plain(ids, w):
    """One text, token by token."""
    d, heads = CONFIG["hidden_size"], CONFIG["num_attention_heads"]

    def norm(x, n):
        m, v = x.mean(), ((x - x.mean()) ** 2).mean()
        return (x - m) / math.sqrt(v + CONFIG["layer_norm_eps"]) * w[f"{n}.weight"] + w[f"{n}.bias"]

    def linear(x, n):
        return w[f"{n}.weight"].astype(float) @ x + w[f"{n}.bias"]

    x = [norm(w["embeddings.word_embeddings.weight"][i].astype(float) + w["embeddings.position_embeddings.weight"][k] + w["embeddings.token_type_embeddings.weight"][0], "embeddings.LayerNorm") for k, i in enumerate(ids)]
    for k in range(CONFIG["num_hidden_layers"]):
        at = f"encoder.layer.{k}"
        q, key, v = ([linear(y, f"{at}.attention.self.{p}") for y in x] for p in ("query", "key", "value"))
        out = []
        for a in range(len(x)):
            parts = []
            for h in range(heads):
                s = slice(h * d // heads, (h + 1) * d // heads)
                e = np.exp([q[a][s] @ key[b][s] / math.sqrt(d / heads) for b in range(len(x))])
                parts.append(sum(e[b] / e.sum() * v[b][s] for b in range(len(x))))
            y = norm(x[a] + linear(np.concatenate(parts), f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm")
            z = linear(y, f"{at}.intermediate.dense")
            z = np.array([t * 0.5 * (1 + math.erf(t / math.sqrt(2))) for t in z])
            out.append(norm(y + linear(z, f"{at}.output.dense"), f"{at}.output.LayerNorm"))
        x = out
    mean = sum(x) / len(x)
    return mean / np.linalg.norm(mean)


def test_against_loops(folder, monkeypatch):
    e, w = bert.BertEmbedder(str(folder)), bert.read_tensors(folder / "model.safetensors")
    texts = ["red apples", "the dog runs", "", "unknown", "a " * 40, "green"]
    ids = {"red apples": [2, 4, 6, 8, 3], "the dog runs": [2, 10, 7, 11, 3], "unknown": [2, 1, 3], "green": [2, 5, 3], "a " * 40: [2] + [9] * 14 + [3]}
    for at_once in (8_192, 7):
        monkeypatch.setattr(bert, "TOKENS_AT_ONCE", at_once)
        for text, v in zip(texts, e.embed(texts), strict=True):
            assert np.allclose(v, plain(ids[text], w) if text else 0, atol=2e-5), text


def test_discovery_and_columns(spark, folder, tmp_path):
    assert bert.find_embedder(spark, f"{tmp_path}/none") is None
    e = bert.find_embedder(spark, str(folder.parent))
    assert isinstance(e, bert.BertEmbedder) and e.dims == 12
    frame = spark.createDataFrame([(1, "red apples"), (2, None), (3, " ")], "id int, text string")
    got = {r.id: r.v for r in frame.select("id", embed_column(F.col("text"), e).alias("v")).collect()}
    assert np.allclose(got[1], e.embed(["red apples"])[0], atol=1e-6) and got[2] is None and got[3] is None
    spark.createDataFrame([("zebra", [1.0] * 12)], "token string, vector array<double>").write.parquet(f"{folder.parent}/table")
    both = bert.find_embedder(spark, str(folder.parent))
    assert isinstance(both, Fallback) and both.embed(["red apples"]).any()
