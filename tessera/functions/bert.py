"""A BERT encoder as an embedder: stored weights, mean over a text's tokens, length 1.

A model's folder holds config.json, tokenizer.json and model.safetensors, as models are commonly
published. Weights are read as they lie in the file and texts are encoded by numpy in batches of
similar length, so that it runs in an Arrow batch of any executor that reaches the folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from tessera.functions.embedding import Embedder, Fallback, StaticEmbedder

_KINDS = {"F32": np.float32, "F16": np.float16, "F64": np.float64, "I64": np.int64}
#: Tokens, padding included, that are encoded together.
TOKENS_AT_ONCE = 8_192


def read_tensors(path: str | Path) -> dict[str, np.ndarray]:
    """The arrays of a safetensors file: the length of a JSON header, the header, and the bytes of all arrays."""
    raw = Path(path).read_bytes()
    size = int.from_bytes(raw[:8], "little")
    header = json.loads(raw[8 : 8 + size])
    out = {}
    for name, h in header.items():
        if name != "__metadata__":
            begin, end = h["data_offsets"]
            if h["dtype"] == "BF16":
                data = (np.frombuffer(raw[8 + size + begin : 8 + size + end], np.uint16).astype(np.uint32) << 16).view(np.float32)
            else:
                data = np.frombuffer(raw[8 + size + begin : 8 + size + end], _KINDS[h["dtype"]])
            out[name] = data.reshape(h["shape"]).astype(np.float32) if h["dtype"] != "I64" else data.reshape(h["shape"])
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, within 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


class Encoder:
    """The forward pass over token ids."""

    def __init__(self, tensors: dict[str, np.ndarray], config: dict):
        prefix = next((p for p in ("", "bert.") if f"{p}embeddings.word_embeddings.weight" in tensors), None)
        if prefix is None:
            raise ValueError("the file has no BERT embeddings")
        self.w = {k.removeprefix(prefix): v for k, v in tensors.items()}
        self.layers, self.heads = config["num_hidden_layers"], config["num_attention_heads"]
        self.eps, self.longest, self.dims = config.get("layer_norm_eps", 1e-12), config["max_position_embeddings"], config["hidden_size"]

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        mean = x.mean(axis=-1, keepdims=True)
        var = ((x - mean) ** 2).mean(axis=-1, keepdims=True)
        return (x - mean) / np.sqrt(var + self.eps) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def run(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Hidden states (texts, tokens, dims); `real` marks what isn't padding."""
        n, t = ids.shape
        x = self.w["embeddings.word_embeddings.weight"][ids] + self.w["embeddings.position_embeddings.weight"][:t] + self.w["embeddings.token_type_embeddings.weight"][0]
        x = self._norm(x, "embeddings.LayerNorm")
        hidden = np.where(real, 0.0, -1e9)[:, None, None, :].astype(np.float32)
        split = lambda y: y.reshape(n, t, self.heads, -1).transpose(0, 2, 1, 3)
        for k in range(self.layers):
            at = f"encoder.layer.{k}"
            q, key, v = (split(self._linear(x, f"{at}.attention.self.{p}")) for p in ("query", "key", "value"))
            a = q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]) + hidden
            a = np.exp(a - a.max(axis=-1, keepdims=True))
            a = (a / a.sum(axis=-1, keepdims=True)) @ v
            x = self._norm(x + self._linear(a.transpose(0, 2, 1, 3).reshape(n, t, -1), f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm")
            h = self._linear(x, f"{at}.intermediate.dense")
            h = h * 0.5 * (1 + _erf(h / np.sqrt(2)))
            x = self._norm(x + self._linear(h, f"{at}.output.dense"), f"{at}.output.LayerNorm")
        return x


@lru_cache(maxsize=2)
def _loaded(folder: str):
    from tokenizers import Tokenizer  # only where a model is used

    base = Path(folder)
    encoder = Encoder(read_tensors(base / "model.safetensors"), json.loads((base / "config.json").read_text()))
    tokenizer = Tokenizer.from_file(str(base / "tokenizer.json"))
    tokenizer.no_padding()
    tokenizer.enable_truncation(encoder.longest)
    return encoder, tokenizer


class BertEmbedder:
    """Texts beyond the model's longest are cut there, as the model has no further positions; an empty text has no vector."""

    def __init__(self, folder: str):
        self.folder = folder
        self.dims = int(json.loads((Path(folder) / "config.json").read_text())["hidden_size"])

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        encoder, tokenizer = _loaded(self.folder)  # once a Python worker
        ids = [e.ids if t.strip() else [] for e, t in zip(tokenizer.encode_batch(list(texts)), texts, strict=True)]
        out = np.zeros((len(texts), self.dims))
        order = [k for k in sorted(range(len(ids)), key=lambda k: len(ids[k])) if ids[k]]
        while order:
            take = max(1, TOKENS_AT_ONCE // len(ids[order[-1]]))
            part, order = order[-take:], order[:-take]
            size = np.array([len(ids[k]) for k in part])
            real = np.arange(size.max()) < size[:, None]
            padded = np.zeros(real.shape, np.int64)
            padded[real] = np.concatenate([ids[k] for k in part])
            x = (encoder.run(padded, real) * real[:, :, None]).sum(axis=1) / size[:, None]
            out[part] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return out


def find_embedder(spark: SparkSession, folder: str) -> Embedder | None:
    """What the models in a folder make: a BERT model first, a static token table where that fails; None without either.

    A subfolder with model.safetensors is a BERT model, one with Parquet files (token, vector) a token table.
    """
    found: list[Embedder] = []
    subfolders = sorted(p for p in Path(folder).iterdir() if p.is_dir()) if Path(folder).is_dir() else []
    for p in subfolders:
        if all((p / f).exists() for f in ("model.safetensors", "config.json", "tokenizer.json")):
            found.append(BertEmbedder(str(p)))
    for p in subfolders:
        if any(p.glob("*.parquet")):
            found.append(StaticEmbedder.load(spark, str(p)))
    same = [e for e in found if e.dims == found[0].dims]
    return None if not found else same[0] if len(same) == 1 else Fallback(*same)
