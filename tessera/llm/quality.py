"""Quality from compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on blocks of good labelled texts, one on blocks of bad ones. A
text is cut into blocks of BLOCK bytes, each compressed with both; x is the difference of
the two compressed sizes (good minus bad) over the text's length
plus SHRINK. A logistic curve fitted to held-out labelled rows turns x into the probability
that the text is good, and a cutoff on it is set on the same rows so that a good text lost
costs GOOD_COST times a bad one kept.

The model is fitted on at most SAMPLE_ROWS labelled rows, those of least hash of their ids,
one for each id, half for the dictionaries and half for the curve; from a text in the first half
at most BLOCKS_EACH blocks are taken, evenly over its whole length. Scores read all of each text.

Defined results: a null text or one of fewer than LEAST_BYTES bytes has no evidence: its score
is null and it is kept; a text of any length is compressed whole; equal texts have equal scores;
rows with a null id are scored like others; of rows that repeat a labelled id the text of least
hash is fitted on; labels that are null, neither 0 nor 1, or
contradict each other for one id are left out of the fit. Without labelled rows of both
kinds nothing can be fitted: all scores are null and all rows stay. An empty table gives an
empty table. Other columns stay as they are; `score` and `keep` are added, and replace
columns of those names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from .spill import cut
from .textkit import buffers

SAMPLE_ROWS = 16_000
BLOCKS_EACH = 8
BLOCK = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHRINK = 64
LEAST_BYTES = 40
GOOD_COST = 3.0

_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    cutoff: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    key = hashlib.sha1(dictionary).digest()
    if key not in _compressors:
        if len(_compressors) >= 8:
            _compressors.clear()
        held = zstandard.ZstdCompressionDict(dictionary)
        _compressors[key] = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)
    return _compressors[key]


def train(blocks: list[bytes]) -> bytes:
    """A dictionary from sample blocks; few of them are used as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too few samples: their bytes, with a leading 0 so that they can't be taken for a trained dictionary's header.
        return b"\0" + b"".join(blocks)[-DICTIONARY_BYTES:].ljust(8, b" ")


def difference(texts: pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    """x of each text; NaN for those without evidence."""
    raw, offsets = buffers(texts)
    g, b = _compressor(good).compress, _compressor(bad).compress
    out = np.full(len(texts), np.nan)
    view = memoryview(raw)
    for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if end - start < LEAST_BYTES:
            continue
        total = 0
        for at in range(start, end, BLOCK):
            block = view[at : min(at + BLOCK, end)]
            total += len(g(block)) - len(b(block))
        out[k] = total / (end - start + SHRINK)
    return out


def _difference(text: Column, good: bytes, bad: bytes) -> Column:
    @arrow_udf(DoubleType())
    def x(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(difference(texts, good, bad), from_pandas=True)

    return x(text)


def blocks_of(text: str) -> list[bytes]:
    raw = text.encode()
    last = max(0, len(raw) - BLOCK)
    return [raw[s : s + BLOCK] for s in sorted({round(last * k / max(1, BLOCKS_EACH - 1)) for k in range(BLOCKS_EACH)})]


@arrow_udf(ArrayType(BinaryType()))
def _blocks(texts: pa.Array) -> pa.Array:
    return pa.array([blocks_of(t) for t in texts.to_pylist()], pa.list_(pa.binary()))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1); Newton steps with a small ridge, so that separable rows have an answer."""
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def best_cutoff(score: np.ndarray, good: np.ndarray) -> float:
    """Rows with a score below it go: least number of bad ones kept plus GOOD_COST times good ones lost, between two scores."""
    order = np.argsort(score, kind="stable")
    s, lost = score[order], np.cumsum(good[order])
    cost = np.concatenate([[0], GOOD_COST * lost]) + np.concatenate([[(~good).sum()], (~good).sum() - np.cumsum(~good[order])])
    edges = np.concatenate([[0.0], (s[:-1] + s[1:]) / 2, [s[-1]]])
    cost = cost[:-1]
    return float(edges[: len(cost)][np.argmin(cost)])


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, text, y, h) of at most `rows` rows: the ids of least hash, each with one of its texts; it is written once."""
    y = labels[label].cast("int")
    ids = (
        labels.select(labels["doc_id"].cast("bigint").alias("__id"), y.alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"), F.max("__y").alias("__top"))
        .where("__y = __top")
        .select("__id", "__y", F.xxhash64("__id").alias("__h"))
        .orderBy("__h", "__id")
        .limit(rows)
    )
    texts = docs.select(docs[id_col].cast("bigint").alias("__id"), docs[text_col].alias("__text")).where("__id is not null and __text is not null")
    # At most `rows` ids: broadcast whatever the size of the tables.
    found = texts.join(F.broadcast(ids), "__id").select(F.col("__id").alias("id"), "__text", F.col("__y").alias("y"), F.col("__h").alias("h"))
    # Of an id with several texts the one of least hash: the same one in every run, and no more rows than ids.
    one = found.groupBy("id", "y", "h").agg(F.min(F.struct(F.xxhash64("__text").alias("k"), "__text")).alias("one"))
    return cut(one.select("id", F.col("one.__text").alias("text"), "y", "h"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    sample = labelled(docs, labels, "quality", id_col, text_col, rows)
    taken = _blocks("text")
    first = sample.where("h % 2 = 0").orderBy("h", "id").select("y", taken.alias("blocks")).collect()
    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    for r in first:
        blocks[r.y] += [bytes(b) for b in r.blocks if len(b) >= 8]
    if not blocks[0] or not blocks[1]:
        return None
    good, bad = train(blocks[1]), train(blocks[0])
    held = sample.where("h % 2 != 0").orderBy("h", "id").select("y", _difference(F.col("text"), good, bad).alias("x")).where("x is not null").collect()
    x, y = np.array([r.x for r in held]), np.array([r.y for r in held])
    if not len(y) or y.min() == y.max():
        return Model(good, bad, -100.0, 0.0, 0.5)
    slope, offset = logistic(x, y)
    return Model(good, bad, slope, offset, best_cutoff(1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500))), y == 1))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with `score`, the probability that the text is good, and `keep`."""
    if model is None:
        return docs.withColumns({"score": F.lit(None).cast("double"), "keep": F.lit(True)})
    x = _difference(docs[text_col], model.good, model.bad)
    scored = docs.withColumn("score", 1 / (1 + F.exp(-(model.slope * x + model.offset))))
    return scored.withColumn("keep", F.col("score").isNull() | (F.col("score") >= model.cutoff))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that the classifier rejects; columns as they are."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    x = _difference(docs[text_col], model.good, model.bad)
    score = 1 / (1 + F.exp(-(model.slope * x + model.offset)))
    return docs.where(F.coalesce(score >= model.cutoff, F.lit(True)))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")


QUERIES = {"op4_compression_quality": op4_compression_quality}
ORACLE_SQL: dict[str, str] = {}
