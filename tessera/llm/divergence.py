"""Quality rules from the divergence of a text's distributions from its language's.

Two histograms are taken of every text: its characters by class (small and capital ASCII
letters, digits, white space, other ASCII, the rest) and its words by the commonest words
of its language, with one bin for all other words. The language's references are the same
histograms summed over texts of that language: a stored table of an earlier, trusted corpus
(see `references`), or else all of the judged ones. The Jensen-Shannon distance (base 2, 0 to
1) of each is a measure; a text goes if one is above its
bound, which falls with the square root of the text's length, and each has a guard: a text
of fewer than LEAST_CHARS characters, or of fewer than LEAST_WORDS words, isn't judged by it.

Texts are read once, for their counts; these are written, summed by Spark and compared in
Arrow batches. References are broadcast up to BROADCAST_LANGS languages, which is checked.

Defined results: a null or empty text has null distances and is kept; a null language is a
language of its own; a language without a word list is judged by characters alone, one without a reference not at all; texts of
any length are counted whole; repeated rows count as often as they occur; rows with a null
id are judged; an empty table gives an empty table. Other columns are never read.
A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .spill import cut
from .textkit import buffers, passes, word_hashes

WORDS = {
    "en": "the of and to a in is that for it was with as on are be at by this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
CLASSES = 6
BINS = 21
LEAST_CHARS, LEAST_WORDS = 200, 30
#: Languages (a few hundred bytes each) up to which all references are broadcast.
BROADCAST_LANGS = 50_000
#: A bound is the first number plus the second over the root of the count, as the distance of a sample from its source falls.
CHAR_BOUND, WORD_BOUND = (0.08, 3.2), (0.06, 2.8)

_CLASS = np.full(256, 4, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[0xC0:] = 5
_CLASS[0x80:0xC0] = 6  # the bytes of a character after its first


def _known() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, its words' hashes in order and the bin of each."""
    out = {}
    for lang, words in WORDS.items():
        h = word_hashes(pa.array(words))[1]
        order = np.argsort(h)
        out[lang] = h[order], order
    return out


_KNOWN = _known()


def histograms(texts: pa.Array, langs: pa.Array) -> np.ndarray:
    """A row for each text: counts of character classes, then of words."""
    raw, offsets = buffers(texts)
    n = len(texts)
    out = np.zeros((n, CLASSES + BINS), np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[:, :CLASSES] = np.bincount(doc * 7 + _CLASS[raw], minlength=n * 7).reshape(n, 7)[:, :CLASSES]
    doc, h = word_hashes(texts)
    lang = np.array([x if x in _KNOWN else "" for x in langs.to_pylist()], dtype=object)
    for name, (known, order) in _KNOWN.items():
        rows = (lang == name)[doc]
        d, x = doc[rows], h[rows]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        which = np.where(known[at] == x, order[at], BINS - 1)
        out[:, CLASSES:] += np.bincount(d * BINS + which, minlength=n * BINS).reshape(n, BINS)
    return out


@arrow_udf(ArrayType(LongType(), False))
def _histograms(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, langs in batches:
        parts, at = [np.zeros((0, CLASSES + BINS), np.int64)], 0
        for part in passes(texts):
            parts.append(histograms(part, langs.slice(at, len(part))))
            at += len(part)
        flat = np.concatenate(parts)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * (CLASSES + BINS), pa.int32()), pa.array(flat.ravel()))


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts, to six decimals; NaN where a row is empty."""
    ps, qs = p.sum(axis=1, keepdims=True).astype(float), q.sum(axis=1, keepdims=True).astype(float)
    some = (ps > 0) & (qs > 0)
    x, y = p / np.where(some, ps, 1), q / np.where(some, qs, 1)
    m = (x + y) / 2
    part = lambda z: np.where(z > 0, z * np.log2(np.where(z > 0, z, 1) / np.where(z > 0, m, 1)), 0.0)
    # Summed bin by bin, as the SQL does.
    total = np.add.accumulate((part(x) + part(y)) / 2, axis=1)[:, -1]
    return np.where(some[:, 0], np.floor(np.sqrt(np.maximum(total, 0)) * 1e6 + 0.5) / 1e6, np.nan)


_JUDGED = StructType([StructField("char_distance", DoubleType()), StructField("word_distance", DoubleType()), StructField("keep", BooleanType())])


@arrow_udf(_JUDGED)
def _judged(own: pa.Array, reference: pa.Array) -> pa.Array:
    rows = lambda a: a.flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES + BINS)
    known = reference.is_valid().to_numpy(zero_copy_only=False)
    h, r = rows(own), np.zeros((len(own), CLASSES + BINS), np.int64)
    r[known] = rows(reference)
    out, keep = [], np.ones(len(own), bool)
    for part, least, bound in ((slice(0, CLASSES), LEAST_CHARS, CHAR_BOUND), (slice(CLASSES, None), LEAST_WORDS, WORD_BOUND)):
        d, n = distances(h[:, part], r[:, part]), h[:, part].sum(axis=1)
        keep &= ~((n >= least) & (np.nan_to_num(d, nan=-1.0) > bound[0] + bound[1] / np.sqrt(np.maximum(n, 1))))
        out.append(pa.array(d, from_pandas=True))
    return pa.StructArray.from_arrays([*out, pa.array(keep)], ["char_distance", "word_distance", "keep"])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, h) of every row, written once."""
    rows = docs.select(docs[id_col].alias(id_col), docs[lang_col].cast("string").alias("lang"), _histograms(docs[text_col].cast("string"), docs[lang_col].cast("string")).alias("h"))
    return cut(rows, "histograms")


def references(counts: DataFrame) -> DataFrame:
    """(r_lang, r, w): the histograms of each language summed, and its number of rows; a table to be stored and used for other corpora."""
    sums = [F.sum(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(CLASSES + BINS)]
    total = counts.groupBy(F.col("lang").alias("r_lang")).agg(*sums, F.count(F.lit(1)).alias("w"))
    return total.select("r_lang", F.array(*(f"h{k}" for k in range(CLASSES + BINS))).alias("r"), "w")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reference: DataFrame | None = None) -> DataFrame:
    """(id, lang, char_distance, word_distance, keep) of every row, against `reference` or else the docs' own languages."""
    counts = counted(docs, id_col, text_col, lang_col)
    reference = cut(references(counts) if reference is None else reference.select("r_lang", "r", "w"), "references")
    on = F.col("lang").eqNullSafe(F.col("r_lang"))
    if reference.count() <= BROADCAST_LANGS:
        both = counts.join(F.broadcast(reference), on, "left")
    else:
        # More languages than fit: those of most rows are broadcast, which are few, so that none meets in one task; the rest are shuffled.
        hot = F.broadcast(reference.orderBy(F.desc("w"), "r_lang").limit(BROADCAST_LANGS))
        rest = reference.join(hot.select("r_lang"), reference["r_lang"].eqNullSafe(hot["r_lang"]), "left_anti")
        cold = counts.join(hot, on, "left_anti")
        both = counts.join(hot, on).unionByName(cold.join(rest, on, "left"))
    out = both.select(id_col, "lang", _judged(F.col("h"), F.col("r")).alias("__j"))
    return out.select(id_col, "lang", "__j.char_distance", "__j.word_distance", "__j.keep")


def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    classes = [r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^\t\n\x0b\x0c\r ]", r"[^\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]", r"[\x00-\x7f]"]
    chars = ", ".join(f"length(regexp_replace(text, '{c}', '', 'g'))" for c in classes)
    words = " ".join(f"WHEN '{lang}' THEN {w!r}" for lang, w in WORDS.items())
    terms = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"

    def js(which: str) -> str:
        p, q = f"(d.{which}[i] / list_sum(d.{which})::DOUBLE)", f"(r.{which}[i] / list_sum(r.{which})::DOUBLE)"
        inner = f"({terms.format(x=p, y=q)} + {terms.format(x=q, y=p)}) / 2"
        return f"CASE WHEN list_sum(d.{which}) > 0 AND list_sum(r.{which}) > 0 THEN round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len(d.{which}) + 1), lambda i: {inner})))), 6) END"

    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, CASE lang {words} END AS known FROM documents),
w AS (SELECT doc_id, lang, known, [{chars}]::BIGINT[] AS c, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM t),
d AS (SELECT doc_id, lang, c, CASE WHEN known IS NULL THEN list_transform(range({BINS}), lambda i: 0::BIGINT) ELSE list_append(
        list_transform(known, lambda k: len(list_filter(words, lambda x: x = k))::BIGINT),
        len(list_filter(words, lambda x: NOT list_contains(known, x)))::BIGINT) END AS b FROM w),
r AS (SELECT lang, [{", ".join(f"sum(c[{i}])" for i in range(1, CLASSES + 1))}]::BIGINT[] AS c, [{", ".join(f"sum(b[{i}])" for i in range(1, BINS + 1))}]::BIGINT[] AS b FROM d GROUP BY lang),
m AS (SELECT d.doc_id, d.lang, list_sum(d.c) AS chars, list_sum(d.b) AS words, {js("c")} AS char_distance, {js("b")} AS word_distance
      FROM d JOIN r ON d.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, lang, char_distance, word_distance,
       NOT coalesce((chars >= {LEAST_CHARS} AND char_distance > {CHAR_BOUND[0]} + {CHAR_BOUND[1]} / sqrt(chars)) OR (words >= {LEAST_WORDS} AND word_distance > {WORD_BOUND[0]} + {WORD_BOUND[1]} / sqrt(words)), false) AS keep
FROM m"""


QUERIES = {"op10_distribution_divergence": op10_distribution_divergence}
ORACLE_SQL = {"op10_distribution_divergence": _sql()}
