"""Text to terms: runs of letters and digits, lower-cased, without long ones, stemmed for English.

The stemmer follows the published description of Porter2. It runs in Python, in Arrow
batches, once for each distinct term of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

TOKEN = r"[\p{L}\p{N}]+"
LONGEST = 40
ANALYZERS = ("simple", "english")

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    m = re.match(r"gener|commun|arsen", w)
    after = lambda at: (x.end() + at if (x := re.search(r"[aeiouy][^aeiouy]", w[at:])) else len(w))
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    # Step 0 and 1a: possessives and plurals.
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # Step 1b: past and progressive.
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(s):
            continue
        if s.startswith("eed"):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
        elif re.search(r"[aeiouy]", w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
        break
    # Step 1c.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in set("cdeghkmnrt")):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # Step 5.
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@arrow_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        terms = lists.flatten().dictionary_encode()
        stems = pa.array([stem(t) for t in terms.dictionary.to_pylist()], pa.string())
        sizes = lists.value_lengths().fill_null(0)
        offsets = [0]
        for n in sizes.to_pylist():
            offsets.append(offsets[-1] + n)
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(terms.indices), mask=lists.is_null())


def terms(text: Column, analyzer: str = "english") -> Column:
    """array<string> of a text's terms, in order; null for a null text."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer is one of {ANALYZERS}, not {analyzer!r}")
    simple = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.octet_length(t) < LONGEST)
    return _stems(simple) if analyzer == "english" else simple


class Splitter:
    """`terms` by the simple analyzer over whole Arrow arrays of texts that are lower-cased already.

    Which characters make a term is asked of the JVM, so that both ways agree on every text.
    """

    _held: list[int] | None = None  # where runs of such characters begin and end

    def __init__(self, spark: SparkSession):
        if Splitter._held is None:
            other = spark._jvm.java.util.regex.Pattern.compile(f"[^{TOKEN[1:-2]}]+")
            points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
            kept = (other.matcher("".join(map(chr, points[at : at + 0x10000]))).replaceAll("") for at in range(0, len(points), 0x10000))
            inside = np.zeros(0x110000 + 1, bool)
            inside[[ord(c) for part in kept for c in part]] = True
            Splitter._held = np.flatnonzero(np.diff(inside, prepend=False)).tolist()
        self.edges = Splitter._held

    def __getstate__(self) -> dict:
        return {"edges": self.edges}

    @property
    def inside(self) -> np.ndarray:
        """For each code point whether it is part of a term."""
        if "_inside" not in self.__dict__:
            at = np.zeros(0x110000, np.int8)
            at[[e for e in self.edges if e < len(at)]] = 1
            self._inside = np.cumsum(at, dtype=np.int32) % 2 == 1
        return self._inside

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All terms of the texts, in order, and the text's number of each; nulls have none."""
        texts = texts.fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(ends[-1] - ends[0]) if len(texts) else 0
        if not size:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        if data.max() < 128:
            inside = self.inside[:128][data]
        else:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            leads = np.flatnonzero((data & 0xC0) != 0x80)
            inside = np.repeat(self.inside[points], np.diff(leads, append=size))
        borders = ends[(ends > 0) & (ends < size)]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begins[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        short = last - first < LONGEST
        first, last = first[short], last[short]
        # Terms and what lies between them, in turn: nothing is copied but the terms.
        cuts = np.column_stack([first, last]).astype(np.int32).ravel()
        pieces = pa.Array.from_buffers(pa.string(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        return pieces.take(pa.array(np.arange(0, len(cuts), 2))), np.searchsorted(ends[1:], first, side="right")


def query_terms(text: str, analyzer: str = "english") -> list[str]:
    """The same on the driver, for a query's words."""
    import regex

    simple = [t for t in regex.findall(TOKEN, text.lower()) if len(t.encode()) < LONGEST]
    return [stem(t) for t in simple] if analyzer == "english" else simple
