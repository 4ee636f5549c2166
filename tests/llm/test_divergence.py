import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import divergence as D

from .helpers import clashing, docs, empty, odd


def histogram(text, lang):
    kinds = [0] * D.CLASSES
    for c in text:
        k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in "\t\n\x0b\x0c\r " else 5 if ord(c) > 127 else 4
        kinds[k] += 1
    words = [0] * D.BINS
    if lang in D.WORDS:
        for w, n in Counter(re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())).items():
            words[D.WORDS[lang].index(w) if w in D.WORDS[lang] else D.BINS - 1] += n
    return kinds, words


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


TEXTS = ["The end of the World is at 12 o'clock.", "für die Straße und 100 % mehr", "AAA!! ###\t\n", "", None, "von der zu den", "日本語 of the", "é" * 300]


@pytest.mark.parametrize("lang", ["en", "de", "xx", None])
def test_histograms(lang):
    out = D.histograms(pa.array(TEXTS), pa.array([lang] * len(TEXTS), pa.string()))
    for row, text in zip(out.tolist(), TEXTS, strict=True):
        kinds, words = histogram(text or "", lang)
        assert row[: D.CLASSES] == kinds and row[D.CLASSES :] == words


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = D.WORDS["en"] + ["river", "stone", "Bridge", "42", "of,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [t.upper().replace(" ", "!! ") for t in texts[:6]] + ["the " * 300, "", None]
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in D.judge(frame).collect()}
    every = [histogram(t or "", "en") for t in texts]
    reference = [[sum(h[k][b] for h in every) for b in range(n)] for k, n in ((0, D.CLASSES), (1, D.BINS))]
    for k, (kinds, found) in enumerate(every):
        a, b = distance(kinds, reference[0]), distance(found, reference[1])
        for x, y in ((rows[k].char_distance, a), (rows[k].word_distance, b)):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6))
        bad = a is not None and sum(kinds) >= D.LEAST_CHARS and a > D.CHAR_BOUND[0] + D.CHAR_BOUND[1] / math.sqrt(sum(kinds))
        bad = bad or (b is not None and sum(found) >= D.LEAST_WORDS and b > D.WORD_BOUND[0] + D.WORD_BOUND[1] / math.sqrt(sum(found)))
        assert rows[k].keep != bad
    assert not rows[66].keep and not any(rows[k].keep for k in range(60, 66) if len(texts[k]) > 400) and all(rows[k].keep for k in (67, 68))


def test_against_a_stored_reference(spark, monkeypatch):
    """Verdicts on a reference fitted on another corpus don't depend on the judged rows; broadcast or not."""
    rng = random.Random(2)
    words = D.WORDS["en"] + ["river", "stone", "bridge"]
    plain = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    junk = [" ".join(rng.choice("@#$%") * 5 for _ in range(200)) for _ in range(60)]
    trusted = D.references(D.counted(docs(spark, plain).unionByName(docs(spark, plain, "de", 500))))
    corpus = docs(spark, junk + plain).unionByName(docs(spark, plain[:3], None, 900)).unionByName(docs(spark, plain[:3], "xx", 950))
    first = sorted(map(str, D.judge(corpus, reference=trusted).collect()))
    rows = {r.doc_id: r for r in D.judge(corpus, reference=trusted).collect()}
    assert not any(rows[k].keep for k in range(60)) and all(rows[k].keep for k in range(60, 90))
    assert all(rows[k].char_distance is None and rows[k].keep for k in (900, 950))
    monkeypatch.setattr(D, "BROADCAST_LANGS", 1)
    assert sorted(map(str, D.judge(corpus, reference=trusted).collect())) == first


def test_odd_tables(spark):
    rows = D.judge(odd(spark)).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 10 and by[1].char_distance is None and by[2].keep and by[1].keep
    assert by[7].lang is None and by[7].char_distance == 0 and by[7].word_distance is None
    assert D.judge(empty(spark)).count() == 0
    unknown = clashing(docs(spark, ["x y z " * 100], "zz"))
    r = D.judge(unknown).first()
    assert r.char_distance == 0 and r.word_distance is None and r.keep
