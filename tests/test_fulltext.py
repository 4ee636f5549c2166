import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.operators import fts
from tessera.plans import textquery as Q

STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "mules": "mule", "denied": "deni", "died": "die", "agreed": "agre", "owned": "own", "humbled": "humbl", "sized": "size",
    "meeting": "meet", "stating": "state", "siezing": "siez", "itemization": "item", "sensational": "sensat", "traditional": "tradit", "reference": "refer", "colonizer": "colon",
    "plotted": "plot", "running": "run", "jumped": "jump", "lazy": "lazi", "dogs": "dog", "foxes": "fox", "generously": "generous", "communication": "communic", "arsenal": "arsenal",
    "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "sky": "sky", "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "succeeds": "succeed",
    "consolingly": "consol", "conspicuous": "conspicu", "knightly": "knight", "knots": "knot", "kneels": "kneel", "relational": "relat", "vietnamization": "vietnam", "rate": "rate",
    "controlling": "control", "probate": "probat", "cease": "ceas", "by": "by", "say": "say", "enjoy": "enjoy", "youth": "youth", "boy": "boy", "employment": "employ", "goodness": "good",
    "hopeful": "hope", "adoption": "adopt", "bowdlerize": "bowdler", "effective": "effect", "formality": "formal", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "is": "is", "gas": "gas", "this": "this", "kiwis": "kiwi", "gaps": "gap", "cries": "cri", "ties": "tie", "bled": "bled", "luxuriated": "luxuri", "hopped": "hop", "fizzed": "fizz",
}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_stemmer(word, stem):
    assert analysis.stem(word) == stem


TEXTS = {0: "The quick brown fox, the lazy dog.", 1: "A lazy dog sleeps; the dog snores", 2: "Quick quick quick!", 3: "nothing here", 4: "", 5: None, 6: "to be or not to be " + "x" * 60, 7: "Füchse und FOX naïve 42"}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, "c", f"f{k % 3}", k * 2, None if k == 3 else k + 1, t) for k, t in TEXTS.items()], "id bigint, collection string, file_id string, chunk_index bigint, page bigint, text string")


@pytest.fixture(scope="module", params=["postings", "scan"])
def search(request, spark, chunks):
    index = fts.FullText.build(chunks, "simple") if request.param == "postings" else fts.TextScan(chunks, "simple")
    return lambda q: {r.chunk_id: r.score for r in index.matches(q).collect()}


def tokens(text):
    return [t for t in re.findall(r"\w+", (text or "").lower()) if len(t.encode()) < 40]


def bm25(tf, idf, dl):
    avg = sum(len(tokens(t)) for t in TEXTS.values()) / len(TEXTS)
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))


def idf(word):
    df = sum(word in tokens(t) for t in TEXTS.values())
    return math.log(1 + (len(TEXTS) - df + 0.5) / (df + 0.5))


def expected(words, only=lambda found: bool(found)):
    out = {}
    for k, t in TEXTS.items():
        count = Counter(tokens(t))
        found = [w for w in words if count[w]]
        if only(set(found)):
            out[k] = sum(bm25(count[w], idf(w), len(tokens(t))) for w in found)
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_words(search):
    same(search("fox"), expected(["fox"]))
    same(search("lazy quick"), expected(["lazy", "quick"]))
    same(search("FOX naïve"), expected(["fox", "naïve"]))
    same(search("dog dog"), {k: 2 * v for k, v in expected(["dog"]).items()})
    same(search("x" * 60), {})
    same(search("unknown"), {})


def test_boolean(search):
    same(search("lazy AND quick"), expected(["lazy", "quick"], lambda f: len(f) == 2))
    same(search("+dog the"), expected(["dog", "the"], lambda f: "dog" in f))
    same(search("dog -fox"), {k: v for k, v in expected(["dog"]).items() if k != 0})
    same(search("dog NOT fox"), {k: v for k, v in expected(["dog"]).items() if k != 0})
    same(search("(lazy OR snores) AND dog"), expected(["lazy", "snores", "dog"], lambda f: "dog" in f and f & {"lazy", "snores"}))
    same(search("fox^3"), {k: 3 * v for k, v in expected(["fox"]).items()})


def test_phrases(search):
    assert set(search('"lazy dog"')) == {0, 1} and set(search('"dog lazy"')) == set()
    assert search('"to be"')[6] == pytest.approx(bm25(2, idf("to") + idf("be"), 6))
    assert set(search('"quick fox"')) == set() and set(search('"quick fox"~1')) == {0}
    assert set(search('"lazy do"*')) == {0, 1} and set(search("lazy-dog")) == {0, 1}


def test_fields(search):
    assert set(search("id:3")) == {3} and search("id:3")[3] == 1.0
    assert set(search("id:[2 TO 4]")) == {2, 3, 4} and set(search("id:{2 TO 4}")) == {3} and set(search("page:>=7")) == {6, 7}
    assert set(search("page:[* TO 2]")) == {0, 1} and set(search("file_id:f1")) == {1, 4, 7} and set(search("id: IN [1 5 9]")) == {1, 5}
    assert set(search("+fox +file_id:f1")) == {7}
    same({k: v for k, v in search("fox id:3").items() if k == 7}, {k: v for k, v in expected(["fox"]).items() if k == 7})
    assert set(search("fox id:3")) == {0, 3, 7}


def test_everything_and_failures(search):
    for q in ("", "*", "  "):
        assert search(q) == {k: 1.0 for k in TEXTS}
    assert search("http://a.b/c") == {} and search("lazy AND") == {} and search('"open') == {} and search("-fox") == {} and search("id:x") == {}
    same(search("fox)"), {})


@pytest.mark.parametrize("text", ["a AND", "AND a", "(a", "a)", '"a', "nofield:a", "page:x", "-a", "a ^b", "id:[a TO b]", "OR"])
def test_parse_errors(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text)


def test_tree():
    assert Q.parse("a AND b OR c") == Q.Bool(should=(Q.Bool(must=(Q.Words("a"), Q.Words("b"))), Q.Words("c")))
    assert Q.parse('+a -"b c"~2 d^2') == Q.Bool((Q.Words("a"),), (Q.Words("d", boost=2.0),), (Q.Words("b c", 2),))


def test_stemmed_index(spark, chunks):
    index = fts.FullText.build(chunks, "english")
    assert {r.chunk_id for r in index.matches("sleeping dogs").collect()} == {0, 1}
    rows = {(r.term, r.chunk_id): (r.tf, list(r.positions)) for r in index.postings.collect()}
    assert rows["sleep", 1] == (1, [3]) and rows["dog", 1] == (2, [2, 5]) and rows["the", 0] == (2, [0, 4])


def test_postings_against_counts(spark):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))) for k in range(2500)}
    rows = fts.postings(spark.createDataFrame(list(texts.items()), "id bigint, text string"), "simple").collect()
    assert {(r.chunk_id, r.term): r.tf for r in rows} == {(k, w): n for k, t in texts.items() for w, n in Counter(t.split()).items()}
    assert all(texts[r.chunk_id].split()[p] == r.term for r in rows[:500] for p in r.positions)


def test_stemmed_scores_against_loops(spark):
    rng = random.Random(5)
    words = ["running", "runs", "runner", "dogs", "dog", "happily", "happy", "national", "nation", "of"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for k in range(80)}
    held = {k: [analysis.stem(w) for w in t.split()] for k, t in texts.items()}
    n, avg = len(texts), sum(map(len, held.values())) / len(texts)
    want = {}
    for k, ws in held.items():
        for q in ("run", "nation"):
            if tf := ws.count(q):
                df = sum(q in x for x in held.values())
                want[k] = want.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    for index in (fts.FullText.build(frame, "english"), fts.TextScan(frame, "english")):
        got = {r.chunk_id: r.score for r in index.matches("Running NATIONS").collect()}
        same(got, want)
        best = sorted(want, key=lambda k: (-want[k], k))[:5]
        assert [r.chunk_id for r in index.search("Running NATIONS", 5).collect()] == best


def test_many_queries_at_once(spark, monkeypatch):
    """The same as asking one after the other, in any blocks; words that no chunk has, empty queries and nulls find nothing."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 40))) for _ in range(150)] + [None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    asked = [" ".join(rng.sample(words, 3)) for _ in range(8)] + ["nothing", "", None, "w1"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
    index = fts.FullText.build(chunks, "simple")
    want = {}
    for q, text in enumerate(asked):
        rows = index.search(text, 5).collect() if text and text != "nothing" else []
        want[q] = [(r.chunk_id, round(r.score, 6)) for r in sorted(rows, key=lambda r: (-round(r.score, 9), r.chunk_id))]
    for at_once, pairs in ((500_000, 4_000_000), (7, 10)):
        monkeypatch.setattr(fts, "WORDS_AT_ONCE", at_once)
        monkeypatch.setattr(fts, "PAIRS_AT_ONCE", pairs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000" if at_once > 7 else "13")
        try:
            got = {}
            for r in fts.search_many(chunks, queries, 5, "simple").orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {q: rows for q, rows in want.items() if rows}
    assert fts.search_many(chunks.where("false"), queries, 5, "simple").count() == 0 and fts.search_many(chunks, queries.where("false"), 5, "simple").count() == 0


ODD = ["Red red APPLE", "", None, "  ", "İstanbul ΣΟΦΟΣ ß", "a" * 39 + " " + "b" * 40 + " c", "é" * 19 + " " + "é" * 20, "x²y ①٣ 中文字 😀🄰 e\u0301", "end", "begin-", "-", "a\u0000b\nc", "\U00010400\U0001d7d8"]


def test_terms_are_split_alike_in_both_ways(spark):
    """Texts are split in Arrow for postings and in the JVM for lengths and scans."""
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "id bigint, text string")
    want = {(r.id, t, k) for r in rows.select("id", analysis.terms(F.col("text"), "simple").alias("terms")).collect() for k, t in enumerate(r.terms or [])}
    got = [(r.chunk_id, r.term, k) for r in fts.postings(rows, "simple").collect() for k in r.positions]
    assert len(got) == len(want) and set(got) == want
    counts = {(r.term, r.chunk_id, r.tf) for r in fts.postings(rows, "simple", places=False).collect()}
    assert counts == {(r.term, r.chunk_id, r.tf) for r in fts.postings(rows, "simple").collect()}
    assert sorted(r.term for r in fts.vocabulary(rows).collect()) == sorted({t for _, t, _ in want})


def test_every_character_is_classed_alike(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(at, " ".join(map(chr, points[at : at + 5000]))) for at in range(0, len(points), 5000)], "id bigint, text string")
    want = {(r.id, k): t for r in rows.select("id", analysis.terms(F.col("text"), "simple").alias("terms")).collect() for k, t in enumerate(r.terms)}
    assert {(r.chunk_id, k): r.term for r in fts.postings(rows, "simple").collect() for k in r.positions} == want


def test_blocks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(fts, "BYTES_AT_ONCE", 10)
    monkeypatch.setattr(fts, "ROWS_AT_ONCE", 3)
    texts = ["a" * 30, "b", None, "c", "d", "e" * 9, "f", "", "g" * 11]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["chunk_id", "text"])
    parts = list(fts.blocks(b, 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 10) for p in parts)
