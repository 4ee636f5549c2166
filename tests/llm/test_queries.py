"""Every registered query over the whole smallest tables: against SQL, brute force, an exact inverse, or labels."""

import itertools
import os
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from tessera.llm import bpe, neardup, packing, pii, quality, records, registry, toxicity

from .test_neardup import brute as near_brute
from .test_packing import check

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def run(spark, name):
    return registry.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    rows = run(spark, name)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted(str([(c, plain(v)) for c, v in sorted(zip(names, r, strict=True))]) for r in cursor.fetchall())
    assert sorted(str([(c, plain(v)) for c, v in sorted(r.asDict().items())]) for r in rows) == want


def everywhere(text):
    """Findings with every parser tried at every place, in the order of the operator's choice among overlaps."""
    low, found = text.lower(), []
    for at in range(len(text)):
        if low[at] == "@" and (f := pii._email(low, at)):
            found.append(f)
        if text[at] in "+(" or (text[at].isdigit() and not (at and text[at - 1].isdigit())):
            found += list(pii._from_digit(text, at))
        if low.startswith("://", at) and (f := pii._url(text, at)):
            found.append(f)
        if (m := pii._IBAN.match(text, at)) and (end := pii._iban_end(m.group())):
            found.append(pii.Finding("iban", at, at + end))
        if m := pii._KEY.match(text, at):
            found.append(pii.Finding("secret", at, m.end()))
        for cue in pii.CUES:
            if low.startswith(cue, at):
                if f := pii._secret(text, at + len(cue)):
                    found.append(f)
                elif cue == "bearer" and (m := pii._BEARER.match(text, at + len(cue))) and any(c.isdigit() for c in m.group(1)):
                    found.append(pii.Finding("secret", m.start(1), m.end(1)))
        for cue in pii.PASSPORTS:
            if low.startswith(cue, at) and (m := pii._PASSPORT.match(text, at + len(cue))):
                found.append(pii.Finding("identifier", m.start(1), m.end(1)))
        if (m := pii._V6.match(text, at)) and pii._is_v6(m.group()):
            found.append(pii.Finding("ip", at, m.end()))
    out = []
    for f in sorted(set(found), key=lambda f: (f.start, -f.end, f.kind)):
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def test_op1(spark, texts):
    want = {(d, f.kind, f.start, f.end, t[f.start : f.end]) for d, t in texts.items() for f in everywhere(t)}
    assert want and {tuple(r) for r in run(spark, "op1_pii")} == want


def test_op1_against_other_parsers(spark, texts):
    """E-mail addresses, IP addresses and account numbers, found by plain patterns that share nothing with the operator."""
    rows = run(spark, "op1_pii")
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    covered = lambda d, m: any(s <= m.start() and m.end() <= e for s, e in spans.get(d, ()))
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    plain = {
        "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
        "ip": re.compile(rf"(?<![\w.]){octet}\.{octet}\.{octet}\.{octet}(?![\w.])"),
        "card": re.compile(r"(?<![\w.-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\w-])"),
    }
    seen = {k: 0 for k in plain}
    for d, t in texts.items():
        for kind, pattern in plain.items():
            for m in pattern.finditer(t):
                seen[kind] += 1
                assert covered(d, m), (d, kind, m.group())
    assert seen["email"] > 3
    for r in rows:
        if r.kind in ("email", "ip") and ":" not in r.value:
            assert plain[r.kind].search(r.value) or not r.value.isascii(), r.value


def test_op2(spark, texts):
    index = registry.queries()["op2_token_records"](spark, DATA)
    folder = os.path.dirname(index.inputFiles()[0]).removesuffix("/index")
    v = bpe.vocabulary()
    back = {r.doc_id: v.decode(np.array(r.token_ids, np.int64), np.array([len(r.token_ids)]))[0].decode() for r in records.read_records(index, folder).collect()}
    assert back == texts


def test_op3(spark, texts):
    f, n = neardup.fingerprints(pa.array(list(texts.values())))
    want = near_brute(f, n, list(texts))
    assert {r.doc_id: (r.class_id, r.links, r.keep) for r in run(spark, "op3_simhash_near_duplicates")} == want


def test_op4(spark, duck, texts):
    marks = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = {r.doc_id: r for r in run(spark, "op4_compression_quality")}
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    good, junk = ([rows[d].keep for d, q in marks.items() if q == y] for y in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.3
    # The scores again, by the parts of the method in a plain loop over whole texts.
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    x = quality.difference(pa.array([texts[d] for d in rows]), model.good, model.bad)
    for (_, r), v in zip(rows.items(), x, strict=True):
        want = None if np.isnan(v) else 1 / (1 + np.exp(-(model.slope * v + model.offset)))
        assert (r.score is None) == (want is None) and (want is None or abs(r.score - want) < 1e-9) and r.keep == (want is None or want >= model.cutoff)


def test_op5(spark, duck, texts):
    marks = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = {r.doc_id: r.toxic for r in run(spark, "op5_toxicity_grammar")}
    assert rows.keys() == texts.keys()
    assert not any(rows[d] for d, y in marks.items() if not y)
    words = {"idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "disgusting", "worthless"}
    plain = {d for d, t in texts.items() if len(words & {w.strip(".,!*#$%&?|").lower() for w in t.split()}) >= 2}
    assert plain and all(rows[d] for d in plain)


def test_op5_against_a_plain_scorer(spark, duck):
    """Every clause of every text, word by word through the four machines one after the other."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.Lexicon(toxicity.fit(docs, labels))
    machines = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.scoring()]
    rows = {r.doc_id: r for r in run(spark, "op5_toxicity_grammar")}
    for d, text, lang in duck.execute("SELECT doc_id, text, lang FROM documents").fetchall():
        total, firm, hits = 0.0, 0.0, 0
        for clause in re.split(r"[.!?;\n\r|]", text.lower()):
            states, score, weight = [0] * 4, 0.0, 1.0
            for word in toxicity.words(clause):
                tag, own = lexicon.tag(word, lang)
                weight = own if tag in toxicity.CORE else weight
                for k, m in enumerate(machines):
                    arc = m.step(states[k], tag)
                    states[k], tag = arc.to, arc.out
                score += arc.weight * weight
                firm += 0.0 if tag.endswith("-reported") else arc.weight * weight
            total += score
            hits += score > 0
        assert rows[d].toxicity == pytest.approx(total, abs=1e-5) and rows[d].toxic_clauses == hits and rows[d].toxic == (round(firm, 6) >= toxicity.THRESHOLD), d


def test_op6(spark, texts):
    v = bpe.vocabulary()
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: k for k, t in enumerate(v.tokens)}, special_tokens={})
    rows = run(spark, "op6_bpe")
    assert {r.doc_id: list(r.token_ids) for r in rows} == {d: e.encode_ordinary(t) for d, t in texts.items()}
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in rows)


def test_op7(spark, texts):
    n = check(run(spark, "op7_genetic_packing"), {d: len(t.encode()) for d, t in texts.items()}, packing.CAPACITY)
    most = packing.CAPACITY - 1
    pieces = np.array(list(itertools.chain.from_iterable([packing.CAPACITY] * ((len(t.encode()) - 1) // most) + [len(t.encode()) - most * ((len(t.encode()) - 1) // most) + 1] for t in texts.values() if t)))
    assert n <= packing.packed(pieces, packing.falling(pieces, np.arange(len(pieces))), packing.CAPACITY).max() + 1


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).collect()
    kept = {d for r in rows for d in r.doc_ids}
    flagged = {r.doc_id for r in run(spark, "op5_toxicity_grammar") if r.toxic}
    assert kept < set(texts) and not kept & flagged and len(kept) > len(texts) / 2
