import random

import pytest

from tessera.llm import toxicity as T

from .helpers import docs, empty, labels, odd

LEXICON = T.Lexicon([("de", "achlich", 1.0), ("en", "gleep$", 0.5)])


def rate(text, lang="en"):
    return round(T.score(text.lower(), LEXICON, lang)[0], 6)


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("what an idiot", 1.0),
        ("you are an idiot", 1.5),
        ("idiot, you", 1.5),
        ("you are not an idiot", 0.0),
        ("she is never stupid", 0.0),
        ("he said you are an idiot", 0.4),
        ("they wrote: you moron", 0.4),
        ('the sign has "idiot" on it', 0.4),
        ("idiot. moron! scum", 3.0),
        ("we will kill you", 1.5),
        ("kill the process", 0.0),
        ("i would never kill them", 0.0),
        ("a gleep of it", 0.5),
        ("gleeps", 0.0),
        ("idiotic weather", 0.0),
        ("", 0.0),
    ],
)
def test_clauses(text, score):
    assert rate(text) == score


THREATS = [
    "ich werde dich töten", "wir werden euch alle töten", "dich werde ich töten", "ich werde dich finden und töten",
    "je vais te tuer", "nous allons vous frapper", "te voy a matar", "yo te voy a matar", "voy a matarte", "vamos a golpearlos",
    "i am going to kill you", "i'm going to kill you", "i’ll kill you", "we will kill you", "i will find you and kill you", "i will definitely kill you",
    "kill yourself", "please just kill yourself", "kill them all",
]
HARMLESS = [
    "ich werde dich nicht töten", "je ne vais pas te tuer", "no te voy a matar", "no voy a matarte", "i am not going to kill you", "i will not kill you or hurt you", "i'm not going to try to kill you",
    "i will never let them hurt you", "i will stop him before he can kill you", "i won't kill you", "don't kill yourself", "i promise you i'll kill the process", "we will kill the process for you",
    "i know you will kill it", "vamos a matar el tiempo", "he said i will kill you", "how to kill the lights", "voy a matar el proceso",
]


@pytest.mark.parametrize("text", THREATS)
def test_threats_in_each_order(text):
    assert rate(text) == 1.5


@pytest.mark.parametrize("text", HARMLESS)
def test_denied_and_unaimed_threats(text):
    assert rate(text) == 0.0


def test_verdict_asks_for_an_aimed_clause_or_several(spark):
    quoted = 'the sign has "idiot" on it. '
    clean = ["take out the trash " + "and go on with it " * 50, "a circus clown", "la basura", "stupid weather", "he said you are an idiot", quoted * 3, quoted * 9 + "stupid weather"]
    toxic = ["you are an idiot", "idiot. moron!", "ich werde dich töten", quoted + "you moron"]
    frame = docs(spark, clean + toxic)
    assert {r.doc_id for r in T.rate(frame, []).where("toxic").collect()} == set(range(len(clean), len(clean + toxic)))
    assert {r.doc_id for r in T.civil_documents(frame, labels(spark, [])).collect()} == set(range(len(clean)))


def test_short_texts_are_fitted_on(spark):
    """Texts of one or two words are samples of their own, and the same rows are fitted on in every run."""
    texts = [f"zorgu{a}{b}{c} ta{b}" for a in "abcdef" for b in "abcdef" for c in "abcdefgh"]
    clean = [f"kolo{a}{b}{c} mi{b}" for a in "abcdef" for b in "abcdef" for c in "abcdefgh"]
    frame = docs(spark, texts + clean)
    marks = labels(spark, [(k, 1, int(k < len(texts))) for k in range(2 * len(texts))])
    stems = T.fit(frame, marks)
    assert any(s.startswith("zor") for _, s, _ in stems) and not any(s.startswith("kol") for _, s, _ in stems)
    assert T.fit(frame.orderBy("text"), marks) == stems


@pytest.mark.parametrize("text", ["i don't think you are an idiot", "je ne pense pas que tu es un idiot", "ich glaube nicht, dass du ein idiot bist", "no creo que seas idiota"])
def test_negated_opinions(text):
    assert rate(text) == 0.0 and rate("i think you are an idiot") == 1.5 and rate("i don't care, you are an idiot") == 1.5


def test_stems_by_language():
    assert rate("der achlichzu ist", "de") == 1.0 and rate("der achlichzu ist", "fr") == 1.0 and rate("der achlichzu ist", "en") == 0.0
    assert rate("der achlichzu ist", None) == 1.0 and rate("nachlich", "de") == 0.0


def test_composition_is_the_machines_one_after_the_other():
    parts = [T.negation(), T.reported(), T.target(), T.scoring()]
    whole = T.grammar()
    tags = sorted({t for p in parts for t in p.tags()} | {"other"})
    rng = random.Random(1)
    for _ in range(500):
        word = [rng.choice(tags) for _ in range(rng.randint(0, 12))]
        states, total = [0] * 4, 0.0
        for tag in word:
            for k, p in enumerate(parts):
                arc = p.step(states[k], tag)
                states[k], tag, total = arc.to, arc.out, total + arc.weight
        state, joint = 0, 0.0
        for tag in word:
            arc = whole.step(state, tag)
            state, joint = arc.to, joint + arc.weight
        assert joint == pytest.approx(total)


def test_every_clause_once():
    assert list(T.clauses("a. idiot moron! b; scum", LEXICON.anchor)) == [" idiot moron", " scum"]


def corpus(n, seed=2):
    rng = random.Random(seed)
    syllables = ["ta", "ko", "mi", "ru", "se", "lo", "na", "pe"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, toxic = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zorgu" + rng.choice(syllables))
        texts.append(" ".join(w) + ".")
        toxic.append(int(k % 5 == 0))
    return texts, toxic


def test_learned_stems_held_out(spark):
    texts, toxic = corpus(800)
    frame, marks = docs(spark, texts, "xx"), labels(spark, [(k, 1, toxic[k]) for k in range(500)])
    stems = T.fit(frame, marks)
    assert stems == [("xx", "zorgu", 1.0)]
    found = {r.doc_id for r in T.rate(frame, stems).where("toxic").collect()}
    assert found == {k for k in range(800) if toxic[k]}
    kept = T.civil_documents(frame, marks)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(800) if not toxic[k]} and kept.columns == frame.columns


def test_odd_tables(spark):
    frame = odd(spark, "you are an idiot of words")
    rows = T.rate(frame, []).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 10 and by[4].toxic and by[4].toxicity > 1000
    assert [(by[k].toxicity, by[k].toxic_clauses, by[k].toxic) for k in (1, 2, 3, 5, 6, 7)] == [(0.0, 0, False)] * 6
    assert sorted(r.toxic for r in rows if r.doc_id is None) == [False, True]
    assert T.rate(empty(spark), []).count() == 0
    none = labels(spark, [])
    assert T.fit(docs(spark, ["a b"]), none) == [] and T.fit(empty(spark), labels(spark, [(1, 1, 1), (2, 1, None), (3, 0, 5)])) == []
    out = T.civil_documents(frame, none)
    assert out.columns == frame.columns and out.count() == 8
    assert T.rate(frame.drop("lang"), []).where("toxic").count() == 2
