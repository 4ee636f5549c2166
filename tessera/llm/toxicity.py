"""Toxicity of clauses from a weighted finite-state grammar.

Words become tags by a lexicon transducer (insult, threat, target, negator, ...). Four small
transducers over tags are composed into one machine, once, by the product of their states:

* negation: an insult or threat behind a negated copula or modal ("is not a", "would never"),
  a contracted one or a bare "no" is marked as denied, a threat also where a target or one other word is between;
* reported speech: one behind a verb of speech or a quotation mark is marked as reported;
* target: an insult with a person spoken to or of, before or behind, is marked as aimed; so is a threat of the
  speaker's ("I will", "voy a") with its target on either side of the verb or joined to it (matarte), and one that
  begins a clause and has its target behind it;
* scoring: every mark has a weight, that of the insult's own word times that of its marks.

The machine reads a clause, which is what stands between two marks of punctuation that end
one, and the clause's score is the sum of the weights on its path. A document's score is the
sum over its clauses. It is toxic from THRESHOLD on, where reported marks don't count: one aimed clause is
enough, a bare insult needs a second, and words that are only quoted never are.

The lexicon holds general words of four languages. To it come stems that a bounded sample
of labelled rows shows to be toxic (SAMPLE_ROWS labelled ids of least hash, one of each
group of rows with an equal min-hash, which for a text of fewer than three words is that of
the whole text; of such a group the row of least hash): beginnings of words, of three letters or more, in far
more toxic texts than others, each extended as long as one continuation keeps KEEPS of its
texts. A stem's weight is its log-odds against FULL_ODDS, 1 at most.

Defined results: a null or empty text has score 0, no clause and isn't toxic; texts of any
length are read whole; repeated rows have equal scores; rows with a null id are scored; an
unknown or null language has the general words and the stems of all languages; labels that
are null, neither 0 nor 1, or contradict each other for one id are left out, and without
both kinds the general words stand alone; an empty table gives an empty table. Other columns
stay as they are; the added columns replace columns of their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .quality import labelled
from .spill import cut
from .textkit import passes, sequence_hashes, word_hashes

SAMPLE_ROWS = 20_000
#: The weight of one aimed insult or threat; a bare insult has less.
THRESHOLD = 1.5
LEAST_TEXTS = 3
#: Entries that a task counts before it passes them on.
HELD = 100_000
LEAST_ODDS, STEM_ODDS = 3.5, 4.5
LEAST_EVIDENCE, STEM_EVIDENCE, RARE_EVIDENCE = 20.0, 40.0, 8.0
FULL_ODDS = 4.0
KEEPS = 0.9
STEM = range(3, 13)

WORDS = {
    "insult": """idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic disgusting worthless imbecile
        imbeciles bastard bastards bitch asshole assholes dumbass retard retards scumbag subhuman vermin cretin
        idiotin trottel dummkopf arschloch abschaum wichser hurensohn schwachkopf vollidiot missgeburt
        connard connards connasse salaud salope abruti abrutis crétin débile ordure enculé imbécile
        idiota idiotas imbécil estúpido estúpida gilipollas cabrón escoria pendejo mierda basura""",
    "threat": """kill murder stab shoot strangle slaughter hang destroy hurt beat töten umbringen erschießen
        tuer égorger frapper étrangler matar apuñalar golpear estrangular""",
    "target": """you your you're youre u yourself yourselves he she they him her them these those people
        du dich dir euch ihr sie tu te toi vous ils elles eux tú usted ustedes vosotros ellos ellas""",
    "self": "i we i'm we're ich wir je nous yo nosotros",
    "future": "will going gonna shall werden",
    "ifuture": "werde vais allons voy vamos",
    "joiner": "and und et y e",
    "lead": "please just go now bitte",
    "copula": "is are am was were be being bist ist sind seid es est êtes sont eres sois son",
    "not": "not never isn't aren't wasn't weren't ain't don't doesn't didn't won't wouldn't can't cannot couldn't shouldn't nicht kein keine keinen nie pas jamais aucun no nunca jamás",
    "filler": "to zu à ne a an the such so very really quite total complete absolute any ein eine so sehr un une des si très una unos muy tan",
    "opine": """think thinks thought believe believes believed mean suppose feel consider denke glaube meine finde halte
        pense penses crois trouve creo pienso opino digo""",
    "speech": """said says saying wrote writes called calls claimed claims told quoted asked reported sagte sagt schrieb nannte
        dit disait écrit appelé dijo dice escribió llamó""",
    "quote": '" “ ” „ « »',
}
#: Words that are read as two: a pronoun and its verb, a verb and its pronoun.
SPLIT = {"i'll": ("i", "will"), "ill": ("i", "will"), "we'll": ("we", "will"), "imma": ("i", "gonna")} | {
    verb + end: (verb, "te" if end == "te" else "ellos") for verb in ("matar", "apuñalar", "golpear", "estrangular") for end in ("te", "os", "lo", "la", "le", "los", "las", "les")
}
#: Weights: bare, aimed, and what a denied or reported one keeps.
INSULT, AIMED, THREAT, AIMED_THREAT = 1.0, 1.5, 0.0, 1.5
DENIED, REPORTED = 0.0, 0.4
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)?|[\"“”„«»]")
_END = frozenset(".!?;\n\r|")


class Arc(NamedTuple):
    to: int
    out: str
    weight: float


class Transducer:
    """Sequential: one arc for each state and tag; a tag without an arc passes unchanged and the state stays."""

    def __init__(self, arcs: dict[tuple[int, str], Arc]):
        self.arcs = arcs

    def step(self, state: int, tag: str) -> Arc:
        return self.arcs.get((state, tag)) or Arc(state, tag, 0.0)

    def states(self) -> list[int]:
        return sorted({0, *(s for s, _ in self.arcs), *(a.to for a in self.arcs.values())})

    def tags(self) -> set[str]:
        return {t for _, t in self.arcs} | {a.out for a in self.arcs.values()}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads as `first`, writes as `second` does on what `first` writes; weights add."""
    wide = len(second.states()) and max(second.states()) + 1
    arcs, seen, todo = {}, {0}, [0]
    tags = first.tags() | second.tags()
    while todo:
        state = todo.pop()
        a, b = divmod(state, wide)
        for tag in tags:
            one = first.step(a, tag)
            two = second.step(b, one.out)
            to = one.to * wide + two.to
            arcs[state, tag] = Arc(to, two.out, one.weight + two.weight)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return Transducer(arcs)


CORE = ("insult", "threat")


def negation() -> Transducer:
    """0 open, 1 behind a copula, future or self word, 2 behind a negator (fillers keep 1 and 2), 3 behind a negator and a target or another word.

    4 behind a negated verb of opinion ("I don't think that you are"), whose whole clause is denied; 5 behind such a verb, which
    passes as another word and whose negator may follow ("ich glaube nicht, dass").
    """
    arcs = {}
    for s in (0, 1, 2, 3, 5):
        arcs[s, "opine"] = Arc(4 if s == 2 else 5, "other", 0)
        for t in ("copula", "future", "ifuture"):
            arcs[s, t] = Arc(s if s in (2, 3) else 1, t, 0)
        for t in ("other", "joiner", "lead", "target"):
            arcs[s, t] = Arc(3 if s == 2 or (s == 3 and t == "target") else 0, t, 0)
        for t in ("self", "speech", "quote"):
            arcs[s, t] = Arc(0, t, 0)
        arcs[s, "not"] = Arc(4 if s == 5 else 2, "not", 0)
        arcs[s, "insult"] = Arc(0, "insult-denied" if s == 2 else "insult", 0)
        arcs[s, "threat"] = Arc(0, "threat-denied" if s in (2, 3) else "threat", 0)
    arcs[4, "opine"] = Arc(4, "other", 0)
    for t in CORE:
        arcs[4, t] = Arc(4, f"{t}-denied", 0)
    for t in ("speech", "quote"):
        arcs[4, t] = Arc(0, t, 0)
    return Transducer(arcs)


def reported() -> Transducer:
    arcs = {(0, "speech"): Arc(1, "speech", 0), (0, "quote"): Arc(2, "quote", 0), (2, "quote"): Arc(0, "quote", 0), (1, "quote"): Arc(2, "quote", 0)}
    for s in (1, 2):
        for t in CORE:
            arcs[s, t] = Arc(s, f"{t}-reported", 0)
    return Transducer(arcs)


def target() -> Transducer:
    """0 a clause begins, 7 nothing; 1 a target stands before, 5 and one word behind it, 9 and a self word by it; 2 an insult stands before and waits for its target.

    3 self, 4 with its future, 10 and one word more, 11 and that one's target, 12 and a joiner: "I will find you and".
    6 such a threat, or one that begins the clause, waits for its target; 8 the speaker's future and the target stand before the verb, 13 and one word more.
    """
    arcs: dict[tuple[int, str], Arc] = {}

    def go(states: tuple[int, ...], tag: str, to: int, out: str = "") -> None:
        arcs.update({(s, tag): Arc(to, out or tag, 0) for s in states})

    for t in ("other", "joiner", "lead"):
        go((0, 2, 3, 5, 6, 10, 11, 12, 13), t, 7)
        go((1, 9), t, 5)
        go((4,), t, 10)
        go((8,), t, 13)
    for t in ("joiner", "lead"):
        go((0,), t, 0)
    go((6,), "joiner", 6)
    go((10, 11), "joiner", 12)
    go((13,), "joiner", 13)
    for t in ("copula", "speech", "future"):
        go((0,), t, 7)
    go((0, 7, 6, 10, 11, 12, 13), "self", 3)
    go((1, 5), "self", 9)
    go((3, 9), "future", 4)
    go((0, 2, 3, 5, 6, 7, 10, 11, 12, 13), "ifuture", 4)
    go((1, 9), "ifuture", 8)
    go((0, 5, 7, 12, 13), "target", 1)
    go((3,), "target", 9)
    go((4,), "target", 8)
    go((10,), "target", 11)
    go((2,), "target", 1, "late-aim")
    go((6,), "target", 1, "threat-aimed")
    go((0, 2, 3, 4, 6, 7, 10, 12), "insult", 2)
    go((1, 5, 8, 9, 11, 13), "insult", 2, "insult-aimed")
    go((1, 3, 5, 7, 9, 11), "threat", 7)
    go((0, 4, 6, 10, 12), "threat", 6)
    go((8, 13), "threat", 1, "threat-aimed")
    for t in ("threat-denied", "threat-reported"):
        go((0, 3, 4, 6, 8, 10, 11, 12, 13), t, 7)
    return Transducer(arcs)


def scoring() -> Transducer:
    weights = {
        "insult": INSULT, "insult-aimed": AIMED, "insult-denied": INSULT * DENIED, "insult-reported": INSULT * REPORTED, "late-aim": AIMED - INSULT,
        "threat": THREAT, "threat-aimed": AIMED_THREAT, "threat-denied": 0.0, "threat-reported": 0.0,
    }
    return Transducer({(0, t): Arc(0, t, w) for t, w in weights.items()})


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    return compose(compose(compose(negation(), reported()), target()), scoring())


class Lexicon:
    """The transducer from words to tags: whole words, then the longest stem of the text's language."""

    def __init__(self, stems: list[tuple[str, str, float]]):
        self.words: dict[str, tuple[str, float]] = {w: (tag, 1.0) for tag, words in WORDS.items() for w in words.split()}
        self.stems: dict[str, dict[str, float]] = defaultdict(dict)
        for lang, stem, weight in stems:
            if stem.endswith("$"):
                self.words.setdefault(stem[:-1], ("insult", weight))
            else:
                for key in (lang, ""):
                    self.stems[key][stem] = max(weight, self.stems[key].get(stem, 0.0))
        self.langs = {lang for lang, _, _ in stems}
        core = {w for w, (t, _) in self.words.items() if t in CORE} | set(self.stems[""])
        self.pattern = "|".join(regex.escape(w, literal_spaces=True) for w in sorted(core))
        self.anchor = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{self.pattern})")

    def tag(self, word: str, lang: str | None) -> tuple[str, float]:
        if word in self.words:
            return self.words[word]
        stems = self.stems[lang if lang in self.langs else ""]
        for k in range(min(len(word), STEM.stop), STEM.start - 1, -1):
            if (w := stems.get(word[:k])) is not None:
                return "insult", w
        return "other", 0.0


def clauses(low: str, anchor: regex.Pattern) -> Iterator[str]:
    """The clauses with an anchor, each once."""
    done = -1
    for m in anchor.finditer(low):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start and low[start - 1] not in _END:
            start -= 1
        while end < len(low) and low[end] not in _END:
            end += 1
        done = end
        yield low[start:end]


def words(clause: str) -> Iterator[str]:
    for m in _WORD.finditer(clause):
        word = m.group().replace("’", "'")
        yield from SPLIT.get(word, (word,))


def clause_scores(clause: str, lexicon: Lexicon, lang: str | None) -> tuple[float, float]:
    """The clause's score, and what of it isn't reported."""
    machine, state, total, firm, weight = grammar(), 0, 0.0, 0.0, 1.0
    for word in words(clause):
        tag, own = lexicon.tag(word, lang)
        arc = machine.step(state, tag)
        if tag in CORE:
            weight = own
        total += arc.weight * weight
        if not arc.out.endswith("-reported"):
            firm += arc.weight * weight
        state = arc.to
    return total, firm


def score(text: str, lexicon: Lexicon, lang: str | None) -> tuple[float, int, float]:
    """(score, number of clauses with a positive score, score without reported marks)."""
    found = [s for c in clauses(text, lexicon.anchor) if (s := clause_scores(c, lexicon, lang))[0] > 0]
    return sum(s for s, _ in found), len(found), sum(f for _, f in found)


# --- stems from labelled rows


def beginnings(text: str) -> set[str]:
    out = set()
    for w in set(regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())):
        out.update(w[:k] for k in STEM if k <= len(w))
        out.add(f"{w[: STEM.stop + 8]}$")
    return out


def _count(wanted: Broadcast | None):
    """Counts texts by language and beginning: of all, or only of those that are wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted else None
        held: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for b in beginnings(text.as_py()):
                    key = (lang, b)
                    if only is None or key in only:
                        held[key] = held.get(key, 0) + 1
                if len(held) > HELD and only is None:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    return count


def _counted(held: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "stem", "n"])


def _counts(texts: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    return texts.select("lang", "text").mapInArrow(_count(wanted), "lang string, stem string, n bigint").groupBy("lang", "stem").agg(F.sum("n").alias("n"))


def choose(rows: list[tuple[str, str, int, int]], totals: dict[str, tuple[int, int]]) -> list[tuple[str, str, float]]:
    """Stems (lang, stem, weight) from (lang, stem, clean texts, toxic texts)."""
    out = []
    for lang, (n_clean, n_toxic) in sorted(totals.items()):
        if not n_clean or not n_toxic:
            continue
        share = n_toxic / (n_clean + n_toxic)
        odds, seen, strength = {}, {}, {}
        for g, stem, clean, toxic in rows:
            if g != lang:
                continue
            seen[stem] = toxic
            o = math.log((toxic / n_toxic) / ((clean + 0.5) / n_clean)) if toxic else 0.0
            n = clean + toxic
            p = toxic / n
            evidence = 2 * (toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0)) if p > share else 0
            strength[stem] = evidence
            if toxic >= LEAST_TEXTS and o >= LEAST_ODDS:
                odds[stem] = o
        for stem in list(odds):
            if not stem.endswith("$"):
                enough = strength[stem] >= STEM_EVIDENCE and odds[stem] >= STEM_ODDS
            elif not (enough := strength[stem] >= LEAST_EVIDENCE):
                # A rarer word counts if what it begins with is toxic beyond doubt.
                enough = strength[stem] >= RARE_EVIDENCE and any(strength.get(stem[:k], 0) >= STEM_EVIDENCE for k in range(5, len(stem) - 1))
            if not enough:
                del odds[stem]
        below = defaultdict(list)
        for stem in odds:
            below[stem[:-1]].append(stem)
        for root in sorted(s for s in odds if s[:-1] not in odds):
            stem = root
            while on := [c for c in below[stem] if seen[c] >= KEEPS * seen[stem]]:
                stem = max(on, key=lambda c: (seen[c], c))
            out.append((lang, stem, min(1.0, odds[stem] / FULL_ODDS)))
    return out


@arrow_udf(StructType([StructField("a", DoubleType()), StructField("b", DoubleType())]))
def _minima(texts: pa.Array) -> pa.Array:
    out = np.full((2, len(texts)), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    for part in passes(texts):
        doc, h = sequence_hashes(*word_hashes(part), 3)
        np.minimum.at(out[0], at + doc, h)
        np.minimum.at(out[1], at + doc, ~h)
        for k in np.flatnonzero(np.bincount(doc, minlength=len(part)) == 0).tolist():
            out[:, at + k] = xxhash.xxh3_64_intdigest((part[k].as_py() or "").lower())
        at += len(part)
    return pa.StructArray.from_arrays([pa.array(out[0].astype(np.float64)), pa.array(out[1].astype(np.float64))], ["a", "b"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> list[tuple[str, str, float]]:
    """Stems from labelled rows; at most a few thousand."""
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    both = docs.select(docs[id_col].alias(id_col), F.struct(lang.alias("lang"), docs[text_col].alias("text")).cast("struct<lang:string,text:string>").alias("both"))
    sample = labelled(both.select(id_col, F.when(F.col("both.text").isNotNull(), F.to_json("both")).alias("both")), labels, "toxic", id_col, "both", rows)
    texts = sample.select(F.from_json("text", "lang string, text string").alias("t"), "y").select("t.lang", "t.text", "y", _minima(F.col("t.text")).alias("m"))
    hashed = texts.select("lang", "text", "y", "m.a", "m.b")
    least = lambda *rest: F.min(F.struct(F.xxhash64("lang", "text").alias("k"), "lang", "text", *rest)).alias("r")
    once = hashed.groupBy("y", "a").agg(least("b")).select("y", "r.*").groupBy("y", "b").agg(least())
    once = cut(once.select("r.lang", "r.text", "y"), "once")
    totals = {r.lang: (r.clean, r.toxic) for r in once.groupBy("lang").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")).collect()}
    # Beginnings of LEAST_TEXTS toxic texts or more; the bounded sample bounds them. Clean texts are counted for these only.
    toxic = {(r.lang, r.stem): r.n for r in _counts(once.where("y = 1")).where(f"n >= {LEAST_TEXTS}").collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = {(r.lang, r.stem): r.n for r in _counts(once.where("y = 0"), wanted).collect()}
    wanted.unpersist()
    return choose([(*key, clean.get(key, 0), n) for key, n in toxic.items()], totals)


# --- scoring a table

SCORED = StructType([StructField("score", DoubleType()), StructField("clauses", IntegerType()), StructField("firm", DoubleType())])


def _scored(docs: DataFrame, stems: list[tuple[str, str, float]], text_col: str, lang_col: str):
    held: list[Lexicon] = []

    @arrow_udf(SCORED)
    def score_all(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not held:
            held.append(Lexicon(stems))
        lexicon = held[0]
        for texts, langs in batches:
            scores, counts, firm, at = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts)), 0
            for part in passes(texts):
                low = pc.utf8_lower(part)
                may = pc.fill_null(pc.match_substring_regex(low, lexicon.pattern), False).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(may).tolist():
                    scores[at + k], counts[at + k], firm[at + k] = score(low[k].as_py(), lexicon, langs[at + k].as_py())
                at += len(part)
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(counts), pa.array(firm)], ["score", "clauses", "firm"])

    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return score_all(docs[text_col].cast("string"), lang)


def rate(docs: DataFrame, stems: list[tuple[str, str, float]], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with toxicity, toxic_clauses and toxic."""
    out = docs.withColumn("toxicity", _scored(docs, stems, text_col, lang_col))
    return out.withColumns({"toxic_clauses": F.col("toxicity.clauses"), "toxic": F.round(F.col("toxicity.firm"), 6) >= THRESHOLD, "toxicity": F.round(F.col("toxicity.score"), 6)})


def civil_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the toxic ones; columns as they are."""
    stems = fit(docs, labels, id_col, text_col, lang_col)
    return docs.where(F.round(_scored(docs, stems, text_col, lang_col)["firm"], 6) < THRESHOLD)


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rate(docs.select("doc_id", "lang", "text"), fit(docs, labels)).drop("text", "lang")


QUERIES = {"op5_toxicity_grammar": op5_toxicity_grammar}
ORACLE_SQL: dict[str, str] = {}
