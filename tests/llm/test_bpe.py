import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

from .helpers import docs, empty, odd


@pytest.fixture(scope="module")
def reference():
    v = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: k for k, t in enumerate(v.tokens)}, special_tokens={})


def ids_of(text):
    ids, sizes = bpe.vocabulary().encode(pa.array([text]))
    assert sizes.tolist() == [len(ids)]
    return ids.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, text):
    assert ids_of(text) == reference.encode_ordinary(text)


def test_mixed_white_space_and_letters(reference):
    rng = random.Random(5)
    letters = " \n\t 　\x85aábcéñthe'sll1234567890.,!?日本語🙂 x"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert ids_of(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 3000, "x" + "é" * 1500, "=-" * 1200, "the" * 900, "日本" * 800])
def test_long_pieces(text, reference):
    assert ids_of(text) == reference.encode_ordinary(text)


def test_last_token_is_unique():
    """For every prefix exactly one token that ends there may follow the prefix before it."""
    v = bpe.vocabulary()
    text = b" thanedbleer"
    ranks = {t: k for k, t in enumerate(v.tokens)}
    last = {0: None}
    for i in range(1, len(text) + 1):
        ways = []
        for j in range(i):
            token = ranks.get(text[j:i])
            if token is not None and (j == 0 or v._follows(np.array([last[j]]), np.array([token]))[0]):
                ways.append(token)
        assert len(ways) == 1
        last[i] = ways[0]


def test_batches_keep_texts_apart(reference):
    texts = ["hello world", "", None, " hello", "world\n", "hello world"]
    ids, sizes = bpe.vocabulary().encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference.encode_ordinary(t or "") for t in texts]


def test_columns(spark, reference):
    texts = ["The end of the line.", "", None, "él 🙂"]
    frame = docs(spark, texts)
    held = frame.withColumn("ids", bpe.encode(frame["text"]))
    rows = held.withColumn("back", bpe.decode(held["ids"])).orderBy("doc_id").collect()
    assert [r.back for r in rows] == texts
    assert [r.ids for r in rows] == [None if t is None else reference.encode_ordinary(t) for t in texts]


def test_odd_tables(spark):
    rows = bpe.encode_and_check(odd(spark)).collect()
    assert len(rows) == 10
    for r in rows:
        assert (r.token_ids is None and r.exact is None and r.n_tokens is None) or (r.exact and r.n_tokens == len(r.token_ids))
    assert [r.token_ids for r in rows if r.doc_id == 2] == [[]] and sum(r.token_ids is None for r in rows) == 2
    assert bpe.encode_and_check(empty(spark)).count() == 0


def test_unknown_id():
    with pytest.raises(ValueError):
        bpe.vocabulary().decode(np.array([10**7]), np.array([1]))


def test_long_pieces_alone_and_among_others(reference):
    rng = random.Random(8)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(letters) for _ in range(n))
    texts = [word(60_000), word(600, "ab"), *(word(rng.randint(500, 1500)) for _ in range(150)), *(word(9) for _ in range(50)), word(40_000, "aé"), "字" * 20_000]
    ids, sizes = bpe.vocabulary().encode(pa.array(texts))
    assert ids.tolist() == [t for x in texts for t in reference.encode_ordinary(x)]
    assert sizes.tolist() == [len(reference.encode_ordinary(x)) for x in texts]
