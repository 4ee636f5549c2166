"""Exact byte-pair encoding by dynamic programming over prefixes, and its inverse.

A text is cut into pre-tokens by the vocabulary's pattern. For every prefix of a pre-token
there is one last token of its encoding. An automaton over all tokens' bytes gives, at each
position, the longest token that ends there, and from each token the next shorter token
that is its suffix; the first of them that may follow the last token of the prefix before
it is stored. Two tokens may follow each other if undoing their merges along the seam, the
latest merge first, meets no pair that would have merged earlier. Following the stored
tokens back from the end gives the ids that repeated merging gives.

The work is done once for each distinct pre-token of a batch, on all of them at once.

Defined results: a null text has null ids, an empty text an empty list; repeated rows give
equal ids; texts of any length are encoded whole; other columns stay as they are; a column
named like the result is replaced; an empty table gives an empty table. Decoding ids that
cut a character in two gives U+FFFD there; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .textkit import buffers, passes

#: Where the public tokenizer files are; a parameter of every function that needs them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AT_ONCE = 1 << 16
LONG = 512
#: Pieces over LONG bytes are encoded together if at least so many are half as long as the longest.
TOGETHER = 96
#: Answers that a long piece keeps.
KNOWN = 1 << 18
DECODED_AT_ONCE = 1 << 19
#: Text bytes encoded together; what a task holds follows it, not the rows of an Arrow batch.
PASS = 6 << 20
#: The same where only counts are wanted, in workers that have other stages' work to do as well: a pass takes some 50 times its bytes.
COUNT_PASS = 1 << 20
NONE = np.int64(1) << 40


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all entries of the ranges [start, start + size), one range after the other."""
    total = np.cumsum(sizes)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])


class Vocabulary:
    def __init__(self, path: str):
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = np.fromiter(map(len, self.tokens), np.int64, n)
        if any(len(t) != 1 for t in self.tokens[:256]):
            raise ValueError(f"{path}: the first 256 ids are not the single bytes")
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self._splits(ranks)
        self._automaton()

    def _splits(self, ranks: dict[bytes, int]) -> None:
        n = len(self.tokens)
        self.left, self.right = np.arange(n), np.arange(n)
        for rank in range(256, n):
            token = self.tokens[rank]
            if not token:
                continue
            ways = [(a, b) for k in range(1, len(token)) if (a := ranks.get(token[:k], n)) < rank and (b := ranks.get(token[k:], n)) < rank]
            if len(ways) > 1:
                ways = [_last_merge(token, rank, ranks)]
            if not ways:
                raise ValueError(f"token {rank} is not made of two earlier ones")
            self.left[rank], self.right[rank] = ways[0]
        made = np.flatnonzero((self.left != np.arange(n)) & (self.size > 0))
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        for key, rank in zip(((self.left[made] << 20) | self.right[made]).tolist(), made.tolist(), strict=True):
            at = int(self._slot(np.int64(key)))
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, rank
        self.known_key = np.full(1 << 21, -1, np.int64)
        self.known = np.zeros(1 << 21, bool)

    def _slot(self, key: np.ndarray, bits: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits or self.bits))).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the token that a and b merge into, or NONE."""
        key = (a << 20) | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        rows, limit = np.arange(len(a)), np.full(len(a), NONE)
        while len(rows):
            early = self.merged(a, b) < limit
            ok[rows[early]] = False
            go = ~early & (np.maximum(a, b) >= 256)
            rows, a, b = rows[go], a[go], b[go]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a, b are the encoding of their joint bytes; answers are kept in a fixed table."""
        key = (a << 20) | b
        at = self._slot(key, 21)
        ok = self.known[at] & (self.known_key[at] == key)
        new = np.flatnonzero(self.known_key[at] != key)
        if len(new):
            ok[new] = self._follows(a[new], b[new])
            # Two keys of one slot may be written in any order: key and answer of the last one stay.
            self.known_key[at[new]] = key[new]
            self.known[at[new]] = ok[new]
            torn = self.known_key[at[new]] != key[new]
            if torn.any():
                self.known_key[at[new[torn]]] = -1
        return ok

    def _automaton(self) -> None:
        ids = np.flatnonzero(self.size > 0)
        node = np.zeros(len(self.tokens), np.int64)
        parents, letters, depths = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [1]
        count, depth = 1, 0
        while len(ids):
            key = node[ids] * 256 + self.data[self.start[ids] + depth]
            new, place = np.unique(key, return_inverse=True)
            node[ids] = count + place
            parents.append(new // 256)
            letters.append(new % 256)
            depths.append(len(new))
            count += len(new)
            depth += 1
            ids = ids[self.size[ids] > depth]
        parent, letter = np.concatenate(parents), np.concatenate(letters)
        ends = np.cumsum(depths)
        own = np.full(count, -1, np.int64)
        real = np.flatnonzero(self.size > 0)
        own[node[real]] = real
        step = np.zeros((count, 256), np.int32)
        fail = np.zeros(count, np.int64)
        step[0, letter[1 : ends[1]]] = np.arange(1, ends[1])
        for d in range(1, len(ends)):
            level = np.arange(ends[d - 1], ends[d])
            if d > 1:
                fail[level] = step[fail[parent[level]], letter[level]]
            step[level] = step[fail[level]]
            if d + 1 < len(ends):
                below = np.arange(ends[d], ends[d + 1])
                step[parent[below], letter[below]] = below
        longest = own.copy()
        for d in range(1, len(ends)):
            level = np.arange(ends[d - 1], ends[d])
            none = level[longest[level] < 0]
            longest[none] = longest[fail[none]]
        self.step, self.longest = step.reshape(-1), longest
        self.shorter = np.full(len(self.tokens), -1, np.int64)
        self.shorter[real] = longest[fail[node[real]]]

    def encode_pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the byte ranges of `raw`, each encoded on its own."""
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        sizes, ids = np.zeros(len(size), np.int64), []
        at = 0
        while at < len(order):
            width = int(size[order[at]]) + 1
            many = max(1, min(AT_ONCE, (AT_ONCE * 64) // width))
            if width > LONG:
                alike = int(np.searchsorted(falling, -(width // 2), side="right")) - at
                if alike < TOGETHER:
                    one = order[at]
                    ids.append(np.array(self._encode_one(raw[start[one] : start[one] + size[one]].tobytes()), np.int64))
                    sizes[one] = len(ids[-1])
                    at += 1
                    continue
                many = min(many, alike)
            part = order[at : at + many]
            flat, count = self._encode_sorted(raw, start[part], size[part])
            ids.append(flat)
            sizes[part] = count
            at += len(part)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        where = np.zeros(len(size), np.int64)
        where[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[ragged(where, sizes)], sizes

    def _encode_sorted(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(start), int(size[0]) + 1 if len(size) else 1
        last = np.full((width, n), -1, np.int32)
        state = np.zeros(n, np.int64)
        for i in range(1, width):
            m = int(np.searchsorted(-size, -i, side="right"))  # pieces of at least i bytes
            state[:m] = self.step[state[:m] * 256 + raw[start[:m] + i - 1]]
            token, rows = self.longest[state[:m]], np.arange(m)
            while len(rows):
                before = i - self.size[token]
                ok = before == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.follows(last[before[inner], rows[inner]].astype(np.int64), token[inner])
                last[i, rows[ok]] = token[ok]
                rows, token = rows[~ok], self.shorter[token[~ok]]
        at, rows, out = size.copy(), np.arange(n), []
        count = np.zeros(n, np.int64)
        rows = rows[at > 0]
        while len(rows):
            token = last[at[rows], rows].astype(np.int64)
            out.append((rows, token))
            count[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        flat = np.zeros(int(count.sum()), np.int64)
        end = np.cumsum(count)
        for k, (rows, token) in enumerate(out):
            flat[end[rows] - 1 - k] = token
        return flat, count

    @cached_property
    def _single(self) -> tuple[dict[int, int], list[int], list[int], list[int], list[int]]:
        """Merges by pair, both parts, sizes and next shorter suffixes, for one token at a time; made when a long piece comes."""
        held = np.flatnonzero(self.keys >= 0)
        merges = dict(zip(self.keys[held].tolist(), self.values[held].tolist(), strict=True))
        return merges, self.left.tolist(), self.right.tolist(), self.size.tolist(), self.shorter.tolist()

    def _encode_one(self, piece: bytes) -> list[int]:
        """The same for one long piece, a position at a time."""
        merges, left, right, size, shorter = self._single
        step, longest = self.step, self.longest
        last, state = [-1] * (len(piece) + 1), 0
        known: dict[int, bool] = {}

        def follows(a: int, b: int) -> bool:
            none = limit = int(NONE)
            while True:
                if merges.get((a << 20) | b, none) < limit:
                    return False
                if a < 256 and b < 256:
                    return True
                if a > b:
                    limit, a = a, right[a]
                else:
                    limit, b = b + 1, left[b]

        for i, byte in enumerate(piece, 1):
            state = int(step[state * 256 + byte])
            token = int(longest[state])
            while before := i - size[token]:
                key = (last[before] << 20) | token
                if (ok := known.get(key)) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    ok = known[key] = follows(last[before], token)
                if ok:
                    break
                token = shorter[token]
            last[i] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        raw, offsets = buffers(texts)
        bounds = word_bounds(raw, offsets)
        if len(bounds) < 2:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        which = words.indices.to_numpy()
        pieces: dict[str, int] = {}
        held, sizes = [], np.zeros(len(words.dictionary), np.int64)
        split = regex.compile(PATTERN).findall
        for k, word in enumerate(words.dictionary.cast(pa.large_string()).to_pylist()):
            found = split(word)
            sizes[k] = len(found)
            held += [pieces.setdefault(p, len(pieces)) for p in found]
        praw, poffs = buffers(pa.array(list(pieces), pa.large_string()))
        flat, count = self.encode_pieces(praw, poffs[:-1], np.diff(poffs))
        first = np.cumsum(count) - count
        held = np.array(held, np.int64)
        word_ids = flat[ragged(first[held], count[held])]
        upto = np.concatenate([[0], np.cumsum(count[held])])
        ends = np.cumsum(sizes)
        word_first, word_count = upto[ends - sizes], upto[ends] - upto[ends - sizes]
        ids = word_ids[ragged(word_first[which], word_count[which])]
        total = np.concatenate([[0], np.cumsum(word_count[which])])
        at = np.searchsorted(bounds, offsets)
        return ids, np.diff(total[at])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is outside the vocabulary")
        data = bytearray()
        for at in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[at : at + DECODED_AT_ONCE]
            data += self.data[ragged(self.start[part], self.size[part])].tobytes()
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        ends = upto[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = bytes(data)
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts begin, and each single space between two characters that aren't white space: pre-tokens end there."""
    if not len(raw):
        return np.zeros(1, np.int64)
    space = raw == 32
    ink = raw > 32
    # A non-ASCII character may be white space, or none; no cut is made beside one that may be.
    odd = (raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)
    cut = np.zeros(len(raw) + 1, bool)
    inner = space[1:-1] & ink[:-2] & ink[2:] & (raw[:-2] < 128) & ~odd[2:]
    cut[1 : len(raw) - 1] = inner
    cut[offsets] = True
    return np.flatnonzero(cut)


def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        k = min(range(len(parts) - 1), key=lambda k: (ranks.get(parts[k] + parts[k + 1], rank), k))
        if ranks.get(parts[k] + parts[k + 1], rank) >= rank:
            raise ValueError(f"token {rank} is not made of two earlier ones")
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return ranks[parts[0]], ranks[parts[1]]


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def _lists(texts: pa.Array, ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch has too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=texts.is_null())


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of the text's token ids."""

    @arrow_udf(ArrayType(IntegerType()))
    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for texts in batches:
            ids, sizes = [], []
            for part in passes(texts, PASS):
                a, b = v.encode(part)
                ids.append(a.astype(np.int32))
                sizes.append(b)
            yield _lists(texts, ids, sizes)

    return _encode(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of the text's tokens; null for a null text."""

    @arrow_udf(LongType())
    def _count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for texts in batches:
            sizes = [v.encode(part)[1] for part in passes(texts, COUNT_PASS)]
            yield pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return _count(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of an array<int> of token ids."""

    @arrow_udf(StringType())
    def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for lists in batches:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = v.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.array([None if no else t.decode("utf-8", "replace") for t, no in zip(texts, lists.is_null().to_pylist(), strict=True)], pa.string())

    return _decode(ids)


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, token_ids, n_tokens, exact) of every row; exact: decoding the ids gives the text again."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in passes(batch.column(1), PASS):
                ids, sizes = v.encode(texts)
                raw, offsets = buffers(texts)
                same = [raw[a:b].tobytes() == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), v.decode(ids, sizes), strict=True)]
                null = texts.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), _lists(texts, [ids.astype(np.int32)], [sizes]), pa.array(sizes, pa.int32(), mask=null), pa.array(same, mask=null)],
                    [id_col, "token_ids", "n_tokens", "exact"],
                )
                at += len(texts)

    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(both, StructType([rows.schema[0], StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("exact", BooleanType())]))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_bpe": op6_bpe}
ORACLE_SQL: dict[str, str] = {}
