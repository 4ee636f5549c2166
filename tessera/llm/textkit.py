"""Vectorised text primitives shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised pass works on; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20
#: Bytes hashed together.
WINDOW_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + _ODD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xA24BAED4963EE407
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return up, down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about `limit` bytes, of one text at least; every text is in exactly one."""
    offsets = buffers(texts)[1]
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield texts.slice(at, to - at)
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of every lower-cased word of the texts, in order.

    A word is a maximal run of ASCII letters and digits and non-ASCII characters. The bytes are
    worked on in windows that end between words, so that a very long text takes no more room at once.
    """
    raw, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    inside = _WORD_BYTE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(raw):
        to = min(len(raw), at + WINDOW_BYTES)
        while to < len(raw) and inside[to] and inside[to - 1] and not first[to]:
            gap = np.flatnonzero(~inside[to : to + WINDOW_BYTES] | first[to : min(len(raw), to + WINDOW_BYTES)])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + WINDOW_BYTES)
        s, h = _window_hashes(raw[at:to], inside[at:to], first[at : to + 1])
        docs.append(np.searchsorted(offsets, at + s, side="right") - 1)
        hashes.append(h)
        at = to
    return np.concatenate(docs), np.concatenate(hashes)


def _window_hashes(raw: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a window."""
    n = len(raw)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(WINDOW_BYTES if n <= WINDOW_BYTES else 1 << int(n).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw] * up[:n], out=total[1:])
        return s, mix64((total[e] - total[s]) * down[s])


def sequence_hashes(doc: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `width` consecutive words within a text."""
    if width <= 1 or len(h) < width:
        return (doc, h) if width <= 1 else (doc[:0], h[:0])
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = mix64(out ^ mix64(h[k : len(h) - width + 1 + k] + np.uint64(k)))
    ok = doc[: len(out)] == doc[width - 1 :]
    return doc[: len(out)][ok], out[ok]
