"""Near-duplicate classes from SimHash fingerprints and sharded vantage-point trees.

A fingerprint has 128 bits: for each bit the majority of that bit over the hashes of the
text's distinct lower-cased words. Two texts are near copies if their fingerprints differ
in at most RADIUS = 19 bits and the smaller number of distinct words is at least four fifths
of the larger (which holds for all pairs of word-set similarity 0.8). The search is exact:

* The first vantage point is the empty text, whose distance from a text is its number of
  distinct words. Its shells are a quarter wide; by the bound above a near copy lies in the
  same shell or the next one, so a fingerprint belongs to its own shell and visits the next.
* A shell of more than BLOCK fingerprints is cut into blocks by a hash, and each pair of its
  blocks is a shard. A shard never holds more than about twice BLOCK, whatever the number of
  copies or of texts of a length; each pair of fingerprints meets in exactly one shard.
* In a shard the fingerprint is cut into eight bands of 16 bits. Two fingerprints within 19 bits
  are within 2 bits in one of the first four bands, or within 1 bit in one of the last four
  (4 * 3 + 4 * 2 = 20 > 19). A vantage-point tree over each band's distinct codes finds the
  code pairs within that radius, pruned by the triangle bound; their fingerprints are held
  against each other on all 128 bits, and a pair counts in its first such band only.

A shard returns a spanning forest of its pairs, and the number of documents that each
fingerprint is linked with; connected components over all shards give the classes. The
document of smallest id of a class is the one kept.

The work is that of all pairs of a shell times the share of codes within the band radii
(about 1 in 100), so it isn't linear; README.md has the figures.

Defined results: null texts and texts without a word are alone in their class; rows with a null
id belong to no class and stay; rows with the same id and fingerprint are one document, rows that
repeat an id with other fingerprints are documents of their own; of equal ids the least
fingerprint is kept; with equal fingerprints (exact copies) the smallest id is kept; an empty
table has no classes. Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .spill import cut
from .textkit import mix64, passes, word_hashes

RADIUS = 19
#: Radius in each of the eight 16-bit bands; sum(r + 1) = RADIUS + 1 makes the search exact.
BAND_RADII = (2, 2, 2, 2, 1, 1, 1, 1)
LEAF_CODES = 256
PAIRS_AT_ONCE = 2_000_000
#: Code pairs of a leaf compared at once: they stay in a core's cache.
CODES_AT_ONCE = 1 << 17
#: Fingerprints of a shell up to which it is one shard; a shard holds at most two blocks.
BLOCK = 524_288
#: Ids (16 bytes each in a hash relation) up to which an anti-join broadcasts them.
BROADCAST_IDS = 2_000_000
#: A key that holds more than this share of the rows is joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n x 2 uint64 fingerprints, and the number of distinct words; zeros for texts without a word."""
    out, sizes = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    at = 0
    for part in passes(texts):
        doc, h = word_hashes(part)
        key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        doc = (key >> np.uint64(40)).astype(np.int64)
        word = key & np.uint64((1 << 40) - 1)
        count = np.bincount(doc, minlength=len(part))
        sizes[at : at + len(part)] = count
        some = np.flatnonzero(count)
        if len(some):
            first = (np.cumsum(count) - count)[some]
            # Runs of up to 255 words: their counts are added in bytes, eight bits at once.
            runs = np.concatenate([np.arange(f, f + c, 255) for f, c in zip(first.tolist(), count[some].tolist(), strict=True)])
            of = np.searchsorted(runs, first)
            for k in range(2):
                bits = np.unpackbits(mix64(word + np.uint64((k + 1) << 50)).view(np.uint8)).view(np.uint64).reshape(-1, 8)
                ones = np.add.reduceat(np.add.reduceat(bits, runs, axis=0).view(np.uint8), of, axis=0, dtype=np.int32)
                packed = np.packbits(2 * ones > count[some, None], axis=1)
                out[at + some, k] = packed.view(np.uint64).ravel()
        at += len(part)
    return out, sizes


@arrow_udf(StructType([StructField("hi", LongType()), StructField("lo", LongType()), StructField("n", IntegerType())]))
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        f, n = fingerprints(texts)
        f = f.view(np.int64)
        yield pa.StructArray.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(n, pa.int32())], ["hi", "lo", "n"], mask=pa.array(n == 0))


def fingerprint(text: Column) -> Column:
    """struct<hi, lo, n> of a text, n its number of distinct words; null for one without words."""
    return _fingerprint(text)


# --- within a shard


class Prints(NamedTuple):
    """Fingerprints of a shard, and the position of each in it."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    at: np.ndarray

    def take(self, rows: np.ndarray) -> Prints:
        return Prints(*(c[rows] for c in self))


def band_codes(hi: np.ndarray, lo: np.ndarray, band: int) -> np.ndarray:
    word = hi if band < 4 else lo
    return ((word >> np.uint64(16 * (band % 4))) & np.uint64(0xFFFF)).astype(np.uint16)


class VantageTree:
    """Over distinct 16-bit codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.root = self._build(np.arange(len(codes)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= LEAF_CODES:
            return idx
        d = np.bitwise_count(self.codes[idx] ^ self.codes[idx[0]])
        near, far = split_distance(d)
        if not near.any() or not far.any():
            return idx
        mu = int(d[near].max())
        return idx[0], mu, self._build(idx[near]), self._build(idx[far])

    def near(self, asked: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """All (index of an asked code, index of a code) within r bits."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        stack = [(self.root, np.arange(len(asked)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, tuple):
                vantage, mu, near, far = node
                d = np.bitwise_count(asked[rows] ^ self.codes[vantage]).astype(np.int16)
                stack.append((near, rows[d - r <= mu]))
                stack.append((far, rows[d + r > mu]))
                continue
            for part in np.array_split(rows, 1 + len(rows) * len(node) // CODES_AT_ONCE):
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(asked[part, None] ^ self.codes[node][None, :]).ravel() <= r), len(node))
                found.append((part[i], node[j]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def split_distance(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near and far side at the distance that parts best; the near side holds all d <= mu."""
    counts = np.cumsum(np.bincount(d, minlength=17))
    mu = int(np.argmin(np.abs(counts - len(d) / 2)))
    return d <= mu, d > mu


def near_pairs(a: Prints, b: Prints, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of near copies of a and b once, as positions; `same`: a and b are the same fingerprints."""
    if not len(a.hi) or not len(b.hi):
        return
    for band, r in enumerate(BAND_RADII):
        ca, cb = band_codes(a.hi, a.lo, band), band_codes(b.hi, b.lo, band)
        order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        x, y = a.take(order_a), b.take(order_b)
        codes_a, first_a, size_a = np.unique(ca[order_a], return_index=True, return_counts=True)
        codes_b, first_b, size_b = np.unique(cb[order_b], return_index=True, return_counts=True)
        i, j = VantageTree(codes_b).near(codes_a, r)
        if same:
            i, j = i[i <= j], j[i <= j]
        for s, t in _chunks(size_a[i] * size_b[j]):
            ci, cj = i[s:t], j[s:t]
            # One range of partners for each row of code i: rows of code j, or the later rows of the same code.
            m = size_a[ci]
            p = np.repeat(first_a[ci] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            start, stop = np.repeat(first_b[cj], m), np.repeat(first_b[cj] + size_b[cj], m)
            if same:
                start = np.where(np.repeat(ci == cj, m), p + 1, start)
            for u, v in _chunks(stop - start):
                m = stop[u:v] - start[u:v]
                pp = np.repeat(p[u:v], m)
                qq = np.repeat(start[u:v] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                d = np.bitwise_count(x.hi[pp] ^ y.hi[qq])
                close = np.flatnonzero(d <= RADIUS)
                pp, qq = pp[close], qq[close]
                close = d[close] + np.bitwise_count(x.lo[pp] ^ y.lo[qq]) <= RADIUS
                close &= 5 * np.minimum(x.n[pp], y.n[qq]) >= 4 * np.maximum(x.n[pp], y.n[qq])
                pp, qq = pp[close], qq[close]
                for earlier in range(band):
                    new = np.bitwise_count(band_codes(x.hi[pp], x.lo[pp], earlier) ^ band_codes(y.hi[qq], y.lo[qq], earlier)) > BAND_RADII[earlier]
                    pp, qq = pp[new], qq[new]
                if len(pp):
                    yield x.at[pp], y.at[qq]


def shard_links(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, weight: np.ndarray, own: np.ndarray, block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(component, linked documents) of each fingerprint of a shard by the pairs that meet in it.

    A shard of one block has its owners' pairs and those with visitors; one of two blocks has
    the pairs across them in which an owner takes part. A component is its smallest position.
    """
    every = Prints(hi, lo, n, np.arange(len(hi)))
    side = lambda of, which: every.take(np.flatnonzero((block == of) & (own == which)))
    blocks = np.unique(block).tolist()
    label, links = np.arange(len(hi)), np.zeros(len(hi), np.int64)
    if not across:
        parts = [(side(blocks[0], True), side(blocks[0], True), True), (side(blocks[0], True), side(blocks[0], False), False)]
    else:
        g, h = blocks if len(blocks) == 2 else (-1, -1)
        parts = [(side(g, True), side(h, True), False), (side(g, True), side(h, False), False), (side(g, False), side(h, True), False)]
    for a, b, same in parts:
        for x, y in near_pairs(a, b, same):
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            label = merge(label, x, y)
    return label, links


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add to about PAIRS_AT_ONCE."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, side="right")))
        yield at, to
        at = to


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component labels after joining the pairs x, y; a label is the smallest index of its component."""
    while True:
        a, b = label[x], label[y]
        small, large = np.minimum(a, b), np.maximum(a, b)
        open_ = small != large
        if not open_.any():
            return label
        x, y, small, large = x[open_], y[open_], small[open_], large[open_]
        np.minimum.at(label, large, small)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


# --- the distributed plan


def shell(n: np.ndarray) -> np.ndarray:
    """Shells around the empty text; 4/5 of a number lies in its own shell or the one before."""
    return np.searchsorted(_EDGES, n, side="right").astype(np.int32)


def _edges() -> np.ndarray:
    """First numbers of words of the shells: each is more than 5/4 of the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


_EDGES = _edges()
NODE = "struct<id:bigint,hi:bigint,lo:bigint,n:int>"


def shards_of(node: np.ndarray, of: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shard, block, whether the shard is across two blocks) for fingerprints in shells `of` of so many blocks each; `first` is a shell's first shard number."""
    count = blocks[of]
    mine = (mix64(node) % np.maximum(count, 1).astype(np.uint64)).astype(np.int64)
    for other in range(int(count.max(initial=0))):
        rows = np.flatnonzero(other < count)
        g, h = np.minimum(mine[rows], other), np.maximum(mine[rows], other)
        yield rows, first[of[rows]] + h * (h + 1) // 2 + g, mine[rows], g != h


def links(groups: DataFrame) -> DataFrame:
    """(u, v, m) from (node, w): u > v are linked nodes, m adds to the documents that u is linked with; one of v and m is null."""
    counts = groups.select(_shell(F.col("node")["n"]).alias("s")).groupBy("s").count().collect()  # at most one row for each shell
    own = np.zeros(len(_EDGES) + 2, np.int64)
    for r in counts:
        own[r.s] = r["count"]
    blocks = np.where(own > 0, -(-(own + np.roll(own, 1)) // BLOCK), 0)
    first = np.cumsum(blocks * (blocks + 1) // 2) - blocks * (blocks + 1) // 2
    shards = int((blocks * (blocks + 1) // 2).sum())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0)
            hi, lo, n = (node.field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "n"))
            key = hi.view(np.uint64) ^ mix64(lo.view(np.uint64))
            for visit in (0, 1):
                for rows, shard, block, across in shards_of(key, shell(n) + visit, blocks, first):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), node.take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), not visit)), pa.array(block), pa.array(across)],
                        ["shard", "node", "w", "own", "block", "across"],
                    )

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node = t.column("node").combine_chunks()
        node = node.chunk(0) if isinstance(node, pa.ChunkedArray) else node
        hi, lo, n = (node.field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "n"))
        w, own, block, across = (t.column(c).to_numpy() for c in ("w", "own", "block", "across"))
        # In the order of ids, so that a component's smallest position has its smallest node.
        order = np.lexsort((n, lo, hi, node.field("id").to_numpy(zero_copy_only=False)))
        label, linked = shard_links(hi[order].view(np.uint64), lo[order].view(np.uint64), n[order].astype(np.int64), w[order], own[order], block[order], bool(across[0]))
        tied, counted = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(linked)
        u = node.take(pa.array(order[np.concatenate([tied, counted])]))
        v = node.take(pa.array(np.concatenate([order[label[tied]], np.zeros(len(counted), np.int64)]), mask=np.arange(len(u)) >= len(tied)))
        m = pa.array(np.concatenate([np.zeros(len(tied), np.int64), linked[counted]]), mask=np.arange(len(u)) < len(tied))
        return pa.table([u, v, m], ["u", "v", "m"])

    sent = groups.select("node", "w").mapInArrow(send, f"shard bigint, node {NODE}, w bigint, own boolean, block bigint, across boolean")
    return sent.repartition(max(1, 2 * shards), "shard").groupBy("shard").applyInArrow(search, f"u {NODE}, v {NODE}, m bigint")


@arrow_udf(IntegerType())
def _shell(n: pa.Array) -> pa.Array:
    return pa.array(shell(n.to_numpy(zero_copy_only=False)), pa.int32())


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(id, root) for every id (of any ordered type) that is not the smallest of its component; large-star and small-star rounds."""
    edges = cut(edges.where("u > v").distinct(), "edges")
    for _ in range(most):
        if _stars(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        edges = cut(small, "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself: then v is the smallest of its component."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    return ends.groupBy("k").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 or (u > 0 and v > 0)").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links, keep): a row for each document; class_id is the smallest id of its class, links the number of its near copies."""
    prints = _prints(docs, id_col, text_col)
    alone = prints.where("hi is null").select("id").distinct()
    alone = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("keep"))
    return _classes(prints).select(F.col("id").alias("doc_id"), "class_id", "links", "keep").unionByName(alone)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo, n) of every row with an id; null for texts without words."""
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("bigint").alias("id"), fingerprint(docs[text_col]).alias("f"))
    return cut(rows.select("id", "f.hi", "f.lo", "f.n"), "prints")


def _classes(prints: DataFrame) -> DataFrame:
    """(id, hi, lo, n, class_id, links, keep) of every document with words."""
    key = ["hi", "lo", "n"]
    members = cut(prints.where("hi is not null").distinct(), "members")
    groups = cut(members.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select(F.struct("id", *key).alias("node"), "w"), "groups")
    found = cut(links(groups), "links")
    roots = components(found.where("v is not null").select("u", "v"))
    # What is known of a node is gathered in one shuffle.
    none = lambda kind: F.lit(None).cast(kind)
    known = groups.select("node", "w", none(NODE).alias("root"), none("bigint").alias("m"))
    known = known.unionByName(roots.select(F.col("id").alias("node"), none("bigint").alias("w"), "root", none("bigint").alias("m")))
    known = known.unionByName(found.where("m is not null").select(F.col("u").alias("node"), none("bigint").alias("w"), none(NODE).alias("root"), "m"))
    nodes = known.groupBy("node").agg(F.max("w").alias("w"), F.max("root").alias("root"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).where("w > 1 or m > 0")
    nodes = cut(nodes.select("node.hi", "node.lo", "node.n", "w", F.coalesce("root", "node").alias("root"), (F.col("w") - 1 + F.col("m")).alias("links")), "nodes")
    joined = _with_hot(members, nodes, key, members.count())
    first = F.struct("id", *key) == F.col("root")
    return joined.select("id", *key, F.coalesce("root.id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(first, F.lit(True)).alias("keep"))


def _with_hot(rows: DataFrame, table: DataFrame, key: list[str], n: int) -> DataFrame:
    """`rows` left-joined with `table` (w is the number of rows of its key); keys of many rows are broadcast, so none meets in one task."""
    least = max(1_000, int(n * HOT_SHARE))
    hot = F.broadcast(table.where(F.col("w") >= least))
    cold = rows.join(hot.select(*key), key, "left_anti").join(table.where(F.col("w") < least), key, "left")
    return rows.join(hot, key).unionByName(cold)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that aren't kept, and with one row for each that is; columns as they are."""
    prints = _prints(docs, id_col, text_col)
    verdict = cut(_classes(prints).select("id", "hi", "lo", "n", "keep"), "verdict")
    repeated = cut(prints.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("hi").alias("some")).where("rows > 1 and some > 0").select(F.col("id").alias("gone")), "repeated")
    gone = cut(verdict.where("not keep").select(F.col("id").alias("gone")).unionByName(repeated).distinct(), "gone")
    kept = without(docs, gone, id_col)
    if repeated.isEmpty():
        return kept
    # Of an id with several rows, each row goes by its own fingerprint; of equal ones the least row by its texts and numbers stays.
    again = docs.join(repeated, docs[id_col].cast("bigint") == repeated["gone"], "left_semi")
    again = again.select(F.struct(*(again[f"`{c}`"] for c in again.columns)).alias("row"), again[id_col].cast("bigint").alias("id"), fingerprint(again[text_col]).alias("f"))
    wordless = again.where("f is null").select("row.*")
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "double", "float", "boolean", "date", "timestamp")]
    one = again.where("f is not null").groupBy("id", "f.hi", "f.lo", "f.n").agg(F.min_by("row", F.struct(f"row.`{text_col}`", *plain)).alias("row"))
    one = one.join(verdict.where("keep"), ["id", "hi", "lo", "n"], "left_semi").select("row.*")
    return kept.unionByName(one).unionByName(wordless)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Anti-join on `gone`; it is broadcast while it has at most BROADCAST_IDS rows, so that texts aren't shuffled."""
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("bigint") == gone["gone"], "left_anti")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_simhash_near_duplicates": op3_simhash_near_duplicates}
ORACLE_SQL: dict[str, str] = {}
