"""Full text: tables of postings and BM25 over them.

An index is three tables: postings (term, chunk_id, tf, positions), doc_stats (chunk_id, dl)
and the corpus counts (n, total length). A query reads only the postings of its terms, one
pass and one shuffle by chunk for all of its words and phrases together.

score(d, q) = sum over terms of boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

n, df and avgdl are those of the whole collection, filtered or not. A phrase counts as one
term whose frequency is the number of its occurrences and whose weight is the sum of its words'.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.operators.fusion import best_of, top
from tessera.plans import textquery as Q
from tessera.sources.shared import shared_folder, shared_table

K1, B = 1.2, 0.75
POSTINGS = "term string, chunk_id bigint, tf int, positions array<int>"
#: Chunks whose terms a task groups together, and bytes of their texts.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_000, 512 << 10
#: A table of fewer bytes than this for each core is spread over all of them before it is scanned.
SPREAD_BYTES = 128 << 20
DOC_STATS = "chunk_id bigint, dl int"


def postings(chunks: DataFrame, analyzer: str = "english", places: bool = True) -> DataFrame:
    """(term, chunk_id, tf, positions) from (id, text), or without the positions. A chunk is one row, so nothing is shuffled.

    Blocks of chunks come sorted by term and chunk.
    """
    if analyzer not in analysis.ANALYZERS:
        raise ValueError(f"analyzer is one of {analysis.ANALYZERS}, not {analyzer!r}")
    split = analysis.Splitter(chunks.sparkSession)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                yield _grouped(part, analyzer, split, places)

    texts = chunks.select(F.col("id").cast("bigint").alias("chunk_id"), F.lower("text").alias("text")).where("text is not null")
    return texts.mapInArrow(grouped, POSTINGS if places else POSTINGS.rsplit(",", 1)[0])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(term): each term of the simple analyzer in (text) once."""
    split = analysis.Splitter(texts.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [split(part.column(0))[0].unique() for part in blocks(b, 0)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(terms).unique() if terms else pa.array([], pa.string())], ["term"])

    return texts.select(F.lower("text").alias("text")).where("text is not null").mapInArrow(found, "term string").distinct()


def blocks(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ROWS_AT_ONCE rows at most, and of about BYTES_AT_ONCE in the column of texts; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < b.num_rows:
        fit = int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES_AT_ONCE, side="right"))
        to = min(max(fit, at + 1), at + ROWS_AT_ONCE)
        yield b.slice(at, to - at)
        at = to


def _grouped(b: pa.RecordBatch, analyzer: str, split: analysis.Splitter, places: bool) -> pa.RecordBatch:
    words, row = split(b.column(1))
    words = words.dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if analyzer == "english":
        stems = pa.array([analysis.stem(t) for t in names.to_pylist()], pa.string()).dictionary_encode()
        code, names = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], stems.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = b.column(0)
    rows = pc.sort_indices(ids).to_numpy()
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    # One number for term, chunk and occurrence: its order is theirs.
    bits = max(1, len(code).bit_length())
    key = np.sort(((rank[code] * max(1, b.num_rows) + place[row]) << bits) | np.arange(len(code)))
    at = key & ((1 << bits) - 1)
    first = np.flatnonzero(np.diff(key >> bits, prepend=-1))
    ends = np.append(first[1:], len(key)) if len(first) else first
    columns = [names.take(pa.array(code[at[first]])).cast(pa.string()), ids.take(pa.array(row[at[first]])), pa.array(ends - first, pa.int32())]
    if places:
        begins = np.searchsorted(row, np.arange(b.num_rows))  # of each chunk's terms
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(at - begins[row[at]], pa.int32())))
    return pa.RecordBatch.from_arrays(columns, ["term", "chunk_id", "tf", "positions"][: len(columns)])


def doc_stats(chunks: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(chunk_id, dl): number of terms; stemming doesn't change it."""
    return chunks.select(F.col("id").alias("chunk_id"), F.coalesce(F.size(analysis.terms(F.col("text"), "simple")), F.lit(0)).alias("dl"))


def corpus_counts(stats: DataFrame) -> tuple[int, int]:
    r = stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    return int(r.n), int(r.total)


@dataclass
class Leaf:
    """A word or phrase of the query, with the columns it becomes."""

    terms: list[str]
    slop: int
    prefix: bool
    boost: float
    tf: str
    idf: float = 0.0


class FullText:
    """Searches over an index; `chunks` (id, text and the fields of queries) is read only by queries that need it."""

    def __init__(self, chunks: DataFrame, postings: DataFrame, doc_stats: DataFrame, n: int, total: int, analyzer: str = "english"):
        self.chunks, self.postings, self.doc_stats = chunks, postings, doc_stats
        self.n, self.avgdl, self.analyzer = n, (total / n if n and total else 1.0), analyzer

    @staticmethod
    def build(chunks: DataFrame, analyzer: str = "english") -> FullText:
        """An index that isn't stored, over the chunks as they are."""
        stats = doc_stats(chunks)
        return FullText(chunks, postings(chunks, analyzer), stats, *corpus_counts(stats), analyzer)

    # --- planning

    def _leaves(self, node: Q.Node, boost: float, out: list[Leaf]) -> tuple[Column, Column, bool]:
        """(matches, score, whether chunks without a word of the query may match)."""
        boost *= node.boost
        if isinstance(node, Q.All):
            return F.lit(True), F.lit(boost), True
        if isinstance(node, Q.Words):
            words = analysis.query_terms(node.text, self.analyzer)
            if node.prefix and words:
                words[-1] = analysis.query_terms(node.text, "simple")[-1]
            if not words:
                return F.lit(False), F.lit(0.0), False
            leaf = Leaf(words, node.slop, node.prefix and len(words) > 1, boost, f"tf{len(out)}")
            out.append(leaf)
            return F.col(leaf.tf) > 0, F.col(f"s_{leaf.tf}"), False
        if isinstance(node, Q.Bool):
            must, should, never = ([self._leaves(n, boost, out) for n in part] for part in (node.must, node.should, node.must_not))
            needed = [m for m, _, _ in must] or [reduce(Column.__or__, [m for m, _, _ in should])]
            match = reduce(Column.__and__, needed + [~m for m, _, _ in never])
            score = reduce(Column.__add__, [s if certain else F.when(m, s).otherwise(0.0) for certain, part in ((True, must), (False, should)) for m, s, _ in part])
            wide = all(w for _, _, w in must) if must else any(w for _, _, w in should)
            return match, score, wide
        return self._field(node), F.lit(boost), True

    def _field(self, node: Q.Node) -> Column:
        number = node.name in Q.NUMBER_FIELDS
        if node.name == "text":
            raise Q.QueryError("ranges and lists of the text field aren't supported")
        column = F.col(node.name)
        cast = (lambda v: F.lit(int(v))) if number else F.lit
        if isinstance(node, Q.Equals):
            match = column == cast(node.value)
        elif isinstance(node, Q.OneOf):
            match = column.isin([int(v) if number else v for v in node.values]) if node.values else F.lit(False)
        else:
            match = column.isNotNull()
            if node.low is not None:
                match &= column > cast(node.low) if node.low_open else column >= cast(node.low)
            if node.high is not None:
                match &= column < cast(node.high) if node.high_open else column <= cast(node.high)
        return F.coalesce(match, F.lit(False))

    def _wanted(self, leaves: list[Leaf]) -> Column:
        exact = sorted({t for leaf in leaves for t in (leaf.terms[:-1] if leaf.prefix else leaf.terms)})
        ways = [F.col("term").isin(exact)] if exact else []
        return reduce(Column.__or__, ways + [F.col("term").startswith(leaf.terms[-1]) for leaf in leaves if leaf.prefix])

    def _count(self, term: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("term") == term, F.col("tf"))), F.lit(0))

    def _positions(self, term: str, prefix: bool) -> Column:
        same = F.col("term").startswith(term) if prefix else F.col("term") == term
        return F.flatten(F.collect_list(F.when(same, F.col("positions"))))

    def _frequency(self, leaf: Leaf) -> Column:
        """A leaf's frequency in a chunk."""
        if len(leaf.terms) == 1:
            return self._count(leaf.terms[0])
        where = [F.transform(self._positions(t, leaf.prefix and k == len(leaf.terms) - 1), _moved(k)) for k, t in enumerate(leaf.terms)]
        if not leaf.slop:
            return F.size(reduce(F.array_intersect, where))

        # Words may be moved by so many places together.
        def near(p: Column) -> Column:
            moved = [F.array_min(F.transform(w, lambda x: F.abs(x - p))) for w in where[1:]]
            return F.coalesce(reduce(Column.__add__, moved) <= leaf.slop, F.lit(False))

        return F.size(F.filter(where[0], near))

    def _rows(self, leaves: list[Leaf], wide: bool) -> tuple[DataFrame, dict[str, int]]:
        """(chunk_id, dl, the leaves' frequencies, fields) of chunks that may match, and the df of every term."""
        rows = self.postings.where(self._wanted(leaves)).groupBy("chunk_id").agg(*(self._frequency(leaf).alias(leaf.tf) for leaf in leaves)).join(self.doc_stats, "chunk_id")
        return rows, self._document_frequencies(leaves)

    def _document_frequencies(self, leaves: list[Leaf]) -> dict[str, int]:
        """df of every term of the query (of all terms together for a prefix); a few rows reach the driver."""
        terms = sorted({t for leaf in leaves for t in leaf.terms})
        exact = self.postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        out = {r.term: r.df for r in exact.collect()}
        for leaf in leaves:
            if leaf.prefix:
                out[leaf.terms[-1] + "*"] = self.postings.where(F.col("term").startswith(leaf.terms[-1])).select("chunk_id").distinct().count()
        return out

    def idf(self, df: int) -> float:
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    # --- running

    def matches(self, query: str, score: bool = True) -> DataFrame:
        """(chunk_id, score) of every chunk that the query matches; a query that can't be parsed is one raw term."""
        try:
            return self._matches(Q.parse(query))
        except Q.QueryError:
            return self._matches(None, raw=query)

    def _matches(self, node: Q.Node | None, raw: str = "") -> DataFrame:
        leaves: list[Leaf] = []
        if node is None:
            leaves.append(Leaf([raw], 0, False, 1.0, "tf0"))
            match, score, wide = F.col("tf0") > 0, F.col("s_tf0"), False
        else:
            match, score, wide = self._leaves(node, 1.0, leaves)
        if not leaves:
            return self._all(match, score)
        rows, df = self._rows(leaves, wide or node is not None and _has_field(node))
        for leaf in leaves:
            names = [t + "*" if leaf.prefix and k == len(leaf.terms) - 1 else t for k, t in enumerate(leaf.terms)]
            leaf.idf = sum(self.idf(df.get(t, 0)) for t in names)
        scores = {}
        for leaf in leaves:
            tf, dl = F.col(leaf.tf).cast("double"), F.col("dl").cast("double")
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))
            scores[f"s_{leaf.tf}"] = F.when(tf > 0, part * (leaf.idf * leaf.boost)).otherwise(0.0)
        rows = rows.withColumns(scores)
        if wide or node is not None and _has_field(node):
            rows = self._with_fields(rows, wide).fillna(0, [leaf.tf for leaf in leaves]).fillna(0.0, list(scores))
        return rows.where(match).select("chunk_id", score.cast("double").alias("score"))

    def _all(self, match: Column, score: Column) -> DataFrame:
        """Chunks that match by their fields alone."""
        return self.chunks.where(match).select(F.col("id").alias("chunk_id"), score.cast("double").alias("score"))

    def _with_fields(self, rows: DataFrame, wide: bool) -> DataFrame:
        fields = [F.col(c).alias(c) for c in self.chunks.columns if c in Q.NUMBER_FIELDS | Q.RAW_FIELDS]
        held = self.chunks.select(*fields)
        return held.join(rows, held["id"] == rows["chunk_id"], "left" if wide else "inner").drop("chunk_id").withColumn("chunk_id", F.col("id"))

    def search(self, query: str, limit: int, eligible: DataFrame | None = None) -> DataFrame:
        """The `limit` best (chunk_id, score), among the eligible ids if they are given."""
        found = self.matches(query)
        if eligible is not None:
            found = found.join(eligible.select("chunk_id"), "chunk_id", "left_semi")
        return top(found, limit)


class TextScan(FullText):
    """Searches without an index: one pass over the texts counts the query's words in each chunk.

    The counts, a few numbers for each chunk, are written to the shared folder, and both the
    corpus counts and the scores are taken from them.
    """

    def __init__(self, chunks: DataFrame, analyzer: str = "english"):
        super().__init__(chunks, chunks, chunks, 0, 0, analyzer)
        self._condition: Column | None = None

    def search(self, query: str, limit: int, eligible: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
        """As above; a condition on the chunks' own columns is met in the same pass, without a join."""
        self._condition = condition
        try:
            return super().search(query, limit, eligible)
        finally:
            self._condition = None

    def _all(self, match: Column, score: Column) -> DataFrame:
        return super()._all(match if self._condition is None else match & F.coalesce(self._condition, F.lit(False)), score)

    def _count(self, term: str) -> Column:
        return F.size(F.filter("terms", lambda t: t == term))

    def _positions(self, term: str, prefix: bool) -> Column:
        places = F.transform("terms", lambda t, i: F.when(t.startswith(term) if prefix else t == term, i))
        return F.filter(places, lambda i: i.isNotNull())

    def _rows(self, leaves: list[Leaf], wide: bool) -> tuple[DataFrame, dict[str, int]]:
        spark = self.chunks.sparkSession
        cores = spark.sparkContext.defaultParallelism
        met = F.lit(True) if self._condition is None else F.coalesce(self._condition, F.lit(False))
        chunks = self.chunks.withColumn("__met", met)
        if int(str(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES * cores:
            chunks = chunks.select(*[c for c in chunks.columns if c in ("text", "__met") or c in Q.NUMBER_FIELDS | Q.RAW_FIELDS]).repartition(cores)
        has = {t: F.array_contains("terms", t) for leaf in leaves for k, t in enumerate(leaf.terms) if not (leaf.prefix and k == len(leaf.terms) - 1)}
        has |= {leaf.terms[-1] + "*": F.exists("terms", _begins(leaf.terms[-1])) for leaf in leaves if leaf.prefix}
        names = {t: f"has{k}" for k, t in enumerate(has)}
        empty = F.array().cast("array<string>")
        words = chunks.withColumn("terms", F.coalesce(analysis.terms(F.col("text"), self.analyzer), empty)).withColumn("chunk_id", F.col("id"))
        fields = [c for c in chunks.columns if c in Q.NUMBER_FIELDS | Q.RAW_FIELDS]
        rows = words.select("chunk_id", "__met", *fields, F.size("terms").alias("dl"), *(self._frequency(leaf).alias(leaf.tf) for leaf in leaves), *(has[t].alias(n) for t, n in names.items()))
        path = shared_folder(spark, "counts")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *(F.count_if(n).alias(n) for n in names.values())).first()
        self.n, self.avgdl = r.n, (r.total / r.n if r.n and r.total else 1.0)
        return rows.where("__met"), {t: r[n] for t, n in names.items()}

    def _with_fields(self, rows: DataFrame, wide: bool) -> DataFrame:
        return rows


def _begins(word: str) -> Callable[[Column], Column]:
    return lambda t: t.startswith(word)


def _moved(places: int) -> Callable[[Column], Column]:
    return lambda p: p - places


def _has_field(node: Q.Node) -> bool:
    if isinstance(node, Q.Bool):
        return any(_has_field(n) for part in (node.must, node.should, node.must_not) for n in part)
    return isinstance(node, (Q.Equals, Q.Range, Q.OneOf))


# --- many queries at once

#: Words of queries (of all of them together) that are scored in one pass, and pairs of a word and a query at once.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 500_000, 4_000_000


def search_many(chunks: DataFrame, queries: DataFrame, k: int, analyzer: str = "english") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks (id, text) for each query (query_id, text), any of its words.

    The texts are analysed once. Their counts of the queries' words are written; each pass over these
    scores a bounded block of queries, and only k rows of a query and task are shuffled. A word that a
    query repeats counts once.
    """
    spark = chunks.sparkSession
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.explode(F.array_distinct(analysis.terms(F.col("text"), analyzer))).alias("term"))
    asked = shared_table(asked, "asked")
    blocks = max(1, -(-asked.count() // WORDS_AT_ONCE))
    held = shared_table(_counts(chunks, asked.select("term").distinct(), analyzer), "counts")
    stats = shared_table(doc_stats(chunks), "lengths")
    n, total = corpus_counts(stats)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = shared_table(asked.join(df.select("term", idf.alias("idf")), "term").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "words")
    # The rows of a chunk lie together, as they were counted.
    rows = held.join(stats, "chunk_id").select("chunk_id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(total / n if total else 1.0)))).alias("part"))
    rows = rows.repartition("chunk_id").sortWithinPartitions("chunk_id")
    found = [rows.mapInArrow(_scores(spark, words.where(F.col("block") == b), k), "query_id bigint, chunk_id bigint, score double") for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _counts(chunks: DataFrame, terms: DataFrame, analyzer: str) -> DataFrame:
    return postings(chunks, analyzer, places=False).select("chunk_id", "term", "tf").join(terms, "term", "left_semi")


def _scores(spark: SparkSession, words: DataFrame, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best chunks of each query, from (chunk_id, term, part); `words` is a block, so it has a bounded number of rows."""
    block = words.select("query_id", "term", "idf").orderBy("term", "query_id").toPandas()
    names, first = np.unique(block["term"].to_numpy(dtype=object).astype(str), return_index=True) if len(block) else (np.zeros(0, "U1"), np.zeros(0, np.int64))
    ids, query = np.unique(block["query_id"].to_numpy(np.int64), return_inverse=True)
    sent = spark.sparkContext.broadcast((pa.array(names.tolist(), pa.string()), np.append(first, len(block)).astype(np.int64), ids, query, block["idf"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, ids, query, idf = sent.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        rest: list[pa.RecordBatch] = []

        def take(b: pa.RecordBatch) -> None:
            nonlocal best
            code = pc.index_in(b.column(1), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.flatnonzero(code >= 0)
            chunk, code, part = b.column(0).to_numpy()[known], code[known], b.column(2).to_numpy()[known]
            size = first[code + 1] - first[code]
            ends = np.append(np.flatnonzero(np.diff(chunk)) + 1, len(chunk))  # a chunk is scored whole
            total, at = np.cumsum(size), 0
            while at < len(chunk):
                base = total[at - 1] if at else 0
                e = ends[(ends > at) & (total[ends - 1] <= base + PAIRS_AT_ONCE)]
                to = int(e[-1]) if len(e) else int(ends[ends > at][0])
                m = size[at:to]
                row = np.repeat(np.arange(at, to), m)
                w = np.repeat(first[code[at:to]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                names_of, local = np.unique(chunk[at:to], return_inverse=True)
                key, where = np.unique(local[row - at] * len(ids) + query[w], return_inverse=True)
                s = np.floor(np.bincount(where, part[row] * idf[w], len(key)) * 1e9 + 0.5) / 1e9
                best = best_of(k, *(np.concatenate(p) for p in zip(best, (key % len(ids), names_of[key // len(ids)], s), strict=True)))
                at = to

        for b in batches:
            if not b.num_rows:
                continue
            if rest and rest[-1].column(0)[-1].as_py() != b.column(0)[0].as_py():
                take(_joined(rest))
                rest = []
            # The last chunk's rows may go on in the next batch.
            ids_here = b.column(0).to_numpy()
            cut = int(np.searchsorted(ids_here, ids_here[-1]))
            if cut:
                take(_joined([*rest, b.slice(0, cut)]))
                rest = []
            rest.append(b.slice(cut))
        if rest:
            take(_joined(rest))
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "chunk_id", "score"])

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
