"""The registered queries of the retrieval engine, each with the SQL that gives the same rows.

The fixtures stand for collections: documents are chunks with the fields lang, source and
n_chars, embeddings their vectors (vec_id = doc_id), conversations are groups whose first
turn is the parent, and events are segments in time. Every query reads its whole tables;
a limit is there only where a top-k or a candidate budget is what is computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.engine import Engine, percent
from tessera.functions import analysis
from tessera.functions import embedding as E
from tessera.functions import metavalue as M
from tessera.operators import facets, fts, relations, scoring, vectors
from tessera.operators.fusion import reciprocal_rank_fusion, top
from tessera.plans.filters import Fields, compile_filters, selectivity
from tessera.plans.search import Search, SearchRequest, Sources
from tessera.sources.catalog import check_name
from tessera.sources.shared import shared_folder
from tessera.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = datetime(2024, 2, 15)
WORDS = ("anea", "stsh", "thion")
TEXT = " ".join(WORDS)
VECTOR = [round(math.sin(1.7 * i + 0.3), 4) for i in range(64)]
DOC_FIELDS = Fields({"lang": ("string", "lang"), "source": ("string", "source"), "n_chars": ("int", "n_chars")}, None)
K = 10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "id")


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def with_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumn("metadata", M.metadata_of(lang=("string", F.col("lang")), source=("string", F.col("source")), n_chars=("int", F.col("n_chars"))))


def index(spark: SparkSession, sf: str, analyzer: str = "simple") -> fts.TextScan:
    """Documents as they are: a query's words are counted in one pass."""
    return fts.TextScan(documents(spark, sf), analyzer)


def _refused(call: Callable[[], object]) -> bool:
    try:
        call()
    except ValueError:
        return True
    return False


def utc_text(column: str) -> Column:
    """A time without zone as text in UTC, whatever the session's zone."""
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def scored(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.round("score", 6).alias("score"))


# --- filters


def _filtered(filters: dict) -> Query:
    return lambda spark, sf: documents(spark, sf).where(compile_filters(filters, DOC_FIELDS)).select("id", "lang", "source", "n_chars")


_DOC = "SELECT doc_id AS id, lang, source, n_chars FROM documents WHERE "
query("filter_eq", _DOC + "lang = 'de'")(_filtered({"lang": "de"}))
query("filter_range", _DOC + "n_chars BETWEEN 500 AND 2000")(_filtered({"n_chars": {"gte": 500, "lte": 2000}}))
query("filter_in", _DOC + "lang IN ('fr', 'es')")(_filtered({"lang": {"in": ["fr", "es", 3]}}))
query("filter_and", _DOC + "lang = 'en' AND source = 'src3' AND n_chars >= 1000")(_filtered({"lang": "en", "source": "src3", "n_chars": {"gte": 1000}}))
query("filter_no_match", _DOC + "false")(_filtered({"lang": "xx"}))
query("filter_typed_equality", _DOC + "false")(_filtered({"n_chars": 1000.0}))


@query("filter_metadata_map", _DOC + "lang = 'de' AND n_chars >= 1000")
def filter_metadata_map(spark: SparkSession, sf: str) -> DataFrame:
    condition = compile_filters({"lang": "de", "n_chars": {"gte": 1000}}, Fields({}))
    return with_metadata(documents(spark, sf)).where(condition).select("id", "lang", "source", "n_chars")


@query("filter_contains", "SELECT doc_id AS id FROM documents WHERE list_contains([lang, source], 'src7')")
def filter_contains(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).withColumn("metadata", M.metadata_of(tags=("list", F.array("lang", "source"))))
    return rows.where(compile_filters({"tags": {"contains": "src7"}}, Fields({}), strict_contains=True)).select("id")


query("filter_scalar_contains", _DOC + "source = 'src7'")(_filtered({"source": {"contains": "src7"}}))
query("filter_unknown_field", _DOC + "false")(_filtered({"nowhere": {"gte": 0}}))


@query("filter_doc_type", "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE turn > 0")
def filter_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).where(compile_filters({"doc_type": "segment"})).select("id")


@query("filter_bad_conditions", "SELECT * FROM (VALUES ('empty', true), ('unknown', true), ('text bound', true), ('range', false)) t(condition, refused)")
def filter_bad_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions that would match everything or nothing by mistake are errors."""
    asked = {"empty": {}, "unknown": {"above": 3}, "text bound": {"gte": "3"}, "range": {"gte": 3}}
    return spark.createDataFrame([(name, _refused(lambda c=c: compile_filters({"n_chars": c}, DOC_FIELDS))) for name, c in asked.items()], "condition string, refused boolean")


@query("filter_json_number", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 20 AND 60")
def filter_json_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("metadata", M.parse_metadata(F.col("props")))
    return rows.where(compile_filters({"k": {"gte": 20, "lte": 60}}, Fields({}))).select("event_id")


@query("filter_numeric_string", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50")
def filter_numeric_string(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("metadata", M.metadata_of(k=("string", F.get_json_object("props", "$.k"))))
    return rows.where(compile_filters({"k": {"gte": 50}}, Fields({}))).select("event_id")


@query(
    "filter_selectivity",
    "SELECT count(*) FILTER (WHERE lang = 'en') AS eligible, count(*) AS universe, round(count(*) FILTER (WHERE lang = 'en') / count(*)::DOUBLE, 6) AS selectivity FROM documents",
)
def filter_selectivity(spark: SparkSession, sf: str) -> DataFrame:
    return selectivity(documents(spark, sf), compile_filters({"lang": "en"}, DOC_FIELDS)).withColumn("selectivity", F.round("selectivity", 6))


# --- full text

_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40)"
_INDEX = f"""
tok AS (SELECT doc_id, lang, n_chars, {_TOKENS} AS ts FROM documents),
dl AS (SELECT doc_id, len(ts) AS dl FROM tok),
cs AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM dl),
p AS (SELECT doc_id, t AS term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM tok) GROUP BY 1, 2)"""


def _bm25(words: tuple[str, ...], boosts: tuple[float, ...] = ()) -> str:
    """CTEs up to s (chunk_id, score, and m1, m2 ... for words that match)."""
    boosts = boosts or (1.0,) * len(words)
    part = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    total = " + ".join(f"coalesce(max(CASE WHEN term = '{w}' THEN {b} * {part} END), 0)" for w, b in zip(words, boosts, strict=True))
    flags = ", ".join(f"max(CASE WHEN term = '{w}' THEN 1 ELSE 0 END) AS m{k}" for k, w in enumerate(words, 1))
    held = ", ".join(f"'{w}'" for w in words)
    return f"""{_INDEX},
df AS (SELECT term, count(*)::DOUBLE AS df FROM p WHERE term IN ({held}) GROUP BY 1),
s AS (SELECT doc_id AS chunk_id, {total} AS score, {flags} FROM p JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN cs GROUP BY doc_id)"""


_TOP = "ORDER BY s.score DESC, chunk_id LIMIT"


@query("index_terms", f"WITH {_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    return fts.postings(documents(spark, sf), "simple", places=False).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query("match_all", "SELECT doc_id AS chunk_id, 1.0::DOUBLE AS score FROM documents")
def match_all(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).matches("*")


def _matching(text: str) -> Query:
    return lambda spark, sf: scored(index(spark, sf).matches(text))


def _topped(text: str) -> Query:
    return lambda spark, sf: scored(index(spark, sf).search(text, K))


_SELECT = "SELECT chunk_id, round(score, 6) AS score FROM s"
query("fts_bm25_or", f"WITH {_bm25(WORDS)} {_SELECT}")(_matching(TEXT))
query("fts_bm25_top10", f"WITH {_bm25(WORDS)} {_SELECT} {_TOP} {K}")(_topped(TEXT))
query("fts_and", f"WITH {_bm25(('the', 'anea'))} {_SELECT} WHERE m1 = 1 AND m2 = 1")(_matching("the AND anea"))
query("fts_must", f"WITH {_bm25(('anea', 'the'))} {_SELECT} WHERE m1 = 1")(_matching("+anea the"))
query("fts_not", f"WITH {_bm25(('anea', 'the'))} SELECT chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, m1, m2, score FROM s) AS s WHERE m1 = 1 AND m2 = 0")(_matching("anea -the"))
query("fts_boost", f"WITH {_bm25(WORDS, (2.5, 1.0, 0.5))} {_SELECT} {_TOP} {K}")(_topped("anea^2.5 stsh thion^0.5"))
query(
    "fts_phrase",
    f"""WITH {_INDEX},
w AS (SELECT doc_id, len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the'))::DOUBLE AS tf FROM tok),
df AS (SELECT sum(x) AS idf FROM (SELECT ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS x FROM p CROSS JOIN cs WHERE term IN ('of', 'the') GROUP BY term))
SELECT doc_id AS chunk_id, round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM w JOIN dl USING (doc_id) CROSS JOIN cs CROSS JOIN df WHERE tf > 0""",
)(_matching('"of the"'))
query("fts_field_range", f"WITH {_bm25(('anea',))} SELECT chunk_id, round(score + 1, 6) AS score FROM s WHERE chunk_id BETWEEN 10 AND 500")(_matching("+anea +id:[10 TO 500]"))
query("fts_parse_failure", "SELECT doc_id AS chunk_id, 0.0::DOUBLE AS score FROM documents WHERE false")(_matching("http://a.example/b"))


@query(
    "fts_batch_top10",
    f"""WITH {_INDEX},
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) < 40)) AS term FROM benchmark),
df AS (SELECT term, count(*)::DOUBLE AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT query_id, doc_id AS chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN cs GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {K}""",
)
def fts_batch_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text asks all documents, in one job."""
    asked = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return fts.search_many(documents(spark, sf), asked, K, "simple").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("fts_filtered_pre", f"WITH {_bm25(WORDS)} SELECT chunk_id, round(score, 6) AS score FROM s JOIN documents d ON d.doc_id = chunk_id WHERE d.lang = 'en' AND d.n_chars >= 1000 {_TOP} {K}")
def fts_filtered_pre(spark: SparkSession, sf: str) -> DataFrame:
    condition = compile_filters({"lang": "en", "n_chars": {"gte": 1000}}, DOC_FIELDS)
    return scored(index(spark, sf).search(TEXT, K, condition=condition))


@query("fts_filtered_post", f"WITH {_bm25(WORDS)}, t AS (SELECT * FROM s {_TOP} {3 * K}) SELECT chunk_id, round(score, 6) AS score FROM t JOIN documents d ON d.doc_id = chunk_id WHERE d.n_chars >= 1000")
def fts_filtered_post(spark: SparkSession, sf: str) -> DataFrame:
    request = SearchRequest(TEXT, mode="fts", top_k=K, filters={"n_chars": {"gte": 1000}}, filter_mode="post")
    sources = Sources(documents(spark, sf).drop("source"), index(spark, sf), lambda _: None, fields=DOC_FIELDS)
    return Search(sources, request, NOW).candidates().select("chunk_id", F.round("base_score", 6).alias("score"))


_STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoling": "consol", "consolidate": "consolid", "consolidating": "consolid",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead",
    "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit",
    "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker", "knocking": "knock", "knopp": "knopp", "knot": "knot",
    "generate": "generat", "generally": "general", "communism": "communism", "dying": "die", "news": "news", "skies": "sky", "happy": "happi", "hopping": "hop", "hoped": "hope", "running": "run",
}


@query("fts_stem_table", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in _STEMS.items()) + ") t(word, stem)")
def fts_stem_table(spark: SparkSession, sf: str) -> DataFrame:
    """The English analyzer over the sample words that the stemmer's published description lists, and some of its special cases."""
    words = spark.createDataFrame([(w,) for w in _STEMS], "word string")
    return words.select("word", F.get(analysis.terms(F.col("word"), "english"), F.lit(0)).alias("stem"))


@query("fts_english_stems")
def fts_english_stems(spark: SparkSession, sf: str) -> DataFrame:
    return scored(index(spark, sf, "english").search(TEXT, K))


# --- vectors

_VECTOR = f"{VECTOR}::DOUBLE[]"
_KNN = f"SELECT vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) AS score FROM embeddings"


@query("vector_topk_cosine", f"SELECT chunk_id, round(score, 6) AS score FROM ({_KNN}) AS s {_TOP} {K}")
def vector_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return scored(vectors.nearest(embedded(spark, sf), VECTOR, K))


@query("vector_filtered_topk", f"SELECT chunk_id, round(score, 6) AS score FROM ({_KNN}) AS s JOIN documents d ON d.doc_id = chunk_id WHERE d.lang = 'fr' {_TOP} {K}")
def vector_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    ok = documents(spark, sf).where(compile_filters({"lang": "fr"}, DOC_FIELDS)).select(F.col("id").alias("chunk_id"))
    return scored(vectors.nearest(embedded(spark, sf), VECTOR, K, ok))


@query("vector_inverted_file", f"SELECT chunk_id, round(score, 6) AS score FROM ({_KNN}) AS s {_TOP} {K}")
def vector_inverted_file(spark: SparkSession, sf: str) -> DataFrame:
    built = vectors.InvertedFile.build(embedded(spark, sf), shared_folder(spark, "ivf"), vectors.IndexParams(dims=64))
    return scored(built.search(VECTOR, K))


@query(
    "vector_batch_topk",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(q.x, e.x) AS score FROM e q JOIN e ON q.vec_id % 100 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {K}""",
)
def vector_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks all vectors, in one job."""
    rows = embedded(spark, sf)
    asked = rows.where(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "query_id")
    return vectors.nearest_of_all(rows, asked, K).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("vector_dims_check", "SELECT * FROM (VALUES (63, false), (64, true), (65, false)) t(dims, accepted)")
def vector_dims_check(spark: SparkSession, sf: str) -> DataFrame:
    """A vector of another size than the space's is an error."""
    dims = spark.createDataFrame([(63,), (64,), (65,)], "dims int")
    sizes = embedded(spark, sf).select(F.size("embedding").alias("n")).groupBy("n").count()
    return dims.join(F.broadcast(sizes), F.col("dims") == F.col("n"), "left").select("dims", F.coalesce(F.size(vectors.check_dims(F.when(F.col("n").isNotNull(), F.array_repeat(F.lit(0.0).cast("float"), 64)), 64)) == F.col("dims"), F.lit(False)).alias("accepted"))


# --- fusion


def _rrf_sql(k: float, wf: float, ws: float) -> str:
    return f"""WITH {_bm25(WORDS)},
f AS (SELECT chunk_id, row_number() OVER ({_TOP.replace(" LIMIT", "")}) - 1 AS r FROM (SELECT * FROM s {_TOP} {3 * K}) AS s),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM (SELECT * FROM ({_KNN}) AS s {_TOP} {3 * K})),
m AS (SELECT chunk_id, coalesce({wf} / ({k} + f.r), 0) + coalesce({ws} / ({k} + v.r), 0) AS score,
      CASE WHEN f.r IS NULL THEN 'semantic' WHEN v.r IS NULL THEN 'fts' ELSE 'both' END AS source FROM f FULL JOIN v USING (chunk_id))
SELECT chunk_id, round(score, 6) AS score, source FROM m AS s {_TOP} {3 * K}"""


def _rrf(k: float, wf: float, ws: float) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = index(spark, sf).search(TEXT, 3 * K)
        near = vectors.nearest(embedded(spark, sf), VECTOR, 3 * K)
        return reciprocal_rank_fusion(found, near, 3 * K, k, wf, ws).select("chunk_id", F.round("base_score", 6).alias("score"), "source")

    return run


query("rrf_hybrid", _rrf_sql(60.0, 1.0, 1.0))(_rrf(60.0, 1.0, 1.0))
query("rrf_weighted", _rrf_sql(20.0, 0.4, 2.5))(_rrf(20.0, 0.4, 2.5))


# --- scores


def _recency(half_life: float, least: float, now: datetime) -> tuple[str, Query]:
    sql = f"""SELECT event_id, round(CASE WHEN age <= 0 THEN 1.0 ELSE greatest({least}, pow(2.0, -(age / 86400.0) / {half_life})) END, 6) AS factor
FROM (SELECT event_id, ((epoch_us(TIMESTAMP '{now}') - epoch_us(ts)) // 1000000)::DOUBLE AS age FROM events)"""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "events").withColumn("metadata", M.metadata_of(ts=("string", utc_text("ts"))))
        factor = scoring.recency_factor(scoring.Recency("ts", half_life, least), F.lit(now.isoformat() + "Z").cast("timestamp"), Fields({}))
        return rows.select("event_id", F.round(factor, 6).alias("factor"))

    return sql, run


for _name, (_half, _least) in scoring.PRESETS.items():
    _sql, _run = _recency(_half, _least, NOW)
    query(f"recency_{_name}", _sql)(_run)
_sql, _run = _recency(5.0, 0.1, datetime(2024, 1, 10))
query("recency_future", _sql)(_run)
_sql, _run = _recency(0.5, 0.25, NOW)
query("recency_floor", _sql)(_run)


def _boosted(boosts: list[scoring.Boost]) -> Query:
    fields = Fields({"priority": ("string", "o_orderpriority"), "price": ("float", "o_totalprice"), "status": ("string", "o_orderstatus")}, None)
    return lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", F.round(scoring.boost_factor(boosts, fields), 6).alias("factor"))


_URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0 ELSE 1.0 END"
_PRICE = "CASE WHEN o_totalprice >= 100000 AND o_totalprice <= 200000 THEN 1.5 ELSE 1.0 END"
query("metadata_boost_string", f"SELECT o_orderkey, round(({_URGENT})::DOUBLE, 6) AS factor FROM orders")(_boosted([scoring.Boost("priority", "1-URGENT", weight=2.0)]))
query("metadata_boost_range", f"SELECT o_orderkey, round(({_PRICE})::DOUBLE, 6) AS factor FROM orders")(_boosted([scoring.Boost("price", gte=100000, lte=200000, weight=1.5)]))
query("metadata_boost_stacked", f"SELECT o_orderkey, round(({_URGENT} * {_PRICE} * CASE WHEN o_orderstatus = 'F' THEN 0.7 ELSE 1.0 END)::DOUBLE, 6) AS factor FROM orders")(
    _boosted([scoring.Boost("priority", "1-URGENT", gte=5, weight=2.0), scoring.Boost("price", gte=100000, lte=200000, weight=1.5), scoring.Boost("status", "F", weight=0.7), scoring.Boost("none", "x", weight=9.0)])
)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as chunks: the first of a conversation is the source of the others."""
    c = table(spark, sf, "conversations")
    at = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        at.alias("id"), at.alias("chunk_id"), "role", "text", "conv_id", "turn", F.col("conv_id").cast("string").alias("group_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), F.when(F.col("turn") > 0, "segment").otherwise("source").alias("doc_type"),
        F.length("text").cast("double").alias("base_score"), M.metadata_of(role=("string", F.col("role")), turn=("int", F.col("turn"))).alias("metadata"),
    )


_CANDIDATES = 300
_TURNS = f"""c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_id, length(text)::DOUBLE AS base_score
 FROM conversations ORDER BY base_score DESC, chunk_id LIMIT {_CANDIDATES}), n AS (SELECT *, base_score / greatest(max(base_score) OVER (), 1e-10) AS x FROM c)"""


def _related(mode: str, agg: str) -> None:
    sql = f"""WITH {_TURNS}
SELECT a.chunk_id, round(a.base_score * (1.0 + CASE WHEN a.parent_id IN (SELECT chunk_id FROM c) THEN 0.3 ELSE 0 END
   + coalesce(0.1 * (SELECT {agg} FROM n b WHERE b.conv_id = a.conv_id AND b.chunk_id <> a.chunk_id), 0)), 6) AS final_score FROM n a"""

    @query(f"relationship_sibling_{mode}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = top(turns(spark, sf), _CANDIDATES, "base_score")
        return scoring.score_candidates(rows, NOW, relationship=scoring.RelationshipBoost(mode=mode)).select("chunk_id", F.round("final_score", 6).alias("final_score"))


for _mode, _agg in (("max", "max(b.x)"), ("avg", "avg(b.x)"), ("sum", "sum(b.x)")):
    _related(_mode, _agg)


@query("relationship_parent", f"WITH {_TURNS} SELECT chunk_id, round(base_score * CASE WHEN parent_id IN (SELECT chunk_id FROM c) THEN 1.5 ELSE 1.0 END, 6) AS final_score FROM n")
def relationship_parent(spark: SparkSession, sf: str) -> DataFrame:
    rows = top(turns(spark, sf), _CANDIDATES, "base_score")
    boost = scoring.RelationshipBoost(parent_weight=0.5, sibling_weight=0.0)
    return scoring.score_candidates(rows, NOW, relationship=boost).select("chunk_id", F.round("final_score", 6).alias("final_score"))


@query(
    "scoring_pipeline",
    f"""WITH {_bm25(WORDS)}, t AS (SELECT * FROM s {_TOP} {3 * K})
SELECT chunk_id, round(f, 6) AS score FROM (SELECT chunk_id, t.score * CASE WHEN d.lang = 'en' THEN 1.3 ELSE 1.0 END * CASE WHEN d.n_chars >= 2000 THEN 0.8 ELSE 1.0 END
 * CASE WHEN l.quality <= 0 THEN 0.5 ELSE 1.0 END AS f FROM t JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id) ORDER BY f DESC, chunk_id LIMIT {K}""",
)
def scoring_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    chunks = documents(spark, sf).drop("source").join(labels, "id", "left")
    fields = Fields({**DOC_FIELDS.promoted, "quality": ("int", "quality")}, None)
    boosts = [scoring.Boost("lang", "en", weight=1.3), scoring.Boost("n_chars", gte=2000, weight=0.8), scoring.Boost("quality", lte=0, weight=0.5)]
    sources = Sources(chunks, index(spark, sf), lambda _: None, fields=fields)
    ranked = Search(sources, SearchRequest(TEXT, mode="fts", top_k=K, boosts=boosts), NOW).ranked()
    return ranked.select("chunk_id", F.round("score", 6).alias("score"))


@query("hybrid_search")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a filtered hybrid search with boosts over documents and embeddings."""
    request = SearchRequest(TEXT, top_k=K, query_vector=VECTOR, filters={"n_chars": {"gte": 300}}, boosts=[scoring.Boost("lang", "en", weight=1.2)])
    chunks, vecs = documents(spark, sf).drop("source"), embedded(spark, sf)
    sources = Sources(chunks, fts.TextScan(chunks, "simple"), lambda _: vecs, fields=DOC_FIELDS)
    return Search(sources, request, NOW).ranked().select("id", "lang", "n_chars", F.round("score", 6).alias("score"), "source")


ORACLE_SQL["hybrid_search"] = f"""WITH {_bm25(WORDS)}, ok AS (SELECT doc_id AS chunk_id, lang, n_chars FROM documents WHERE n_chars >= 300),
f AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM (SELECT s.* FROM s JOIN ok USING (chunk_id) {_TOP} {3 * K})),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM (SELECT s.* FROM ({_KNN}) AS s JOIN ok USING (chunk_id) {_TOP} {3 * K})),
m AS (SELECT chunk_id, coalesce(1.0 / (60.0 + f.r), 0) + coalesce(1.0 / (60.0 + v.r), 0) AS b,
      CASE WHEN f.r IS NULL THEN 'semantic' WHEN v.r IS NULL THEN 'fts' ELSE 'both' END AS source FROM f FULL JOIN v USING (chunk_id)),
c AS (SELECT * FROM m ORDER BY b DESC, chunk_id LIMIT {3 * K})
SELECT chunk_id AS id, lang, n_chars, round(x, 6) AS score, source
FROM (SELECT *, b * CASE WHEN lang = 'en' THEN 1.2 ELSE 1.0 END AS x FROM c JOIN ok USING (chunk_id)) ORDER BY x DESC, chunk_id LIMIT {K}"""


# --- facets, parents, segments

_FACET = "SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents {w} GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents {w} GROUP BY 2"
query("facets_all", _FACET.format(w="") + " UNION ALL SELECT 'n_chars', n_chars::VARCHAR, count(*) FROM documents GROUP BY 2")(lambda spark, sf: facets.facet_counts(with_metadata(documents(spark, sf))))
query("facets_fields", _FACET.format(w=""))(lambda spark, sf: facets.facet_counts(with_metadata(documents(spark, sf)), ["lang", "source"]))
query("facets_query", _FACET.format(w=f"WHERE list_contains({_TOKENS}, 'anea')"))(
    lambda spark, sf: facets.facet_counts(with_metadata(documents(spark, sf)), ["lang", "source"], index(spark, sf).matches("anea"))
)


@query("facets_list_value", "SELECT 'tags' AS field, lang || ',' || source AS value, count(*) AS count FROM documents GROUP BY 2")
def facets_list_value(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_counts(documents(spark, sf).withColumn("metadata", M.metadata_of(tags=("list", F.array("lang", "source")))))


@query("facets_numbers", "SELECT 'quantity' AS field, (l_quantity::BIGINT)::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY 2")
def facets_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_counts(table(spark, sf, "lineitem").withColumn("metadata", M.metadata_of(quantity=("float", F.col("l_quantity")))))


@query("facets_bitmaps", "SELECT lang AS value, count(*) AS count FROM documents GROUP BY 1")
def facets_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_sets(with_metadata(documents(spark, sf)), "lang").groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("count"))


@query(
    "parent_metadata",
    """SELECT s.conv_id * 1000 + s.turn AS id, CASE WHEN s.turn > 0 THEN p.role END AS parent_role FROM conversations s LEFT JOIN conversations p ON p.conv_id = s.conv_id AND p.turn = 0""",
)
def parent_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf)
    return relations.parent_metadata(rows, rows).select("id", M.field("role", F.col("parent_metadata"))["s"].alias("parent_role"))


@query("resolve_parent_ref", "SELECT a.conv_id * 1000 + a.turn AS id, coalesce(b.conv_id * 1000 + b.turn, -1) AS parent_id FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def resolve_parent_ref(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    rows = turns(spark, sf).select("id", name(F.col("turn")).alias("client_id"), name(F.col("turn") + 1).alias("parent_ref"), F.lit(-1).cast("bigint").alias("parent_id"))
    return relations.resolve_parents(rows).select("id", "parent_id")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Events as segments of their user, each up to the user's next event."""
    ms = F.floor(F.unix_micros(utc_text("ts").cast("timestamp")) / 1000)
    following = F.lead(ms).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("group_id"), F.lit("segment").alias("doc_type"), ms.alias("s"), following.alias("e"))
    return rows.withColumn("metadata", M.metadata_of(timerange_start_ms=("int", F.col("s")), timerange_end_ms=("int", F.col("e"))))


_AT, _TO = 1_705_312_800_000, 1_705_744_800_000
_SPANS = "WITH x AS (SELECT event_id AS id, user_id::VARCHAR AS g, (epoch_us(ts) // 1000) AS s, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events) SELECT id, s, e FROM x WHERE g = '7'"


def _segments(name: str, where: str, **window: float) -> None:
    @query(f"segments_{name}", f"{_SPANS} {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return relations.segments_at(spans(spark, sf), "7", **window).select("id", "s", "e")


_segments("point", f"AND s <= {_AT} AND e >= {_AT}", time_ms=_AT)
_segments("range", f"AND s <= {_TO} AND e >= {_AT}", time_start_ms=_AT, time_end_ms=_TO)
_segments("open", f"AND e >= {_AT}", time_start_ms=_AT)
_segments("enumerate", "")


@query(
    "segments_batch",
    f"WITH x AS (SELECT event_id AS id, user_id::VARCHAR AS g, (epoch_us(ts) // 1000) AS s, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events) SELECT DISTINCT g AS asset, {_AT}::BIGINT AS time_ms, id FROM x WHERE s <= {_AT} AND e >= {_AT}",
)
def segments_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans(spark, sf).select("id", F.col("group_id").alias("asset"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    points = rows.select("asset").distinct().withColumn("time_ms", F.lit(_AT).cast("bigint"))
    return relations.segments_for_points(rows, points).select("asset", "time_ms", "id")


# --- embedding, counters, ingest, streams


@query(
    "static_embed",
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
m AS (SELECT doc_id, avg(length(w)::DOUBLE) AS a, avg((ascii(w) % 11)::DOUBLE) AS b, avg((ascii(right(w, 1)) % 13)::DOUBLE) AS c FROM t GROUP BY 1)
SELECT doc_id AS id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y, round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM m""",
)
def static_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    w = F.col("token")
    vector = F.array(F.length(w).cast("double"), (F.ascii(w) % 11).cast("double"), (F.ascii(F.right(w, F.lit(1))) % 13).cast("double"))
    words = fts.vocabulary(docs).withColumnRenamed("term", "token").withColumn("vector", vector)
    out = E.static_embedding(docs.select("id", "text"), words, 3)
    return out.select("id", *(F.round(F.get("embedding", F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")))


query("group_counts", "SELECT role, count(*) AS chunks, count(DISTINCT conv_id) AS groups FROM conversations GROUP BY 1")(
    lambda spark, sf: turns(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("group_id").alias("groups"))
)


@query(
    "rebuild_progress",
    "SELECT count(v.vec_id) AS embedded, count(*) AS total, round(100.0 * count(v.vec_id) / count(*), 6)::DOUBLE AS percent FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id",
)
def rebuild_progress(spark: SparkSession, sf: str) -> DataFrame:
    has = embedded(spark, sf).select(F.col("chunk_id").alias("id"), F.lit(1).alias("has")).distinct()
    rows = documents(spark, sf).join(has, "id", "left").agg(F.count("has").alias("embedded"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("percent", F.round(F.when(F.col("total") > 0, 100.0 * F.col("embedded") / F.col("total")).otherwise(F.lit(percent(0, 0))), 6))


def _collection(spark: SparkSession, sf: str, analyzer: str = "simple") -> tuple[Engine, str]:
    """Documents with their vectors in a new collection of the shared folder."""
    engine = Engine(spark, shared_folder(spark, "collections"))
    engine.create_collection("documents", embedding_dims=64, config={"analyzer": analyzer})
    docs = with_metadata(documents(spark, sf))
    vecs = embedded(spark, sf).select(F.col("chunk_id").alias("id"), "embedding")
    rows = docs.join(vecs, "id", "left").select(F.col("id").alias("ordinal"), F.concat(F.lit("doc-"), "id").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), "text", "metadata", "embedding")
    engine.ingest_frame("documents", rows)
    return engine, "documents"


@query("ingest_persist", "SELECT lang, count(*) AS chunks, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def ingest_persist(spark: SparkSession, sf: str) -> DataFrame:
    """Ids follow the order of the batch, so they are the documents' own."""
    engine, name = _collection(spark, sf)
    lang = M.field("lang")["s"].alias("lang")
    return engine.chunks(name).groupBy(lang).agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("collection_search", ORACLE_SQL["hybrid_search"].replace("lang, n_chars, round", "round"))
def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship over a stored collection: postings, vectors and metadata are read from its tables."""
    engine, name = _collection(spark, sf)
    request = SearchRequest(TEXT, top_k=K, query_vector=VECTOR, filters={"n_chars": {"gte": 300}}, boosts=[scoring.Boost("lang", "en", weight=1.2)])
    return engine.plan(name, request, NOW).ranked().select("id", F.round("score", 6).alias("score"), "source")


@query("stream_event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS count, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    events = streams.read_events(spark, sf)
    out = streams.event_counts(events, late="400 days").writeStream.outputMode("complete")
    out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "count", F.round("value", 4).alias("value"))


@query("stream_ingest", "SELECT source, kind, count(*) AS chunks FROM (SELECT 'turns' AS source, role AS kind FROM conversations UNION ALL SELECT 'events', event_type FROM events) GROUP BY 1, 2")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams with checkpoints of their own fill one collection; each is started again, and adds nothing twice."""
    folder = shared_folder(spark, "stream")
    engine = Engine(spark, f"{folder}/collections")
    engine.create_collection("both", embedding_dims=4, config={"analyzer": "simple"})
    read = lambda schema, name: streams.read_table(spark, schema, f"{sf}/{name}.parquet")
    said = read("conv_id bigint, turn bigint, role string, text string", "conversations")
    said = said.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("chunk_index"), "text", M.metadata_of(source=("string", F.lit("turns")), kind=("string", F.col("role"))).alias("metadata"))
    done = read("event_id bigint, user_id bigint, event_type string, props string", "events")
    done = done.select(F.col("event_id").cast("string").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.col("props").alias("text"), M.metadata_of(source=("string", F.lit("events")), kind=("string", F.col("event_type"))).alias("metadata"))
    for name, rows in (("turns", said), ("events", done), ("turns", said)):
        streams.stream_into(engine, "both", rows, f"{folder}/{name}").awaitTermination()
    slot = lambda f: M.field(f)["s"].alias(f)
    return engine.chunks("both").groupBy(slot("source"), slot("kind")).agg(F.count(F.lit(1)).alias("chunks"))


# --- the catalog and the engine's other calls


@query(
    "catalog_lifecycle",
    "SELECT * FROM (VALUES ('created', 'alpha', 3, 'default', 0), ('created', 'beta', 8, 'image', 0), ('after restart', 'alpha', 3, 'default', 0), ('after restart', 'beta', 8, 'text', 0), ('after delete', 'beta', 8, 'text', 0)) t(step, name, dims, default_space, chunks)",
)
def catalog_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Create, list, get, switch the default space, discover after a restart, delete."""
    root, rows = shared_folder(spark, "catalog"), []

    def note(step: str, engine: Engine) -> None:
        for c in engine.list_collections():
            held = engine.get_collection(c.name)
            rows.append((step, c.name, held.vector_spaces[held.default_vector_space].dims, held.default_vector_space, held.chunk_count))

    first = Engine(spark, root)
    first.create_collection("alpha", embedding_dims=3)
    first.create_collection("beta", {"image": {"dims": 8}, "text": {"dims": 8}})
    note("created", first)
    first.set_default_vector_space("beta", "text")
    second = Engine(spark, root)
    note("after restart", second)
    second.delete_collection("alpha")
    note("after delete", second)
    return spark.createDataFrame(rows, "step string, name string, dims int, default_space string, chunks int")


_NAMES = [("news-2024", True), ("archive", True), ("v2", True), ("a", True), ("", False), ("..", False), ("../x", False), ("a/b", False), ("a b", False), (".", False), ("a_b", False), ("é", False)]


@query("catalog_names", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, ok in _NAMES) + ") t(name, accepted)")
def catalog_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, not _refused(lambda n=n: check_name(n))) for n, _ in _NAMES], "name string, accepted boolean")


@query("vector_space_states", "SELECT * FROM (VALUES ('default', 'active', true), ('second', 'building', false)) t(name, status, is_default)")
def vector_space_states(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark, shared_folder(spark, "spaces"))
    engine.create_collection("c", embedding_dims=4)
    for name in ("second", "third"):
        engine.add_vector_space("c", name, 4)
    engine.delete_vector_space("c", "third")
    return spark.createDataFrame([(s["name"], s["status"], s["is_default"]) for s in engine.list_vector_spaces("c")], "name string, status string, is_default boolean")


@query("chunk_lookup", "SELECT doc_id AS id, 'doc-' || doc_id AS file_id, lang, length(text) AS size FROM documents WHERE doc_id IN (0, 7, 11, 199)")
def chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Point and batch lookup by id in a stored collection; an unknown id gives nothing."""
    engine, name = _collection(spark, sf)
    rows = engine.store.get(engine.catalog.need(name), [0, 7, 11, 199, 10**12])
    return rows.select("id", "file_id", M.field("lang")["s"].alias("lang"), F.length("text").cast("bigint").alias("size"))


@query("ingest_json_lines", "SELECT event_id AS id, props->>'$.k' AS k, event_type FROM events")
def ingest_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines of request objects; whole numbers stay whole."""
    folder = shared_folder(spark, "json")
    meta = F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    lines = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("file_id"), F.lit(0).alias("chunk_index"), F.col("event_type").alias("text"), meta.alias("metadata"))).alias("value"))
    lines.write.text(f"{folder}/in")
    engine = Engine(spark, f"{folder}/collections")
    engine.create_collection("events", embedding_dims=4, config={"analyzer": "simple"})
    engine.ingest_json("events", f"{folder}/in")
    return engine.chunks("events").select(F.col("file_id").cast("bigint").alias("id"), M.field("k")["i"].cast("string").alias("k"), M.field("event_type")["s"].alias("event_type"))


@query("search_explain", "SELECT count(*) FILTER (WHERE d.lang = 'en') AS eligible, count(*) AS universe, count(e.vec_id) FILTER (WHERE d.lang = 'en') AS candidates, 'exact' AS engine FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def search_explain(spark: SparkSession, sf: str) -> DataFrame:
    chunks, vecs = documents(spark, sf).drop("source"), embedded(spark, sf)
    sources = Sources(chunks, None, lambda _: vecs, fields=Fields({"lang": ("string", "lang")}, None))
    x = Search(sources, SearchRequest("", mode="semantic", query_vector=VECTOR, filters={"lang": "en"}), NOW).explain()
    return spark.createDataFrame([(x.eligible_count, x.universe_count, x.candidates_inspected, x.engine)], "eligible bigint, universe bigint, candidates bigint, engine string")


@query("search_limits", "SELECT * FROM (VALUES (0, false), (1, true), (1000, true), (1001, false)) t(top_k, accepted)")
def search_limits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, not _refused(lambda k=k: SearchRequest("x", top_k=k))) for k in (0, 1, 1000, 1001)], "top_k int, accepted boolean")


@query("collection_ivf_search", f"SELECT chunk_id AS id, round(s.score, 4) AS score FROM ({_KNN}) AS s JOIN documents d ON d.doc_id = chunk_id WHERE d.lang = 'en' {_TOP} {K}")
def collection_ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    """A stored inverted file, built over half of the documents, extended by the ingest of the rest, and opened by another engine."""
    root = shared_folder(spark, "collections")
    engine = Engine(spark, root)
    engine.create_collection("documents", embedding_dims=64, config={"analyzer": "simple"})
    vecs = embedded(spark, sf).select(F.col("chunk_id").alias("id"), "embedding")
    rows = with_metadata(documents(spark, sf)).join(vecs, "id", "left").select("id", F.col("id").cast("string").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.lit("").alias("text"), "metadata", "embedding")
    engine.ingest_frame("documents", rows.where("id % 2 = 0").drop("id"))
    engine.build_inverted_file("documents")
    engine.ingest_frame("documents", rows.where("id % 2 = 1").drop("id"))
    request = SearchRequest("", mode="semantic", top_k=K, query_vector=VECTOR, filters={"lang": "en"})
    return Engine(spark, root).plan("documents", request, NOW).ranked().select(F.col("file_id").cast("bigint").alias("id"), F.round("score", 4).alias("score"))


@query(
    "auto_embedding",
    r"""SELECT role, count(*) AS chunks, count(*) FILTER (WHERE role = 'user') AS embedded_as_given, count(*) FILTER (WHERE role <> 'user' AND len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) > 0) AS embedded_by_fallback FROM conversations GROUP BY 1""",
)
def auto_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest embeds what has no vector: a table that knows no word falls back on a second embedder; the old single field is kept as given."""
    known = E.StaticEmbedder({"no-such-token": [1.0, 0.0, 0.0]})
    engine = Engine(spark, shared_folder(spark, "embedded"), E.Fallback(known, AnyWord()))
    engine.create_collection("turns", embedding_dims=3, config={"analyzer": "simple"})
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), "text", M.metadata_of(role=("string", F.col("role"))).alias("metadata"),
        F.when(F.col("role") == "user", F.array(*(F.lit(x).cast("float") for x in (0.0, 1.0, 0.0)))).alias("embedding"),
    )
    c = engine.ingest_frame("turns", rows)
    held = engine.store.vectors(c, "default").select(F.col("chunk_id").alias("id"), F.get("embedding", F.lit(1)).alias("y"), F.get("embedding", F.lit(2)).alias("z"))
    out = engine.chunks("turns").join(held, "id", "left").groupBy(M.field("role")["s"].alias("role"))
    return out.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("y") == 1).alias("embedded_as_given"), F.count_if(F.col("z") == 1).alias("embedded_by_fallback"))


class AnyWord:
    """(0, 0, 1) for a text with a word."""

    dims = 3

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([[0.0, 0.0, 1.0 if analysis.query_terms(t, "simple") else 0.0] for t in texts]).reshape(len(texts), 3)


@query("rebuild_and_compact", "SELECT count(*) AS chunks, count(*) FILTER (WHERE strlen(text) > 0) AS vectors, 1 AS batches, 'done' AS status FROM conversations WHERE role IN ('user', 'assistant')")
def rebuild_and_compact(spark: SparkSession, sf: str) -> DataFrame:
    """A space is embedded anew over two batches, which compaction then makes one."""
    engine = Engine(spark, shared_folder(spark, "rebuilt"))
    engine.create_collection("turns", embedding_dims=3, config={"analyzer": "simple"})
    rows = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"), "text", "role")
    for role in ("user", "assistant"):
        engine.ingest_frame("turns", rows.where(F.col("role") == role).drop("role"))
    status = engine.rebuild("turns", "default", AnyWord())["status"]
    c = engine.compact("turns")
    n, v = engine.chunks("turns").count(), engine.store.vectors(c, "default").count()
    return spark.createDataFrame([(n, v, len(c.live), status)], "chunks bigint, vectors bigint, batches int, status string")


@query("health", "SELECT 'ok' AS status, 1 AS collections, count(*) AS chunks FROM documents")
def health(spark: SparkSession, sf: str) -> DataFrame:
    h = _collection(spark, sf)[0].health()
    return spark.createDataFrame([(h["status"], h["collections"], h["chunks"])], "status string, collections int, chunks bigint")
