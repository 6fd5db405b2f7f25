"""Registered queries over the lexical and vector index, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN
from ..operators import blocks as bl
from ..operators import index as ix
from ..operators import units as u
from ..operators import vectors as vx
from ..operators.evidence import query_variants
from ..sources.tables import drop, stored, table

_ENDERS = "([" + LATIN.enders + "])"
_STOP = ", ".join(f"'{w}'" for w in LATIN.stopwords)

#: CTEs shared by the SQL twins.
CHUNKS = """x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE length(coalesce(text, '')) > 0),
chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 1800 + 1, 2000) AS chunk FROM (
    SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 200) / 1800), 1)::BIGINT)) AS i FROM x))"""
INDEX = CHUNKS + """,
tok AS (SELECT doc_id, chunk_index, regexp_extract_all(chunk, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_]+') AS ts FROM chunks),
post AS (SELECT term, doc_id, chunk_index, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(ts) AS term FROM tok) GROUP BY ALL),
len AS (SELECT doc_id, chunk_index, len(ts) AS n_terms FROM tok),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM len) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25 = INDEX + """,
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
    unnest(regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, chunk_index, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / (SELECT avg(n_terms) FROM len)))), 6) AS score
    FROM q JOIN stats USING (term) JOIN post USING (term) JOIN len USING (doc_id, chunk_index) GROUP BY ALL HAVING score > 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored) WHERE rank <= 5)"""
EVIDENCE = BM25 + f""",
qt AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'),
    lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))) AS terms FROM benchmark),
sent AS (SELECT query_id, doc_id, chunk_index, rank, terms, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM (
    SELECT query_id, doc_id, chunk_index, rank, terms, list_filter(list_transform(string_split(regexp_replace(chunk, '{_ENDERS}', '\\1' || chr(10), 'g'), chr(10)),
        lambda s: trim(s, ' ')), lambda s: s != '') AS ss FROM hits JOIN chunks USING (doc_id, chunk_index) JOIN qt USING (query_id))),
ev AS (SELECT *, len(list_filter(terms, lambda t: contains(lower(sentence), t))) AS hit_count FROM sent),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY hit_count DESC, pos) AS in_chunk FROM ev WHERE hit_count > 0),
ev3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, pos, doc_id, chunk_index) AS evidence_rank FROM ev2 WHERE in_chunk <= 2)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.fixed_windows(table(spark, sf_dir, "documents"))


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.term_stats(bl.build(chunks(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.bm25_top(questions(spark, sf_dir), bl.build(chunks(spark, sf_dir)), 5)


def bm25_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the 5 best chunks of every benchmark passage and their matching sentences."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    hits = bl.bm25_top(q, bl.build(c), 5)
    return ix.sentence_evidence(hits.join(c, ["doc_id", "chunk_index"]), q)


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vector_search(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 10)


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.mmr(vector_search(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5)


#: Sources that stand for fiction and for academic files.
FICTION, ACADEMIC = "src[01]$", "src1[0-3]$"
#: Variants of a query have the id 4 query_id + variant while they are searched.
VARIANTS = 4


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 for every passage: itself, its refinement (H12) and its narrative expansion (B21) when asked for its history."""
    q = questions(spark, sf_dir)
    asked = F.concat(F.lit("history of "), fx.blank("text"))
    rewrites = q.select("query_id", F.lit(1).alias("ord"), fx.refine_query("text").alias("text")).unionByName(q.select("query_id", F.lit(2).alias("ord"), fx.narrative_expand(asked).alias("text")))
    return query_variants(q, rewrites).select((F.col("query_id") * VARIANTS + F.col("place")).alias("query_id"), "text")


def _candidates(spark, sf_dir, hits: DataFrame, c: DataFrame) -> DataFrame:
    """Hits of variants under their query's id, keyed by document and first 100 characters, with the document's weight."""
    start = c.select("doc_id", "chunk_index", F.substring("chunk", 1, 100).alias("prefix"))
    weight = table(spark, sf_dir, "documents").select("doc_id", ix.vector_weight(F.col("source"), FICTION, ACADEMIC).alias("weight"))
    rows = hits.join(start, ["doc_id", "chunk_index"]).join(weight, "doc_id")
    return rows.select(F.expr(f"query_id div {VARIANTS}").alias("query_id"), "doc_id", "prefix", "score", "rank", "weight")


def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for every passage in up to three variants, by tf-idf cosine and BM25, fused."""
    q, c = stored(variants(spark, sf_dir), "variants"), chunks(spark, sf_dir)
    index = bl.build(c, bigrams=True)
    vec = _candidates(spark, sf_dir, bl.cosine_top(q, index, bl.vocabulary(index), 40), c)
    lex = _candidates(spark, sf_dir, bl.bm25_top(q, index, 40), c)
    fused = ix.fuse(vec, lex, ["doc_id", "prefix"], "weight")
    return fused.select("query_id", "doc_id", F.md5("prefix").alias("prefix_md5"), "v_rank", "b_rank", "score")


def hybrid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 over the vectors of D7: BM25 fused with dot products of SVD vectors of chunks (D7), found by an inverted file."""
    q, c = stored(variants(spark, sf_dir), "variants"), chunks(spark, sf_dir)
    index = bl.build(c, bigrams=True)
    terms = bl.vocabulary(index)
    counts, names, idf = bl.term_counts(index, terms)
    v = u.components(bl.weighed(counts, idf), len(names))
    asked = u.projected(bl.query_weights(q, terms).select("term", F.col("query_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("a").alias("weight")), names, v)
    lists = vx.build(counts, embed=u.embedder(spark, v, idf))
    drop(counts)
    hits = vx.search(asked.select(F.col("doc_id").alias("query_id"), "embedding"), lists, 40)
    fused = ix.fuse(_candidates(spark, sf_dir, hits, c), _candidates(spark, sf_dir, bl.bm25_top(q, index, 40), c), ["doc_id", "prefix"], "weight")
    return fused.select("query_id", "doc_id", F.md5("prefix").alias("prefix_md5"), "v_rank", "b_rank", "score")


def phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    hits = bl.bm25_top(q, bl.build(c), 5).select("query_id", "doc_id", "chunk_index", (1 / (60 + F.col("rank"))).alias("score"))
    return ix.phrase_bonus(hits.join(c, ["doc_id", "chunk_index"]), q).select("query_id", "doc_id", "chunk_index", "score")


def tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.tfidf(chunks(spark, sf_dir))


def weak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose best fused score is below 0.010."""
    best = hybrid_fuse(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("weak", F.col("best") < 0.010)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered citations of every query's hits, distinct by file, page and chunk; two chunks stand for a page."""
    hits = bm25_search(spark, sf_dir).withColumn("page", F.expr("chunk_index div 2") + 1)
    hits = hits.groupBy("query_id", "doc_id", "page", "chunk_index").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    loc = F.format_string("doc %d, page %d, part %d", "doc_id", "page", F.col("chunk_index") + 1)
    return hits.select("query_id", number.alias("number"), loc.alias("location"), F.round(1 / (1 + F.col("score")), 4).alias("distance"))


_VEC = """dots AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dots WHERE score > 0.01) WHERE rank <= 40)"""
_TOKEN = "[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_]+"


def _grams(name: str, rows: str, keys: str) -> str:
    """CTE: (keys, term) of every term and bigram of ``t``."""
    return f"""{name} AS (SELECT {keys}, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM (
        SELECT {keys}, regexp_extract_all(t, '{_TOKEN}') AS ts FROM {rows}))"""


#: CTEs up to ``tw``: (term, doc_id, chunk_index, w) by tf-idf.
TFIDF = f"""{_grams('gr', '(SELECT *, chunk AS t FROM chunks)', 'doc_id, chunk_index')},
gp AS (SELECT term, doc_id, chunk_index, count(*) AS tf FROM gr GROUP BY ALL),
voc AS (SELECT term, ln((1 + (SELECT count(*) FROM chunks)) / (1 + count(*))) + 1 AS idf FROM gp GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
gw AS (SELECT term, doc_id, chunk_index, tf * idf AS raw FROM gp JOIN voc USING (term)),
tw AS (SELECT term, doc_id, chunk_index, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, chunk_index)) AS w FROM gw)"""
_ASK = "'history of ' || coalesce(text, '')"
_BM25_OF = BM25[len(INDEX) :].replace("SELECT item_id AS query_id,", "SELECT query_id,").replace("FROM benchmark)", "FROM var)").replace("rank <= 5", "rank <= 40")
_FUSE = f"""{INDEX}, {TFIDF},
nw AS (SELECT item_id, i, ts[i] AS t FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower({_ASK}), '[a-z0-9_]+') AS ts FROM benchmark))),
ne AS (SELECT item_id, arg_min(t, (-length(t), i)) AS entity FROM nw WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY ALL),
va AS (SELECT item_id, 0 AS ord, trim(coalesce(text, ''), ' ') AS text FROM benchmark UNION ALL SELECT item_id, 1, trim(substr(coalesce(text, ''), 1, 30), ' ') FROM benchmark
    UNION ALL SELECT item_id, 2, entity || ' {' '.join(LATIN.history)}' FROM ne),
vb AS (SELECT item_id, text, min(ord) AS ord FROM va WHERE text != '' GROUP BY ALL),
var AS (SELECT * FROM (SELECT item_id * {VARIANTS} + row_number() OVER (PARTITION BY item_id ORDER BY ord, text) AS query_id, text FROM vb)){_BM25_OF},
{_grams('qg', '(SELECT query_id, text AS t FROM var)', 'query_id')},
qr AS (SELECT query_id, term, count(*) * any_value(idf) AS raw FROM qg JOIN voc USING (term) GROUP BY ALL),
qw AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS a FROM qr),
cs AS (SELECT query_id, doc_id, chunk_index, round(sum(a * w), 6) AS score FROM qw JOIN tw USING (term) GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM cs WHERE score > 0.01) WHERE rank <= 40),
wt AS (SELECT doc_id, CASE WHEN regexp_matches(source, '{FICTION}') THEN {ix.FICTION_WEIGHT} WHEN regexp_matches(source, '{ACADEMIC}') THEN {ix.ACADEMIC_WEIGHT} ELSE {ix.VECTOR_WEIGHT} END::DOUBLE AS weight FROM documents),
lv AS (SELECT query_id // {VARIANTS} AS query_id, doc_id, substr(chunk, 1, 100) AS prefix, min(rank) AS rank FROM ch JOIN chunks USING (doc_id, chunk_index) GROUP BY ALL),
ll AS (SELECT query_id // {VARIANTS} AS query_id, doc_id, substr(chunk, 1, 100) AS prefix, min(rank) AS rank FROM hits JOIN chunks USING (doc_id, chunk_index) GROUP BY ALL),
fused AS (SELECT query_id, doc_id, md5(prefix) AS prefix_md5, v_rank, b_rank, round(weight / (60 + coalesce(v_rank, 9999)) + (1 - weight) / (60 + coalesce(b_rank, 9999)), 8) AS score FROM (
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.prefix, b.prefix) AS prefix, a.rank AS v_rank, b.rank AS b_rank
    FROM lv a FULL JOIN ll b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.prefix = b.prefix) JOIN wt USING (doc_id))"""

QUERIES = {
    "fixed_windows": (fixed_windows, f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM chunks"),
    "bm25_index": (bm25_index, f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM stats"),
    "bm25_search": (bm25_search, f"WITH {BM25} SELECT query_id, doc_id, chunk_index, score, rank FROM hits"),
    "bm25_evidence": (bm25_evidence, f"WITH {EVIDENCE} SELECT query_id, evidence_rank, doc_id, chunk_index, pos, hit_count, sentence FROM ev3 WHERE evidence_rank <= 8"),
    "vector_search": (vector_search, f"WITH {_VEC} SELECT * FROM vec"),
    "mmr_rerank": (mmr_rerank, None),
    "hybrid_fuse": (hybrid_fuse, f"WITH {_FUSE} SELECT * FROM fused"),
    "hybrid_vectors": (hybrid_vectors, None),
    "weak_evidence": (weak_evidence, f"WITH {_FUSE} SELECT query_id, max(score) AS best, max(score) < 0.010 AS weak FROM fused GROUP BY query_id"),
    "tfidf_matrix": (tfidf_matrix, f"WITH {CHUNKS}, {TFIDF} SELECT term, doc_id, chunk_index, round(w, 6) AS weight FROM tw"),
    "citations": (citations, f"WITH {BM25} SELECT query_id, rank AS number, 'doc ' || doc_id || ', page ' || (chunk_index // 2 + 1) || ', part ' || (chunk_index + 1) AS location, round(1 / (1 + score), 4) AS distance FROM hits"),
}
# The first eight distinct terms in order, which DuckDB's list_distinct does not keep.
_ORDERED = f"""qt AS (SELECT item_id AS query_id, list(t ORDER BY i)[1:8] AS terms FROM (
    SELECT item_id, t, min(i) AS i FROM (SELECT item_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t FROM (
        SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS ts FROM benchmark))
    WHERE length(t) BETWEEN 2 AND 4 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}) GROUP BY ALL) GROUP BY item_id)"""
QUERIES["phrase_bonus"] = (phrase_bonus, f"""WITH {BM25}, {_ORDERED}
    SELECT query_id, doc_id, chunk_index, round(1 / (60 + rank) + least(0.06, 0.02 * len(list_filter(terms, lambda t: contains(lower(chunk), t)))), 8) AS score
    FROM hits JOIN chunks USING (doc_id, chunk_index) JOIN qt USING (query_id)""")
