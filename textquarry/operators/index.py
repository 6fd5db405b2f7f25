"""Chunks, vector search, fusion of ranked lists and evidence, for all queries at once.

The lexical index and its search are in ``blocks``. Ranking is a per-query window limited to k, which
Spark cuts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN, ZH, Profile
from ..sources.tables import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
MISSING_RANK = 9999
#: Rows (query, term) up to which the query side is broadcast, about 100 bytes each.
BROADCAST_TERMS = 500_000
#: Parts of a term's postings in a join by shuffle.
SALTS = 16
#: Queries whose vectors go to every task at once.
QUERY_BLOCK = 4096
#: Vectors that a task multiplies with these at once: 32 MB of scores.
VECTOR_BLOCK = 1024


def fixed_windows(docs: DataFrame, size: int = 2000, overlap: int = 200, cap: int | None = None) -> DataFrame:
    """(doc_id, chunk_index, chunk) windows of ``size`` characters; consecutive ones share ``overlap``.

    Empty texts have no window. ``cap`` keeps the first windows, where that is the feature.
    """
    t = fx.blank("text")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(t) - overlap) / step), F.lit(1)) - 1
    if cap:
        last = F.least(last, F.lit(cap - 1))
    at = docs.where(F.length(t) > 0).select("doc_id", t.alias("text"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_index"))
    return at.select("doc_id", "chunk_index", F.substring("text", (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)).alias("chunk"))


def terms_of(profile: Profile = ZH, bigrams: bool = False, text: Column | str = "chunk") -> Column:
    """The terms of ``text`` in order; with ``bigrams`` also those of two consecutive terms, joined by a space."""
    one = F.regexp_extract_all(text, F.lit(profile.token), F.lit(0))
    if not bigrams:
        return one
    pairs = lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.concat(F.get(t, i), F.lit(" "), x))
    return F.get(F.transform(F.array(one), lambda t: F.concat(t, pairs(t))), F.lit(0))


def query_term_rows(queries: DataFrame, profile: Profile = ZH) -> DataFrame:
    """(query_id, term, qtf)."""
    terms = F.explode(F.regexp_extract_all(fx.blank("text"), F.lit(profile.token), F.lit(0)))
    return queries.select("query_id", terms.alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def with_terms(post: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """``post`` joined by term to ``wanted`` (query_id, term, ...): broadcast when ``small``, else dealt over SALTS parts a term."""
    if small:
        return post.join(F.broadcast(wanted), "term")
    dealt = post.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(SALTS)).cast("int"))
    return dealt.join(wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "__salt"]).drop("__salt")


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", ties: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """the ``k`` best rows of each query with their ``rank`` from 1; ties by ``ties``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.01, max_queries: int = QUERY_BLOCK) -> DataFrame:
    """C4: raw dot product of every query (query_id, query) with every row (vec_id, embedding); the best max(4k, 40), ties by id.

    Queries go to the tasks in blocks of about ``max_queries``, one pass over the vectors each; a task scores
    a batch by one matrix product and gives its own best rows only, which are merged after the shuffle.
    Null vectors, and those of another length than the queries', have no score.
    """
    most, n = max(4 * k, 40), queries.count()
    blocks = max(1, -(-n // max_queries))
    out = None
    for i in range(blocks):
        asked = queries.where(F.col("query").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()
        best = top_k(_block_search(asked, vectors, most, least), most, ties=("vec_id",))
        best = best if blocks == 1 else stored(best, "hits")  # so only one block of queries is held at a time
        out = best if out is None else out.unionByName(best)
    return out


def _block_search(asked: list, vectors: DataFrame, most: int, least: float) -> DataFrame:
    """(query_id, vec_id, score): the ``most`` best rows of each task for the queries ``asked``."""
    import numpy as np

    ids = [r["query_id"] for r in asked]
    matrix = np.array([r["query"] for r in asked], dtype=float)
    width = matrix.shape[1] if len(ids) else 0

    def run(frames):
        import pyarrow as pa

        best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        worst = np.full(len(ids), -np.inf)  # of the queries that have ``most`` rows, the last one's score
        for frame in frames:
            for start in range(0, len(frame) if ids else 0, VECTOR_BLOCK):
                part = frame.slice(start, VECTOR_BLOCK)
                vec = part.column(0).to_numpy()
                score = np.round(part.column(1).flatten().to_numpy().astype(float).reshape(len(vec), width) @ matrix.T, 6)
                new = (score > least) & (score >= worst)
                for q in np.flatnonzero(new.any(axis=0)):
                    at = np.flatnonzero(new[:, q])
                    s, v = np.concatenate((best[q][0], score[at, q])), np.concatenate((best[q][1], vec[at]))
                    order = np.lexsort((v, -s))[:most]
                    best[q] = (s[order], v[order])
                    if len(order) == most:
                        worst[q] = s[order[-1]]
        for q, (s, v) in zip(ids, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(v), pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    rows = vectors.where(F.size("embedding") == width).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


#: Weights of the vector list where a file looks like fiction or academic, else VECTOR_WEIGHT; the lexical list has the rest.
FICTION_WEIGHT, ACADEMIC_WEIGHT, VECTOR_WEIGHT = 0.55, 0.80, 0.7


def vector_weight(hint: Column, fiction: str, academic: str) -> Column:
    return F.when(hint.rlike(fiction), FICTION_WEIGHT).when(hint.rlike(academic), ACADEMIC_WEIGHT).otherwise(VECTOR_WEIGHT)


def fuse(vec: DataFrame, lex: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two candidate lists (query_id, key..., score, rank) over query variants.

    Variants of a query share its id: the best score and rank of each list count. ``weight`` names the
    column of the lists that has the vector list's weight.
    """
    extra = [F.max(weight).alias(weight)] if weight else []

    def best(d, side):
        return d.groupBy("query_id", *key).agg(F.max("score").alias(f"{side}_score"), F.min("rank").alias(f"{side}_rank"), *(e.alias(f"{side}_weight") for e in extra))

    both = best(vec, "v").join(best(lex, "b"), ["query_id", *key], "full")
    rank = lambda c: F.coalesce(c, F.lit(MISSING_RANK))
    wv = F.coalesce("v_weight", "b_weight") if weight else F.lit(VECTOR_WEIGHT)
    score = wv / (RRF_K + rank("v_rank")) + (1 - wv) / (RRF_K + rank("b_rank"))
    out = both.withColumn("score", F.round(score, 8))
    return out.drop("v_weight", "b_weight") if weight else out


def phrase_bonus(cands: DataFrame, queries: DataFrame, text: str = "chunk") -> DataFrame:
    """Add min(0.06, 0.02 hits) for the query's phrase terms that the candidate's text contains."""
    terms = queries.select("query_id", fx.phrase_terms("text").alias("terms"))
    hit = cands.join(terms, "query_id")
    n = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col(text)), t)))
    return hit.withColumn("score", F.round(F.col("score") + F.least(F.lit(0.06), 0.02 * n), 8)).drop("terms")


def sentence_evidence(hits: DataFrame, queries: DataFrame, n: int = 8, per_chunk: int = 2, profile: Profile = LATIN) -> DataFrame:
    """Sentences of hit chunks by the number of query terms in them; ``per_chunk`` a chunk, ``n`` a query.

    ``hits`` has query_id, doc_id, chunk_index, chunk and rank.
    """
    terms = queries.select("query_id", fx.query_terms("text", profile).alias("terms"))
    rows = hits.join(terms, "query_id").select("query_id", "doc_id", "chunk_index", "rank", "terms", F.posexplode(fx.sentence_array("chunk", profile)).alias("pos", "sentence"))
    rows = rows.withColumn("hit_count", F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("sentence")), t)))).where("hit_count > 0")
    inside = Window.partitionBy("query_id", "doc_id", "chunk_index").orderBy(F.desc("hit_count"), "pos")
    rows = rows.withColumn("in_chunk", F.row_number().over(inside)).where(F.col("in_chunk") <= per_chunk)
    over = Window.partitionBy("query_id").orderBy(F.desc("hit_count"), "pos", "doc_id", "chunk_index")
    rows = rows.withColumn("evidence_rank", F.row_number().over(over)).where(F.col("evidence_rank") <= n)
    return rows.select("query_id", "evidence_rank", "doc_id", "chunk_index", "pos", "hit_count", "sentence")


def mmr(hits: DataFrame, vectors: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Greedy diversity re-ranking of each query's first max(4k, 16) hits (query_id, vec_id, score, rank).

    Picks the largest trade * score - (1 - trade) * largest cosine to what is chosen. A query's pool
    is bounded by k, so a group fits one task.
    """
    import numpy as np
    import pandas as pd

    pool = hits.where(F.col("rank") <= max(4 * k, 16)).join(vectors, "vec_id")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        if len(pdf) > k:
            m = np.stack([np.asarray(v, dtype=float) for v in pdf["embedding"]])
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            score, near, chosen = pdf["score"].to_numpy(), np.zeros(len(pdf)), []
            for _ in range(k):
                value = trade * score - (1 - trade) * near
                value[chosen] = -np.inf
                best = int(np.argmax(value))
                if value[best] <= -1:
                    break
                chosen.append(best)
                cos = m @ m[best]
                near = cos if len(chosen) == 1 else np.maximum(near, cos)
            pdf = pdf.iloc[chosen]
        return pd.DataFrame({"query_id": pdf["query_id"], "vec_id": pdf["vec_id"], "place": range(1, len(pdf) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, place long")
