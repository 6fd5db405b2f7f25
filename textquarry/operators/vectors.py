"""An inverted-file index of chunk vectors, as a stored table, and search in it.

Centroids are fitted by spherical k-means on a bounded sample. Every vector goes to the list of its nearest
centroid; lists are sorted and packed, up to PACK vectors a row, so a list of any size is many rows and a
search reads only the row groups of the lists it probes. What is sampled, dealt and stored of a vector are the columns that it is made of, which
for SVD vectors of chunks are the counts of their terms, a tenth of their 384 numbers: tasks make the vectors. A query's lists are those whose centroids it is
most alike; their vectors are scored exactly, by one matrix product a row. ``probes=None`` scans all lists: the exact mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .index import top_k

#: Vectors that centroids are fitted on at most, by the hash of their ids; most lists; vectors of a row; rows of a list that are dealt together, about.
SAMPLE, LISTS, PACK, DEALT = 20_000, 1024, 512, 4096
#: Queries that are sent to the lists at a time.
QUERIES = 20_000
#: Share of the lists that a search probes by default.
PROBED = 0.25


@dataclass(frozen=True)
class Ivf:
    """``packs``: (list, and an array of each of doc_id, chunk_index and the columns of a vector); ``centroids``: lists x places; ``embed`` makes vectors of columns."""

    packs: DataFrame
    centroids: np.ndarray
    embed: Callable


def dense(embedding) -> np.ndarray:
    """Vectors that are stored as they are: the matrix of an Arrow list array."""
    return np.asarray(embedding.flatten().to_numpy().reshape(len(embedding), -1), dtype=float)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(m[at : at + 4096] @ centroids.T, axis=1) for at in range(0, len(m), 4096))])


def _sampled(rows: DataFrame, embed: Callable, sample: int) -> np.ndarray:
    """The vectors of at most ``sample`` rows, by the hash of their ids; only ids are sorted and shuffled."""
    keys = [F.xxhash64("doc_id", "chunk_index").alias("luck"), F.col("doc_id"), F.col("chunk_index")]
    last = rows.select(*keys).orderBy("luck", "doc_id", "chunk_index").limit(sample).agg(F.max(F.struct("luck", "doc_id", "chunk_index")).alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            if len(frame):
                m = embed(*frame.columns[3:])
                yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))], names=["luck", "doc_id", "chunk_index", "embedding"])

    value = [c for c in rows.columns if c not in ("doc_id", "chunk_index")]
    taken = rows.select(*keys, *value).join(F.broadcast(last), F.struct("luck", "doc_id", "chunk_index") <= F.col("x")).select("luck", "doc_id", "chunk_index", *value)
    taken = taken.mapInArrow(run, f"luck long, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, embedding array<double>").toArrow()
    taken = taken.sort_by([("luck", "ascending"), ("doc_id", "ascending"), ("chunk_index", "ascending")]).slice(0, sample)
    return dense(taken.column("embedding").combine_chunks()) if len(taken) else np.zeros((0, 0))


def fit_centroids(m: np.ndarray, n_lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means on sampled vectors; fewer vectors than lists give fewer lists."""
    if not len(m):
        return np.zeros((0, 0))
    m = _unit(m)
    rng = np.random.default_rng(seed)
    centroids = m[np.sort(rng.choice(len(m), min(n_lists, len(m)), replace=False))]
    for _ in range(rounds):
        near = _nearest(m, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, near, m)
        # An empty list takes a random vector.
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        total[empty] = m[rng.integers(0, len(m), len(empty))]
        centroids = _unit(total)
    return centroids


def build(vectors: DataFrame, n_lists: int | None = None, sample: int = SAMPLE, embed: Callable = dense) -> Ivf:
    """The index of ``vectors`` (doc_id, chunk_index, embedding), all of one length; null vectors are left out.

    By default there are as many lists as the square root of the vectors, LISTS at most. In place of ``embedding`` rows may
    have other columns of which ``embed``, given their Arrow arrays, makes a matrix of vectors; these must be in a stored table.
    """
    value = [c for c in vectors.columns if c not in ("doc_id", "chunk_index")]
    vectors = vectors.select("doc_id", "chunk_index", *value).dropna(subset=value)
    total = vectors.count()
    n = n_lists or int(min(LISTS, max(1, total**0.5)))
    m = _sampled(vectors, embed, sample)
    centroids = fit_centroids(m, n)
    # A list is no hot key: of a larger one, by the sample, rows are dealt over several parts.
    held = np.bincount(_nearest(m, centroids), minlength=len(centroids))
    parts = np.ceil(held * (total / max(1, len(m))) / DEALT).clip(1).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, parts))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    names = ["doc_id", "chunk_index", *value]

    def assign(frames):
        import pyarrow as pa

        centroids, parts = shared.value
        for frame in frames:
            if len(frame):
                near = _nearest(embed(*frame.columns[3:]), centroids)
                part = frame.column(0).to_numpy() % parts[near]
                yield pa.RecordBatch.from_arrays([*frame.columns[1:], pa.array(near, pa.int32()), pa.array(part, pa.int32())], names=[*names, "list", "part"])

    def pack(frames):
        import pyarrow as pa

        for frame in frames:
            lists = frame.column(len(names)).to_numpy()
            cuts = np.flatnonzero(np.diff(lists, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(lists)], strict=True):
                for at in range(a, b, PACK):
                    part = frame.slice(at, min(PACK, b - at))
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array([lists[a]], pa.int32()), *(one(x) for x in part.columns[: len(names)])], names=["list", *names])

    placed = vectors.select(F.xxhash64("doc_id", "chunk_index"), *names).mapInArrow(assign, ", ".join(f"{c} {kinds[c]}" for c in names) + ", list int, part int")
    placed = placed.repartition("list", "part").sortWithinPartitions("list").drop("part")
    return Ivf(stored(placed.mapInArrow(pack, "list int, " + ", ".join(f"{c} array<{kinds[c]}>" for c in names)), "lists", wide=True), centroids, embed)


def search(queries: DataFrame, index: Ivf, k: int, least: float = 0.01, probes: int | None = 0) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, rank): the ``k`` largest dot products over ``least`` of each query (query_id, embedding).

    ``probes`` lists are searched for each query: 0 stands for the share PROBED of all, None for all lists. Queries
    are gathered QUERIES at a time; each group's hits are stored before the next. Ties by document and chunk.
    """
    queries = queries.where(F.col("embedding").isNotNull())
    groups = max(1, -(-queries.count() // QUERIES))
    out = None
    for i in range(groups):
        own = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == i)
        best = top_k(_pass(own, index, k, least, probes), k)
        best = best if groups == 1 else stored(best, "hits")
        out = best if out is None else out.unionByName(best)
    return out


def _pass(queries: DataFrame, index: Ivf, k: int, least: float, probes: int | None) -> DataFrame:
    given = queries.select("query_id", "embedding").orderBy("query_id").toArrow().combine_chunks()
    ids = given.column(0).to_numpy()
    m = given.column(1).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, index.centroids.shape[1]))
    n_lists = len(index.centroids)
    packs, embed = index.packs, index.embed
    asks = np.ones((len(ids), n_lists), dtype=bool)
    if probes is not None and n_lists and len(ids):
        most = min(n_lists, probes or max(1, int(np.ceil(PROBED * n_lists))))
        asks[:] = False
        np.put_along_axis(asks, np.argpartition(-(m @ index.centroids.T), most - 1, axis=1)[:, :most], True, axis=1)
        packs = packs.where(F.col("list").isin(np.flatnonzero(asks.any(axis=0)).tolist()))
    shared = queries.sparkSession.sparkContext.broadcast((ids, m, asks))
    kinds = {f.name: f.dataType for f in packs.schema}

    def run(frames):
        import pyarrow as pa

        ids, m, asks = shared.value
        kept: list = [None] * len(ids)
        worst = np.full(len(ids), least)  # of the queries that have k rows, a little below the last one's score
        for frame in frames:
            for r in range(len(frame)):
                docs, chunk = (frame.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                own = np.flatnonzero(asks[:, frame.column(0)[r].as_py()])
                scores = np.round(m[own] @ embed(*(c[r].values for c in frame.columns[3:])).T, 6)
                reach = scores.max(axis=1) > worst[own]
                for q, score in zip(own[reach], scores[reach], strict=True):
                    hit = np.flatnonzero(score > worst[q])
                    if len(hit):
                        s, d, c = score[hit], docs[hit], chunk[hit]
                        if kept[q] is not None:
                            s, d, c = np.concatenate((kept[q][0], s)), np.concatenate((kept[q][1], d)), np.concatenate((kept[q][2], c))
                        top = np.lexsort((c, d, -s))[:k]
                        kept[q] = (s[top], d[top], c[top])
                        if len(top) == k:
                            worst[q] = max(least, s[top[-1]] - 1e-9)
        full = [(q, x) for q, x in zip(ids, kept, strict=True) if x is not None]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in full], [len(x[0]) for _, x in full])), *(pa.array(np.concatenate([x[i] for _, x in full])) for i in (1, 2, 0))], names=["query_id", "doc_id", "chunk_index", "score"])

    ddl = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {kinds['doc_id'].elementType.simpleString()}, chunk_index {kinds['chunk_index'].elementType.simpleString()}, score double"
    return packs.mapInArrow(run, ddl)
