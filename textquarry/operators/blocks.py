"""A stored lexical index in blocks of chunks, and ranked search over it.

A block is one row: up to BLOCK chunks with the packed lists of their terms (term, number of chunks, places,
frequencies); a bigram is the numbers of its two terms, and its text is nowhere stored. It is made inside the task that cuts the chunks, so no posting is shuffled, and written once;
statistics of single terms come from a row for each block and term. A search sends packed queries, a bounded number
of terms at a time, to the blocks: a task scores its blocks one after the other, passes over a block for a query whose
best possible score there (from the lists' maxima) is below what the query already has k times, and gives
its k best rows a query. So what is shuffled is k rows for each query and task, however many chunks match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import ZH, Profile
from ..sources.tables import drop, stored
from .index import B, BROADCAST_TERMS, EPSILON, K1, query_term_rows, terms_of, top_k

#: Chunks and terms (with repeats) of a block at most; a single chunk may have more terms.
BLOCK, BLOCK_TERMS = 512, 400_000

#: For each term of a vocabulary, terms that a block gives at first, and terms that are counted in all blocks at most.
GIVEN, ABLE = 4, 8

_SCHEMA = "doc_id {doc}, chunk_index array<int>, n_terms array<int>, term array<string>, follow array<int>, second array<int>, df array<int>, at array<int>, tf array<int>"
#: Columns that lists are read from.
_LISTS = ["term", "follow", "second", "df", "at", "tf"]


def build(chunks: DataFrame, profile: Profile = ZH, bigrams: bool = False) -> DataFrame:
    """The index of ``chunks`` (doc_id, chunk_index, chunk), stored: one row a block.

    ``doc_id``, ``chunk_index`` and ``n_terms`` have an entry a chunk; ``term`` one a distinct single term of the block.
    With ``bigrams`` two consecutive terms, joined by a space, are a term too (``n_terms`` counts single ones): ``follow`` has
    for each single term how many bigrams begin with it, and ``second`` the numbers of their second terms, ascending for each first one.
    ``df`` has the chunks of all single terms and then of all bigrams; ``at`` and ``tf`` are their lists
    in this order, one after the other: places of chunks in the block, and frequencies.
    """

    def run(frames):
        import numpy as np
        import pyarrow as pa

        for frame in frames:
            if not len(frame):
                continue
            sizes = frame.column(2).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            start = 0
            while start < len(frame):
                base = ends[start] - sizes[start]
                stop = min(start + BLOCK, max(start + 1, int(np.searchsorted(ends, base + BLOCK_TERMS, side="right"))))
                yield _packed(frame.slice(start, stop - start), sizes[start:stop], bigrams)
                start = stop

    rows = chunks.select("doc_id", "chunk_index", terms_of(profile).alias("terms"))
    return stored(rows.mapInArrow(run, _SCHEMA.format(doc=f"array<{chunks.schema['doc_id'].dataType.simpleString()}>")), "index", wide=True)


def _packed(part, sizes, bigrams: bool):
    import numpy as np
    import pyarrow as pa

    coded = part.column(2).flatten().dictionary_encode()
    ids, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    places = np.repeat(np.arange(len(part)), sizes)
    keys, tf = np.unique(ids * BLOCK + places, return_counts=True)
    number, at = np.divmod(keys, BLOCK)
    df = np.bincount(number, minlength=len(terms))
    follow, second = np.zeros(len(terms) if bigrams else 0, np.int64), np.zeros(0, np.int64)
    if bigrams and len(ids) > 1:
        inside = places[1:] == places[:-1]
        pairs, pair = np.unique(ids[:-1][inside] * len(terms) + ids[1:][inside], return_inverse=True)
        keys, tf2 = np.unique(pair * BLOCK + places[1:][inside], return_counts=True)
        number, at2 = np.divmod(keys, BLOCK)
        first, second = np.divmod(pairs, len(terms))
        follow = np.bincount(first, minlength=len(terms))
        df, at, tf = np.concatenate((df, np.bincount(number, minlength=len(pairs)))), np.concatenate((at, at2)), np.concatenate((tf, tf2))
    one = lambda x, kind=None: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind))
    values = [one(part.column(0)), one(part.column(1).cast(pa.int32())), one(sizes, pa.int32()), one(terms), *(one(x, pa.int32()) for x in (follow, second, df, at, tf))]
    return pa.RecordBatch.from_arrays(values, names=["doc_id", "chunk_index", "n_terms", *_LISTS])


def sizes_of(blocks: DataFrame) -> DataFrame:
    """One row (n, mean_terms) of the chunks."""
    total = F.sum(F.aggregate("n_terms", F.lit(0).cast("long"), lambda a, x: a + x))
    return blocks.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).alias("n"), total.alias("total")).select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean_terms"))


def _frequent(blocks: DataFrame, most: int) -> DataFrame:
    """(term, freq, rest): of each block the ``most`` terms with most occurrences, and the occurrences of its next one; a row without term for blocks that have more."""

    def run(frames):
        import numpy as np
        import pyarrow as pa

        for frame in frames:
            for r in range(len(frame)):
                row = {name: frame.column(c)[r] for c, name in enumerate(frame.schema.names)}
                df = row["df"].values.to_numpy()
                if not len(df):
                    continue
                freq = np.add.reduceat(row["tf"].values.to_numpy().astype(np.int64), np.cumsum(df) - df)
                top, rest = np.arange(len(freq)), 0
                if len(freq) > most:
                    top = np.argpartition(-freq, most)
                    top, rest = top[:most], freq[top[most]]
                terms = pa.concat_arrays([_names(row, np.sort(top)), pa.array([None], pa.string())])
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.append(freq[np.sort(top)], 0)), pa.array(np.full(len(terms), rest), pa.int64())], names=["term", "freq", "rest"])

    return blocks.select(*(c for c in _LISTS if c != "at")).mapInArrow(run, "term string, freq long, rest long")


def _names(row, places):
    """The terms of a block at ``places``, ascending: single ones and then bigrams."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    terms, n = row["term"].values, len(row["term"].values)
    pairs = places[places >= n] - n
    first = np.repeat(np.arange(len(row["follow"].values)), row["follow"].values.to_numpy())[pairs]
    second = row["second"].values.to_numpy()[pairs]
    return pa.concat_arrays([terms.take(pa.array(places[places < n])), pc.binary_join_element_wise(terms.take(pa.array(first, pa.int64())), terms.take(pa.array(second, pa.int64())), " ")])


def document_frequencies(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, freq): chunks and occurrences of ``terms`` (term), which are sent to the blocks; a task adds its own blocks."""
    import pyarrow as pa

    names = [r["term"] for r in terms.select("term").collect()]
    shared = blocks.sparkSession.sparkContext.broadcast((_parts(names), pa.array(names, pa.string())))

    def run(frames):
        import numpy as np

        parts, names = shared.value
        df, freq = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for frame in frames:
            for r in range(len(frame)):
                row = {name: frame.column(c)[r] for c, name in enumerate(frame.schema.names)}
                number, first, length = _lists(row, parts)
                df[number] += length
                if len(number):
                    freq[number] += np.add.reduceat(row["tf"].values.to_numpy().astype(np.int64)[_gather(first, length)], np.cumsum(length) - length)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(has)), pa.array(df[has]), pa.array(freq[has])], names=["term", "df", "freq"])

    rows = blocks.select(*(c for c in _LISTS if c != "at")).mapInArrow(run, "term string, df long, freq long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("freq").alias("freq"))


def term_stats(blocks: DataFrame) -> DataFrame:
    """(term, df, idf) of the single terms, where a negative idf becomes EPSILON times the mean idf."""
    single = F.arrays_zip("term", F.slice("df", F.lit(1), F.size("term")).alias("df"))
    df = blocks.select(F.explode(single).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    raw = df.crossJoin(F.broadcast(sizes_of(blocks).select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = stored(raw, "terms")
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_top(queries: DataFrame, blocks: DataFrame, k: int, profile: Profile = ZH, most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """The ``k`` best chunks of each query (query_id, text) with a positive score, rounded to 6 decimals; ties by document and chunk."""
    asked = stored(query_term_rows(queries, profile), "asked")
    stats = term_stats(blocks).join(asked.select("term").distinct(), "term", "left_semi")
    asked = stored(asked.join(stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("a")), "asked")
    mean = sizes_of(blocks).first()["mean_terms"]

    def weigh(n_terms, number, at, tf):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms[at] / mean))

    return search(asked, blocks, k, 0.0, weigh, most_terms)


def cosine_top(queries: DataFrame, blocks: DataFrame, terms: DataFrame, k: int, least: float = 0.01, profile: Profile = ZH, most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """C4 in the space of tf-idf: the ``k`` best chunks of each query by cosine over ``least``, of the vocabulary ``terms`` (term, idf)."""
    return search(query_weights(queries, terms, profile), blocks, k, least, None, most_terms, terms)


def query_weights(queries: DataFrame, terms: DataFrame, profile: Profile = ZH) -> DataFrame:
    """(query_id, term, a): L2-normalised tf-idf of the queries (query_id, text) over a vocabulary ``terms``."""
    asked = queries.select("query_id", F.explode(terms_of(profile, bigrams=True, text=fx.blank("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    asked = asked.join(F.broadcast(terms), "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    return asked.select("query_id", "term", (F.col("raw") / norm).alias("a"))


def _parts(terms: list[str]):
    """Of single terms and bigrams: their distinct single terms, and the numbers among these of each term's first and, or -1, second one."""
    import numpy as np
    import pyarrow as pa

    known: dict[str, int] = {}
    numbers = np.array([(known.setdefault(a, len(known)), known.setdefault(b, len(known)) if space else -1) for a, space, b in (t.partition(" ") for t in terms)], dtype=np.int64).reshape(-1, 2)
    return pa.array(list(known), pa.string()), numbers[:, 0], numbers[:, 1]


def _lists(row, wanted):
    """Of a block: for each term of ``wanted`` (_parts) that it has its number there, and its list as (first, length) into at and tf."""
    import numpy as np
    import pyarrow.compute as pc

    single, one, two = wanted
    n = len(row["term"].values)
    known = pc.index_in(single, value_set=row["term"].values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = known[one]
    if (two >= 0).any():
        pair = np.flatnonzero((two >= 0) & (place >= 0))
        second = known[two[pair]]
        place[two >= 0] = -1
        pair, key = pair[second >= 0], (known[one[pair]] * n + second)[second >= 0]
        follow = row["follow"].values.to_numpy()
        keys = np.repeat(np.arange(len(follow)), follow) * n + row["second"].values.to_numpy()
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        has = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        place[pair[has]] = n + at[has]
    number = np.flatnonzero(place >= 0)
    number = number[np.argsort(place[number])]
    df, has = row["df"].values.to_numpy(), place[number]
    return number, (np.cumsum(df) - df)[has], df[has]


def _gather(first, length):
    """Indices of all places of the lists, one list after the other."""
    import numpy as np

    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _counted(row, wanted):
    """(number, at, tf) of the block's lists of ``wanted``."""
    import numpy as np

    number, first, length = _lists(row, wanted)
    index = _gather(first, length)
    return np.repeat(number, length), row["at"].values.to_numpy()[index], row["tf"].values.to_numpy()[index]


def _normed(row, wanted, idf):
    """(number, at, weight) of the block's lists of ``wanted``: tf-idf by chunks of unit length."""
    import numpy as np

    number, at, tf = _counted(row, wanted)
    raw = tf * idf[number]
    norm = np.sqrt(np.bincount(at, weights=raw * raw, minlength=len(row["doc_id"].values)))
    return number, at, raw / norm[at]


def search(asked: DataFrame, blocks: DataFrame, k: int, least: float, weigh: Callable | None, most_terms: int = BROADCAST_TERMS, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, rank): the ``k`` best sums of a * weight over ``least``.

    ``asked`` is (query_id, term, a), and is sent to the blocks in groups of whole queries of about ``most_terms`` terms, one pass over the index each, whose
    results are stored before the next group is gathered. ``weigh`` gives the weights of a list's places; without
    it they are those of tf-idf over ``vocabulary`` by chunks of unit length.
    """
    n = asked.count()
    groups = max(1, -(-n // most_terms))
    out = None
    for i in range(groups):
        own = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == i)
        best = top_k(_pass(own, blocks, k, least, weigh, vocabulary), k)
        best = best if groups == 1 else stored(best, "hits")
        out = best if out is None else out.unionByName(best)
    return out


def _pass(asked: DataFrame, blocks: DataFrame, k: int, least: float, weigh: Callable | None, vocabulary: DataFrame | None) -> DataFrame:
    """``search`` for one group: the ``k`` best rows of each task."""
    import numpy as np
    import pyarrow as pa

    given = asked.orderBy("query_id").toArrow().combine_chunks()
    query, term, a = (given.column(c).combine_chunks() if given.num_rows else pa.array([], given.schema.field(c).type) for c in ("query_id", "term", "a"))
    ids, first = np.unique(query.to_numpy(zero_copy_only=False), return_index=True)
    if vocabulary is None:
        wanted = term.unique()
        idf = None
    else:
        known = vocabulary.select("term", "idf").toArrow().combine_chunks()
        wanted, idf = known.column("term").combine_chunks(), known.column("idf").to_numpy()
    import pyarrow.compute as pc

    number_of = pc.index_in(term, value_set=wanted).to_numpy(zero_copy_only=False).astype(np.int64) if len(term) else np.zeros(0, np.int64)
    shared = asked.sparkSession.sparkContext.broadcast((ids, np.append(first, len(term)), number_of, a.to_numpy(zero_copy_only=False), _parts(wanted.to_pylist()), idf))
    kinds = {f.name: f.dataType for f in blocks.schema}
    doc_kind = kinds["doc_id"].elementType.simpleString()

    def run(frames):
        ids, bounds, numbers, a, wanted, idf = shared.value
        n = len(wanted[1])
        kept: list = [None] * len(ids)
        for frame in frames:
            for r in range(len(frame)):
                row = {name: frame.column(c)[r] for c, name in enumerate(frame.schema.names)}
                docs, chunk = row["doc_id"].values.to_numpy(zero_copy_only=False), row["chunk_index"].values.to_numpy()
                if weigh is None:
                    number, at, w = _normed(row, wanted, idf)
                else:
                    number, at, tf = _counted(row, wanted)
                    w = weigh(row["n_terms"].values.to_numpy(), number, at, tf.astype(float))
                order = np.argsort(number, kind="stable")
                number, at, w = number[order], at[order], w[order]
                starts = np.searchsorted(number, np.arange(n + 1))
                best = np.zeros(n)
                np.maximum.at(best, number, w)
                reach = np.concatenate(([0.0], np.cumsum(np.maximum(a * best[numbers], 0))))
                reach = reach[bounds[1:]] - reach[bounds[:-1]]
                for q in np.flatnonzero(reach > least):
                    have = kept[q]
                    if have is not None and len(have[0]) == k and reach[q] + 2e-6 < have[0][-1]:
                        continue
                    t = numbers[bounds[q] : bounds[q + 1]]
                    length = starts[t + 1] - starts[t]
                    index = _gather(starts[t], length)
                    score = np.round(np.bincount(at[index], weights=w[index] * np.repeat(a[bounds[q] : bounds[q + 1]], length), minlength=len(docs)), 6)
                    hit = np.flatnonzero((score > least) & (score >= (have[0][-1] if have is not None and len(have[0]) == k else least)))
                    if not len(hit):
                        continue
                    s, d, c = score[hit], docs[hit], chunk[hit]
                    if have is not None:
                        s, d, c = np.concatenate((have[0], s)), np.concatenate((have[1], d)), np.concatenate((have[2], c))
                    top = np.lexsort((c, d, -s))[:k]
                    kept[q] = (s[top], d[top], c[top])
        full = [(q, x) for q, x in zip(ids, kept, strict=True) if x is not None]
        if full:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _ in full], [len(x[0]) for _, x in full]), given.schema.field("query_id").type), *(pa.array(np.concatenate([x[i] for _, x in full])) for i in (1, 2, 0))],
                names=["query_id", "doc_id", "chunk_index", "score"],
            )

    rows = blocks.select("doc_id", "chunk_index", "n_terms", *_LISTS)
    return rows.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {doc_kind}, chunk_index int, score double")


def vocabulary(blocks: DataFrame, vocab: int = 5000) -> DataFrame:
    """(term, df, idf) of the ``vocab`` most frequent terms, ties by term, stored; smoothed idf ln((1 + N) / (1 + df)) + 1, N all chunks.

    Not every term of every block is shuffled: blocks give their most frequent terms only. The ``vocab``-th sum of these is a
    bound that the terms sought reach; a term can reach it only with the most that the blocks which have not given it
    may hide. These terms alone are counted in all blocks. When a term that no block gave could reach the bound, or too many
    given ones could, blocks give four times as many, in the end all.
    """
    most = GIVEN * vocab
    while True:
        given = stored(_frequent(blocks, most).groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("rest").alias("rest")), "frequent")
        hidden = given.where("term IS NULL").agg(F.sum("rest")).first()[0] or 0
        known = given.where("term IS NOT NULL")
        bound = known.orderBy(F.desc("freq")).limit(vocab).agg(F.count("*"), F.min("freq")).first()
        bound = bound[1] if bound[0] == vocab else 0
        able = known.where(F.col("freq") + hidden - F.col("rest") >= bound) if hidden else known.orderBy(F.desc("freq"), "term").limit(vocab)
        if not hidden or hidden < bound and able.count() <= ABLE * vocab:
            break
        drop(given)
        most *= 4
    top = document_frequencies(blocks, able).orderBy(F.desc("freq"), "term").limit(vocab)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    out = stored(top.crossJoin(F.broadcast(sizes_of(blocks).select("n"))).select("term", "df", idf.alias("idf")), "vocabulary")
    drop(given)
    return out


def weights(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, chunk_index, weight): L2-normalised tf-idf over a ``vocabulary`` (broadcast), each block in its own task."""
    import pyarrow as pa

    known = terms.select("term", "idf").toArrow()
    idf, names = known.column("idf").to_numpy(), known.column("term").to_pylist()
    shared = blocks.sparkSession.sparkContext.broadcast((_parts(names), pa.array(names, pa.string())))

    def run(frames):
        import numpy as np

        wanted, names = shared.value
        for frame in frames:
            for r in range(len(frame)):
                row = {name: frame.column(c)[r] for c, name in enumerate(frame.schema.names)}
                number, at, w = _normed(row, wanted, idf)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), row["doc_id"].values.take(at), row["chunk_index"].values.take(at), pa.array(np.asarray(w, dtype=float))], names=["term", "doc_id", "chunk_index", "weight"])

    doc_kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    return blocks.select("doc_id", "chunk_index", *_LISTS).mapInArrow(run, f"term string, doc_id {doc_kind}, chunk_index int, weight double")


def term_counts(blocks: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[str], list[float]]:
    """Sparse rows (doc_id, chunk_index, i: ascending numbers of terms, tf), stored, and the terms that are numbered with their idf.

    Each block gives its own chunks' rows; chunks without a term of the vocabulary have none. Weights follow from tf
    (``unit_weights``): these small numbers take a fifth of the space.
    """
    known = terms.select("term", "idf").orderBy("term").toArrow()
    names, idf = known.column("term").to_pylist(), known.column("idf").to_pylist()
    shared = blocks.sparkSession.sparkContext.broadcast(_parts(names))

    def run(frames):
        import numpy as np
        import pyarrow as pa

        for frame in frames:
            for r in range(len(frame)):
                row = {name: frame.column(c)[r] for c, name in enumerate(frame.schema.names)}
                number, at, tf = _counted(row, shared.value)
                order = np.lexsort((number, at))
                has, size = np.unique(at, return_counts=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                has = pa.array(has)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (number, tf)]
                yield pa.RecordBatch.from_arrays([row["doc_id"].values.take(has), row["chunk_index"].values.take(has), *lists], names=["doc_id", "chunk_index", "i", "tf"])

    doc_kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    rows = blocks.select("doc_id", "chunk_index", *_LISTS).mapInArrow(run, f"doc_id {doc_kind}, chunk_index int, i array<int>, tf array<int>")
    return stored(rows, "matrix"), names, idf


def unit_weights(i, tf, idf):
    """The weights of Arrow lists ``i`` and ``tf``, one list after the other: tf-idf by rows of unit length; ``idf`` by number."""
    import numpy as np

    size = i.value_lengths().to_numpy()
    raw = tf.flatten().to_numpy() * idf[i.flatten().to_numpy()]
    return raw / np.repeat(np.sqrt(np.add.reduceat(raw * raw, np.cumsum(size) - size)), size) if len(raw) else raw


def sparse_rows(blocks: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[str]]:
    """D6 as sparse rows (doc_id, chunk_index, i: numbers of terms, x: weights) of stored counts, and the terms that are numbered."""
    counts, names, idf = term_counts(blocks, terms)
    return weighed(counts, idf), names


def weighed(counts: DataFrame, idf: list[float]) -> DataFrame:
    """(doc_id, chunk_index, i, x): rows of ``term_counts`` with their weights."""
    import numpy as np

    given = np.array(idf)

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            i = frame.column(2)
            ends = pa.array(np.concatenate(([0], np.cumsum(i.value_lengths().to_numpy()))), pa.int32())
            x = pa.ListArray.from_arrays(ends, pa.array(unit_weights(i, frame.column(3), given), pa.float64()))
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], x], names=["doc_id", "chunk_index", "i", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    return counts.mapInArrow(run, f"doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, i array<int>, x array<double>")


def tfidf(chunks: DataFrame, vocab: int = 5000, profile: Profile = ZH) -> DataFrame:
    """L2-normalised tf-idf weights (term, doc_id, chunk_index, weight) of terms and bigrams, rounded to 6 decimals."""
    index = build(chunks, profile, bigrams=True)
    return weights(index, vocabulary(index, vocab)).withColumn("weight", F.round("weight", 6))
