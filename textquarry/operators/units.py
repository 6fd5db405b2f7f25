"""Pages, paragraphs and translation units; checks and repairs of generated text; vectors from tf-idf.

Cutting that depends on what was cut before runs along one document, in Arrow batches of
documents; it never groups documents together.
"""

from __future__ import annotations

import functools
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources.tables import stored
from .blocks import unit_weights

#: Texts that a task cuts at a time, out of an Arrow batch of up to 64 MB.
SLICE = 64


def _per_text(docs: DataFrame, cut: Callable[[str], list[str]], name: str) -> DataFrame:
    """(doc_id, pos, ``name``): the pieces that ``cut`` makes of each text, in order; a task has SLICE texts in hand at a time."""

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            for at in range(0, len(frame), SLICE):
                part = frame.slice(at, SLICE)
                rows = [(d, i, piece) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, piece in enumerate(cut(t))]
                ids, pos, pieces = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(pieces, pa.string())], names=["doc_id", "pos", name])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fx.blank("text").alias("text")).mapInArrow(run, f"doc_id long, pos int, {name} string")


def _break_at(text: str, start: int, stop: int) -> tuple[int, int]:
    """Place and length of the last blank line, else line end, of ``text[start:stop]``; (-1, 0) without any."""
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, start, stop)
        if at >= 0:
            return at, len(mark)
    return -1, 0


def cut_pages(pages: list[tuple[int, str]], size: int, overlap: int) -> list[tuple[int, str]]:
    """(page, chunk) of one document's pages in order; chunks are trimmed.

    Text gathers page by page. Once it has ``size`` characters it is cut at its last break from 40 %
    of ``size`` on, or at its end; from four sizes on it is cut again and again after the last break
    before size + overlap, or at ``size``. What follows begins ``overlap`` before the cut. A chunk
    has the number of the page before the one that completed it (1 at first), the remainder the last.
    """
    least, hard = max(int(0.4 * size), 1), 4 * size
    if not 0 <= overlap < least:
        raise ValueError("the overlap must be under 40 % of the size")
    out: list[tuple[int, str]] = []
    held, before = "", 1
    for page, body in pages:
        held += body + "\n"
        if size <= len(held) < hard:
            at, _ = _break_at(held, least, len(held))
            cuts = [at if at >= 0 else len(held)]
        else:
            cuts = []
        while cuts or len(held) >= hard:
            if not cuts:
                at, width = _break_at(held, least, size + overlap)
                cuts = [at + width if at >= 0 else size]
            at = cuts.pop()
            out.append((before, held[:at].strip()))
            held = held[max(at - overlap, 0):]
        before = page
    if held.strip():
        out.append((before, held.strip()))
    return out


def chunk_pages(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, page, chunk) of pages (doc_id, page, text); a document's pages fit one task.

    Pages are gathered to one row a document, and rows are cut one by one.
    """

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            for at in range(0, len(frame), SLICE):
                part = frame.slice(at, SLICE)
                rows = []
                for d, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += [(d, i, p, c) for i, (p, c) in enumerate(cut_pages([(x["page"], x["text"]) for x in held], size, overlap))]
                ids, number, page, chunk = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(page, pa.int64()), pa.array(chunk, pa.string())], names=["doc_id", "chunk_index", "page", "chunk"])

    rows = pages.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), fx.blank("text").alias("text"))
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return held.mapInArrow(run, "doc_id long, chunk_index int, page long, chunk string")


_HEADING = re.compile(r"#|第[一二三四五六七八九十百0-9]+[章节部篇卷]|(?i:(?:chapter|part) +[0-9])")
_NUMBERED = re.compile(r"[0-9]+(\.[0-9]+)?\s+\S")
_SENTENCE_END = re.compile("[.!?。！？」\"』)）]$")


def paragraphs_of(text: str, least: int = 15, long: int = 60) -> list[str]:
    """Paragraphs of one text: lines of a block join until two sentences and more than ``long`` characters are there.

    Headings stand alone, numbered lines begin anew, and a paragraph of under ``least`` characters
    joins the one before it, unless either is a heading.
    """
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        held, ends = "", 0
        parts: list[str] = []
        for line in filter(None, (x.strip() for x in block.split("\n"))):
            heading = _HEADING.match(line) is not None
            full = ends >= 2 and len(held) > long
            if held and (heading or full or _HEADING.match(held) or _NUMBERED.match(line)):
                parts.append(held)
                held, ends = "", 0
            held = f"{held} {line}" if held and held.isascii() else held + line
            ends += _SENTENCE_END.search(line) is not None
        if held:
            parts.append(held)
        for p in parts:
            if out and len(p) < least and not _HEADING.match(p) and not _HEADING.match(out[-1]):
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
    return out


def merge_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, paragraph, level): merged paragraphs; headings with their level."""
    return _per_text(docs, paragraphs_of, "paragraph").withColumn("level", fx.heading_level("paragraph"))


def groups_of(text: str, most: int) -> list[str]:
    """Paragraphs joined greedily up to ``most`` characters; fenced blocks alone; longer ones split by line, then hard."""
    pieces: list[tuple[str, bool]] = []
    for i, part in enumerate(re.split(r"(?m)^(```[^\n]*\n(?:.*\n)*?```[^\n]*)$", text)):
        pieces += [(part, True)] if i % 2 else [(p.strip("\n"), False) for p in re.split(r"\n\s*\n", part) if p.strip()]
    out: list[str] = []
    open_ = False
    for piece, fenced in pieces:
        if len(piece) > most and not fenced:
            held = ""
            for line in piece.split("\n"):
                if held and len(held) + 1 + len(line) > most:
                    out.append(held)
                    held = ""
                held = f"{held}\n{line}" if held else line
                while len(held) > most:
                    out.append(held[:most])
                    held = held[most:]
            if held:
                out.append(held)
            open_ = False
        elif open_ and not fenced and len(out[-1]) + 2 + len(piece) <= most:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
            open_ = not fenced
    return out


def translation_units(docs: DataFrame, most: int = 3500, target: str = "[\\x{4e00}-\\x{9fff}]") -> DataFrame:
    """(doc_id, pos, unit, skip): groups of paragraphs; those already in the target script are to be skipped."""
    return _per_text(docs, lambda t: groups_of(t, most), "unit").withColumn("skip", fx.script_gate("unit", target) | F.startswith("unit", F.lit("```")))


def assemble_units(units: DataFrame, results: DataFrame) -> DataFrame:
    """Per document (doc_id, pos) the finished and needed counts and, once all are there, the results joined in order."""
    rows = units.select("doc_id", "pos").distinct().join(results.groupBy("doc_id", "pos").agg(F.min("result").alias("result")), ["doc_id", "pos"], "left")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("result").isNotNull(), F.struct("pos", "result")))), lambda x: x["result"])
    out = rows.groupBy("doc_id").agg(F.count("*").alias("needed"), F.count("result").alias("finished"), parts.alias("parts"))
    return out.select("doc_id", "needed", "finished", F.when(F.col("needed") == F.col("finished"), F.array_join("parts", "\n\n")).alias("text"))


def entities(text: Column | str) -> Column:
    """Distinct capital runs, Han runs, numbers with units, and identifiers with a capital or underscore."""
    t = fx.blank(text)
    words = F.filter(F.regexp_extract_all(t, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,}$") | (w.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$") & w.rlike("^[A-Z]|_")))
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in ("[\\x{4e00}-\\x{9fff}]{2,}", "[0-9]+(?:\\.[0-9]+)?[ \t]*[年月日时分秒%℃°万元亿千百十]")]
    return F.array_distinct(F.concat(words, *found))


def summary_check(pairs: DataFrame) -> DataFrame:
    """Pairs (source, summary) with coverage, invented entities, length ratio, score and ``passed``.

    Score: 0.8 coverage and 0.2 when nothing is invented; passed with coverage 0.7 and nothing
    invented, or when the source has no entities.
    """
    rows = pairs.withColumn("__a", entities("source")).withColumn("__b", entities("summary"))
    n, ratio = F.size("__a"), F.length(fx.blank("summary")) / F.greatest(F.length(fx.blank("source")), F.lit(1))
    cover = F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect("__a", "__b")) / F.greatest(n, F.lit(1)))
    rows = rows.withColumn("coverage", F.round(cover, 4)).withColumn("n_invented", F.when(n == 0, 0).otherwise(F.size(F.array_except("__b", "__a")))).withColumn("short_enough", ratio <= 0.3)
    rows = rows.withColumn("score", F.round(0.8 * cover + F.when(F.col("n_invented") == 0, 0.2).otherwise(0.0), 4))
    return rows.withColumn("passed", (n == 0) | ((cover >= 0.7) & (F.col("n_invented") == 0))).drop("__a", "__b")


def stats_text() -> Column:
    """A line of statistics from the columns of ``document_stats``."""
    number = lambda c: F.format_number(F.col(c), 0)
    return F.format_string("Document %s: %s characters, %s words, %s sentences, %s paragraphs.", F.col("doc_id").cast("string"), *(number(c) for c in ("n_chars", "n_words", "n_sentences", "n_paragraphs")))


def card_text(label: Column | str, summary: Column | str, related: Column | str, n: int = 3) -> Column:
    """Label, summary and the first ``n`` related labels of a card, without blank parts."""
    near = F.array_join(F.slice(F.coalesce(fx._c(related), F.array().cast("array<string>")), 1, n), ", ")
    full = lambda c: F.when(F.trim(fx.blank(c)) != "", F.trim(c))
    return F.concat_ws(". ", full(fx._c(label)), full(fx._c(summary)), F.when(near != "", F.concat(F.lit("Related: "), near)))


def salvage_json(raw: DataFrame, schema: str, field: str = "label") -> DataFrame:
    """``parsed`` by ``schema``, the ``way`` it was got, and ``labels`` when nothing parses.

    Ways: ``strict``; ``repaired`` (the outermost fragment from the first bracket on, without
    trailing commas and with quoted keys); ``labels`` (values of ``field`` by pattern); ``none``.
    """
    t = F.trim(fx.blank("raw"))
    shape = "^[ \t\r\n]*" + ("\\[" if schema.lower().startswith("array") else "\\{")
    fragment = F.regexp_extract(t, "(?s)(\\[.*\\]|\\{.*\\})" if schema.lower().startswith("array") else "(?s)(\\{.*\\})", 1)
    repaired = F.regexp_replace(F.regexp_replace(fragment, ",([ \t\r\n]*[\\]}])", "$1"), "([{,][ \t\r\n]*)([A-Za-z_][A-Za-z0-9_]*)[ \t]*:", '$1"$2":')
    valid = lambda c: c.rlike(shape) & F.get_json_object(c, "$").isNotNull()
    labels = F.regexp_extract_all(t, F.lit(f'"?{field}"?[ \t]*:[ \t]*"([^"]+)"'), F.lit(1))
    way = F.when(valid(t), "strict").when(valid(repaired), "repaired").when(F.size(labels) > 0, "labels").otherwise("none")
    rows = raw.withColumn("way", way)
    source = F.when(F.col("way") == "strict", t).when(F.col("way") == "repaired", repaired)
    return rows.withColumn("parsed", F.from_json(source, schema)).withColumn("labels", F.when(F.col("way") == "labels", labels))


#: Most terms of a matrix that may be decomposed, vectors beyond the wanted ones, and passes before the last.
MAX_TERMS, OVERSAMPLE, PASSES = 20_000, 10, 5
#: Most terms whose Gram matrix is summed whole (half of it, 144 MB); rows that make one more task worth its sum; numbers of a piece of a sum.
GRAM_TERMS, TASK_ROWS, PIECE = 6_000, 65_536, 1 << 17
#: Terms of a row whose pairs are added at once.
PAIRED = 1024


def _sparse_rows(frame):
    """(numbers of terms, weights) of each row of an Arrow batch (doc_id, chunk_index, i, x)."""
    i, x = frame.column(2), frame.column(3)
    ends = i.value_lengths().to_numpy().cumsum()
    i, x = i.flatten().to_numpy(), x.flatten().to_numpy()
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        yield i[a:b], x[a:b]


def _sparse(weights: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, chunk_index, i, x): the numbers of a chunk's terms and their weights; chunks without a known term have no row."""
    at = weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = weights.join(F.broadcast(at), "term").groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("v"))
    return rows.select("doc_id", "chunk_index", F.col("v.i").alias("i"), F.col("v.weight").alias("x"))


def svd_embed(weights: DataFrame, dim: int = 384, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(vectors (doc_id, chunk_index, embedding), model (term, component)) by truncated SVD of tf-idf weights.

    Randomised subspace iteration: a pass multiplies a block of ``dim`` + OVERSAMPLE vectors by the Gram matrix of the
    terms. Up to GRAM_TERMS terms this is summed once, each task adding up its own chunks, and passes are products on the driver, which holds
    terms x terms / 2 numbers in a mapped file (100 MB for 5,000). With more, each pass goes over the chunks, and only terms x block numbers are
    on the driver or in a task. There are never more sums than cores, however many chunks, and they are added
    in pieces by one shuffle. The matrix itself is a table of sparse rows, of which only the terms of a chunk are
    multiplied. More than MAX_TERMS terms are an error: ``vocabulary`` bounds them. The model
    is a table: write it, read it back, and pass it to ``project``. Vectors are not normalised; they have
    min(dim, terms) places, each component's largest entry being positive. Empty weights give empty tables.
    """
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").limit(MAX_TERMS + 1).collect()]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: weigh a smaller vocabulary")
    return svd_of(stored(_sparse(weights, terms), "matrix"), terms, dim, seed)


def _summed(matrix: DataFrame, add, size: int):
    """The sum over all rows of a sparse matrix: ``add(total, i, x)`` puts a row into the ``size`` numbers of its task. On the driver it lies in a mapped file."""
    import numpy as np

    tasks = min(matrix.sparkSession.sparkContext.defaultParallelism, 1 + matrix.count() // TASK_ROWS)

    def batch(at, x):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "part"])

    def run(frames):
        total = np.zeros(size)
        for frame in frames:
            for i, x in _sparse_rows(frame):
                add(total, i, x)
        for at in range(0, size, PIECE):
            yield batch(at, total[at : at + PIECE])

    def join(frames):
        held: dict = {}
        for frame in frames:
            for at, part in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                part = np.frombuffer(part.as_buffer())
                if at in held:
                    held[at] += part
                else:
                    held[at] = part.copy()
        for at, part in held.items():
            yield batch(at, part)

    parts = matrix.coalesce(tasks).mapInArrow(run, "at long, part binary").repartition(1 + size // (8 * PIECE), "at").mapInArrow(join, "at long, part binary")
    total = np.memmap(tempfile.TemporaryFile(), np.float64, "w+", shape=(size,))
    for r in parts.toLocalIterator(prefetchPartitions=True):
        total[r["at"] : r["at"] + PIECE] = np.frombuffer(r["part"])
    return total


@functools.cache
def _pairs():
    """All (a, b), a <= b < PAIRED, by b: the first m (m + 1) / 2 are those below m."""
    import numpy as np

    b, a = np.tril_indices(PAIRED)
    return a, b


def _gram(matrix: DataFrame, n: int):
    """The product of a block by the Gram matrix of a sparse matrix, from its upper triangle, summed once."""
    import numpy as np

    starts = np.arange(n) * n - np.arange(n) * (np.arange(n) + 1) // 2  # of a row of the triangle, less its first column

    def add(total, i, x):
        i, n = i.astype(np.int64), len(i) * (len(i) + 1) // 2
        if len(i) <= PAIRED:
            a, b = (k[:n] for k in _pairs())
            at, pair = starts[i].take(a), x.take(a)
            at += i.take(b)
            pair *= x.take(b)
            np.add.at(total, at, pair)
        else:
            for k in range(len(i)):
                total[starts[i[k]] + i[k:]] += x[k] * x[k:]

    total = _summed(matrix, add, n * (n + 1) // 2)

    def times(block):
        out = np.zeros_like(block)
        step = max(1, 4 * PIECE // n)
        for a in range(0, n, step):
            b = min(n, a + step)
            rows = np.zeros((b - a, n - a))
            for k in range(a, b):
                rows[k - a, k - a :] = total[starts[k] + k : starts[k] + n]
            out[a:b] += rows @ block[a:]
            rows[np.arange(b - a), np.arange(b - a)] = 0
            out[a:] += rows.T @ block[a:b]
        return out

    return times


def svd_of(matrix: DataFrame, terms: list[str], dim: int = 384, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``svd_embed`` of a matrix (doc_id, chunk_index, i, x) of sparse rows over ``terms``, ``i`` ascending, read from a stored table."""
    import numpy as np
    import pyarrow as pa

    v = components(matrix, len(terms), dim, seed)
    if not terms:
        model = matrix.sparkSession.createDataFrame([], "term string, component array<double>")
        return matrix.select("doc_id", "chunk_index", F.array().cast("array<double>").alias("embedding")).where(F.lit(False)), model
    ends = pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32())
    model = matrix.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "component": pa.ListArray.from_arrays(ends, pa.array(v.ravel()))}))
    return _times(matrix, v), model


def components(matrix: DataFrame, n: int, dim: int = 384, seed: int = 7):
    """The components of D7, terms x places, of a matrix (doc_id, chunk_index, i, x) of sparse rows over ``n`` terms."""
    import numpy as np

    spark = matrix.sparkSession
    wide = min(dim + OVERSAMPLE, n)

    def by_passes(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(block)

        def add(total, i, x):
            total.reshape(n, wide)[i] += x[:, None] * (x @ shared.value[i])

        total = _summed(matrix, add, n * wide).reshape(n, wide)
        shared.destroy()
        return total

    if not n:
        return np.zeros((0, 0))
    gram_times = _gram(matrix, n) if n <= GRAM_TERMS else by_passes
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, wide)))[0]
    for _ in range(PASSES if wide < n else 0):
        basis = np.linalg.qr(gram_times(basis))[0]
    small = basis.T @ gram_times(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    v = basis @ turn[:, np.argsort(-values, kind="stable")[: min(dim, n)]]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return v


def _products(i, x, v):
    """The rows of a sparse matrix, given by their lengths ``i`` (Arrow lists) and weights one after the other, times ``v``."""
    import numpy as np

    ends = np.cumsum(i.value_lengths().to_numpy())
    i = i.flatten().to_numpy()
    out = np.zeros((len(ends), v.shape[1]))
    for r, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        out[r] = x[a:b] @ v[i[a:b]]
    return out


def _times(matrix: DataFrame, v) -> DataFrame:
    """(doc_id, chunk_index, embedding): rows of a sparse matrix times the broadcast components ``v``."""
    shared, wide = matrix.sparkSession.sparkContext.broadcast(v), v.shape[1]

    def run(frames):
        import numpy as np
        import pyarrow as pa

        for part in frames:
            flat = _products(part.column(2), part.column(3).flatten().to_numpy(), shared.value).ravel()
            ends = pa.array(np.arange(0, len(part) * wide + 1, wide), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc_id", "chunk_index", "embedding"])

    ids = {f.name: f.dataType.simpleString() for f in matrix.schema}
    return matrix.mapInArrow(run, f"doc_id {ids['doc_id']}, chunk_index {ids['chunk_index']}, embedding array<double>")


def _components(model: DataFrame):
    """The terms of a model, ascending, and their components as a matrix."""
    known = model.select("term", "component").orderBy("term").limit(MAX_TERMS + 1).toArrow()
    component = known.column("component").combine_chunks()
    sizes = set(component.value_lengths().to_pylist())
    if len(component) > MAX_TERMS or len(sizes) > 1:
        raise ValueError(f"a model has at most {MAX_TERMS} terms and components of one size, not sizes {sorted(sizes)}")
    return known.column("term").to_pylist(), component.flatten().to_numpy().reshape(len(component), -1) if len(component) else None


def project(weights: DataFrame, model: DataFrame) -> DataFrame:
    """Embeddings of chunks by a stored model; terms that it does not know add nothing, chunks without a known one have no row.

    The model, at most MAX_TERMS rows of one size, is broadcast; components of different sizes are an error.
    """
    return projected(weights, *_components(model))


def projected(weights: DataFrame, terms: list[str], v) -> DataFrame:
    """``project`` by the ``components`` of ``terms``."""
    if not terms:
        return weights.select("doc_id", "chunk_index", F.array().cast("array<double>").alias("embedding")).where(F.lit(False))
    return _times(_sparse(weights, terms), v)


def embedder(spark, v, idf: list[float]):
    """For rows of ``blocks.term_counts``: the function that makes their D7 vectors, by ``components`` of the same terms, of their Arrow lists (i, tf) inside a task."""
    import numpy as np

    shared = spark.sparkContext.broadcast((v, np.array(idf)))

    def embed(i, tf):
        v, idf = shared.value
        return _products(i, unit_weights(i, tf, idf), v)

    return embed
