"""Registered queries over pages, paragraphs, units and generated text of ``documents``; SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from ..operators import blocks as bl
from ..operators import units as u
from ..operators.index import fixed_windows
from ..sources.tables import table
from .textual import _D as _TD
from .textual import _STATS


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def chunk_pages(spark, sf_dir):
    """Windows of 1,000 characters stand in for pages."""
    pages = fixed_windows(_docs(spark, sf_dir), 1000, 0).select("doc_id", F.col("chunk_index").alias("page"), F.col("chunk").alias("text"))
    return u.chunk_pages(pages).select("doc_id", "chunk_index", "page", F.md5("chunk").alias("chunk_md5"))


def merge_paragraphs(spark, sf_dir):
    return u.merge_paragraphs(_docs(spark, sf_dir)).select("doc_id", "pos", "level", F.md5("paragraph").alias("paragraph_md5"))


def translation_units(spark, sf_dir):
    return u.translation_units(_docs(spark, sf_dir)).select("doc_id", "pos", "skip", F.md5("unit").alias("unit_md5"))


def assemble_units(spark, sf_dir):
    """Chunks of odd documents lack their last result."""
    c = fixed_windows(_docs(spark, sf_dir)).select("doc_id", F.col("chunk_index").alias("pos"), F.col("chunk").alias("result"))
    return u.assemble_units(c, c.where("doc_id % 2 = 0 OR pos > 0")).withColumn("text", F.md5("text"))


def summary_check(spark, sf_dir):
    """The first 300 characters stand in for a document's summary."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("source"), F.substring("text", 1, 300).alias("summary"))
    return u.summary_check(d).drop("source", "summary")


def stats_text(spark, sf_dir):
    return corpus.document_stats(_docs(spark, sf_dir)).select("doc_id", u.stats_text().alias("line"))


def card_text(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", u.card_text(F.get(words, F.lit(0)), F.substring("text", 1, 40), F.slice(words, 2, 5)).alias("line"))


def salvage_json(spark, sf_dir):
    """Model outputs made of the documents' first words, in four states of repair."""
    label = F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)", 1)
    shapes = ['[{"label": "%s"}]', 'Sure: [{label: "%s",},]', 'so "label": "%s" it is', "%s"]
    raw = F.get(F.array(*(F.format_string(s, label) for s in shapes)), F.pmod("doc_id", F.lit(4)).cast("int"))
    out = u.salvage_json(_docs(spark, sf_dir).select("doc_id", raw.alias("raw")), "array<struct<label:string>>")
    return out.select("doc_id", "way", F.coalesce(F.get("parsed", F.lit(0))["label"], F.get("labels", F.lit(0))).alias("label"))


def svd_embed(spark, sf_dir):
    """5,000 terms and 384 dimensions over all chunks; of each vector its size and length."""
    index = bl.build(fixed_windows(_docs(spark, sf_dir)), bigrams=True)
    vectors, _ = u.svd_of(*bl.sparse_rows(index, bl.vocabulary(index)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("doc_id", "chunk_index", F.size("embedding").alias("dim"), F.round(norm, 5).alias("norm"))


_STATS_ONLY = _STATS.split(",\n    pg AS")[0]
_D = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
QUERIES = {
    "chunk_pages": (chunk_pages, None),
    "merge_paragraphs": (merge_paragraphs, None),
    "translation_units": (translation_units, None),
    "assemble_units": (assemble_units, """WITH d AS (SELECT doc_id, text AS t, greatest(ceil((length(text) - 200) / 1800), 1)::BIGINT AS n FROM documents WHERE text != '')
        SELECT doc_id, n AS needed, CASE WHEN doc_id % 2 = 0 THEN n ELSE n - 1 END AS finished,
            CASE WHEN doc_id % 2 = 0 THEN md5(array_to_string(list_transform(range(0, n), lambda i: substr(t, i * 1800 + 1, 2000)), chr(10) || chr(10))) END AS text FROM d"""),
    "summary_check": (summary_check, f"""WITH {_D}, f AS (SELECT doc_id, length(t) AS n, length(substr(t, 1, 300)) AS m, unnest([t, substr(t, 1, 300)]) AS x, unnest([1, 2]) AS side FROM d),
        e AS (SELECT doc_id, n, m, side, list_distinct(list_concat(list_concat(list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'),
            lambda w: regexp_matches(w, '^[A-Z]{{2,}}$') OR (regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{2,}}$') AND regexp_matches(w, '^[A-Z]|_'))),
            regexp_extract_all(x, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')), regexp_extract_all(x, '[0-9]+(?:\\.[0-9]+)?[ \\t]*[年月日时分秒%℃°万元亿千百十]'))) AS es FROM f),
        p AS (SELECT a.doc_id, a.n, a.m, len(a.es) AS k, len(list_intersect(a.es, b.es)) AS c, len(list_filter(b.es, lambda w: NOT list_contains(a.es, w))) AS v FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.side = 1 AND b.side = 2),
        q AS (SELECT *, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE c / k END AS cover, CASE WHEN k = 0 THEN 0 ELSE v END AS n_invented FROM p)
        SELECT doc_id, round(cover, 4) AS coverage, n_invented, m / greatest(n, 1) <= 0.3 AS short_enough,
            round(0.8::DOUBLE * cover + CASE WHEN n_invented = 0 THEN 0.2::DOUBLE ELSE 0 END, 4) AS score, k = 0 OR (cover >= 0.7 AND n_invented = 0) AS passed FROM q"""),
    "stats_text": (stats_text, f"""WITH {_TD}, {_STATS_ONLY} SELECT doc_id, 'Document ' || doc_id || ': ' || format('{{:,}} characters, {{:,}} words, {{:,}} sentences, {{:,}} paragraphs.', n_chars, n_words, n_sentences, n_paragraphs) AS line FROM st"""),
    "card_text": (card_text, f"""WITH {_D}, w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Z][a-z]+') AS ws FROM d)
        SELECT doc_id, concat_ws('. ', ws[1], nullif(trim(substr(t, 1, 40), ' '), ''), CASE WHEN len(ws) > 1 THEN 'Related: ' || array_to_string(ws[2:4], ', ') END) AS line FROM w"""),
    "salvage_json": (salvage_json, f"""WITH {_D}, l AS (SELECT doc_id, regexp_extract(t, '([A-Za-z]+)', 1) AS label FROM d)
        SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND label = '' THEN 'none' ELSE ['strict', 'repaired', 'labels', 'none'][doc_id % 4 + 1] END AS way,
            CASE WHEN doc_id % 4 = 3 OR (doc_id % 4 = 2 AND label = '') THEN NULL ELSE label END AS label FROM l"""),
    "svd_embed": (svd_embed, None),
}
