"""Registered queries over files, stores and single text functions, each with its SQL twin.

The tables have no files of their own: every document stands for the file
``/lib/<source>/f<doc_id>.<suffix>``, its characters for the size, its id for the time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN
from ..operators import corpus
from ..operators.index import fixed_windows
from ..sources import files as fs
from ..sources.tables import shared_dir, table
from .textual import _q


def _files(spark, sf_dir):
    suffix = F.get(F.array(*(F.lit(s) for s in fs.SUFFIXES)), F.pmod("doc_id", F.lit(6)).cast("int"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    d = table(spark, sf_dir, "documents").withColumn("name", name)
    return d.withColumn("path", F.concat(F.lit("/lib/"), "source", F.lit("/"), "name"))


_FILES = f"""d AS (SELECT *, coalesce(text, '') AS t, 'f' || doc_id || '.' || {list(fs.SUFFIXES)}[doc_id % 6 + 1] AS name FROM documents),
f AS (SELECT *, '/lib/' || source || '/' || name AS path FROM d)"""


def path_identity(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", fs.path_identity(F.col("path"), "/lib").alias("p")).select("doc_id", "p.*")


def wrap_source_code(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.md5(fs.wrap_source_code(F.col("name"), fx.blank("text"))).alias("wrapped_md5"))


def export_json(spark, sf_dir):
    """Conversations written as JSON to the shared folder and read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations")
    fs.export_json(turns, path)
    return spark.read.schema(turns.schema).json(path)


def _chunks(spark, sf_dir):
    names = _files(spark, sf_dir).select("doc_id", F.col("path").alias("physical_name"), F.col("name").alias("file_name"), F.col("lang").alias("domain"))
    return fixed_windows(table(spark, sf_dir, "documents")).join(names, "doc_id")


_CHUNKS = _FILES + """, chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 1800 + 1, 2000) AS chunk, path AS physical_name, name AS file_name, lang AS domain FROM (
    SELECT *, unnest(range(0, greatest(ceil((length(t) - 200) / 1800), 1)::BIGINT)) AS i FROM f WHERE length(t) > 0))"""


def write_index(spark, sf_dir):
    """Every third document is imported again in capitals."""
    stored = fixed_windows(table(spark, sf_dir, "documents"))
    fresh = fixed_windows(table(spark, sf_dir, "documents").where("doc_id % 3 = 0").withColumn("text", F.translate("text", "abcdefghij", "ABCDEFGHIJ")))
    return corpus.replace_documents(stored, fresh).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def _gone(spark, sf_dir):
    """Every fifth file by its path, every seventh by its name; a blank id."""
    f = _files(spark, sf_dir)
    ids = f.where("doc_id % 5 = 0").select(F.col("path").alias("id")).unionByName(f.where("doc_id % 7 = 0").select(F.col("name").alias("id")))
    return ids.unionByName(spark.range(1).select(F.lit(" ").alias("id")))


def delete_documents(spark, sf_dir):
    left = corpus.delete_documents(_chunks(spark, sf_dir), _gone(spark, sf_dir), ("physical_name", "file_name"))
    return left.select("doc_id", "chunk_index")


def removed_counts(spark, sf_dir):
    return corpus.removed_counts(_chunks(spark, sf_dir), _gone(spark, sf_dir), ("physical_name", "file_name"))


def delete_domain(spark, sf_dir):
    return corpus.delete_domain(_chunks(spark, sf_dir), "fr").select("doc_id", "chunk_index")


def domain_files(spark, sf_dir):
    return corpus.domain_files(_chunks(spark, sf_dir))


def _listing(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select(
        "doc_id", F.lit("/lib").alias("source_root"), F.concat("source", F.lit("/"), "name").alias("rel_path"), "name", F.col("n_chars").alias("size"),
        F.col("doc_id").cast("double").alias("mtime"), (F.col("doc_id") * 37 % 1000).alias("uploaded_at"), "path",
    )


def _both(spark, sf_dir):
    """On disk all files but every fifth, each third changed; in the index three quarters: whole, without root, with a name alone."""
    f = _listing(spark, sf_dir)
    disk = f.where("doc_id % 5 != 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 3 == 0, 100.0).otherwise(0.5))
    tier = F.col("doc_id") % 4
    indexed = f.where(tier < 3).withColumn("source_root", F.when(tier == 0, F.col("source_root"))).withColumn("rel_path", F.when(tier < 2, F.col("rel_path")))
    return disk, indexed


def corpus_diff(spark, sf_dir):
    return corpus.corpus_diff(*_both(spark, sf_dir))


def corpus_diff_counts(spark, sf_dir):
    return corpus.diff_counts(corpus.corpus_diff(*_both(spark, sf_dir)), _both(spark, sf_dir)[1])


def skip_unchanged(spark, sf_dir):
    """Even files are indexed, each sixth with another size; targets are the files of long documents."""
    f = _listing(spark, sf_dir)
    indexed = f.where("doc_id % 2 = 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return corpus.skip_unchanged(f, indexed, f.where("size > 1000"))


_DIFF = _FILES + """, s AS (SELECT doc_id, source || '/' || name AS rel_path, name, n_chars AS size, doc_id::DOUBLE AS mtime, doc_id * 37 % 1000 AS uploaded_at, path FROM f),
diff AS (SELECT CASE WHEN doc_id % 5 = 0 AND doc_id % 4 = 2 THEN NULL ELSE rel_path END AS rel_path, name, CASE WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 4 = 3 THEN 'new' ELSE 'modified' END AS status
    FROM s WHERE CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 < 3 ELSE doc_id % 4 = 3 OR doc_id % 3 = 0 END)"""


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.blank("text").alias("t"))


def parse_upload_time(spark, sf_dir):
    """H7: event times as ISO texts; every seventh is none."""
    e = table(spark, sf_dir, "events")
    iso = F.when(F.col("event_id") % 7 == 0, F.lit("yesterday")).otherwise(F.col("ts").cast("string"))
    return e.select("event_id", F.round(fx.parse_time(iso), 3).alias("seconds"))


def strip_bad_refs(spark, sf_dir):
    """Answers that cite a source by their turn and a page by the conversation."""
    ref = lambda kind, n: F.concat(F.lit(f"[{kind}"), n.cast("string"), F.lit("]"))
    answer = F.concat("t", ref("参考资料", F.col("turn") % 5), ref("网页", F.col("conv_id") % 7), ref("参考资料", F.col("turn")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(fx.strip_bad_refs(answer, F.lit(3), F.lit(4))).alias("answer_md5"))


def collapse_cjk_spaces(spark, sf_dir):
    """Texts whose vowels are written as Han characters."""
    han = F.translate("t", "aeiou", "中文字母音")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(fx.collapse_cjk_spaces(F.regexp_replace(han, "([a-z])", " "))).alias("text_md5"))


def interpret_rewrite(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", fx.interpret_rewrite(F.replace("t", F.lit("."), F.lit("\n")), F.lit("asked")).alias("r")).select("conv_id", "turn", "r.*")


def score_to_weight(spark, sf_dir):
    """Weights of scores, and labels of edges between an event's type and its user; each third score and label is missing."""
    e = table(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 3 != 0, F.floor("value") / 1000)
    label = F.when(F.col("event_id") % 3 == 1, F.lit(" ")).when(F.col("event_id") % 3 == 2, F.col("event_type"))
    return e.select("event_id", fx.score_to_weight(score).alias("weight"), fx.edge_label(label, F.col("event_type"), F.col("user_id").cast("string")).alias("label"))


_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz0123456789")
_SYNONYMS = {"the": "article", "die": "article", "der": "article"}


def canonical_labels(spark, sf_dir):
    """H3: the words with capitals, their letters written in full width, with a note and dashes."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(fx.blank("text"), F.lit("[A-Z][A-Za-z0-9]+"), F.lit(0))).alias("label"))
    n = words.groupBy("label").agg(F.count("*").alias("n"))
    wide = F.concat(F.translate("label", "abcdefghijklmnopqrstuvwxyz0123456789", _WIDE), F.lit("（note） ·-"))
    return n.select("label", "n", fx.canonical_label(wide, _SYNONYMS, nfkc=True).alias("canonical"))


def narrative_expand(spark, sf_dir):
    """Every passage asked for its history, and as it is."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit("history of "), F.lit(""))).alias("ask"), fx.blank("text").alias("t"))
    return b.select("item_id", "ask", fx.narrative_expand(F.concat("ask", "t")).alias("expanded"))


_STOP = ", ".join(map(_q, LATIN.stopwords))
_ASKED = "ask || coalesce(text, '')"
QUERIES = {
    "path_identity": (path_identity, f"WITH {_FILES} SELECT doc_id, '/lib' AS source_root, source || '/' || name AS rel_path, source AS rel_dir, source AS domain FROM f"),
    "wrap_source_code": (wrap_source_code, f"""WITH {_FILES} SELECT doc_id, md5('文件: ' || name || chr(10) || '```' || CASE doc_id % 6 WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'json' WHEN 5 THEN 'csv' ELSE '' END
        || chr(10) || t || chr(10) || '```') AS wrapped_md5 FROM f"""),
    "export_json": (export_json, "SELECT * FROM conversations"),
    "write_index": (write_index, f"""WITH {_CHUNKS} SELECT doc_id, chunk_index, md5(CASE WHEN doc_id % 3 = 0 THEN translate(chunk, 'abcdefghij', 'ABCDEFGHIJ') ELSE chunk END) AS chunk_md5 FROM chunks"""),
    "delete_documents": (delete_documents, f"WITH {_CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE doc_id % 5 != 0 AND doc_id % 7 != 0"),
    "removed_counts": (removed_counts, f"""WITH {_CHUNKS}, ids AS (SELECT doc_id, path AS id FROM f WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, name FROM f WHERE doc_id % 7 = 0)
        SELECT id, count(c.doc_id) AS removed FROM ids LEFT JOIN chunks c ON ids.doc_id = c.doc_id GROUP BY id"""),
    "delete_domain": (delete_domain, f"WITH {_CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE domain IS DISTINCT FROM 'fr'"),
    "domain_files": (domain_files, f"WITH {_CHUNKS} SELECT domain, count(DISTINCT doc_id) AS n_files FROM chunks GROUP BY domain"),
    "corpus_diff": (corpus_diff, f"WITH {_DIFF} SELECT * FROM diff"),
    "corpus_diff_counts": (corpus_diff_counts, f"""WITH {_DIFF} SELECT {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('new', 'modified', 'deleted'))},
        (SELECT count(*) FROM s WHERE doc_id % 4 < 3) AS total_indexed, (SELECT max(uploaded_at) FROM s WHERE doc_id % 4 < 3) AS last_scan FROM diff"""),
    "skip_unchanged": (skip_unchanged, f"WITH {_DIFF} SELECT path, size, mtime FROM s WHERE size > 1000 AND (doc_id % 2 != 0 OR doc_id % 6 = 0)"),
    "parse_upload_time": (parse_upload_time, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(epoch(ts), 3) END AS seconds FROM events"),
    "strip_bad_refs": (strip_bad_refs, """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, turn % 5 AS a, conv_id % 7 AS b FROM conversations)
        SELECT conv_id, turn, md5(t || CASE WHEN a BETWEEN 1 AND 3 THEN '[参考资料' || a || ']' ELSE '' END || CASE WHEN b BETWEEN 1 AND 4 THEN '[网页' || b || ']' ELSE '' END
        || CASE WHEN turn BETWEEN 1 AND 3 THEN '[参考资料' || turn || ']' ELSE '' END) AS answer_md5 FROM c"""),
    "collapse_cjk_spaces": (collapse_cjk_spaces, f"""WITH c AS (SELECT conv_id, turn, regexp_replace(translate(coalesce(text, ''), 'aeiou', '中文字母音'), '([a-z])', ' ', 'g') AS t FROM conversations)
        SELECT conv_id, turn, md5({'regexp_replace(' * 2}t{", '([一-鿿])[ \t]+([一-鿿])', '\\1\\2', 'g')" * 2}) AS text_md5 FROM c"""),
    "interpret_rewrite": (interpret_rewrite, """WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(coalesce(text, ''), '.', chr(10)), chr(10)), lambda s: trim(s, ' ')), lambda s: s != '') AS ls FROM conversations)
        SELECT conv_id, turn, CASE WHEN length(ls[1]) BETWEEN 3 AND 80 THEN ls[1] ELSE 'asked' END AS rewrite, CASE WHEN length(ls[2]) BETWEEN 3 AND 80 THEN ls[2] ELSE '' END AS expansion FROM c"""),
    "score_to_weight": (score_to_weight, """SELECT event_id, round_even(0.4 + 0.6 * coalesce(CASE WHEN event_id % 3 != 0 THEN floor(value) / 1000 END, 0.0), 3)::DOUBLE AS weight,
        CASE WHEN event_id % 3 = 2 THEN event_type ELSE event_type || '→' || user_id END AS label FROM events"""),
    "canonical_labels": (canonical_labels, """WITH l AS (SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Za-z0-9]+')) AS label FROM documents) GROUP BY label)
        SELECT label, n, CASE WHEN lower(label) IN ('the', 'die', 'der') THEN 'article' ELSE lower(label) END AS canonical FROM l"""),
    "narrative_expand": (narrative_expand, f"""WITH b AS (SELECT item_id, text, unnest(['history of ', '']) AS ask FROM benchmark),
        w AS (SELECT item_id, ask, i, ts[i] AS t FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT item_id, ask, regexp_extract_all(lower({_ASKED}), '[a-z0-9_]+') AS ts FROM b))),
        e AS (SELECT item_id, ask, arg_min(t, (-length(t), i)) AS entity FROM w WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY ALL)
        SELECT item_id, ask, CASE WHEN regexp_matches({_ASKED}, {_q(LATIN.routes['is_narrative'])}) AND entity IS NOT NULL THEN entity || ' {' '.join(LATIN.history)}' END AS expanded FROM b LEFT JOIN e USING (item_id, ask)"""),
}
