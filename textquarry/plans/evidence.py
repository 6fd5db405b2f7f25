"""Registered queries over evidence, chunk selection and document comparison, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN
from ..operators import evidence as e
from ..operators.index import fixed_windows
from ..sources.tables import table
from .retrieval import _STOP, CHUNKS, EVIDENCE, bm25_evidence, questions

_SPLIT = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?;])', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s != '')"
_WORDS = "regexp_extract_all({}, '[A-Za-z0-9_]+')"
_ITEMS = "SELECT item_id AS query_id, coalesce(text, '') AS t FROM benchmark"


def _exact_sql(asked: str) -> str:
    """CTEs up to ``ex``, the exact scan's rows for the queries (query_id, t) that ``asked`` selects."""
    return f""",
xp AS (SELECT *, trim(regexp_extract(t, '["“「『]([^"”」』]{{2,}})["”」』]', 1), ' ') AS phrase FROM ({asked})),
xt AS (SELECT query_id, unnest(list_distinct(list_filter({_WORDS.format("lower(t)")}, lambda t: length(t) >= 2 AND t NOT IN ({_STOP})))) AS term FROM xp WHERE phrase = ''),
xn AS (SELECT query_id, unnest(list_distinct(list_filter({_WORDS.format("t")}, lambda w: regexp_full_match(w, '[A-Z][a-z]{{1,3}}') AND lower(w) NOT IN ({_STOP})))) AS term FROM xp WHERE phrase = ''),
xq AS (SELECT query_id, term, max(a) AS a, max(b) AS b FROM (SELECT query_id, term, 1 AS a, 0 AS b FROM xt UNION ALL SELECT query_id, term, 0, 1 FROM xn) GROUP BY ALL),
sl AS (SELECT * FROM (SELECT doc_id, chunk_index, chunk, {_SPLIT.format("chunk")} AS ss FROM chunks) WHERE len(ss) > 0),
s AS (SELECT doc_id, chunk_index, i - 1 AS pos, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sl)),
w AS (SELECT doc_id, chunk_index, pos, substr(sentence, 1, 80) AS prefix, unnest(list_distinct(list_concat({_WORDS.format("sentence")}, {_WORDS.format("lower(sentence)")}))) AS term FROM s),
h0 AS (SELECT query_id, doc_id, chunk_index, pos, prefix, sum(a) AS hits, list(term) FILTER (WHERE b = 1) AS names FROM w JOIN xq USING (term) GROUP BY ALL HAVING hits > 0),
h1 AS (SELECT query_id, doc_id, chunk_index, pos, prefix, false AS spans, (hits + CASE WHEN len(list_distinct(flatten(list(coalesce(names, []))
    OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)))) >= 2 THEN 3 ELSE 0 END)::BIGINT AS hit_count FROM h0),
p0 AS (SELECT query_id, phrase, sl.*, len(list_filter(ss, lambda x: contains(x, phrase))) = 0 AS spans FROM sl JOIN xp ON phrase != '' AND contains(chunk, phrase)),
p1 AS (SELECT query_id, phrase, doc_id, chunk_index, 0 AS pos, substr(chunk, 1, 200) AS sentence, true AS spans FROM p0 WHERE spans UNION ALL
    SELECT query_id, phrase, doc_id, chunk_index, pos, sentence, false FROM p0 JOIN s USING (doc_id, chunk_index) WHERE NOT spans AND contains(sentence, phrase)),
h2 AS (SELECT * FROM h1 UNION ALL SELECT query_id, doc_id, chunk_index, pos, substr(sentence, 1, 80), spans, contains(sentence, phrase)::BIGINT FROM p1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, prefix ORDER BY doc_id, chunk_index, pos) AS r1 FROM h2),
h4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY hit_count DESC, pos) AS r2 FROM h3 WHERE r1 = 1),
h5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, doc_id, chunk_index, pos) AS place FROM h4 WHERE r2 <= 2),
ex AS (SELECT query_id, place, doc_id, chunk_index, pos, hit_count, CASE WHEN spans THEN substr(chunk, 1, 200) ELSE ss[pos + 1] END AS sentence,
    concat(CASE WHEN pos > 0 THEN ss[pos] ELSE '' END, ss[pos + 1], coalesce(ss[pos + 2], '')) AS window_text FROM h5 JOIN sl USING (doc_id, chunk_index) WHERE place <= 8)"""


_EXACT_ONLY = _exact_sql(_ITEMS)
_EXACT = CHUNKS + _EXACT_ONLY
_PHRASE = CHUNKS + _exact_sql(f"""SELECT 2 * query_id AS query_id, concat('"', t, '"') AS t FROM ({_ITEMS}) UNION ALL
    SELECT 2 * query_id + 1, concat('"', coalesce({_SPLIT.format("t")}[1], ''), '"') FROM ({_ITEMS})""")
_DEDUP = EVIDENCE + _EXACT_ONLY + """,
both_ AS (SELECT 0 AS origin, query_id, place, doc_id, chunk_index, pos, sentence FROM ex UNION ALL SELECT 1, query_id, evidence_rank, doc_id, chunk_index, pos, sentence FROM ev3 WHERE evidence_rank <= 8),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(sentence, 1, 80) ORDER BY origin, place, doc_id, chunk_index, pos) AS r1 FROM both_),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY origin, place, pos) AS r2 FROM b1 WHERE r1 = 1),
ded AS (SELECT * EXCLUDE (place, r1, r2) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, doc_id, chunk_index, pos) AS p FROM b2 WHERE r2 <= 2) WHERE p <= 12)"""
_FC = CHUNKS + ", fc AS (SELECT source AS domain, c.* FROM chunks c JOIN documents USING (doc_id))"


def _chunks(spark, sf_dir):
    return fixed_windows(table(spark, sf_dir, "documents"))


def _domain_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain")), "doc_id")


def _exact(spark, sf_dir):
    return e.exact_sentences(questions(spark, sf_dir), _chunks(spark, sf_dir), 8)


def exact_sentence_scan(spark, sf_dir):
    return _exact(spark, sf_dir).select("query_id", "place", "doc_id", "chunk_index", "pos", "hit_count", F.md5("window_text").alias("window_md5"))


def exact_phrase_scan(spark, sf_dir):
    """Every benchmark item in quotation marks, whole (which spans sentences) and its first sentence."""
    q, quoted = questions(spark, sf_dir), lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    both = q.select((2 * F.col("query_id")).alias("query_id"), quoted(F.col("text")).alias("text")).unionByName(
        q.select((2 * F.col("query_id") + 1).alias("query_id"), quoted(F.get(fx.sentence_array("text"), F.lit(0))).alias("text")))
    rows = e.exact_sentences(both, _chunks(spark, sf_dir), 8)
    return rows.select("query_id", "place", "doc_id", "chunk_index", "pos", "hit_count", F.md5("sentence").alias("sentence_md5"), F.md5("window_text").alias("window_md5"))


def _dedup(spark, sf_dir):
    """The exact scan's sentences before those of the BM25 hits."""
    hits = bm25_evidence(spark, sf_dir).withColumnRenamed("evidence_rank", "place")
    return e.evidence_dedup(e.exact_sentences(questions(spark, sf_dir), _chunks(spark, sf_dir), 8), hits)


def evidence_dedup(spark, sf_dir):
    return _dedup(spark, sf_dir).select("query_id", "origin", "doc_id", "chunk_index", "pos")


def evidence_entity_filter(spark, sf_dir):
    return e.evidence_entity_filter(_exact(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "doc_id", "chunk_index", "pos", "hit")


def select_graph_chunks(spark, sf_dir):
    return e.select_graph_chunks(_domain_chunks(spark, sf_dir), "time")


def analysis_scope(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"), F.col("n_chars").alias("time"))
    return e.analysis_scope(_chunks(spark, sf_dir), files)


def query_variants(spark, sf_dir):
    q = questions(spark, sf_dir)
    rewrites = q.select("query_id", F.posexplode(F.array(F.lower("text"), F.col("text"), F.concat("text", F.lit("?")), F.lit(" "))).alias("ord", "text")).withColumn("ord", F.col("ord") + 1)
    return e.query_variants(q, rewrites)


def file_budget_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"), "text")
    return e.file_budget_text(d).select("domain", "doc_id", F.md5("part").alias("part_md5"))


def file_topics(spark, sf_dir):
    return e.file_topics(_chunks(spark, sf_dir), 12)


def reality_check(spark, sf_dir):
    """The words of every sentence of a benchmark item, one by one, against the document of the same number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("segment_id"), F.col("text"))
    words = fx.sentences(items).select("segment_id", "pos", F.posexplode(F.split("sentence", " ")).alias("word", "point"))
    segments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    return e.reality_check(words, segments).select("segment_id", "pos", "word")


def pending_units(spark, sf_dir):
    units = _chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").alias("grp"))
    return e.pending_units(units, units.where("(doc_id + grp) % 2 = 0"))


def document_pair_diff(spark, sf_dir):
    """Every document against the one with the next id."""
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return e.document_pair_diff(fx.sentences(d.select("doc_id", "text")), pairs).drop("added", "removed")


def locate_evidence(spark, sf_dir):
    """Every sentence of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return e.locate_evidence(fx.sentences(d), d).select("doc_id", "pos", "start", "end")


QUERIES = {
    "exact_sentence_scan": (exact_sentence_scan, f"WITH {_EXACT} SELECT query_id, place, doc_id, chunk_index, pos, hit_count, md5(window_text) AS window_md5 FROM ex"),
    "exact_phrase_scan": (exact_phrase_scan, f"WITH {_PHRASE} SELECT query_id, place, doc_id, chunk_index, pos, hit_count, md5(sentence) AS sentence_md5, md5(window_text) AS window_md5 FROM ex"),
    "evidence_dedup": (evidence_dedup, f"WITH {_DEDUP} SELECT query_id, origin, doc_id, chunk_index, pos FROM ded"),
    "evidence_entity_filter": (evidence_entity_filter, f"""WITH {_EXACT}, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{{3,}}')) AS es,
        regexp_matches(coalesce(text, ''), '{LATIN.routes["is_narrative"]}') AS narrative FROM benchmark),
        r AS (SELECT ex.*, narrative, len(list_filter(es, lambda x: contains(sentence, x))) > 0 AS hit FROM ex JOIN q USING (query_id)),
        r2 AS (SELECT *, max(hit) OVER (PARTITION BY query_id, doc_id) AS fh, max(hit) OVER (PARTITION BY query_id) AS ah FROM r)
        SELECT query_id, doc_id, chunk_index, pos, hit FROM r2 WHERE hit OR NOT ah OR (narrative AND fh AND regexp_matches(lower(sentence), 'found|origin|history|began|begin'))"""),
    "select_graph_chunks": (select_graph_chunks, f"""WITH {_FC}, f AS (SELECT domain, doc_id, chunk_index, len(regexp_extract_all(' ' || regexp_replace(lower(chunk), '[^a-z0-9_]+', '  ', 'g') || ' ', ' time ')) AS focus FROM fc),
        g AS (SELECT *, sum(focus) OVER (PARTITION BY domain, doc_id) AS total, count(*) OVER (PARTITION BY domain, doc_id) AS available,
            row_number() OVER (PARTITION BY domain, doc_id ORDER BY focus DESC, chunk_index) AS rn FROM f)
        SELECT domain, place, doc_id, chunk_index, focus, available FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY least(rn, 5), total DESC, doc_id, rn) AS place FROM g WHERE rn <= 12) WHERE place <= 48"""),
    "analysis_scope": (analysis_scope, f"""WITH {CHUNKS}, f AS (SELECT source AS domain, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS file_rank FROM documents),
        c AS (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS available, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS rn FROM chunks)
        SELECT domain, file_rank, doc_id, chunk_index, available, least(available, 8) AS selected FROM c JOIN f USING (doc_id) WHERE rn <= 8 AND file_rank <= 8"""),
    "query_variants": (query_variants, """WITH v AS (SELECT item_id AS query_id, unnest([0, 1, 2, 3]) AS ord, unnest([trim(text, ' '), trim(lower(text), ' '), trim(text, ' '), trim(text || '?', ' ')]) AS text FROM benchmark),
        m AS (SELECT query_id, text, min(ord) AS ord FROM v WHERE text != '' GROUP BY ALL)
        SELECT query_id, place, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, text) AS place FROM m) WHERE place <= 3"""),
    "file_budget_text": (file_budget_text, """WITH n AS (SELECT source AS domain, doc_id, coalesce(text, '') AS t, greatest(400, 8000 // count(*) OVER (PARTITION BY source)) AS quota FROM documents),
        p AS (SELECT domain, doc_id, substr(t, 1, quota) AS part FROM n WHERE t != ''),
        r AS (SELECT *, 8000 - coalesce(sum(length(part)) OVER (PARTITION BY domain ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
        SELECT domain, doc_id, md5(substr(part, 1, room::BIGINT)) AS part_md5 FROM r WHERE room > 0"""),
    "file_topics": (file_topics, f"""WITH {CHUNKS}, f AS (SELECT DISTINCT doc_id FROM chunks ORDER BY doc_id LIMIT 12)
        SELECT doc_id, chunk_index + 1 AS place, trim(substr(chunk, 1, 80), ' ') AS point FROM chunks WHERE doc_id IN (SELECT doc_id FROM f) AND chunk_index < 2"""),
    "reality_check": (reality_check, f"""WITH b AS (SELECT item_id, {_SPLIT.format("coalesce(text, '')")} AS ss FROM benchmark), p AS (SELECT item_id, i - 1 AS pos, string_split(ss[i], ' ') AS ws FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM b)),
        w AS (SELECT item_id, pos, i - 1 AS word, regexp_extract_all(ws[i], '[A-Za-z0-9]{{3,}}') AS ts FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM p)),
        s AS (SELECT doc_id AS item_id, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g') AS flat FROM documents)
        SELECT item_id AS segment_id, pos, word FROM w LEFT JOIN s USING (item_id) WHERE len(ts) = 0 OR len(list_filter(ts, lambda t: contains(coalesce(flat, ''), t))) > 0"""),
    "pending_units": (pending_units, f"WITH {CHUNKS} SELECT doc_id, chunk_index AS grp FROM chunks WHERE (doc_id + chunk_index) % 2 != 0"),
    "document_pair_diff": (document_pair_diff, f"""WITH l AS (SELECT doc_id, unnest({_SPLIT.format("coalesce(text, '')")}) AS sentence FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9_]+'), ' ') AS s FROM l),
        p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), s1 AS (SELECT * FROM s WHERE s != ''),
        x AS (SELECT a, b, s FROM p JOIN s1 ON doc_id = a), y AS (SELECT a, b, s FROM p JOIN s1 ON doc_id = b),
        u AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.s, y.s) AS s, x.a IS NOT NULL AS ia, y.a IS NOT NULL AS ib FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b AND x.s = y.s),
        o AS (SELECT a, b, s, list_distinct(string_split(s, ' ')) AS w FROM u WHERE NOT ib), n AS (SELECT a, b, s, list_distinct(string_split(s, ' ')) AS w FROM u WHERE NOT ia),
        m AS (SELECT o.a, count(DISTINCT o.s) AS n_modified FROM o JOIN n USING (a, b) WHERE len(list_intersect(o.w, n.w)) > 0
            AND 2 * len(list_intersect(o.w, n.w)) >= len(o.w) + len(n.w) - len(list_intersect(o.w, n.w)) GROUP BY o.a)
        SELECT u.a, u.b, count(*) FILTER (NOT ia) AS n_added, count(*) FILTER (NOT ib) AS n_removed, round((count(*) FILTER (ia AND ib)) / count(*), 4)::DOUBLE AS similarity,
            coalesce(any_value(n_modified), 0) AS n_modified FROM u LEFT JOIN m ON u.a = m.a GROUP BY u.a, u.b"""),
    "locate_evidence": (locate_evidence, f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, string_split(t, '') AS cs FROM d),
        m AS (SELECT doc_id, regexp_replace(t, '[ \\t\\r\\n]', '', 'g') AS flat, list_filter(range(1, len(cs) + 1), lambda i: cs[i] NOT IN (' ', chr(9), chr(10), chr(13))) AS places, {_SPLIT.format("t")} AS ss FROM c),
        s AS (SELECT doc_id, i - 1 AS pos, flat, places, regexp_replace(ss[i], '[ \\t\\r\\n]', '', 'g') AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM m)),
        f AS (SELECT *, strpos(flat, s) AS first FROM s)
        SELECT doc_id, pos, CASE WHEN s != '' AND first > 0 THEN places[first] - 1 ELSE -1 END AS start, CASE WHEN s != '' AND first > 0 THEN places[first + length(s) - 1] ELSE -1 END AS "end" FROM f"""),
}
