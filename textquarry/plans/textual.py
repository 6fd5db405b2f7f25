"""Registered queries of the text functions and document statistics, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN
from ..operators import corpus
from ..sources.tables import table

_D = "d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)"
_SPACE = "[ \\t\\r\\n]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _per_doc(**columns):
    """A query that adds columns computed from each document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", *(c().alias(n) for n, c in columns.items()))

    return run


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(column: str, patterns, to: str = "") -> str:
    for p in patterns:
        flags = "g"
        if p.startswith("(?m)"):
            p, flags = p[4:], "gm"
            p = f"(?m){p}"
            flags = "g"
        column = f"regexp_replace({column}, {_q(p)}, {_q(to)}, '{flags}')"
    return column


_CLEAN = _replaced(_replaced(_replaced("t", LATIN.cleanup), ["\\n{4,}"], "\n\n\n"), ["(?m)^[ \\t]*[0-9]{1,4}[ \\t]*$", "^[ \\t\\r\\n]+", "[ \\t\\r\\n]+$"])
_PRE = _replaced(_replaced(_replaced(_replaced(_replaced(_replaced("t", [fx.STRAY]), LATIN.preprocess), ["\\n{4,}"], "\n\n\n"), ["(?m)^ {4,}"], "  "), ["([^ \\t\\r\\n])[ \\t]*•[ \\t]*"], "\\1\n- "), [f"(?m)([{LATIN.orphan}])Y([ \\t]*)$"], "\\1\\2")
_SENT = f"""s AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([{LATIN.enders}])', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s != '') AS ss FROM d))"""


def sentences(spark, sf_dir):
    s = fx.sentences(_docs(spark, sf_dir).select("doc_id", "text"))
    return s.select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"), F.length("sentence").alias("n_chars"))


def sentence_window(spark, sf_dir):
    """Every sentence with its neighbours."""
    s = fx.sentences(_docs(spark, sf_dir).select("doc_id", "text"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    joined = F.concat(F.coalesce(F.lag("sentence").over(w), F.lit("")), F.col("sentence"), F.coalesce(F.lead("sentence").over(w), F.lit("")))
    return s.select("doc_id", "pos", F.md5(joined).alias("window_md5"))


def labels(spark, sf_dir):
    """Capitalised words and short lines stand in for labels."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(fx.blank("text"), F.lit("[A-Z][A-Za-z0-9]+"), F.lit(0))).alias("label"))
    return words.groupBy("label").agg(F.count("*").alias("n"))


_LABELS = "l AS (SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[A-Z][A-Za-z0-9]+')) AS label FROM d) GROUP BY label)"


def label_gate(spark, sf_dir):
    return labels(spark, sf_dir).select("label", fx.valid_concept("label").alias("valid"), fx.clean_label("label").alias("cleaned"), fx.slugify("label").alias("slug"),
        fx.infer_category("label").alias("category"), fx.canonical_label("label").alias("canonical"), fx.card_type(F.lit(""), "label").alias("card_type"))


_CAT = "CASE " + " ".join((f"WHEN regexp_matches(label, {_q(LATIN.titles)}) THEN 'person' " if n == "event" else "") + f"WHEN regexp_matches(lower(label), {_q(p)}) THEN '{n}'" for n, p in LATIN.categories) + " ELSE 'concept' END"
_VALID = f"""length(label) BETWEEN 2 AND 40 AND lower(label) NOT IN ({', '.join(map(_q, fx.GENERIC_LABELS))}) AND (lower(label) IN ({', '.join(map(_q, fx.CONCEPT_WHITELIST))})
    OR regexp_matches(label, '^[A-Z]{{2,8}}$') OR regexp_matches(label, '^[A-Za-z]*[a-z][A-Z][A-Za-z]*$')
    OR (regexp_matches(label, '[A-Za-z]') AND regexp_matches(label, '[0-9]') AND regexp_matches(label, '^[A-Za-z0-9-]+$')))"""


def lines(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(fx.blank("text"), "\n", -1)).alias("line_no", "line"))
    # Every 7th line stands in for a numbered heading; the table has none of its own.
    return d.withColumn("line", F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("1.2 "), F.regexp_replace(F.substring("line", 1, 24), "[.,;:!?]", ""))).otherwise(F.col("line")))


_LINES = """li AS (SELECT doc_id, i - 1 AS line_no, CASE WHEN (i - 1) % 7 = 0 THEN '1.2 ' || regexp_replace(substr(ls[i], 1, 24), '[.,;:!?]', '', 'g') ELSE ls[i] END AS line
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)))"""


def headings(spark, sf_dir):
    """Heading lines with level and id, the first of each id in a document."""
    h = lines(spark, sf_dir).withColumn("level", fx.heading_level("line")).where("level IS NOT NULL").withColumn("text", F.trim("line"))
    w = Window.partitionBy("doc_id", F.lower("text")).orderBy("line_no")
    return h.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "line_no", "level", "text")


_LEVEL = """CASE WHEN regexp_matches(x, '^#{1,6}[ \\t]+[^ \\t]') THEN length(regexp_extract(x, '^(#{1,6})', 1))
    WHEN regexp_matches(x, '(?i)^part +[0-9]+') AND length(x) < 200 AND NOT regexp_matches(x, '[。！？，,：:；;.!?]$') THEN 0
    WHEN regexp_matches(x, '(?i)^chapter +[0-9]+') AND length(x) < 200 AND NOT regexp_matches(x, '(?i)^chapter +[0-9]+ *[,，]') THEN 1
    WHEN regexp_matches(x, '^[0-9]+(\\.[0-9]+){1,3}[ \\t]+[^ \\t]') AND length(x) < 60 AND NOT regexp_matches(x, '[。！？，,：:；;]')
        THEN least(3, length(regexp_replace(regexp_extract(x, '^([0-9.]+)', 1), '[0-9]', '', 'g')) + 1)
    WHEN regexp_matches(x, '^[0-9]+\\.[ \\t]+[^。，,！!？?：:；;、]+$') AND length(x) < 30 THEN 2
    WHEN x IN ('Preface', 'Introduction', 'Contents', 'Abstract', 'References', 'Conclusion') THEN 1 END"""


def query_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.array_sort(fx.query_terms("text")), " ").alias("terms"), fx.cache_key("text", "q").alias("cache_key"), fx.refine_query("text").alias("refined"))


def route_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return fx.route_questions(c.select("conv_id", "turn", "text")).drop("text")


def _all_stats(spark, sf_dir):
    """Every window of a document is a page of it; headings as in ``headings``."""
    from ..operators.index import fixed_windows

    pages = fixed_windows(_docs(spark, sf_dir)).select("doc_id", (F.col("chunk_index") + 1).alias("page"))
    return corpus.document_stats(_docs(spark, sf_dir), pages, headings(spark, sf_dir))


def document_stats(spark, sf_dir):
    return _all_stats(spark, sf_dir)


def library_stats(spark, sf_dir):
    """Of the documents with a 7 in their id."""
    return corpus.library_stats(_all_stats(spark, sf_dir), _docs(spark, sf_dir), ids="7")


def file_catalogue(spark, sf_dir):
    from ..operators.index import fixed_windows

    files = _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("."), F.upper("lang")).alias("file_name"), "lang")
    return corpus.file_catalogue(fixed_windows(_docs(spark, sf_dir)), files)


def kb_stats(spark, sf_dir):
    from ..operators.index import fixed_windows

    return fixed_windows(_docs(spark, sf_dir)).agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_files"))


def html_to_text(spark, sf_dir):
    return corpus.html_to_text(table(spark, sf_dir, "pages")).select("page_id", "title", F.md5("content").alias("content_md5"))


def cross_document_terms(spark, sf_dir):
    return corpus.cross_document_terms(_docs(spark, sf_dir))


def markdown_sections(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return corpus.markdown_sections(marked)


_CHUNKS = """chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 1800 + 1, 2000) AS chunk FROM (
    SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 200) / 1800), 1)::BIGINT)) AS i FROM d WHERE length(t) > 0))"""
_STATS = """st AS (SELECT doc_id, length(regexp_replace(t, '[ \\t\\r\\n]', '', 'g')) AS n_chars, length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS n_han,
    len(regexp_extract_all(t, '[^ \\t\\r\\n]+')) AS n_words, len(list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])', '\\1' || chr(10), 'g'), chr(10)),
    lambda s: trim(s, ' ')), lambda s: s != '')) AS n_sentences, len(list_filter(string_split_regex(t, '\\n[ \\t]*\\n'), lambda p: trim(p, ' ' || chr(10)) != '')) AS n_paragraphs FROM d),
    pg AS (SELECT doc_id, max(chunk_index) + 1 AS pages FROM chunks GROUP BY doc_id),
    hd AS (SELECT doc_id, line_no, """ + _LEVEL + """ AS level, x AS text FROM (SELECT *, trim(line, ' ') AS x FROM li)),
    ch AS (SELECT doc_id, count(DISTINCT lower(text)) AS chapters FROM hd WHERE level IS NOT NULL GROUP BY doc_id),
    full_st AS (SELECT st.*, pages, chapters FROM st LEFT JOIN pg USING (doc_id) LEFT JOIN ch USING (doc_id))"""
_HTML = "html"
for _p, _to in (("(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), ("(?i)</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>|<br */?>", "\n"), ("<[^>]*>", " ")):
    _HTML = f"regexp_replace({_HTML}, {_q(_p)}, {_q(_to)}, 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, {_q(_a)}, {_q(_b)})"

QUERIES = {
    "clean_text": (_per_doc(cleaned_md5=lambda: F.md5(fx.clean_text("text"))), f"WITH {_D} SELECT doc_id, md5({_CLEAN}) AS cleaned_md5 FROM d"),
    "preprocess_cleanup": (_per_doc(cleaned_md5=lambda: F.md5(fx.preprocess("text"))), f"WITH {_D} SELECT doc_id, md5({_PRE}) AS cleaned_md5 FROM d"),
    "garbled_ratio": (_per_doc(ratio=lambda: F.round(fx.garbled_ratio("text"), 6)),
        f"""WITH {_D}, g AS (SELECT doc_id, regexp_replace(t, '[ \\t\\r\\n.,;:!?，。；：！？“”‘’（）()【】\\[\\]《》、—…·]', '', 'g') AS s FROM d)
        SELECT doc_id, round(length(regexp_replace(s, '[ -~\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{ff01}}-\\x{{ff5e}}]', '', 'g')) / greatest(length(s), 1), 6) AS ratio FROM g"""),
    "script_gate": (_per_doc(is_ascii_lower=lambda: fx.script_gate("text", "[a-z]", 0.75)),
        f"WITH {_D} SELECT doc_id, trim(t, ' ') = '' OR (length(t) - length(regexp_replace(t, '[a-z]', '', 'g'))) / greatest(length(t), 1) > 0.75 AS is_ascii_lower FROM d"),
    "infer_domain": (_per_doc(domain=lambda: fx.infer_domain("source")), f"WITH {_D} SELECT doc_id, CASE WHEN regexp_matches(lower(source), 'src[02468]$') THEN 'even_sources' ELSE 'default' END AS domain FROM d"),
    "match_files": (_per_doc(kept=lambda: fx.match_files("source", ["src1", "src12"])), f"WITH {_D} SELECT doc_id, source IN ('src1', 'src12') AS kept FROM d"),
    "same_file": (_per_doc(same=lambda: fx.same_file(F.concat(F.lit("a\\"), F.col("source")), F.lit("b/src3"))), f"WITH {_D} SELECT doc_id, source = 'src3' AS same FROM d"),
    "detect_doc_type": (_per_doc(kind=lambda: fx.detect_doc_type("text")), f"""WITH {_D}, c AS (SELECT doc_id, lower(substr(t, 1, 3000)) AS h FROM d),
        n AS (SELECT doc_id, {' + '.join(f"contains(h, '{w}')::INT" for w in LATIN.academic)} AS a, {' + '.join(f"contains(h, '{w}')::INT" for w in LATIN.novel)} AS b FROM c)
        SELECT doc_id, CASE WHEN a >= 3 AND a > 1.5 * b THEN 'academic' WHEN b >= 4 AND b > a THEN 'novel' ELSE 'general' END AS kind FROM n"""),
    "focus_score": (_per_doc(score=lambda: fx.focus_score("text", "the")),
        f"WITH {_D} SELECT doc_id, len(list_filter(string_split_regex(lower(t), '[^a-z0-9_]+'), lambda x: x = 'the')) AS score FROM d"),
    "sentences": (sentences, f"WITH {_D}, {_SENT} SELECT doc_id, pos, md5(sentence) AS sentence_md5, length(sentence) AS n_chars FROM s"),
    "sentence_window": (sentence_window, f"""WITH {_D}, {_SENT} SELECT doc_id, pos, md5(coalesce(lag(sentence) OVER w, '') || sentence || coalesce(lead(sentence) OVER w, '')) AS window_md5
        FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""),
    "label_functions": (label_gate, f"""WITH {_D}, {_LABELS} SELECT label, {_VALID} AS valid, CASE WHEN length(label) BETWEEN 2 AND 60 THEN label END AS cleaned,
        trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_CAT} AS category, lower(label) AS canonical,
        CASE WHEN regexp_matches(lower(label), 'method|algorithm|ation$') THEN 'method' ELSE 'concept' END AS card_type FROM l"""),
    "headings": (headings, f"""WITH {_D}, {_LINES}, h AS (SELECT doc_id, line_no, {_LEVEL} AS level, x AS text FROM (SELECT *, trim(line, ' ') AS x FROM li))
        SELECT doc_id, line_no, level, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY line_no) AS rn FROM h WHERE level IS NOT NULL) WHERE rn = 1"""),
    "query_terms": (query_terms, f"""SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'),
        lambda t: length(t) >= 2 AND t NOT IN ({', '.join(map(_q, LATIN.stopwords))})))), ' '), '') AS terms,
        'q:' || md5(trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS cache_key, substr(coalesce(text, ''), 1, 30) AS refined FROM benchmark"""),
    "route_questions": (route_questions, "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(coalesce(text, ''), {_q(p)}) AS {k}" for k, p in LATIN.routes.items())
        + f", is_overview OR is_enumerate OR regexp_matches(coalesce(text, ''), {_q(LATIN.single)}) AS is_single_overview FROM conversations"),
    "document_stats": (document_stats, f"WITH {_D}, {_CHUNKS}, {_LINES}, {_STATS} SELECT * FROM full_st"),
    "library_stats": (library_stats, f"""WITH {_D}, {_CHUNKS}, {_LINES}, {_STATS}, b AS (SELECT full_st.*, lang AS format FROM full_st JOIN d USING (doc_id) WHERE contains(doc_id::VARCHAR, '7'))
        SELECT 'document' AS kind, doc_id::VARCHAR AS doc_id, format, 1 AS n_documents, n_words, n_sentences, chapters FROM b
        UNION ALL SELECT 'format', NULL, format, count(*), sum(n_words), sum(n_sentences), NULL FROM b GROUP BY format
        UNION ALL SELECT 'library', NULL, NULL, count(*), sum(n_words), sum(n_sentences), NULL FROM b"""),
    "file_catalogue": (file_catalogue, f"""WITH {_D}, {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(length(chunk)) AS n_chars, md5(arg_min(chunk, chunk_index)) AS first_md5,
        any_value(d.source || '.' || upper(d.lang)) AS file_name, any_value(d.lang) AS lang, any_value(d.lang) AS suffix FROM chunks JOIN d USING (doc_id) GROUP BY doc_id"""),
    "kb_stats": (kb_stats, f"WITH {_D}, {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_files FROM chunks"),
    "html_to_text": (html_to_text, f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), x AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), ''), 'Imported') AS title,
        list_filter(list_transform(string_split({_HTML}, chr(10)), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'), ' ')), lambda s: length(s) > 5)[1:300] AS ls FROM p)
        SELECT page_id, title, md5(substr(coalesce(array_to_string(ls, chr(10)), ''), 1, 15000)) AS content_md5 FROM x"""),
    "cross_document_terms": (cross_document_terms, f"""WITH {_D}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS term FROM d), c AS (SELECT term, count(*) AS n, min(doc_id) AS first_doc FROM w GROUP BY term)
        SELECT term, n AS n_documents, n > 1 AS shared, CASE WHEN n = 1 THEN first_doc END AS only_doc FROM c"""),
    "markdown_sections": (markdown_sections, f"""WITH {_D}, {_LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '## ' || line ELSE line END AS line FROM li),
        h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t]') AS is_head FROM m), r AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h)
        SELECT doc_id, section::BIGINT AS section, coalesce(max(length(regexp_extract(line, '^(#+)', 1))) FILTER (WHERE is_head), 0) AS level,
        coalesce(max(trim(regexp_replace(line, '^#+[ \\t]+', ''), ' ')) FILTER (WHERE is_head), '') AS title, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_head), '')) AS content_md5
        FROM r GROUP BY doc_id, section"""),
}
