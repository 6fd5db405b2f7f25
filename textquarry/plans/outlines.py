"""Registered queries over headings, outlines and trees of ``documents``, each with its SQL twin.

The documents have no headings, so every line of theirs stands for one, at level line mod 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outline as o
from ..operators.index import fixed_windows
from ..sources.tables import table
from .retrieval import CHUNKS
from .textual import _LEVEL

_L = """l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"""
_H = _L + """, h AS (SELECT * FROM (SELECT doc_id, line_no, trim(line, ' ') AS title, line_no % 3 AS level FROM l) WHERE title != '')"""
#: H2 without the encoding, which keeps different ids apart.
_ID = "regexp_replace(regexp_replace(lower(trim(title, ' ')), '[ \\t\\r\\n]+', '-', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g')"


def _lines(spark, sf_dir):
    return o.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _headings(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("doc_id", "line_no", F.trim("line").alias("title"), (F.col("line_no") % 3).alias("level")).where("title != ''")


def _chunks(spark, sf_dir):
    return fixed_windows(table(spark, sf_dir, "documents"))


def drop_inline_toc(spark, sf_dir):
    """Lines after the thirtieth lie ten times as far apart."""
    h = _headings(spark, sf_dir).withColumn("line_no", F.col("line_no") * F.when(F.col("line_no") > 30, 10).otherwise(1))
    return o.drop_inline_toc(h)


def _short_lines(spark, sf_dir, line):
    """The documents with a line a clause, ``line`` of (x, i) in place of the i-th, from 0."""
    ls = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[.!?,] ", "\n"), "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(ls, line), "\n").alias("text"))


def toc_region(spark, sf_dir):
    """The second clause of a document is its contents line; clauses are indented by their number, and some are blank or chapters."""
    line = lambda x, i: F.when(i == 1, "Contents").when(i % 47 == 46, F.concat(F.lit("第3章 "), x)).when(i % 11 == 10, "").otherwise(F.concat(F.repeat(F.lit(" "), i % 4 * 3), x))
    return o.toc_region(_short_lines(spark, sf_dir, line))


def inline_headings(spark, sf_dir):
    return o.inline_headings(_lines(spark, sf_dir)).select("doc_id", "line_no", F.md5("title").alias("title_md5"), "level")


def outline_from_markdown(spark, sf_dir):
    """Every line with something in it becomes a markdown heading."""
    rows = _lines(spark, sf_dir).where("trim(line) != ''")
    return o.outline_from_markdown(rows.select("doc_id", "line_no", F.concat(F.expr("repeat('#', line_no % 3 + 1)"), F.lit(" "), F.trim("line")).alias("line")))


def outline_clean(spark, sf_dir):
    return o.outline_clean(_headings(spark, sf_dir))


def chapters_to_parts(spark, sf_dir):
    return o.chapters_to_parts(_headings(spark, sf_dir))


def volumes(spark, sf_dir):
    """Clauses are headings, at level line mod 3, where they have at most 40 characters and the line number is no multiple of 4."""
    d = _short_lines(spark, sf_dir, lambda x, i: x)
    rows = o.numbered_lines(d).where("line_no % 4 > 0 AND length(line) <= 40")
    return o.volumes(d, rows.select("doc_id", "line_no", F.col("line").alias("title"), (F.col("line_no") % 3).alias("level")))


def structure_graph(spark, sf_dir):
    return o.structure_graph(_headings(spark, sf_dir))


def graph_mode(spark, sf_dir):
    return o.graph_mode(_chunks(spark, sf_dir))


def merge_outlines(spark, sf_dir):
    h = _headings(spark, sf_dir)
    return o.merge_outlines(h.where("level = 0"), h.where("level > 0"))


def outline_points_distinct(spark, sf_dir):
    h = _headings(spark, sf_dir)
    return o.outline_points_distinct(h.select("doc_id", F.expr("line_no div 9").alias("chapter"), F.col("line_no").alias("ord"), F.col("title").alias("point")))


def chapter_sample(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return o.chapter_sample(c, c.where("chunk_index % 4 = 0"), 6)


def rule_tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"))
    return o.rule_tree(_chunks(spark, sf_dir).join(d, "doc_id"))


def tree_clean(spark, sf_dir):
    """A tree a source: documents hang on the document of half their number within the source."""
    d = table(spark, sf_dir, "documents")
    n = d.selectExpr("source AS tree", "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord", "substring(text, 1, 300) AS description", "regexp_extract(text, '^([A-Za-z]+)', 1) AS label")
    return o.tree_clean(n.selectExpr("tree", "ord", "CAST(ord AS STRING) AS node_id", "CASE WHEN ord > 1 THEN CAST(ord div 2 AS STRING) END AS parent_id", "CASE WHEN ord = 1 THEN 'root' ELSE label END AS label", "description")).drop("description")


_CLAUSES = "cl AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?,] ', chr(10), 'g'), chr(10)) AS ls FROM documents)"
_T = "regexp_replace(x, '^[ \\t\\r\\x0b\\x0c　]+|[ \\t\\r\\x0b\\x0c　]+$', '', 'g')"
#: H11 for the lines of these documents, whose only Han characters are those of the chapter lines.
_P = _T
_OWN = "regexp_replace(raw, '^[ \\t\\r　]+|[ \\t\\r　]+$', '', 'g')"
_FREE = "list_filter(x.ps, lambda p: len(list_filter(a.c, lambda c: abs(c.ofs - p) < 5000)) = 0)"
#: B19 in SQL.
_VALID = "(length(trim({0}, ' ')) BETWEEN 2 AND 20 AND NOT regexp_matches(trim({0}, ' '), '[.,;:!?。，；：！？]$') AND NOT regexp_matches(trim({0}, ' '), '(?i)^(fig|figure|table|图|表)') AND NOT regexp_matches(trim({0}, ' '), '[0-9]{{4}}[-/年]') AND length(regexp_replace({0}, '[^A-Za-z一-鿿]', '', 'g')) >= 2)"
_SPREAD = "(CASE WHEN least({n}, {q}) <= 1 THEN {i} = 0 ELSE list_contains(list_transform(range(0, least({n}, {q})::BIGINT), lambda z: round_even(z * ({n} - 1) / (least({n}, {q}) - 1), 0)::BIGINT), {i}) END)"
QUERIES = {
    "drop_inline_toc": (drop_inline_toc, f"""WITH {_H}, g AS (SELECT doc_id, CASE WHEN line_no > 30 THEN line_no * 10 ELSE line_no END AS line_no, title, level FROM h),
        a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN line_no - lag(line_no) OVER w <= 25 THEN 0 ELSE 1 END AS far FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        b AS (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM a), r AS (SELECT doc_id, run, count(*) AS c, min(i) AS s FROM b GROUP BY ALL),
        k AS (SELECT doc_id, min(s) FILTER (c >= 5) AS s, max(c) AS c FROM r GROUP BY doc_id)
        SELECT doc_id, line_no, title, level FROM b JOIN k USING (doc_id) WHERE NOT coalesce(n > 5 AND (s <= 5 OR s >= n - c - 3) AND i >= s AND i < s + c, false)"""),
    "toc_region": (toc_region, f"""WITH {_CLAUSES}, a AS (SELECT doc_id, list_transform(ls, lambda x, i: CASE WHEN i = 2 THEN 'Contents' WHEN (i - 1) % 47 = 46 THEN '第3章 ' || x WHEN (i - 1) % 11 = 10 THEN ''
            ELSE repeat(' ', ((i - 1) % 4 * 3)::BIGINT) || x END) AS ls FROM cl),
        s AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches({_T}, '{o.TOC_TITLE}')), true) AS ofs FROM a),
        r AS (SELECT doc_id, ofs, ls[ofs + 1:ofs + {o.TOC_SCAN}] AS ls FROM s WHERE ofs > 0),
        k AS (SELECT *, list_transform(ls, lambda x: {{'i': -1::BIGINT, 'bad': CASE WHEN {_T} = '' THEN 1 WHEN NOT regexp_matches({_P}, '{o.TOC_META}') AND (length({_T}) < 50 OR regexp_matches({_T}, '^[0-9]{{1,2}}[ \\t]')
            OR regexp_matches({_P}, '(?i)^(第|chapter|part)') OR regexp_matches({_P}, '^[一二三四五六七八九十]+[ \\t]*[、.]')) THEN 0 ELSE 2 END, 'ch': regexp_matches({_P}, '{o.TOC_CHAPTER}'), 'e': -1::BIGINT}}) AS ks FROM r),
        f AS (SELECT doc_id, ofs, ls, list_reduce(list_prepend({{'i': 0::BIGINT, 'bad': 0, 'ch': false, 'e': -1::BIGINT}}, ks), lambda a, x: CASE WHEN a.e >= 0 THEN a ELSE {{'i': a.i + 1,
            'bad': CASE x.bad WHEN 0 THEN 0 ELSE a.bad + 1 END, 'ch': false, 'e': CASE WHEN x.bad = 2 AND a.bad >= 2 THEN greatest(a.i - 3, 0) WHEN x.bad != 1 AND x.ch THEN a.i ELSE -1 END}} END) AS z FROM k),
        g AS (SELECT doc_id, ofs, unnest(range(0, len(t))) AS n, unnest(t) AS x FROM (SELECT doc_id, ofs, ls[1:CASE WHEN z.e >= 0 THEN z.e ELSE {o.TOC_TAKEN} END] AS t FROM f)),
        h AS (SELECT doc_id, ofs + n AS line_no, {_T} AS own, {_P} AS title, length(x) - length(regexp_replace(x, '^[ \\t\\r\\x0b\\x0c　]+', '')) AS indent FROM g),
        v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {_ID} ORDER BY line_no) AS rn FROM h WHERE length(own) > 1 AND length(title) > 1 AND NOT regexp_matches(own, '^[iIvVxX0-9]+$')
            AND NOT regexp_matches(own, '(?i)^(contents|目　?录)$') AND NOT regexp_matches(title, '{o.TOC_DROP}'))
        SELECT doc_id, line_no, title, CASE WHEN indent >= 8 THEN 2 WHEN indent >= 3 THEN 1 WHEN regexp_matches(title, '^[0-9]{{1,2}}[ \\t]') AND length(title) < 50 THEN 1 ELSE 0 END AS level FROM v WHERE rn = 1"""),
    "inline_headings": (inline_headings, f"""WITH {_L}, v AS (SELECT doc_id, line_no, x, {_LEVEL} AS level, trim(coalesce(lag(line) OVER w, ''), ' ') = '' AND trim(coalesce(lead(line) OVER w, ''), ' ') = '' AND length(x) BETWEEN 3 AND 20 AS alone
            FROM (SELECT *, trim(line, ' ') AS x FROM l) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        n AS (SELECT *, count(level) OVER (PARTITION BY doc_id) = 0 AND count(*) OVER (PARTITION BY doc_id) < 5000 AS none FROM v)
        SELECT doc_id, line_no, md5(trim(regexp_replace(x, '^#+[ \\t]*', ''), ' ')) AS title_md5, CASE WHEN level IS NULL THEN 2 ELSE level END AS level FROM n WHERE level IS NOT NULL OR (none AND alone)"""),
    "outline_from_markdown": (outline_from_markdown, f"""WITH {_L}, m AS (SELECT doc_id, line_no, trim(line, ' ') AS title, line_no % 3 AS level FROM l),
        m2 AS (SELECT * FROM m WHERE title != ''), k AS (SELECT doc_id, regexp_replace(lower(title), '[ \\t]+', '', 'g') AS key, min(line_no) AS line_no, arg_max(title, line_no) AS title, arg_max(level, line_no) AS level FROM m2 GROUP BY 1, 2),
        b AS (SELECT DISTINCT doc_id, regexp_extract(title, '(?i)^((?:chapter|part) +[0-9]+)', 1) AS head FROM k WHERE regexp_extract(title, '(?i)^((?:chapter|part) +[0-9]+)', 1) NOT IN ('', title))
        SELECT doc_id, line_no, title, level FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND head = title)"""),
    "outline_clean": (outline_clean, f"""WITH {_H}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {_ID} ORDER BY line_no) AS rn FROM h
            WHERE length(title) BETWEEN 3 AND 80
            AND NOT (regexp_matches(title, '^[0-9]+\\.?[ \\t]+.{{10,}}') AND regexp_matches(title, '(?i)\\b(can|should|must|will|first|finally|then)\\b')))
        SELECT doc_id, line_no, title, level FROM c WHERE rn = 1"""),
    "chapters_to_parts": (chapters_to_parts, f"""WITH {_H}, p AS (SELECT *, max(CASE WHEN level = 0 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part_line FROM h)
        SELECT p.doc_id, part_line, h.title AS part, p.line_no, p.title FROM p JOIN h ON h.doc_id = p.doc_id AND h.line_no = part_line WHERE p.level > 0"""),
    "volumes": (volumes, f"""WITH {_CLAUSES}, l0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw FROM cl),
        l AS (SELECT *, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(raw) - 1)::BIGINT AS ofs, {_OWN} AS line, regexp_replace(raw, '[ \\t\\r　]+', '', 'g') AS key FROM l0),
        b AS (SELECT * FROM l WHERE ofs > 5000 AND key != ''),
        it AS (SELECT * FROM (SELECT doc_id, line_no, line AS title, key, line_no % 3 AS level, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS rn FROM l WHERE line_no % 4 > 0 AND length(raw) <= 40) WHERE rn = 1 AND length(title) BETWEEN 2 AND 80),
        pl AS (SELECT it.*, ps, ps[1] AS ofs FROM it JOIN (SELECT doc_id, key, list(ofs ORDER BY ofs) AS ps FROM b GROUP BY ALL) USING (doc_id, key)),
        mb AS (SELECT * FROM pl WHERE level = 0 AND {_VALID.format('title')} AND NOT regexp_matches(title, '{o.VOLUME_NOISE}') AND NOT regexp_matches(title, '{o.VOLUME_SECTION}')),
        g1 AS (SELECT doc_id, list_reduce(list_prepend({{'c': []::STRUCT(ofs BIGINT, title VARCHAR, rule VARCHAR)[], 't': '', 'ps': []::BIGINT[]}}, list({{'c': []::STRUCT(ofs BIGINT, title VARCHAR, rule VARCHAR)[], 't': title, 'ps': ps}} ORDER BY line_no)),
            lambda a, x: {{'c': CASE WHEN len({_FREE}) > 0 THEN list_append(a.c, {{'ofs': ({_FREE})[1], 'title': x.t, 'rule': 'heading'}}) ELSE a.c END, 't': x.t, 'ps': x.ps}}).c AS v FROM mb GROUP BY doc_id),
        sh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ofs) AS rn FROM (SELECT doc_id, line, min(ofs) AS ofs FROM b WHERE length(line) BETWEEN 2 AND 12 AND NOT regexp_matches(line, '{o.LINE_NOT}') AND NOT regexp_matches(line, '{o.LINE_NOISE}') GROUP BY ALL)),
        ok AS (SELECT doc_id, ofs, line FROM sh WHERE rn <= 12 AND {_VALID.format('line')} AND (SELECT count(*) FROM pl WHERE pl.doc_id = sh.doc_id AND level >= 1 AND pl.ofs >= sh.ofs AND pl.ofs < sh.ofs + 20000) >= 3
            AND NOT EXISTS (SELECT 1 FROM it WHERE it.doc_id = sh.doc_id AND it.title = sh.line AND it.level = 0 AND {_VALID.format('it.title')} AND NOT regexp_matches(it.title, '{o.VOLUME_NOISE}') AND NOT regexp_matches(it.title, '{o.VOLUME_SECTION}'))),
        g2 AS (SELECT doc_id, list({{'ofs': ofs, 'title': line, 'rule': 'line'}} ORDER BY ofs, line) AS lone FROM ok GROUP BY doc_id),
        g3 AS (SELECT doc_id, coalesce(v, []) AS v, coalesce(lone, []) AS lone FROM g1 FULL JOIN g2 USING (doc_id)),
        g4 AS (SELECT doc_id, unnest(list_reduce(list_prepend(v, list_transform(lone, lambda y: [y])), lambda a, x: CASE WHEN len(list_filter(a, lambda c: abs(c.ofs - x[1].ofs) < 5000)) = 0 THEN list_concat(a, x) ELSE a END)) AS v FROM g3),
        vo AS (SELECT doc_id, v.ofs AS volume_at, v.title AS volume, v.rule AS rule, lead(v.ofs, 1, 9223372036854775807) OVER (PARTITION BY doc_id ORDER BY v.ofs) AS until FROM g4),
        ch AS (SELECT vo.*, pl.ofs AS chapter_at, pl.title AS chapter FROM pl JOIN vo ON pl.doc_id = vo.doc_id AND pl.ofs >= volume_at AND pl.ofs < until WHERE (level = 1 OR (level = 0 AND NOT regexp_matches(pl.title, '{o.VOLUME_NOISE}')))
            AND NOT EXISTS (SELECT 1 FROM vo x WHERE x.doc_id = pl.doc_id AND x.volume = pl.title)),
        si AS (SELECT vo.*, b.ofs AS chapter_at, b.line AS chapter, b.key FROM b JOIN vo ON b.doc_id = vo.doc_id AND b.ofs >= volume_at AND b.ofs < until WHERE length(b.line) <= 40 AND regexp_matches(b.line, '{o.VOLUME_STAND_IN}')
            AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = vo.doc_id AND ch.volume_at = vo.volume_at)),
        st AS (SELECT *, row_number() OVER (PARTITION BY doc_id, volume_at ORDER BY chapter_at) AS rn FROM (SELECT doc_id, volume_at, volume, rule, min(chapter_at) AS chapter_at, arg_min(chapter, chapter_at) AS chapter FROM si GROUP BY doc_id, volume_at, volume, rule, key))
        SELECT doc_id, volume_at, volume, rule, chapter_at, chapter FROM ch UNION ALL SELECT doc_id, volume_at, volume, rule, chapter_at, chapter FROM st WHERE rn <= 12
        UNION ALL SELECT doc_id, volume_at, volume, rule, NULL, NULL FROM vo WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = vo.doc_id AND ch.volume_at = vo.volume_at) AND NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = vo.doc_id AND st.volume_at = vo.volume_at)"""),
    "structure_graph": (structure_graph, f"""WITH {_H}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS rn FROM h),
        v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM u WHERE rn = 1), n AS (SELECT * FROM v WHERE place <= 60),
        e AS (SELECT b.doc_id, b.title AS dst, b.level, arg_max(a.title, a.line_no) FILTER (a.level < b.level) AS up, arg_max(a.title, a.line_no) FILTER (a.level = b.level) AS same
            FROM n b JOIN n a ON a.doc_id = b.doc_id AND a.line_no < b.line_no GROUP BY b.doc_id, b.title, b.level)
        SELECT doc_id, up AS src, dst, 'contains' AS relation, 0.8::DOUBLE AS weight, round(0.9 - 0.15 * level, 2)::DOUBLE AS node_weight FROM e WHERE up IS NOT NULL
        UNION ALL SELECT doc_id, same, dst, 'next', 0.5, round(0.9 - 0.15 * level, 2)::DOUBLE FROM e WHERE same IS NOT NULL"""),
    "graph_mode": (graph_mode, f"""WITH {CHUNKS} SELECT doc_id, CASE WHEN avg(regexp_matches(chunk, '(?im)^(#{{1,6}}[ \\t]|(chapter|part) +[0-9]+|第[一二三四五六七八九十百0-9]+[章节部篇卷])')::INT) >= 0.3 THEN 'structure' ELSE 'concept' END AS mode
        FROM chunks GROUP BY doc_id"""),
    "merge_outlines": (merge_outlines, f"""WITH {_H}, k AS (SELECT *, regexp_replace(lower(title), '[ \\t\\r\\n　]+', '', 'g') AS flat, {_ID} AS hid FROM h)
        SELECT 0 AS origin, doc_id, line_no, title, level FROM k WHERE level = 0 UNION ALL
        SELECT 1, doc_id, line_no, title, level FROM k i WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM k t WHERE t.level = 0 AND t.doc_id = i.doc_id AND (t.flat = i.flat OR t.hid = i.hid))"""),
    "outline_points_distinct": (outline_points_distinct, f"""WITH {_H}, p AS (SELECT doc_id, line_no // 9 AS chapter, line_no AS ord, title AS point, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM h),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY chapter, ord) AS rn FROM p WHERE key != '') WHERE rn = 1)
        SELECT c.doc_id, c.chapter, coalesce(ord, 0) AS ord, coalesce(point, '(see the other chapters)') AS point FROM (SELECT DISTINCT doc_id, chapter FROM p) c LEFT JOIN k USING (doc_id, chapter)"""),
    "chapter_sample": (chapter_sample, f"""WITH {CHUNKS}, t AS (SELECT doc_id FROM chunks WHERE chunk_index % 4 = 0 GROUP BY doc_id HAVING count(*) >= 2),
        a AS (SELECT doc_id, chunk_index, CASE WHEN doc_id IN (SELECT doc_id FROM t) THEN chunk_index // 4 + 1 ELSE 0 END AS span FROM chunks),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, span ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY doc_id, span) AS n FROM a),
        s AS (SELECT doc_id, greatest(1, 6 // count(DISTINCT span)) AS q FROM a GROUP BY doc_id),
        c AS (SELECT *, {_SPREAD.format(n="n", q="q", i="i")} AS inn FROM b JOIN s USING (doc_id)),
        d AS (SELECT *, count(*) FILTER (inn) OVER (PARTITION BY doc_id) AS taken, count(*) OVER (PARTITION BY doc_id, inn) AS rest, row_number() OVER (PARTITION BY doc_id, inn ORDER BY chunk_index) - 1 AS j FROM c)
        SELECT doc_id, chunk_index, span FROM d WHERE inn OR (taken < 6 AND {_SPREAD.format(n="rest", q="(6 - taken)", i="j")})"""),
    "rule_tree": (rule_tree, f"""WITH {CHUNKS}, f AS (SELECT source AS domain, doc_id, count(*) AS n_chunks FROM chunks JOIN documents USING (doc_id) GROUP BY ALL)
        SELECT domain, 'node_0' AS node_id, NULL AS parent_id, domain AS label, sum(n_chunks)::BIGINT AS n_chunks FROM f GROUP BY domain
        UNION ALL SELECT domain, 'node_' || row_number() OVER (PARTITION BY domain ORDER BY doc_id), 'node_0', doc_id::VARCHAR, n_chunks FROM f"""),
    "tree_clean": (tree_clean, """WITH RECURSIVE a AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1) AS label FROM documents),
        b AS (SELECT tree, ord::VARCHAR AS node_id, CASE WHEN ord > 1 THEN (ord // 2)::VARCHAR END AS parent_id, substr(CASE WHEN ord = 1 THEN 'root' ELSE label END, 1, 20) AS label FROM a),
        w AS (SELECT tree, node_id, parent_id, label, 0 AS depth FROM b WHERE parent_id IS NULL UNION ALL
            SELECT b.tree, b.node_id, b.parent_id, b.label, depth + 1 FROM w JOIN b ON b.tree = w.tree AND b.parent_id = w.node_id WHERE depth < 4 AND b.label != '')
        SELECT * FROM w WHERE tree IN (SELECT tree FROM w WHERE depth = 1)"""),
}
