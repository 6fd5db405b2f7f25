"""Registered queries that restrict, change and judge the concept graph of ``documents``, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import graph_edit as ge
from ..operators import blocks as bl
from ..operators.corpus import html_to_text
from ..operators.index import fixed_windows
from ..sources.tables import table
from .graphs import _BASE, _BOTH, _CAT, _graph, _labels
from .retrieval import CHUNKS, TFIDF
from .textual import _HTML


def _sourced(spark, sf_dir):
    """Nodes with their first document's source as file; edges with the first letter of their start's as theirs."""
    _, nodes, edges = _graph(spark, sf_dir)
    nodes = nodes.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("first_doc"), F.col("source").alias("source_file")), "first_doc")
    return nodes, edges.join(nodes.select(F.col("id").alias("src"), "source_file"), "src")


_SRC = _BASE + """, fd AS (SELECT id, min(doc_id) AS doc_id FROM lab WHERE id IN (SELECT id FROM nodes) GROUP BY id),
    sn AS (SELECT w.*, d.source AS source_file FROM wnodes w JOIN fd USING (id) JOIN documents d USING (doc_id)), se AS (SELECT e.*, s.source_file FROM edges e JOIN sn s ON s.id = e.src),
    one AS (SELECT min(source) AS f FROM documents)"""


def _file(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.min("source").alias("source_file"))


def graph_of_file(spark, sf_dir):
    nodes, edges = _sourced(spark, sf_dir)
    return ge.filter_to_file(nodes, edges, _file(spark, sf_dir).first()[0])[0].select("id", "label", "source_file")


def graph_scope(spark, sf_dir):
    nodes, edges = _sourced(spark, sf_dir)
    return ge.filter_scope(nodes, edges, files=_file(spark, sf_dir), keyword="e")[1].select("src", "dst", "n")


def _raw_categories(nodes):
    kinds = F.array(*map(F.lit, ("people", "person", "org", "weird", "Location", "method")))
    return nodes.withColumn("category", F.get(kinds, F.length("label") % 6))


def correct_category(spark, sf_dir):
    return ge.correct_category(_raw_categories(g.concept_nodes(_labels(spark, sf_dir)))).select("id", "category")


def normalize_relation(spark, sf_dir):
    edges = _graph(spark, sf_dir)[2].select("src", "dst", F.col("src").alias("label"))
    aliases = spark.createDataFrame([("in", "contains", 1), ("er", "causes", 2), ("un", "part_of", 3)], "alias string, relation string, ord int")
    return ge.normalize_relation(edges, aliases).select("src", "dst", "relation")


def mark_source_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    gone = d.where("lang = 'fr'").select("doc_id")
    return ge.mark_source_removed(_labels(spark, sf_dir), gone).groupBy("label").agg(F.count("*").alias("n"), F.count_if("source_removed").alias("n_removed"))


def remove_nodes(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return ge.remove_nodes(nodes, edges, nodes.where("label < 'E'"))[1].select("src", "dst", "n")


def restore_nodes(spark, sf_dir):
    """Labels before E go and those before C come back."""
    _, nodes, edges = _graph(spark, sf_dir)
    edges = edges.withColumn("edge_id", F.concat("src", F.lit(">"), "dst"))
    left = ge.remove_nodes(nodes, edges, nodes.where("label < 'E'"))
    return ge.restore_nodes(*left, nodes.where("label < 'C'"))[1].select("src", "dst", "n")


def import_graph(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    n = nodes.select("id", "label", F.lit("").alias("category"))
    e = edges.select("src", "dst", F.col("relation").alias("label"))
    return ge.import_graph(n.limit(0), e.limit(0), n.where("label > 'E'"), e, "new-")[1]


def graph_quality(spark, sf_dir):
    from ..functions import text as fx

    _, nodes, edges = _graph(spark, sf_dir)
    x = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("double") / 8
    y = F.conv(F.substring(F.md5("id"), 5, 4), 16, 10).cast("double") / 8
    return ge.graph_quality(nodes.select("id", "label", fx.infer_category("label").alias("category"), x.alias("x"), y.alias("y")), edges, ("er", "in"))


def domain_graphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"))
    return ge.domain_graphs(_labels(spark, sf_dir).join(d, "doc_id"))[2]


def gap_hints(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    chains = g.concept_chains(edges, g.rank_concepts(nodes, 60), 2)
    return ge.gap_hints(chains, edges)


def name_candidates(spark, sf_dir):
    """Capitalised words before frequent short words stand in for names before verbs."""
    return ge.name_candidates(fixed_windows(table(spark, sf_dir, "documents")), "[A-Z][a-z]{3,}", "is|ist|est|es", "the|der|le|la", ("chapter",))


def chunk_keywords(spark, sf_dir):
    c = fixed_windows(table(spark, sf_dir, "documents"))
    return ge.chunk_keywords(bl.tfidf(c), c, 10)


def filter_web_results(spark, sf_dir):
    """Pages stand in for results of ten queries."""
    p = table(spark, sf_dir, "pages")
    results = html_to_text(p).join(p.select("page_id", "url"), "page_id")
    results = results.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("ord"), "title", "url", F.col("content").alias("body"))
    queries = p.select((F.col("page_id") % 10).alias("query_id"), F.lit("plain words").alias("text")).distinct()
    return ge.filter_web_results(results, queries, 8).select("query_id", "place", "url")


QUERIES = {
    "graph_of_file": (graph_of_file, f"WITH {_SRC} SELECT id, label, source_file FROM sn WHERE source_file = (SELECT f FROM one)"),
    "graph_scope": (graph_scope, f"""WITH {_SRC}, k AS (SELECT id FROM sn WHERE contains(lower(label), 'e') AND (source_file = (SELECT f FROM one)
        OR id IN (SELECT src FROM se WHERE source_file = (SELECT f FROM one) UNION ALL SELECT dst FROM se WHERE source_file = (SELECT f FROM one))))
        SELECT src, dst, n FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""),
    "correct_category": (correct_category, f"""WITH {_BASE}, r AS (SELECT id, label, ['person', 'person', 'organization', 'concept', 'location', 'method'][length(label) % 6 + 1] AS c FROM nodes)
        SELECT id, CASE WHEN c IN ('person', 'organization', 'location') AND regexp_matches(lower(label), '(ness|ity|ism|ment|tion|ance|ence)$') THEN 'concept'
            WHEN c = 'person' AND NOT regexp_matches(label, '^[A-Z][a-z]+$') THEN 'concept' ELSE c END AS category FROM r"""),
    "normalize_relation": (normalize_relation, f"""WITH {_BASE} SELECT src, dst, CASE WHEN contains(src, 'in') THEN 'contains' WHEN contains(src, 'er') THEN 'causes' WHEN contains(src, 'un') THEN 'part_of' END AS relation FROM edges"""),
    "mark_source_removed": (mark_source_removed, f"WITH {_BASE} SELECT label, count(*) AS n, count(*) FILTER (lang = 'fr') AS n_removed FROM lab JOIN documents USING (doc_id) GROUP BY label"),
    "remove_nodes": (remove_nodes, f"WITH {_BASE}, k AS (SELECT id FROM nodes WHERE label >= 'E') SELECT src, dst, n FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"),
    "restore_nodes": (restore_nodes, f"WITH {_BASE}, k AS (SELECT id FROM nodes WHERE label >= 'E' OR label < 'C') SELECT src, dst, n FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"),
    "import_graph": (import_graph, f"WITH {_BASE}, k AS (SELECT id FROM nodes WHERE label > 'E') SELECT 'new-' || src AS src, 'new-' || dst AS dst, relation AS label FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"),
    "graph_quality": (graph_quality, f"""WITH RECURSIVE {_BOTH}, und AS MATERIALIZED (SELECT DISTINCT * FROM bw),
        lb(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
            SELECT u.src AS id, min(l.component) AS component FROM lb l JOIN und u ON u.dst = l.id JOIN recurring.lb o ON o.id = u.src GROUP BY u.src HAVING min(l.component) < any_value(o.component)),
        cs AS (SELECT component, count(*) AS n FROM lb GROUP BY component), k AS (SELECT {_CAT} AS category, count(*) AS n FROM nodes GROUP BY 1),
        p AS (SELECT id, ('0x' || substr(md5(id), 1, 4))::BIGINT / 8 AS x, ('0x' || substr(md5(id), 5, 4))::BIGINT / 8 AS y FROM nodes),
        ov AS (SELECT count(*) AS n FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 2500),
        f AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM k) AS cats, (SELECT max(n) FROM k) AS largest,
            (SELECT avg((relation IN ('', 'related', 'relates', '关联', '相关', '有关'))::INT) FROM edges) AS vague, (SELECT count(*) FROM cs) AS comps, (SELECT count(*) FROM cs WHERE n = 1) AS alone,
            (SELECT n FROM ov) AS n_over, (SELECT avg(regexp_matches(lower(label), 'er|in')::INT) FROM nodes) AS coverage),
        q AS (SELECT *, least(1, cats / 4 * (1 - 0.5::DOUBLE * largest / n_nodes)) AS diversity, greatest(0, 1 - 1.5::DOUBLE * vague) AS labels, greatest(0, 1 - 0.2::DOUBLE * (comps - 1) - alone / n_nodes) AS connectivity,
            greatest(0, 1 - 2 * n_over / greatest(n_nodes * (n_nodes - 1) / 2, 1)) AS layout, least(1, coverage * 1.2::DOUBLE) AS coherence FROM f),
        r AS (SELECT *, round({' + '.join(f'{w}::DOUBLE * {k}' for k, w in ge.QUALITY_WEIGHTS.items())}, 4) AS score FROM q)
        SELECT n_nodes, n_edges, round(diversity, 6) AS diversity, round(labels, 6) AS labels, round(connectivity, 6) AS connectivity, round(layout, 6) AS layout, round(coherence, 6) AS coherence,
            score, score >= 0.6 AS passed, vague > 0.5 AS warn_vague, alone / n_nodes > 0.1 AS warn_isolated FROM r"""),
    "domain_graphs": (domain_graphs, f"""WITH {_BASE}, dl AS (SELECT lab.*, source AS domain FROM lab JOIN documents USING (doc_id)),
        dn AS (SELECT domain, id FROM dl GROUP BY ALL HAVING count(DISTINCT (doc_id, chunk_index)) >= 2),
        ds AS (SELECT domain, id AS a, lead(id) OVER (PARTITION BY doc_id, chunk_index ORDER BY pos) AS b FROM dl SEMI JOIN dn USING (domain, id)),
        e AS (SELECT domain, count(DISTINCT (a, b)) AS n_edges FROM ds WHERE b IS NOT NULL AND a != b GROUP BY domain), n AS (SELECT domain, count(*) AS n_nodes FROM dn GROUP BY domain)
        SELECT d.domain, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, n_nodes IS NOT NULL AS ok FROM (SELECT DISTINCT domain FROM dl) d LEFT JOIN n USING (domain) LEFT JOIN e USING (domain)"""),
    "gap_hints": (gap_hints, f"""WITH RECURSIVE {_BOTH}, walk AS (SELECT id AS start, 0 AS step, id, [id] AS path FROM top UNION ALL
        SELECT start, step + 1, dst, list_append(path, dst) FROM (SELECT w.*, e.dst, row_number() OVER (PARTITION BY start ORDER BY weight DESC, dst) AS rn
            FROM walk w JOIN edges e ON e.src = w.id WHERE NOT list_contains(path, e.dst) AND step < 2) WHERE rn = 1),
        ends AS (SELECT start, arg_min(id, step) AS head, arg_max(id, step) AS tail FROM walk GROUP BY start),
        o AS (SELECT start, 'before' AS side, src AS hint, weight FROM ends JOIN edges ON dst = head UNION ALL SELECT start, 'after', dst, weight FROM ends JOIN edges ON src = tail),
        b AS (SELECT start, side, arg_min(hint, (-weight, hint)) AS hint, max(weight) AS weight FROM o WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.start = o.start AND w.id = o.hint) GROUP BY ALL),
        s AS (SELECT start, unnest(['before', 'after']) AS side FROM ends)
        SELECT start, side, coalesce(hint, '(none)') AS hint, weight, CASE WHEN hint IS NULL THEN 'medium' ELSE 'high' END AS priority FROM s LEFT JOIN b USING (start, side)"""),
    "name_candidates": (name_candidates, f"""WITH {_BASE}, n AS (SELECT unnest(regexp_extract_all(chunk, '([A-Z][a-z]{{3,}}) *(?:is|ist|est|es)', 1)) AS name, 2 AS s FROM chunks
        UNION ALL SELECT unnest(regexp_extract_all(chunk, '([A-Z][a-z]{{3,}}) *(?:the|der|le|la)', 1)), 1 FROM chunks UNION ALL SELECT unnest(regexp_extract_all(chunk, '[A-Z][a-z]{{3,}}')), 1 FROM chunks)
        SELECT name, sum(s)::BIGINT AS score FROM n WHERE lower(name) != 'chapter' GROUP BY name HAVING sum(s) >= 2 ORDER BY score DESC, length(name) DESC, name LIMIT 30"""),
    "chunk_keywords": (chunk_keywords, f"""WITH {CHUNKS}, {TFIDF}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY round(w, 6) DESC, term) AS rn FROM tw)
        SELECT doc_id, chunk_index, term AS keyword FROM t WHERE rn <= 10 UNION SELECT doc_id, chunk_index, unnest(regexp_extract_all(chunk, '[A-Z][a-z]+(?:tion|ment|ness|ity)')) FROM chunks
        UNION SELECT doc_id, chunk_index, unnest(list_filter(regexp_extract_all(chunk, '[\\p{{L}}\\p{{N}}_]+'), lambda v: regexp_matches(v, '^[A-Z]{{2,8}}$'))) FROM chunks"""),
    "filter_web_results": (filter_web_results, f"""WITH g AS (SELECT page_id, url AS u, coalesce(html, '') AS html FROM pages),
        x AS (SELECT page_id, trim(coalesce(u, ''), ' ') AS url, trim(coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), ''), 'Imported'), ' ') AS title,
            list_filter(list_transform(string_split({_HTML}, chr(10)), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'), ' ')), lambda s: length(s) > 5)[1:300] AS ls FROM g),
        b AS (SELECT page_id % 10 AS query_id, page_id, url, title, trim(substr(coalesce(array_to_string(ls, chr(10)), ''), 1, 15000), ' ') AS body FROM x),
        k AS (SELECT * FROM b WHERE title != '' AND url != '' AND length(body) >= 20 AND NOT regexp_matches(lower(title || ' ' || url || ' ' || body), '{"|".join(ge.SPAM_WORDS)}')
            AND NOT regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1), '(^|\\.)({"|".join(h.replace(".", chr(92) + ".") for h in ge.SPAM_HOSTS)})$')),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY page_id) AS rn FROM k)
        SELECT query_id, place, url FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id, url) AS place, substr(url, 1, 500) AS url FROM o WHERE rn = 1) WHERE place <= 8"""),
}
