"""Registered queries over the concept graph of ``documents``, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import LATIN
from ..operators import graph as g
from ..operators.index import fixed_windows
from ..sources.tables import stored, table

_BASE = """x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE length(coalesce(text, '')) > 0),
chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 1800 + 1, 2000) AS chunk FROM (
    SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 200) / 1800), 1)::BIGINT)) AS i FROM x)),
lab AS (SELECT doc_id, chunk_index, i - 1 AS pos, ls[i] AS label, lower(ls[i]) AS id FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, chunk_index, regexp_extract_all(chunk, '[A-Z][a-z]{5,}') AS ls FROM chunks))),
nodes AS (SELECT id, arg_min(label, (doc_id, chunk_index, pos)) AS label, count(DISTINCT (doc_id, chunk_index)) AS n_chunks,
    min((doc_id, chunk_index))[1] AS first_doc, min((doc_id, chunk_index))[2] AS first_chunk FROM lab GROUP BY id HAVING n_chunks >= 2),
wnodes AS (SELECT id, label, n_chunks, round(least(0.95, 0.55 + 0.1 * n_chunks), 3)::DOUBLE AS weight, first_doc, first_chunk FROM nodes),
seq AS (SELECT doc_id, chunk_index, id AS src, lead(id) OVER (PARTITION BY doc_id, chunk_index ORDER BY pos) AS dst FROM lab WHERE id IN (SELECT id FROM nodes)),
en AS (SELECT src, dst, count(*) AS n FROM seq WHERE dst IS NOT NULL AND dst != src GROUP BY ALL),
edges AS (SELECT src, dst, n, round(least(0.9, 0.6 + 0.08 * (n - 1)), 3)::DOUBLE AS weight,
    CASE WHEN contains(src, dst) THEN 'contains' WHEN contains(dst, src) THEN 'belongs_to' ELSE 'related' END AS relation FROM en)"""
_BOTH = _BASE + ", bw AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), top AS (SELECT * FROM wnodes ORDER BY weight DESC, n_chunks DESC, length(label) DESC, id LIMIT 60)"


def _labels(spark, sf_dir):
    return g.chunk_labels(fixed_windows(table(spark, sf_dir, "documents")))


def concept_nodes(spark, sf_dir):
    return g.concept_nodes(_labels(spark, sf_dir))


def concept_chunks(spark, sf_dir):
    return g.concept_chunks(_labels(spark, sf_dir), concept_nodes(spark, sf_dir))


def rank_concepts(spark, sf_dir):
    return g.rank_concepts(concept_nodes(spark, sf_dir), 60)


def _graph(spark, sf_dir):
    """Labels, nodes and edges, each stored: what follows reads them several times, and the texts once."""
    labels = stored(_labels(spark, sf_dir), "labels")
    nodes = stored(g.concept_nodes(labels), "nodes")
    return labels, nodes, stored(g.adjacency_edges(labels, nodes), "edges")


def adjacency_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


def edge_chunks(spark, sf_dir):
    labels, nodes, _ = _graph(spark, sf_dir)
    return g.edge_chunks(labels, nodes)


def chain_edges(spark, sf_dir):
    """The first label of each chunk alone gives no neighbours: the 60 best concepts become a chain."""
    labels = _labels(spark, sf_dir)
    return g.adjacency_edges(labels.where("pos = 0"), rank_concepts(spark, sf_dir), chain=True)


def sentence_cooccurrence(spark, sf_dir):
    s = fx.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.sentence_cooccurrence(s, concept_nodes(spark, sf_dir))


def sentence_edges(spark, sf_dir):
    """C9 in fiction, with the bound on edges."""
    s = fx.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.sentence_cooccurrence(s, concept_nodes(spark, sf_dir), fiction=True, cap=60)


def keep_edges(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return g.keep_edges(edges, g.rank_concepts(nodes, 60), 60).select("src", "dst", "weight")


def node_degree(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return g.node_degree(nodes, edges)


def related_concepts(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return g.related_concepts(nodes, edges)


def concept_sources(spark, sf_dir):
    labels, nodes, _ = _graph(spark, sf_dir)
    return g.concept_sources(labels, nodes, g.edge_chunks(labels, nodes))


def connected_components(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return g.components(nodes, edges)


def bfs_rings(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    centre = g.node_degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(1)
    return g.bfs_rings(nodes, edges, centre)


def concept_chain(spark, sf_dir):
    _, nodes, edges = _graph(spark, sf_dir)
    return g.concept_chains(edges, g.rank_concepts(nodes, 60))


def entity_resolve(spark, sf_dir):
    labels, _, edges = _graph(spark, sf_dir)
    return g.entity_resolve(labels.groupBy("label").agg(F.count("*").alias("n")), edges, 100)


def edge_majority(spark, sf_dir):
    """What stands between two concepts, most often, over all sentences."""
    pairs = sentence_cooccurrence(spark, sf_dir)
    return g.edge_majority(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation", "n"), "n")


def layout_overlap(spark, sf_dir):
    nodes = concept_nodes(spark, sf_dir)
    x = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("double") / 8
    y = F.conv(F.substring(F.md5("id"), 5, 4), 16, 10).cast("double") / 8
    return g.layout_overlap(nodes.select("id", x.alias("x"), y.alias("y")))


def category_shares(spark, sf_dir):
    return g.category_shares(concept_nodes(spark, sf_dir), fx.infer_category("label"))


_CAT = "CASE " + " ".join((f"WHEN regexp_matches(label, '{LATIN.titles}') THEN 'person' " if n == "event" else "") + f"WHEN regexp_matches(lower(label), '{p}') THEN '{n}'" for n, p in LATIN.categories) + " ELSE 'concept' END"


def _cooccur(fiction: bool) -> str:
    """CTE ``co``: (a, b, relation, n, weight)."""
    tight = r"""regexp_replace(gap, '[ \t,，、。！？；："'']', '', 'g')"""
    relation = "CASE " + " ".join(f"WHEN regexp_matches(gap, '{p}') THEN '{n}'" for n, p in g.BETWEEN)
    relation += (f" WHEN length({tight}) BETWEEN 1 AND 4 THEN {tight}" if fiction else "") + " ELSE 'co_occurrence' END"
    return f"""s AS (SELECT sentence, list_distinct(regexp_extract_all(sentence, '[A-Z][a-z]{{5,}}')) AS ids FROM (
        SELECT unnest(list_transform(string_split(regexp_replace(t, '([.!?;])', '\\1' || chr(10), 'g'), chr(10)), lambda v: trim(v, ' '))) AS sentence FROM x) WHERE length(sentence) BETWEEN 4 AND 200),
        i AS (SELECT row_number() OVER () AS r, sentence, ids FROM s WHERE len(ids) >= 2), e AS (SELECT r, sentence, unnest(ids) AS id FROM i),
        pr AS (SELECT a.id AS la, b.id AS lb, a.sentence, strpos(a.sentence, a.id) AS pa, strpos(a.sentence, b.id) AS pb FROM e a JOIN e b ON a.r = b.r AND a.id < b.id),
        gp AS (SELECT *, least(pa, pb) + length(CASE WHEN pa < pb THEN la ELSE lb END) AS gap_at FROM pr),
        gq AS (SELECT la, lb, CASE WHEN greatest(pa, pb) > gap_at THEN substr(sentence, gap_at, greatest(pa, pb) - gap_at) ELSE '' END AS gap FROM gp),
        co AS (SELECT lower(la) AS a, lower(lb) AS b, {relation} AS relation, count(*) AS n, round(least(0.95, 0.7 + 0.1 * (count(*) - 1)), 3)::DOUBLE AS weight FROM gq
            WHERE lower(la) IN (SELECT id FROM nodes) AND lower(lb) IN (SELECT id FROM nodes) GROUP BY ALL)"""

QUERIES = {
    "concept_nodes": (concept_nodes, f"WITH {_BASE} SELECT * FROM wnodes"),
    "rank_concepts": (rank_concepts, f"WITH {_BOTH} SELECT * FROM top"),
    "adjacency_edges": (adjacency_edges, f"WITH {_BASE} SELECT * FROM edges"),
    "concept_chunks": (concept_chunks, f"WITH {_BASE} SELECT DISTINCT id, doc_id, chunk_index FROM lab WHERE id IN (SELECT id FROM nodes)"),
    "edge_chunks": (edge_chunks, f"WITH {_BASE} SELECT DISTINCT src, dst, doc_id, chunk_index FROM seq WHERE dst IS NOT NULL AND dst != src"),
    "chain_edges": (chain_edges, f"""WITH {_BOTH}, c AS (SELECT id AS src, lead(id) OVER (ORDER BY weight DESC, n_chunks DESC, length(label) DESC, id) AS dst FROM top)
        SELECT src, dst, 0 AS n, 0.4::DOUBLE AS weight, CASE WHEN contains(src, dst) THEN 'contains' WHEN contains(dst, src) THEN 'belongs_to' ELSE 'related' END AS relation FROM c WHERE dst IS NOT NULL"""),
    "sentence_cooccurrence": (sentence_cooccurrence, f"WITH {_BASE}, {_cooccur(False)} SELECT * FROM co"),
    "sentence_edges": (sentence_edges, f"WITH {_BASE}, {_cooccur(True)} SELECT * FROM co ORDER BY n DESC, a, b, relation LIMIT (SELECT least(60, 3 * count(*)) FROM nodes)"),
    "keep_edges": (keep_edges, f"WITH {_BOTH} SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY weight DESC, src, dst LIMIT 120"),
    "node_degree": (node_degree, f"WITH {_BOTH} SELECT id, count(src) AS degree FROM nodes LEFT JOIN bw ON id = src GROUP BY id"),
    "related_concepts": (related_concepts, f"WITH {_BOTH} SELECT src AS id, label AS related, row_number() OVER (PARTITION BY src ORDER BY label, dst) AS place FROM (SELECT DISTINCT * FROM bw) JOIN nodes ON dst = id"),
    "concept_sources": (concept_sources, f"WITH {_BASE} SELECT DISTINCT id, doc_id AS document FROM lab WHERE id IN (SELECT id FROM nodes)"),
    # Reachability would be quadratic in a component; labels fall over the edges until none does.
    "connected_components": (connected_components, f"""WITH RECURSIVE {_BOTH}, und AS MATERIALIZED (SELECT DISTINCT * FROM bw),
        lb(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
            SELECT u.src AS id, min(l.component) AS component FROM lb l JOIN und u ON u.dst = l.id JOIN recurring.lb o ON o.id = u.src GROUP BY u.src HAVING min(l.component) < any_value(o.component))
        SELECT id, component FROM lb"""),
    "bfs_rings": (bfs_rings, f"""WITH {_BOTH}, c AS (SELECT id FROM (SELECT id, count(src) AS degree FROM nodes LEFT JOIN bw ON id = src GROUP BY id) ORDER BY degree DESC, id LIMIT 1),
        one AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM c)), two AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM one))
        SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 0 WHEN id IN (SELECT id FROM one) THEN 1 WHEN id IN (SELECT id FROM two) THEN 2 ELSE 3 END AS ring FROM nodes"""),
    "concept_chain": (concept_chain, f"""WITH RECURSIVE {_BOTH}, walk AS (SELECT id AS start, 0 AS step, id, [id] AS path FROM top UNION ALL
        SELECT start, step + 1, dst, list_append(path, dst) FROM (SELECT w.*, e.dst, row_number() OVER (PARTITION BY start ORDER BY weight DESC, dst) AS rn
            FROM walk w JOIN edges e ON e.src = w.id WHERE NOT list_contains(path, e.dst) AND step < 4) WHERE rn = 1)
        SELECT start, step, id FROM walk"""),
    "entity_resolve": (entity_resolve, f"""WITH {_BASE}, r AS (SELECT lower(label) AS canon, min(label) AS label, count(*) AS n FROM lab GROUP BY 1),
        dg AS (SELECT canon, sum(n) AS degree FROM (SELECT src AS canon, n FROM edges UNION ALL SELECT dst, n FROM edges) GROUP BY canon),
        s AS (SELECT r.*, coalesce(degree, 0)::BIGINT AS degree, {_CAT} AS category FROM r LEFT JOIN dg USING (canon)),
        v AS (SELECT *, (n + 0.5::DOUBLE * degree) * CASE WHEN category = 'organization' THEN 0.7::DOUBLE WHEN regexp_matches(canon, '(ness|ity|ism|ment|tion|ance|ence)$') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM s)
        SELECT canon, label, category, n, degree, round_even(raw / (SELECT max(raw) FROM v), 3)::DOUBLE AS score FROM v ORDER BY raw DESC, n DESC, canon LIMIT 100"""),
    "edge_majority": (edge_majority, f"""WITH {_BASE}, {_cooccur(False)} SELECT a AS src, b AS dst, relation, round(least(1.0, 0.4 + 0.15 * n), 3)::DOUBLE AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, relation) AS rn FROM co) WHERE rn = 1"""),
    "layout_overlap": (layout_overlap, f"""WITH {_BASE}, p AS (SELECT id, ('0x' || substr(md5(id), 1, 4))::BIGINT / 8 AS x, ('0x' || substr(md5(id), 5, 4))::BIGINT / 8 AS y FROM nodes)
        SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 2500"""),
    "category_shares": (category_shares, f"WITH {_BASE} SELECT {_CAT} AS category, count(*) AS n FROM nodes GROUP BY 1"),
}
