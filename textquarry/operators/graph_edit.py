"""Changes, restrictions and quality of stored concept graphs; label candidates for new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import HAN
from .graph import components, keep_edges, layout_overlap

#: D11, fixed values: weights of the parts.
QUALITY_WEIGHTS = {"diversity": 0.25, "labels": 0.25, "connectivity": 0.20, "layout": 0.15, "coherence": 0.15}
#: B17, fixed values: synonyms of categories, the categories, and those that abstract labels leave.
CATEGORY_SYNONYMS = {"people": "person", "character": "person", "company": "organization", "org": "organization", "place": "location", "algorithm": "method", "technique": "method"}
CATEGORIES = ("concept", "person", "organization", "location", "event", "process", "method")
CONCRETE = ("person", "event", "organization", "location", "process")
#: B11, fixed values: words and hosts of results that are dropped.
SPAM_WORDS = ("porn", "xxx", "adult", "sex", "nude", "dating", "casino", "bet", "成人", "色情", "博彩", "赌博", "在线观看", "伦理片", "无码", "高清资源")
SPAM_HOSTS = ("kanliao.org", "e-ham.ru")


def filter_to_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, source_file) of one file and the edges among them."""
    kept = nodes.where(fx.same_file("source_file", F.lit(file)))
    return kept, keep_edges(edges, kept)


def filter_scope(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, concepts: DataFrame | None = None, keyword: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes within all given restrictions, and the edges among them.

    ``files`` (source_file) holds for a node by its own file or one of its edges'; ``concepts`` (id)
    by its id; ``keyword`` by its label, whatever the case.
    """
    kept = nodes
    if files is not None:
        by_edge = edges.join(files, "source_file", "left_semi")
        ids = by_edge.select(F.col("src").alias("id")).union(by_edge.select("dst")).union(nodes.join(files, "source_file", "left_semi").select("id"))
        kept = kept.join(ids.distinct(), "id", "left_semi")
    if concepts is not None:
        kept = kept.join(concepts.select("id"), "id", "left_semi")
    if keyword:
        kept = kept.where(F.contains(F.lower("label"), F.lit(keyword.lower())))
    return kept, keep_edges(edges, kept)


def person_name(label: Column | str) -> Column:
    """One to four capitalised words, or 2 to 4 Han characters, perhaps with a middle dot."""
    return fx.blank(label).rlike("^[A-Z][a-z'-]+( [A-Z][a-z'.-]+){0,3}$|^[\\x{4e00}-\\x{9fff}]{2,4}$|^[\\x{4e00}-\\x{9fff}]+·[\\x{4e00}-\\x{9fff}]+$")


def correct_category(nodes: DataFrame) -> DataFrame:
    """Synonyms to their category, unknown ones to ``concept``; so abstract labels of concrete categories and persons without a name."""
    c = F.lower(F.trim(fx.blank("category")))
    for a, b in CATEGORY_SYNONYMS.items():
        c = F.when(c == a, b).otherwise(c)
    c = F.when(c.isin(*CATEGORIES), c).otherwise("concept")
    wrong = (c.isin(*CONCRETE) & fx.abstract_label("label")) | ((c == "person") & ~person_name("label"))
    return nodes.withColumn("category", F.when(wrong, "concept").otherwise(c))


def normalize_relation(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """H4: the relation of an equal alias (alias, relation, ord), else of the first that the label contains, else null.

    The aliases are a vocabulary, not data; distinct labels meet them, not edges.
    """
    label = F.lower(F.trim(fx.blank("label")))
    known = edges.select(label.alias("__l")).distinct()
    a = aliases.select(F.lower("alias").alias("__a"), "relation", "ord")
    hit = known.join(a, (F.col("__a") != "") & F.contains("__l", F.col("__a")))
    best = hit.groupBy("__l").agg(F.min(F.struct((F.col("__a") != F.col("__l")).alias("part"), "ord", "relation")).alias("b")).select("__l", F.col("b.relation").alias("relation"))
    return edges.withColumn("__l", label).join(best, "__l", "left").drop("__l")


def mark_source_removed(rows: DataFrame, deleted: DataFrame, by: str = "doc_id") -> DataFrame:
    """``source_removed`` is true for rows of deleted documents; all rows stay."""
    gone = deleted.where(F.col(by).isNotNull()).select(F.col(by).alias("__gone")).distinct()
    return rows.join(gone, F.col(by) == F.col("__gone"), "left").withColumn("source_removed", F.col("__gone").isNotNull()).drop("__gone")


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C20: (nodes, edges, removed nodes, removed edges) when the nodes ``ids`` and their edges go."""
    ids = ids.select("id").distinct()
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    kept = edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*edges.columns)
    gone = edges.join(src, "src", "left_semi").select(*edges.columns).unionByName(edges.join(src, "src", "left_anti").join(dst, "dst", "left_semi").select(*edges.columns))
    return nodes.join(ids, "id", "left_anti"), kept, nodes.join(ids, "id", "left_semi"), gone


def restore_nodes(nodes: DataFrame, edges: DataFrame, removed: DataFrame, removed_edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C20: nodes ``ids`` come back unless there again; removed edges that touch them too, unless their edge_id is there or an end is missing."""
    back = removed.join(ids.select("id").distinct(), "id", "left_semi").join(nodes.select("id"), "id", "left_anti")
    now = nodes.unionByName(back)
    new = removed_edges.join(edges.select("edge_id"), "edge_id", "left_anti")
    touches = [new.join(back.select(F.col("id").alias(c)), c, "left_semi").select(*edges.columns) for c in ("src", "dst")]
    new = touches[0].unionByName(touches[1]).dropDuplicates(["edge_id"])
    return now, edges.unionByName(keep_edges(new, now).select(*edges.columns))


def import_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The stored graph with an extracted one under ids ``prefix`` + id.

    Edges whose ends are no nodes of it go; blank labels become the id (edges: ``related``), blank categories ``concept``.
    """
    label = lambda other: F.when(F.trim(fx.blank("label")) == "", other).otherwise(F.col("label"))
    n = new_nodes.where(F.col("id").isNotNull()).select(
        F.concat(F.lit(prefix), "id").alias("id"), label(F.col("id")).alias("label"), F.when(F.trim(fx.blank("category")) == "", "concept").otherwise(F.col("category")).alias("category"))
    e = keep_edges(new_edges, new_nodes).select(F.concat(F.lit(prefix), "src").alias("src"), F.concat(F.lit(prefix), "dst").alias("dst"), label(F.lit("related")).alias("label"))
    return nodes.select("id", "label", "category").unionByName(n), edges.select("src", "dst", "label").unionByName(e)


def graph_quality(nodes: DataFrame, edges: DataFrame, keywords: tuple[str, ...] = (), least: float = 0.6, vague: tuple[str, ...] = ("", "related", "relates", "关联", "相关", "有关")) -> DataFrame:
    """One row of part scores, the weighted ``score``, ``passed`` and warnings for a graph (id, label, category, x, y; src, dst, relation).

    An empty graph fails with 0. Overlaps are counted through grid cells, not pair by pair.
    """
    shares = nodes.groupBy("category").agg(F.count("*").alias("n")).agg(F.count("*").alias("cats"), F.max("n").alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"))
    lab = edges.agg(F.coalesce(F.avg(F.trim(fx.blank("relation")).isin(*vague).cast("int")), F.lit(1.0)).alias("vague_share"), F.count("*").alias("n_edges"))
    comp = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    comp = comp.agg(F.count("*").alias("n_components"), F.coalesce(F.sum((F.col("n") == 1).cast("int")), F.lit(0)).alias("n_isolated"))
    over = layout_overlap(nodes.select("id", "x", "y")).agg(F.count("*").alias("n_overlaps"))
    hit = F.lower("label").rlike("|".join(keywords)) if keywords else F.lit(False)
    cover = nodes.agg(F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("coverage"))
    n = F.greatest(F.col("n_nodes"), F.lit(1)).cast("double")
    pairs = n * (n - 1) / 2
    least0 = lambda c: F.greatest(F.lit(0.0), c)
    isolated = F.col("n_isolated") / n
    parts = {
        "diversity": F.least(F.lit(1.0), F.col("cats") / 4 * (1 - 0.5 * F.coalesce("largest", F.lit(0)) / n)),
        "labels": least0(1 - 1.5 * F.col("vague_share")),
        "connectivity": least0(1 - 0.2 * (F.col("n_components") - 1) - isolated),
        "layout": F.when(F.col("n_nodes") < 2, 0.5).otherwise(least0(1 - 2 * F.col("n_overlaps") / F.greatest(pairs, F.lit(1.0)))),
        "coherence": F.least(F.lit(1.0), F.col("coverage") * 1.2) if keywords else F.lit(0.7),
    }
    total = sum((F.col(k) * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    # Five one-row tables.
    out = shares.crossJoin(lab).crossJoin(comp).crossJoin(over).crossJoin(cover).withColumns({k: F.round(v, 6) for k, v in parts.items()})
    out = out.withColumn("score", F.when(F.col("n_nodes") == 0, 0.0).otherwise(F.round(total, 4)))
    return out.select("n_nodes", "n_edges", *parts, "score", (F.col("score") >= least).alias("passed"), (F.col("vague_share") > 0.5).alias("warn_vague"), (isolated > 0.1).alias("warn_isolated"))


def domain_graphs(labels: DataFrame, least_chunks: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of a graph per domain, from labels (domain, doc_id, chunk_index, pos, label), in one job.

    Domains whose labels give no node have ``ok`` false in the summary.
    """
    rows = labels.withColumn("id", fx.slugify("label"))
    nodes = rows.groupBy("domain", "id", "doc_id", "chunk_index").agg(F.min("label").alias("label")).groupBy("domain", "id").agg(F.count("*").alias("n_chunks"), F.min("label").alias("label"))
    nodes = nodes.where(F.col("n_chunks") >= least_chunks)
    kept = rows.join(nodes.select("domain", "id"), ["domain", "id"], "left_semi")
    w = Window.partitionBy("doc_id", "chunk_index").orderBy("pos")
    edges = kept.withColumn("dst", F.lead("id").over(w)).where("dst IS NOT NULL AND dst != id").groupBy("domain", F.col("id").alias("src"), "dst").agg(F.count("*").alias("n"))
    n = nodes.groupBy("domain").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("domain").agg(F.count("*").alias("n_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    summary = labels.select("domain").distinct().join(n, "domain", "left").join(e, "domain", "left").select("domain", zero("n_nodes"), zero("n_edges"), F.col("n_nodes").isNotNull().alias("ok"))
    return nodes, edges, summary


def gap_hints(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, side, hint, weight, priority) for chains (start, step, id): the strongest edge from an unvisited
    node into the first step, and out of the last one; without any a ``(none)`` of medium priority."""
    ends = chains.groupBy("start").agg(F.min_by("id", "step").alias("head"), F.max_by("id", "step").alias("tail"))
    into = ends.join(edges, F.col("dst") == F.col("head")).select("start", F.lit("before").alias("side"), F.col("src").alias("hint"), "weight")
    out = ends.join(edges, F.col("src") == F.col("tail")).select("start", F.lit("after").alias("side"), F.col("dst").alias("hint"), "weight")
    free = into.unionByName(out).join(chains.select("start", F.col("id").alias("hint")), ["start", "hint"], "left_anti")
    best = free.groupBy("start", "side").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hint")).alias("b"))
    sides = ends.select("start", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side"))
    return sides.join(best, ["start", "side"], "left").select("start", "side", F.coalesce("b.hint", F.lit("(none)")).alias("hint"), (-F.col("b.w")).alias("weight"), F.when(F.col("b").isNull(), "medium").otherwise("high").alias("priority"))


def name_candidates(chunks: DataFrame, name: str, speech: str, action: str, stop: tuple[str, ...] = (), n: int = 30, not_first: str = "", not_last: str = "", inside: str = "") -> DataFrame:
    """Names by count: 2 for each before a speech verb, 1 before an action verb, 1 for each occurrence; at least 2, the ``n`` best.

    The patterns are the profile's: a name, and the verbs that follow a name and a space (or nothing, in Han text).
    Fragments of sentences are no names: what begins with a character of ``not_first``, ends with one of ``not_last`` or holds one
    of ``inside``, and Han labels that the concept gate (B8) refuses.
    """
    found = lambda p, g, s: chunks.select(F.explode(F.regexp_extract_all("chunk", F.lit(p), F.lit(g))).alias("name"), F.lit(s).alias("s"))
    rows = found(f"({name}) *(?:{speech})", 1, 2).unionByName(found(f"({name}) *(?:{action})", 1, 1)).unionByName(found(f"({name})", 1, 1))
    fragments = [f"^[{not_first}]"] * bool(not_first) + [f"[{not_last}]$"] * bool(not_last) + [f"[{inside}]"] * bool(inside)
    if fragments:
        rows = rows.where(~F.col("name").rlike("|".join(fragments)))
    if stop:
        rows = rows.where(~F.lower("name").isin(*stop))
    c = rows.groupBy("name").agg(F.sum("s").alias("score")).where("score >= 2")
    c = c.where(~F.col("name").rlike(f"[{HAN}]") | fx.valid_concept("name"))
    return c.orderBy(F.desc("score"), F.desc(F.length("name")), "name").limit(n)


def chunk_keywords(weights: DataFrame, chunks: DataFrame, k: int = 30, concept: str = "[A-Z][a-z]+(?:tion|ment|ness|ity)", academic: str = "") -> DataFrame:
    """(doc_id, chunk_index, keyword): a chunk's ``k`` heaviest tf-idf terms, its concept-pattern and acronym hits, and those of ``academic``."""
    w = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("weight"), "term")
    top = weights.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).select("doc_id", "chunk_index", F.col("term").alias("keyword"))
    words = F.regexp_extract_all("chunk", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    hits = [F.filter(words, lambda x: x.rlike("^[A-Z]{2,8}$"))] + [F.regexp_extract_all("chunk", F.lit(p), F.lit(0)) for p in (concept, academic) if p]
    found = chunks.select("doc_id", "chunk_index", F.explode(F.array_distinct(F.concat(*hits))).alias("keyword"))
    return top.unionByName(found).distinct()


def filter_web_results(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """At most ``k`` results (query_id, ord, title, url, body) a query, one per url, without blank, short or spam ones.

    A query that names a 《title》 takes only results with it. Titles are cut to 200, urls and bodies to 500 characters.
    """
    title, url, body = (F.trim(fx.blank(c)) for c in ("title", "url", "body"))
    rows = results.select("query_id", "ord", title.alias("title"), url.alias("url"), body.alias("body")).where("title != '' AND url != '' AND length(body) >= 20")
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/:]+)", 1)
    everything = F.lower(F.concat_ws(" ", "title", "url", "body"))
    rows = rows.where(~host.rlike("(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in SPAM_HOSTS) + ")$") & ~everything.rlike("|".join(SPAM_WORDS)))
    named = queries.select("query_id", F.regexp_extract(fx.blank("text"), "《([^》]+)》", 1).alias("__named"))
    rows = rows.join(named, "query_id").where((F.col("__named") == "") | F.contains(F.concat("title", "body"), F.col("__named")))
    once = Window.partitionBy("query_id", "url").orderBy("ord")
    rows = rows.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "url"))).where(F.col("place") <= k)
    return rows.select("query_id", "place", F.substring("title", 1, 200).alias("title"), F.substring("url", 1, 500).alias("url"), F.substring("body", 1, 500).alias("body"))
