"""Concept graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.profiles import HAN
from ..sources.tables import shared_dir, stored


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def chunk_labels(chunks: DataFrame, pattern: str = "[A-Z][a-z]{5,}") -> DataFrame:
    """(doc_id, chunk_index, pos, label): label candidates of each chunk in order."""
    found = F.regexp_extract_all("chunk", F.lit(pattern), F.lit(0))
    return chunks.select("doc_id", "chunk_index", F.posexplode(found).alias("pos", "label"))


def concept_nodes(labels: DataFrame, chunks: DataFrame | None = None, fiction: bool = False) -> DataFrame:
    """Nodes (id, label, n_chunks, weight, first_doc, first_chunk); the first spelling is shown.

    Outside fiction a node occurs in 2 chunks at least, unless ``chunks`` are fewer than 4. Counts combine
    before the shuffle in two steps, so a label on a third of all chunks stays cheap.
    """
    few = chunks is not None and chunks.limit(4).count() < 4
    least = 1 if fiction or few else 2
    per_chunk = labels.withColumn("id", fx.slugify("label")).groupBy("id", "doc_id", "chunk_index").agg(F.min(F.struct("pos", "label")).alias("first"))
    nodes = per_chunk.groupBy("id").agg(F.count("*").alias("n_chunks"), F.min(F.struct("doc_id", "chunk_index", "first")).alias("f"))
    weight = F.round(F.least(F.lit(0.95), 0.55 + 0.1 * F.col("n_chunks")), 3)
    first = (F.col("f.doc_id").alias("first_doc"), F.col("f.chunk_index").alias("first_chunk"))
    return nodes.where(F.col("n_chunks") >= least).select("id", F.col("f.first.label").alias("label"), "n_chunks", weight.alias("weight"), *first)


def concept_chunks(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, doc_id, chunk_index): the chunks of every node, as rows, for a node may have very many."""
    return labels.select(fx.slugify("label").alias("id"), "doc_id", "chunk_index").distinct().join(nodes.select("id"), "id", "left_semi")


def rank_concepts(nodes: DataFrame, n: int) -> DataFrame:
    """the ``n`` best nodes by weight (Han labels gain 0.08 for each of up to 5 characters beyond 2), chunks, label length and id."""
    bonus = F.when(F.col("label").rlike(f"^[{HAN}]+$"), 0.08 * F.least(F.greatest(F.length("label") - 2, F.lit(0)), F.lit(5))).otherwise(0.0)
    return nodes.orderBy(F.desc(F.col("weight") + bonus), F.desc("n_chunks"), F.desc(F.length("label")), "id").limit(n)


def adjacent(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, doc_id, chunk_index) of consecutive selected concepts of a chunk."""
    kept = labels.withColumn("id", fx.slugify("label")).join(nodes.select("id"), "id", "left_semi")
    w = Window.partitionBy("doc_id", "chunk_index").orderBy("pos")
    pairs = kept.withColumn("dst", F.lead("id").over(w)).where("dst IS NOT NULL AND dst != id")
    return pairs.select(F.col("id").alias("src"), "dst", "doc_id", "chunk_index")


def adjacency_edges(labels: DataFrame, nodes: DataFrame, chain: bool = False) -> DataFrame:
    """Edges (src, dst, n, weight, relation) between consecutive selected concepts of a chunk.

    With ``chain``, nodes (a bounded selection, ranked) without any such edge are joined in the order of
    their rank by edges of weight 0.4.
    """
    edges = adjacent(labels, nodes).groupBy("src", "dst").agg(F.count("*").alias("n"))
    edges = edges.withColumn("weight", F.round(F.least(F.lit(0.9), 0.6 + 0.08 * (F.col("n") - 1)), 3))
    if chain and edges.isEmpty():
        w = Window.orderBy(F.desc("weight"), F.desc("n_chunks"), F.desc(F.length("label")), "id")
        edges = nodes.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lit(0).cast("long").alias("n"), F.lit(0.4).alias("weight")).where("dst IS NOT NULL")
    return edges.withColumn("relation", fx.infer_relation("src", "dst"))


def edge_chunks(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, doc_id, chunk_index): the chunks of every edge, as rows."""
    return adjacent(labels, nodes).distinct()


#: Relations by what stands between two labels, in order, where the caller names no others.
BETWEEN = (("part_of", "^ of (the )?$"), ("and", "^,? (and|or) $"), ("in", "^ (in|on|at) (the )?$"), ("is", "^ (is|was|are) (an? |the )?$"))


def sentence_cooccurrence(sentences: DataFrame, nodes: DataFrame, pattern: str = "[A-Z][a-z]{5,}", between: tuple = BETWEEN, fiction: bool = False, cap: int | None = None) -> DataFrame:
    """Unordered concept pairs (a, b, relation, n, weight) of sentences with 4 to 200 characters.

    The relation is the first of ``between`` that what stands between the labels matches, in fiction the 1
    to 4 characters between them without spaces and commas, else ``co_occurrence``. ``cap`` keeps the most
    frequent min(3 nodes, cap) edges. Pairs are formed inside one sentence's label array, which the length bounds.
    """
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))))
    s = sentences.where(F.length("sentence").between(4, 200)).select("sentence", ids.alias("ids")).where(F.size("ids") >= 2)
    pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("la"), b.alias("lb")))))
    p = s.select("sentence", F.explode(pairs).alias("p")).select("sentence", "p.*")
    p = p.withColumn("pa", F.instr("sentence", F.col("la"))).withColumn("pb", F.instr("sentence", F.col("lb")))
    left = F.when(F.col("pa") < F.col("pb"), F.col("la")).otherwise(F.col("lb"))
    at = F.least("pa", "pb") + F.length(left)
    p = p.withColumn("gap", F.when(F.greatest("pa", "pb") > at, F.substring(F.col("sentence"), at, F.greatest("pa", "pb") - at)).otherwise(""))
    relation = F.lit("co_occurrence")
    if fiction:
        tight = F.regexp_replace("gap", "[ \t,，、。！？；：\"']", "")
        relation = F.when(F.length(tight).between(1, 4), tight).otherwise(relation)
    for name, shape in reversed(between):
        relation = F.when(F.col("gap").rlike(shape), F.lit(name)).otherwise(relation)
    p = p.groupBy(F.lower("la").alias("a"), F.lower("lb").alias("b"), relation.alias("relation")).agg(F.count("*").alias("n"))
    ends = nodes.select("id")
    p = p.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").join(ends.withColumnRenamed("id", "b"), "b", "left_semi")
    p = p.withColumn("weight", F.round(F.least(F.lit(0.95), 0.7 + 0.1 * (F.col("n") - 1)), 3))
    return p if cap is None else p.orderBy(F.desc("n"), "a", "b", "relation").limit(min(cap, 3 * nodes.count()))


def keep_edges(edges: DataFrame, nodes: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Edges with both ends among ``nodes``; with ``max_nodes`` the 2 max_nodes strongest of them."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept if max_nodes is None else kept.orderBy(F.desc("weight"), "src", "dst").limit(2 * max_nodes)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree), 0 kept."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def related_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """C11: (id, related, place): neighbours in both directions, numbered by label."""
    near = both_ways(edges).distinct().join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    w = Window.partitionBy("src").orderBy("label", "dst")
    return near.select(F.col("src").alias("id"), F.col("label").alias("related"), F.row_number().over(w).alias("place"))


def concept_sources(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, document): the distinct documents of every concept and of its edges (src, dst, doc_id), as rows."""
    own = labels.select(fx.slugify("label").alias("id"), "doc_id")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "doc_id")
    both = own.distinct().unionByName(ends.distinct()).distinct()
    return both.join(nodes.select("id"), "id", "left_semi").withColumnRenamed("doc_id", "document")


def edge_majority(edges: DataFrame, count: str | None = None) -> DataFrame:
    """Per (src, dst) the most frequent relation (the first in order on ties) and min(1, 0.4 + 0.15 n).

    Rows count one each, or as ``count`` says.
    """
    n = edges.groupBy("src", "dst", "relation").agg((F.sum(count) if count else F.count("*")).alias("n"))
    best = n.groupBy("src", "dst").agg(F.min(F.struct((-F.col("n")).alias("m"), "relation")).alias("b"))
    return best.select("src", "dst", F.col("b.relation").alias("relation"), F.round(F.least(F.lit(1.0), 0.4 + 0.15 * -F.col("b.m")), 3).alias("weight"))


def entity_resolve(raw: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Canonical groups of raw labels (label, n): spelling, count, degree and score relative to the best, the ``n`` best.

    ``edges`` (src, dst, n, relation) have labels or ids as ends; those without a relation do not count. The
    score is (count + 0.5 degree), times 0.7 for organizations and 1.15 for abstract labels.
    """
    g = raw.groupBy(fx.canonical_label("label").alias("canon")).agg(F.sum("n").alias("n"), F.min("label").alias("label"))
    ends = edges.where("relation IS NOT NULL AND src != dst").select(F.explode(F.array("src", "dst")).alias("end"), "n")
    degree = ends.groupBy(fx.canonical_label("end").alias("canon")).agg(F.sum("n").alias("degree"))
    g = g.where("canon != ''").join(degree, "canon", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("category", fx.infer_category("label"))
    factor = F.when(F.col("category") == "organization", 0.7).when(fx.abstract_label("label"), 1.15).otherwise(1.0)
    g = g.withColumn("raw", (F.col("n") + 0.5 * F.col("degree")) * factor)
    best = g.agg(F.max("raw").alias("best"))
    top = g.orderBy(F.desc("raw"), F.desc("n"), "canon").limit(n)
    return top.crossJoin(F.broadcast(best)).select("canon", "label", "category", "n", "degree", F.bround(F.col("raw") / F.col("best"), 3).alias("score"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges among ``nodes``, by contraction.

    In every round each end goes to that of itself and its neighbours which comes first in an order by hash, new in each
    round, and edges are those between the ends' targets, until none is left. A round leaves at most about three
    quarters of the ends, whatever the graph, so rounds are logarithmic on chains too, and all rounds together read a
    few times the edges.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    first = edges.where("src != dst").select(a.alias("src"), b.alias("dst")).distinct()
    left = stored(keep_edges(first, nodes), "links")
    labels, turn = nodes.select("id", F.col("id").alias("at")).distinct(), 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        best = both_ways(left).groupBy("src").agg(F.min(rank("dst")).alias("near"))
        to = stored(best.select(F.col("src").alias("at"), F.least(rank("src"), "near")["id"].alias("to")), "targets")
        moved = lambda df, c: df.join(to.select(F.col("at").alias(c), F.col("to").alias(f"{c}_to")), c)  # noqa: B023, E731
        ends = moved(moved(left, "src"), "dst").where("src_to != dst_to")
        left = stored(ends.select(F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).distinct(), "links")
        labels = stored(labels.join(to, "at", "left").select("id", F.coalesce("to", "at").alias("at")), "labels")
        turn += 1
    smallest = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(smallest, "at", "left").select("id", F.coalesce("component", "id").alias("component"))


def bfs_rings(nodes: DataFrame, edges: DataFrame, centre: DataFrame, far: int = 3) -> DataFrame:
    """Hops of every node from the one node of ``centre`` (id), undirected; ``far`` when further or unreached."""
    both = both_ways(edges).distinct()
    seen = centre.select("id", F.lit(0).alias("ring"))
    front = seen
    for ring in range(1, far):
        front = both.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(front.join(seen.select("id"), "id", "left_anti").withColumn("ring", F.lit(ring)))
        seen = seen.unionByName(front)
    return nodes.select("id").join(seen, "id", "left").select("id", F.coalesce("ring", F.lit(far)).alias("ring"))


def concept_chains(edges: DataFrame, starts: DataFrame, steps: int = 4) -> DataFrame:
    """From every start (id) follow the strongest unvisited out-edge; (start, step, id)."""
    path = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    out = edges.select("src", "dst", "weight")
    for _ in range(steps):
        tip = F.element_at("path", -1)
        nxt = path.join(out, tip == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        best = nxt.groupBy("start").agg(F.min(F.struct((-F.col("weight")).alias("w"), "dst")).alias("b"))
        path = path.join(best, "start", "left").select("start", F.when(F.col("b").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("b.dst"))).alias("path"))
        path = cut(path)
    return path.select("start", F.posexplode("path").alias("step", "id"))


def layout_overlap(nodes: DataFrame, radius: float = 50.0) -> DataFrame:
    """Pairs of placed nodes (id, x, y) nearer than ``radius``, by grid cells and the half of their neighbours that is ahead."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    placed = nodes.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    ahead = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = placed.withColumn("o", F.explode(ahead)).select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    both = placed.join(near, ["cx", "cy"]).where("id < b OR (NOT own AND id > b)")
    both = both.where(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) < radius * radius)
    return both.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def category_shares(nodes: DataFrame, category: Column) -> DataFrame:
    """D11, first part: node counts by category."""
    return nodes.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
