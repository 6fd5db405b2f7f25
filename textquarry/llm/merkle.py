"""A Merkle manifest of a table: one tree a group, one tree over the groups' roots, a proof for every row.

1. Every row becomes a leaf digest in the scan, so texts are never shuffled.
2. Leaves are numbered inside their group by a range sort of (group, id): a piece of the sort knows
   its rows' places, and the counts of the pieces before it give the offset. No group meets in one task.
3. BLOCK consecutive leaves form an aligned block, one row. Each level of a block is one string of
   hex digests, 64 characters each; parents are hashes of its fixed-width substrings of FAN digests.
   The block's last digest is a node of the next tier, which is built the same way until every
   group has one node. The groups' roots are then the leaves of one more tree.
4. On the way down a row's siblings are the substrings that flank its own digest in each level;
   the segments of its block, of the block's own block and so on are appended, up to the root.

A row of 2 ** 40 needs five tiers; a block row holds at most 2 * BLOCK digests. Nothing but the size of the
largest group and the number of pieces reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Nodes that are hashed together.
FAN = 2
#: Levels that a block spans, and its leaves.
DEPTH = 8
BLOCK = FAN**DEPTH
#: Characters of a digest in hex.
WIDE = 64
#: Pieces of groups up to which their offsets are broadcast (about 60 bytes each).
BROADCAST_PIECES = 200_000


def leaf_digest(*fields: Column | str) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")) for c in fields)).cast("binary"), 256)


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, saved, with ``pos`` (0-based place inside ``group`` by ``order``, nulls first) and ``total``.

    ``order`` must tell rows apart, or equal rows are placed in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = saved(df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("piece", F.shiftright("at", 33))
    pieces = saved(rows.groupBy(group, "piece").agg(F.min("at").alias("first"), F.count("*").alias("n")), "pieces")
    # A group has at most one row a piece here, so these windows hold few rows.
    upto = f"sum(n) OVER (PARTITION BY {group} ORDER BY piece)"
    pieces = pieces.select(group, "piece", F.expr(f"{upto} - n - first").alias("offset"), F.expr(f"sum(n) OVER (PARTITION BY {group})").alias("total"))
    pieces = F.broadcast(pieces) if pieces.count() <= BROADCAST_PIECES else pieces
    return rows.join(pieces, [group, "piece"]).withColumn("pos", F.col("at") + F.col("offset")).drop("piece", "at", "offset")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(tree, blk, total, members, levels) of ``nodes`` (tree, pos, total, node, carry columns)."""
    member = F.struct("pos", "node", *carry)
    rows = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("blk")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members"))
    # Levels of the block: those of its tree, at most DEPTH.
    high = " + ".join(f"int(total > {FAN**j})" for j in range(DEPTH))
    run = FAN * WIDE
    parents = f"""concat_ws('', transform(sequence(0, (length(element_at(done, -1)) - 1) div {run}),
        i -> sha2(substring(element_at(done, -1), i * {run} + 1, {run}), 256)))"""
    rows = rows.withColumn("first", F.expr("concat_ws('', transform(members, m -> m.node))").cast("binary"))
    rows = rows.withColumn("levels", F.expr(f"aggregate(slice(sequence(1, {DEPTH}), 1, {high}), array(first), (done, j) -> concat(done, array(cast({parents} AS binary))))"))
    return rows.drop("first")


def climb(nodes: DataFrame, carry: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over ``nodes``, saved, and (tree, root) of every tree; ``most``: nodes of the largest tree."""
    tiers = []
    while True:
        tiers.append(saved(_blocks(nodes, carry), "tier"))
        top = F.element_at("levels", F.lit(-1)).cast("string").alias("node")
        nodes = tiers[-1].select("tree", F.col("blk").alias("pos"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), top)
        carry = []
        most = -(-most // BLOCK)
        if most <= 1:
            return tiers, nodes.select("tree", F.col("node").alias("root"))


def descend(tiers: list[DataFrame], above: DataFrame, kept: list[str], carry: list[str]) -> DataFrame:
    """(carry columns, kept columns, path) of every leaf of ``tiers``.

    ``above`` has for each tree a path that every leaf's own is followed by, and the ``kept`` columns.
    A path is an array of (left, right), one element a level from the leaf up: the digests that
    flank the leaf's ancestor among those hashed together with it.
    """
    powers = f"array({', '.join(str(FAN**j) for j in range(DEPTH))})"
    x = f"(i div element_at({powers}, j))"
    cut = lambda start, n: f"string(substring(element_at(levels, j), int(({start}) * {WIDE} + 1), int(({n}) * {WIDE})))"
    step = f"named_struct('left', {cut(f'{x} - {x} % {FAN}', f'{x} % {FAN}')}, 'right', {cut(f'{x} + 1', f'{FAN - 1} - {x} % {FAN}')})"
    own = f"transform(slice(sequence(1, {DEPTH}), 1, size(levels) - 1), j -> {step})"
    at = above.withColumn("pos", F.lit(0).cast("long"))
    for k, tier in reversed(list(enumerate(tiers))):
        names = carry if k == 0 else []
        fields = ", ".join(f"'{c}', m.{c}" for c in ("pos", *names))
        rows = tier.join(at.withColumnRenamed("pos", "blk"), ["tree", "blk"])
        rows = rows.select("tree", *kept, F.explode(F.expr(f"transform(members, (m, i) -> named_struct({fields}, 'path', concat({own}, path)))")).alias("m"))
        at = rows.select("tree", *kept, *(F.col(f"m.{c}").alias(c) for c in ("pos", *names, "path")))
    return at.drop("pos")


def proof(path: str = "path") -> Column:
    """The siblings of a path as one string, level by level to the root, left to right."""
    return F.expr(f"concat_ws('', transform({path}, p -> concat(p.left, p.right)))")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.expr(f"aggregate({path}, {leaf}, (node, p) -> sha2(concat(p.left, node, p.right), 256))")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, path, ``extra`` columns): one row per row of ``docs``.

    Groups are ordered bytewise, null first; a group's leaves by id, null first, those of equal ids by
    digest (equal rows have equal digests, so any order of them gives the same tree). A group of one row has
    that leaf as its subroot. Null and empty values differ in the digest; other columns are not
    read; an empty table gives an empty manifest. ``extra`` columns are computed beside the leaf.
    """
    extra = extra or {}
    group = F.col(f"`{group_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))
    leaves = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_digest(*fields).alias("node"), *(c.alias(f"x_{n}") for n, c in extra.items()))
    leaves = saved(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = ranked(leaves, "tree", ["id", "node", "row"]).drop("row")
    carry = ["id", *(f"x_{n}" for n in extra)]
    most = nodes.agg(F.max("total")).first()[0] or 0
    tiers, tops = climb(nodes, carry, most)
    groups = ranked(tops.select(F.lit("").alias("all"), F.col("tree").alias("group"), F.col("root").alias("node")), "all", ["group"]).withColumnRenamed("all", "tree")
    upper, root = climb(groups, ["group"], groups.count())
    above = root.withColumn("path", F.expr("array_remove(array(named_struct('left', '', 'right', '')), named_struct('left', '', 'right', ''))"))
    above = descend(upper, above.withColumn("subroot", F.lit("")), ["root"], ["group"])
    above = above.drop("tree").withColumnRenamed("group", "tree").join(tops.withColumnRenamed("root", "subroot"), "tree")
    rows = descend(tiers, above, ["root", "subroot"], ["node", *carry])
    value = F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
    return rows.select(F.col("id").alias(id_col), value.alias(group_col), F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(f"x_{n}").alias(n) for n in extra))
