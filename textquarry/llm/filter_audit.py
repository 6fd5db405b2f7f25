"""Audit of text filters that act on the same documents: what each removes, alone and in any order.

1. One pass over the texts gives each row the bits of the filters that look at one text, and its hash.
2. Filter E, a duplicate, is an existential self-join: a left-semi join on hash, exact text and a smaller
   doc_id. Only hashes that two ids share take part. The side that is searched holds each text once, with its
   smallest id; rows of a text with many copies are dealt over parts.
3. E's ids and the rows of the other failures are united and their bits combined per row.
4. Rows are counted by part, combination of bits and label; the orders are computed from those
   counts, of which a part has at most 32.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deal, saved

#: Filters in the order of their bits. The last is the duplicate filter.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Hashes that several ids share, up to which they are broadcast (32 bytes each).
BROADCAST_HASHES = 500_000


def text_failures() -> Column:
    """Bits of the filters A to D, over ``text`` and its words ``w``."""
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """(id, part, hash, bits, rows): rows of ``docs`` by id, part and text, with the bits of the filters that they fail.

    Null texts are empty and null parts the empty string. A row without an id is nobody's smaller copy, nor
    has one; rows that repeat an id and text are counted in ``rows`` and are no duplicates of each other.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # Split keeps an empty string before a leading and after a closing run of white space.
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    alone = saved(rows.withColumn("w", words).select("id", "part", "hash", text_failures().alias("bits")), "failures")
    shared = saved(alone.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("members")).where("low < high").select("hash", "members"), "shared")
    among = F.broadcast(shared.select("hash")) if shared.count() <= BROADCAST_HASHES else shared.select("hash")
    copies = rows.where(F.col("id").isNotNull()).join(among, "hash", "left_semi")
    twins = copies.groupBy("hash", F.col("text").alias("same")).agg(F.min("id").alias("smaller"))
    left, right = deal(copies, twins, shared, "hash", F.xxhash64("id"))
    right = right.withColumnRenamed("hash", "h").withColumnRenamed("deal", "d")
    seen = (F.col("hash") == F.col("h")) & (F.col("deal") == F.col("d")) & (F.col("text") == F.col("same")) & (F.col("smaller") < F.col("id"))
    twice = left.join(right, seen, "left_semi").select("id", "part", "hash", F.lit(DUPLICATE).alias("bits"), F.lit(0).alias("one"))
    both = alone.withColumn("one", F.lit(1)).unionByName(twice)
    return both.groupBy("id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("one").alias("rows"))


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, bits, n, good, toxic): documents by combination of failures, those with ``quality`` 1 and ``toxic`` 1 apart.

    Where labels of an id repeat, one that says so is enough.
    """
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    truth = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    truth = truth.where(F.col("id").isNotNull()).withColumn("loose", F.lit(0).cast("long"))
    # Rows without an id have no label; spread, they are no hot key.
    loose = F.when(F.col("id").isNull(), F.xxhash64("hash", "part")).otherwise(F.lit(0))
    rows = failed.withColumn("loose", loose).join(truth, ["id", "loose"], "left")
    weigh = lambda c: F.sum(F.col("rows") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "bits").agg(F.sum("rows").alias("n"), weigh("good"), weigh("toxic"))


def orders(combos: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and finds removed already."""
    per = combos.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("all"))
    every = F.lit(["".join(p) for p in permutations(FILTERS)])
    rows = per.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1)"
    rows = rows.withColumn("own", F.expr(bit("step")))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (done, i) -> IF(i < step, done | {bit('i')}, done))"))
    total = lambda value, where: F.expr(f"aggregate(filter(all, c -> {where}), 0L, (done, c) -> done + {value})")
    here = "c.bits & own != 0 AND c.bits & before = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("c.n", "c.bits & (own | before) = 0").alias("kept"),
        total("c.n", here).alias("removed"),
        total("c.n", "c.bits & own != 0 AND c.bits & before != 0").alias("redundant"),
        total("c.n", "c.bits = own").alias("unique_fails"),
        total("c.good", here).alias("good_lost"),
        total("c.toxic", here).alias("toxic_lost"),
        # Of the filters that a document fails each comes first in an equal part of all orders.
        total(f"c.n * ({math.factorial(len(FILTERS))} div bit_count(c.bits))", "c.bits & own != 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """The audit of all orders; an empty table has no parts and gives no rows."""
    return orders(combinations(failures(docs, text_col, id_col, part_col), labels, id_col))
