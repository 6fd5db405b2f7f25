"""Numbers and running sums inside groups of any size, by prefix sums over the pieces of a range sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Pieces of groups up to which their sums are broadcast (about 60 bytes each).
BROADCAST_PIECES = 200_000


def running(df: DataFrame, group: str, order: str, value: Column | None = None) -> DataFrame:
    """``df`` with ``number`` (from 1) and ``before`` (the sum of ``value`` of earlier rows) inside ``group``, by ``order``.

    Rows are sorted by range of (group, order), so a group spreads over tasks; each piece of a group is summed where it
    lies, and the sums of the pieces before it are added. Equal values of ``order`` inside a group stand in any order,
    and together in one piece.
    """
    rows = df.withColumn("__v", F.lit(0).cast("long") if value is None else value.cast("long"))
    rows = stored(rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, order).withColumn("__piece", F.spark_partition_id()), "pieces")
    pieces = rows.groupBy(group, "__piece").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    # A group has at most one row a piece here.
    earlier = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    pieces = stored(pieces.select(F.col(group).alias("__g"), F.col("__piece").alias("__p"), zero("__n").alias("__n0"), zero("__s").alias("__s0")), "offsets")
    offsets = F.broadcast(pieces) if pieces.count() <= BROADCAST_PIECES else pieces
    inside = Window.partitionBy(group, "__piece").orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(inside)).withColumn("__b", F.coalesce(F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__piece") == F.col("__p")))
    return rows.withColumn("number", F.col("__i") + F.col("__n0")).withColumn("before", F.col("__b") + F.col("__s0")).drop("__v", "__piece", "__i", "__b", "__g", "__p", "__n0", "__s0")
