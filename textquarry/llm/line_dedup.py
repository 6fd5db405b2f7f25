"""Cross-site boilerplate lines, found by their spread over distinct sites.

Every line's 128-bit hash gets a HyperLogLog sketch of the sites it stands on; the sketches are
built per task and merged by the aggregation, so a line that holds a third of all rows travels
once per task. Sketches decide all lines but those near the threshold, whose distinct sites are
counted exactly. A boilerplate line stays in one document, the one with the smallest id (so
that whole-document copies do not all lose their text), and goes everywhere else.

The lines found, and before them those near the threshold, are saved and counted. Up to
BROADCAST_KEYS of them are broadcast, so that no line row is shuffled for them; more are joined by
a shuffle in which every key is dealt over SALTS tasks, whatever its frequency. Only hashes are
shuffled; texts move once, in the final join by document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_SITES = 10
LG_K = 12
#: Line keys (16 bytes each, and an id) up to which they are broadcast.
BROADCAST_KEYS = 500_000
#: Parts of a key's rows in a join by shuffle.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """128-bit hash of a line without the spaces around it."""
    return F.unhex(F.md5(F.trim(line)))


def line_rows(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, site, key): one row per document and distinct line with something in it."""
    filled = F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(filled, line_key))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.explode(keys).alias("key"))


def with_keys(rows: DataFrame, keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` joined by ``key`` to the saved table ``keys``, which has each key once."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), "key")
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["key", "__salt"]).drop("__salt")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(key, first_id, sites): lines on at least ``min_sites`` distinct sites; saved."""
    rows = line_rows(docs, site_col, text_col, id_col)
    spread = rows.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("id").alias("first_id"), F.count("*").alias("n"))
    margin = 1 + int(3 * 1.04 / (1 << LG_K) ** 0.5 * min_sites)
    # A line in fewer documents than min_sites cannot be on so many sites.
    spread = spread.where(F.col("n") >= min_sites).select("key", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = saved(spread.where(F.col("sites") >= min_sites - margin), "spread")
    sure = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where(F.col("sites") <= min_sites + margin).select("key", "first_id")
    if near.isEmpty():
        return sure
    exact = with_keys(rows, near, broadcast_keys).groupBy("key").agg(F.min("first_id").alias("first_id"), F.count_distinct("site").alias("sites"))
    return saved(sure.unionByName(exact.where(F.col("sites") >= min_sites)), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (lines with something in them) and ``n_removed``.

    Null texts count as empty and keep an empty text; blank lines are never removed or counted;
    null sites are one site; documents without an id count as one document. Rows that repeat an
    id all keep a line whose first document they are. Extra columns pass through, but for those
    named like a new one, which gives way.
    """
    docs = docs.drop("kept_text", "n_lines", "n_removed")
    bad = boilerplate(docs, min_sites, site_col, text_col, id_col, broadcast_keys)
    rows = line_rows(docs, site_col, text_col, id_col).select("id", "key")
    hits = with_keys(rows, bad.select("key", "first_id"), broadcast_keys).where(~F.col("id").eqNullSafe(F.col("first_id")))
    hits = hits.groupBy("id").agg(F.collect_set("key").alias("__bad")).withColumnRenamed("id", "__hit_id")
    out = docs.join(hits, F.col(id_col).eqNullSafe(F.col("__hit_id")), "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col("__bad").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", line_key(x))), "\n")
    )
    filled = lambda t: F.size(F.filter(_lines(t), lambda x: F.trim(x) != "")).cast("long")
    out = out.withColumn("kept_text", kept).withColumn("n_lines", filled(F.col(text_col)))
    return out.withColumn("n_removed", F.col("n_lines") - filled(F.col("kept_text"))).drop("__bad", "__hit_id")


def line_digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
