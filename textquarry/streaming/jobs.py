"""Structured Streaming jobs: incremental index, reading counter, expiring results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import index, records

#: Parts of a bucketed store; a batch rewrites only those that its keys fall into.
BUCKETS = 256


def _bucket(*key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of a bucketed store in the latest version of each bucket (of those ``before`` a batch); None when there is none."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    latest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # one row a bucket, of partition values
    return rows.join(F.broadcast(latest), ["bucket", "batch"], "left_semi").where("NOT marker").drop("bucket", "batch", "marker")


def _write_buckets(rows: DataFrame, touched: DataFrame, path: str, number: int) -> None:
    """Write ``rows`` (with bucket) as version ``number`` of the ``touched`` buckets and drop versions that no replay reads.

    Only these partitions are overwritten, so a batch that is replayed writes the same again. A
    marker row stands in every bucket, which keeps a version that has become empty.
    """
    spark = rows.sparkSession
    marked = touched.select("bucket", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"), F.lit(True).alias("marker"))
    out = rows.withColumn("marker", F.lit(False)).unionByName(marked).withColumn("batch", F.lit(number))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    versions = spark.read.parquet(path).select("bucket", "batch").distinct().join(F.broadcast(touched.select("bucket").distinct()), "bucket", "left_semi")
    old = versions.groupBy("bucket").agg(F.sort_array(F.collect_set("batch")).alias("b")).select("bucket", F.explode(F.filter("b", lambda x: x < F.try_element_at(F.filter("b", lambda y: y < number), F.lit(-1)))).alias("batch"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in old.collect():  # at most one or two a touched bucket
        gone = fs.Path(f"{path}/bucket={r['bucket']}/batch={r['batch']}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def index_batch(batch: DataFrame, number: int, path: str, size: int = 2000, overlap: int = 200, buckets: int = BUCKETS) -> None:
    """Chunks of the batch's documents replace those of the same documents; documents whose text is stored already are skipped.

    Of documents that repeat in a batch one counts, that with the largest text.
    """
    docs = batch.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    stored = read_store(batch.sparkSession, path, number)
    if stored is not None:
        docs = docs.join(stored.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_anti")
    docs = docs.withColumn("bucket", _bucket("doc_id", buckets=buckets)).persist()
    touched = docs.select("bucket").distinct()
    fresh = index.fixed_windows(docs, size, overlap).join(docs.select("doc_id", "digest", "bucket"), "doc_id")
    if stored is not None:
        kept = stored.withColumn("bucket", _bucket("doc_id", buckets=buckets)).join(F.broadcast(touched), "bucket", "left_semi")
        fresh = kept.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
    _write_buckets(fresh, touched, path, number)
    docs.unpersist()


def incremental_index(stream: DataFrame, path: str, checkpoint: str, size: int = 2000, overlap: int = 200, buckets: int = BUCKETS) -> StreamingQuery:
    """Chunks of arriving documents (doc_id, text) in a bucketed store under ``path`` (``read_store``), by ``index_batch``."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: index_batch(batch, number, path, size, overlap, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reading_batch(batch: DataFrame, number: int, path: str, ignored: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """The batch's reading records added to the stored ones of the same user and document."""
    fresh = records.reading_records(batch, ignored).withColumn("bucket", _bucket("user_id", buckets=buckets)).persist()
    touched = fresh.select("bucket").distinct()
    stored = read_store(batch.sparkSession, path, number)
    rows = fresh
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("bucket", _bucket("user_id", buckets=buckets)).join(F.broadcast(touched), "bucket", "left_semi"))
    merged = rows.groupBy("bucket", "user_id", "document").agg(F.min("first_read").alias("first_read"), F.max("last_read").alias("last_read"), F.sum("read_count").alias("read_count"))
    _write_buckets(merged, touched, path, number)
    fresh.unpersist()


def reading_counter(events: DataFrame, path: str, checkpoint: str, ignored: tuple[str, ...] = (), buckets: int = BUCKETS) -> StreamingQuery:
    """First and last time and number of events (user_id, document, ts) per user and document, in a bucketed store.

    Records count for life, so they are rows of a table; the stream itself holds no state that would have to expire.
    """
    writer = events.writeStream.foreachBatch(lambda batch, number: reading_batch(batch, number, path, ignored, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_batch(batch: DataFrame, number: int, path: str, seconds: dict[str, int], cap: int) -> None:
    """The live results after a batch (key, kind, ts, ...): the first of each key, none older than its kind's seconds, the ``cap`` latest.

    Ages are of event time, against the latest result seen. The store is bounded by ``cap``, so it is written anew.
    """
    spark = batch.sparkSession
    stored = read_store(spark, path, number)
    rows = batch if stored is None else batch.unionByName(stored)
    ttl = F.create_map(*(F.lit(x) for pair in seconds.items() for x in pair))[F.col("kind")]
    now = rows.agg(F.max("ts").alias("__now"))
    live = rows.crossJoin(F.broadcast(now)).where(F.col("__now").cast("double") - F.col("ts").cast("double") <= ttl).drop("__now")
    first = live.groupBy("key").agg(F.min_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")
    kept = first.orderBy(F.desc("ts"), "key").limit(cap).withColumn("bucket", F.lit(0))
    _write_buckets(kept, spark.range(1).select(F.lit(0).alias("bucket")), path, number)


def result_cache(results: DataFrame, path: str, checkpoint: str, seconds: dict[str, int], cap: int = 10_000) -> StreamingQuery:
    """A store of live results under ``path``: the first of each key by ``first_results``, the oldest evicted over ``cap`` (``cache_batch``)."""
    writer = first_results(results, seconds).writeStream.foreachBatch(lambda batch, number: cache_batch(batch, number, path, seconds, cap))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstOfKey(StatefulProcessor):
    """State of a key: event time and seconds to live of its live result. Keys of kinds that ``seconds`` does not name are never live."""

    def __init__(self, seconds: dict[str, int]) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "ts double, ttl long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        """Results in the order of their time: one is passed on where none is live, and a timer frees its state when it has expired."""
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        until = None
        if self.live.exists():
            ts, ttl = self.live.get()
            until = ts + ttl
        kept = []
        for i, (kind, ts) in enumerate(zip(frame["kind"], frame["ts"], strict=True)):
            ttl, at = self.seconds.get(kind), ts.timestamp()
            if ttl is not None and (until is None or at > until):
                kept.append(i)
                until = at + ttl
                self.live.update((at, ttl))
                self.handle.registerTimer(int(until * 1000) + 1)
        yield frame.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """The timer of a result that another has replaced since is not the key's; the state goes with the live one's."""
        if self.live.exists():
            ts, ttl = self.live.get()
            if int((ts + ttl) * 1000) + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.live.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_results(results: DataFrame, seconds: dict[str, int], late: str = "600 seconds") -> DataFrame:
    """The first result of each key (key, kind, ts, ...), and the next one after as many seconds of event time as its ``kind`` says.

    State is kept by key with a timer of its own length for each kind, so it is bounded by the live results; results more than ``late``
    behind the latest are dropped. It needs the RocksDB state store, which is set for the session.
    """
    spark = results.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = results.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(statefulProcessor=FirstOfKey(seconds), outputStructType=results.schema, outputMode="Append", timeMode="EventTime")


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Drive a stream through all that is there and stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return query
