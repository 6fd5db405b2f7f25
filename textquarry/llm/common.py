"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two alphabets of the ASCII-only lower-casing.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; where that is unset a temporary folder of this
    machine stands in for it, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until ``clear``: results are lazy and may read it at any time. Only
    ``instead_of``, a table that was saved before and is read by nothing else, goes at once.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    paths = _written.setdefault(spark.sparkContext.applicationId, [])
    paths.append(path)
    if instead_of is not None:
        paths.remove(instead_of.saved_at)
        _delete(spark, instead_of.saved_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def clear(spark: SparkSession) -> None:
    """Delete all tables that the operators of this application have saved.

    Call it when their results are written or no longer needed.
    """
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text of a row, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def map_rows(df: DataFrame, make, ddl: str, inputs: list[str], carry: list[str] | None = None, rows: int = 2000, chars: int = 2_000_000) -> DataFrame:
    """``carry`` columns of ``df`` (all by default), untouched, and new columns that Python computes.

    ``make()`` runs once a task and gives ``fn(*lists)``, which gets a slice of each column of
    ``inputs`` and returns one list or Arrow array per column of ``ddl``; ``fn.done()``, where there
    is one, runs when the task has no more rows. The first input is text, null as empty.
    Slices have at most ``rows`` rows and about ``chars`` characters, which bounds a task's
    temporaries; a single row is never cut. Carried columns stay in Arrow, so their nulls and
    types survive. A new column takes the place of a carried one of the same name.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    new = T.StructType.fromDDL(ddl)
    carry = [c for c in (df.columns if carry is None else carry) if c not in new.names]
    kinds = [to_arrow_type(f.dataType) for f in new]
    n = len(carry)
    given = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), *(F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)))
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)])

    def run(frames):
        fn = make()
        for frame in frames:
            sizes = pc.fill_null(pc.binary_length(frame.column(n)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes, rows, chars):
                part = frame.slice(a, b - a)
                got = [part.column(n + i).to_pylist() for i in range(len(inputs))]
                got[0] = [x or "" for x in got[0]]
                made = fn(*got)
                del got
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=schema.names)
        if hasattr(fn, "done"):
            fn.done()
        # workers live on after a task: what this one allocated goes back to the machine
        del fn
        pa.default_memory_pool().release_unused()

    out = given.mapInArrow(run, schema)
    return out.toDF(*carry, *new.names)


#: Rows of a key up to which they meet in one task, and the most keys that are dealt over several.
DEAL_ROWS = 1000
DEAL_KEYS = 200_000


def deal(rows: DataFrame, side: DataFrame, sizes: DataFrame, key: str, by: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``side`` with a column ``deal``, to be joined on it and ``key``, so that no key is hot.

    ``sizes`` has in ``members`` how many of ``rows`` have each ``key``. A key of more than DEAL_ROWS is dealt
    over parts by ``by``, and its rows of ``side`` are copied to each part. At most DEAL_KEYS keys are: what
    makes a key hot is at least the DEAL_KEYS-th part of all rows, so what is broadcast is bounded.
    """
    total = sizes.agg(F.sum("members")).first()[0] or 0
    most = max(DEAL_ROWS, total // DEAL_KEYS)
    hot = F.broadcast(sizes.where(F.col("members") > most).select(key, F.floor(F.col("members") / most).cast("int").alias("deals")))
    last = F.coalesce("deals", F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("deal", F.pmod(by, last + 1).cast("int")).drop("deals")
    copies = side.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), last))).drop("deals")
    return dealt, copies


def _slices(sizes, rows: int, chars: int):
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or size + n > chars):
            yield start, i
            start, size = i, 0
        size += int(n)
    if len(sizes):
        yield start, len(sizes)
