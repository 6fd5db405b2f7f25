"""WARC archives with a two-level capture index.

Archives: every row becomes one WARC/1.1 record, each a gzip member of its own. Of records with
equal payloads one is the response and the others are revisits without payload that refer to
it. Each task writes one file to the shared store and renames it when it is whole, so a task
that is run again leaves no half file in the way.

Index: a capture line per record is keyed by the URL with its host reversed. Lines are sorted
(range partitions, so one host may hold any share of them), packed into compressed blocks of
BLOCK_LINES lines, and each index file gets a sparse directory of its blocks' first keys. A
lookup routes a query to its index file by the files' first keys (one per partition, so bounded
by the number of partitions), binary-searches that file's directory, reads one block by range,
binary-searches the block and reads the record by range.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, new_path, saved

BLOCK_LINES = 512
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Repeated payloads (a digest, an id and a URL of 100 bytes on average) up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of records that a task reads before it hands them on.
READ_BYTES = 8_000_000
#: Parts of a digest's pages in a join by shuffle.
SALTS = 16


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hexadecimal digits are four base-32 digits."""
    hexed = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(part(i) for i in range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def reversed_host_key(url: str, page_id) -> str:
    """``com,example,www)/path?query`` of a URL, then a tab and the zero-filled page id."""
    try:
        u = urlsplit(url or "")
        host = ",".join(reversed((u.hostname or "").split(".")))
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return f"){(url or '').lower()}\t{_pad(page_id)}".replace("\n", " ")
    query = f"?{u.query}" if u.query else ""
    return f"{host}{port}){u.path or '/'}{query}".replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") + "\t" + _pad(page_id)


def _pad(page_id) -> str:
    """Whole numbers in their order, as 20 digits; other ids as text."""
    if isinstance(page_id, int):
        return f"{page_id + (1 << 63):020d}"
    return "" if page_id is None else str(page_id).replace("\t", "%09").replace("\n", "%0A")


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, and refers_to and refers_url of the response (null: a response).

    Only digests are grouped: a payload's largest id (and the largest URL with it), combined before
    the shuffle; digests that occur once are not kept. Up to ``broadcast_rows`` repeated payloads are
    broadcast, so payloads stay where they are; with more, pages are joined by a shuffle in which each
    digest is dealt over SALTS tasks.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", base32_sha1(payload))
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("__d"), F.col("payload_bytes").alias("__b"))
    firsts = firsts.agg(F.max(F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))).alias("__first"), F.count("*").alias("__n"))
    firsts = saved(firsts.where("__n > 1").select("__d", "__b", "__first"), "firsts")
    size = firsts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("__first.url")), F.lit(0)).alias("bytes")).first()
    on = (F.col("payload_digest") == F.col("__d")) & (F.col("payload_bytes") == F.col("__b"))
    if size["n"] <= broadcast_rows and size["bytes"] <= 100 * broadcast_rows:
        firsts = F.broadcast(firsts)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        firsts = firsts.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("__salt") == F.col("__s"))
    rows = rows.join(firsts, on, "left")
    other = ~F.col(id_col).eqNullSafe(F.col("__first.id"))
    rows = rows.withColumn("refers_to", F.when(other, F.col("__first.id"))).withColumn("refers_url", F.when(other, F.col("__first.url")))
    return rows.drop("__d", "__b", "__first", "__salt", "__s")


def record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url or ""}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url=None) -> bytes:
    """One WARC record, uncompressed; a revisit names its response by that record's id and URL."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    clean = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, url),
        "WARC-Target-URI": clean(url),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = record_id(refers_to, refers_url)
        head["WARC-Refers-To-Target-URI"] = clean(refers_url)
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = str(refers_to)
    head["Content-Type"] = "text/html; charset=utf-8"
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Store:
    """Files of the shared store by range, through whatever file system its URI names."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(base)
        self.open: OrderedDict = OrderedDict()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str):
        """(stream, finish): what is written appears under ``name`` only when finished."""
        hidden = self.path(f".{name}.{uuid.uuid4().hex}")
        return self.fs.open_output_stream(hidden), lambda: self.fs.move(hidden, self.path(name))

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 32:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(self.path(name))
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)


def _file_name(kind: str) -> str:
    context = TaskContext.get()
    return f"{kind}-{context.partitionId():05d}-{context.taskAttemptId()}"


def write_archives(classified: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row under ``path``; captures (key, file, offset, length), saved.

    Files carry the attempt that wrote them, and the captures name the attempt that counted.
    """

    def make():
        store = Store(path)
        name = _file_name("archive") + ".warc.gz"
        stream, finish = store.write(name)
        at = 0

        def run(texts, ids, urls, digests, refers, refer_urls):
            nonlocal at
            keys, offsets, lengths = [], [], []
            for text, page, url, digest, refer, refer_url in zip(texts, ids, urls, digests, refers, refer_urls, strict=True):
                raw = gzip.compress(record(page, url, text.encode("utf-8", "surrogatepass"), digest, refer, refer_url), 4, mtime=0)
                stream.write(raw)
                keys.append(reversed_host_key(url, page))
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            return keys, [name] * len(keys), offsets, lengths

        def done():
            stream.close()
            finish()

        run.done = done
        return run

    captures = map_rows(classified, make, "key string, file string, offset long, length long", [payload_col, id_col, url_col, "payload_digest", "refers_to", "refers_url"], [])
    return saved(captures, "captures")


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort ``captures`` into compressed blocks; the top directory (first_key, file, directory_offset, directory_length), saved."""

    def run(frames):
        import pyarrow as pa

        store = None
        lines: list[str] = []
        directory: list[tuple] = []
        at, first = 0, None

        def flush():
            nonlocal at
            raw = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            stream.write(raw)
            directory.append((lines[0].rsplit("\t", 3)[0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for frame in frames:
            for key, file, offset, length in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if store is None:
                    store, name, first = Store(path), _file_name("index") + ".idx", key
                    stream, finish = store.write(name)
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    flush()
        if store is not None:
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            stream.write(raw)
            stream.close()
            finish()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "file": [name], "directory_offset": [at], "directory_length": [len(raw)]})

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return saved(ordered.mapInArrow(run, "first_key string, file string, directory_offset long, directory_length long"), "directory")


def _finder(store: Store, top: list[tuple]):
    """fn(key) -> the index lines of the key, one by one; keys best come sorted."""
    firsts = [t[0] for t in top]
    directories: OrderedDict = OrderedDict()
    blocks: OrderedDict = OrderedDict()

    def directory(i):
        if i not in directories:
            if len(directories) >= 4:
                directories.popitem(last=False)
            _, file, offset, length = top[i]
            rows = json.loads(zlib.decompress(store.read(file, offset, length)))
            directories[i] = ([r[0] for r in rows], rows)
        return directories[i]

    def block(i, j):
        if (i, j) not in blocks:
            if len(blocks) >= 8:
                blocks.popitem(last=False)
            _, offset, length = directory(i)[1][j]
            lines = zlib.decompress(store.read(top[i][1], offset, length)).decode("utf-8", "surrogatepass").split("\n")
            split = [x.rsplit("\t", 3) for x in lines]
            blocks[i, j] = ([x[0] for x in split], split)
        return blocks[i, j]

    def find(key):
        # Equal keys may cross blocks and files: from the last block that starts before the key on.
        i = max(0, bisect_left(firsts, key) - 1)
        while i < len(top) and (firsts[i] <= key):
            starts = directory(i)[0]
            j = max(0, bisect_left(starts, key) - 1)
            while j < len(starts) and starts[j] <= key:
                keys, rows = block(i, j)
                yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]
                j += 1
            i += 1

    return find


def lookup(queries: DataFrame, directory: DataFrame, path: str, key_col: str = "key", read_bytes: int = READ_BYTES) -> DataFrame:
    """``queries`` (sorted by key within tasks) with one row per record found under its key.

    Columns: record_type, page, payload_bytes, payload_digest, refers (texts; "" for none), body (binary).
    The top directory has one row per index file; it is sent with the tasks. Records leave a task in batches
    of about ``read_bytes``; only a single record may be larger.
    """
    top = [tuple(r) for r in directory.orderBy("first_key", "file").collect()]
    # Keys are small but the records behind them are not: a number keeps AQE from joining the parts.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = queries.repartitionByRange(parts, key_col).sortWithinPartitions(key_col)
    run = _reader(path, top, queries.columns.index(key_col), read_bytes)
    return ordered.mapInArrow(run, T.StructType([*queries.schema.fields, *RECORD.fields]))


#: What is read of a record.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "page")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers", T.StringType()), T.StructField("body", T.BinaryType())]
)


def _reader(path: str, top: list[tuple], at: int, read_bytes: int):
    """fn(batches with keys in column ``at``) -> those batches, a row per record found, with RECORD's columns."""

    def run(frames):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in RECORD]
        store = Store(path)
        find = _finder(store, top)

        def batch(frame, rows, found):
            columns = [c.take(pa.array(rows, pa.int64())) for c in frame.columns]
            values = zip(*found, strict=True) if found else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=[*frame.schema.names, *RECORD.names])

        for frame in frames:
            rows, found, size = [], [], 0
            for i, key in enumerate(frame.column(at).to_pylist()):
                for _, file, offset, length in find(key):
                    head, body = parse(gzip.decompress(store.read(file, int(offset), int(length))))
                    rows.append(i)
                    found.append((head["WARC-Type"], head["X-Page-Id"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page-Id", ""), body))
                    size += len(body) + 200
                    if size >= read_bytes:
                        yield batch(frame, rows, found)
                        rows, found, size = [], [], 0
            yield batch(frame, rows, found)

    return run


def page_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The distinct index keys of the rows."""
    make = lambda: lambda urls, ids: ([reversed_host_key(u, i) for u, i in zip(urls, ids, strict=True)],)
    return map_rows(pages, make, "key string", [url_col, id_col], []).distinct()


def archive(pages: DataFrame, spark: SparkSession, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[str, DataFrame]:
    """Write archives and index of ``pages`` (page_id, url, html) to a new folder; it and the top directory.

    Null payloads are empty, null URLs are empty, rows that repeat an id and payload each get a
    record (those of the largest id are all responses; the same id and URL give the same record id),
    ids may be of any type that orders, extra columns are not read; an empty table gives an empty
    archive. The folder is the result; it stays until the caller deletes it.
    """
    path = new_path(spark, "warc")
    _make_folder(spark, path)
    captures = write_archives(classify(pages.select("page_id", "url", "html"), min_bytes), path)
    return path, build_index(captures, path)


def _make_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
