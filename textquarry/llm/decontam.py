"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training windows.

Texts are normalised to bytes (A-Z lower-cased, everything but ASCII letters, digits and
non-ASCII characters a separator) and cut into words. A benchmark item gives its windows of N
consecutive words, or, when shorter, one window of all its words.

Spark cuts the benchmark into windows and counts them. Up to BROADCAST_WINDOWS distinct windows
with IDS_PER_WINDOW items each on average, the set is broadcast as sorted 64-bit hashes with a
128-bit digest that verifies each hit: about 30 bytes a window and 20 an item id, so 20 MB in each task. While the
set is made, its rows are on the driver too, at the bound some 500 MB. Training
texts are scanned in slices, all their windows at once. A larger benchmark stays a table: the
windows of the documents are joined to it by digest, in shuffles, and hits are put together per row.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, saved

WINDOW = 10
BROADCAST_WINDOWS = 500_000
IDS_PER_WINDOW = 4
#: Words whose hashes a task remembers at most.
MEMORY = 100_000

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WordHashes(dict):
    """64-bit hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh64_intdigest(word)
        return value

    def of(self, cut: list[list[bytes]], n: int) -> np.ndarray:
        """Hashes of the ``n`` words of ``cut``, one after the other."""
        if len(self) > MEMORY:
            self.clear()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.uint64, n)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes (wrapping arithmetic)."""
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MULTIPLIER + h[j : j + count]
    return out ^ (out >> np.uint64(31))


def digest(gram: list[bytes]) -> bytes:
    """128 bits of a window's words."""
    return blake2b(b" ".join(gram), digest_size=16).digest()


def item_windows(text: str, n: int = WINDOW) -> list[list[bytes]]:
    w = words(text)
    size = min(n, len(w))
    return [w[i : i + size] for i in range(len(w) - size + 1)] if w else []


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(key, hash, size, item_ids): the distinct windows of the items, with the ids that have them; saved.

    Items without an id have windows too but add no id; null texts have none; repeats count once.
    """

    def make():
        memory = WordHashes()

        def run(texts):
            keys, hashes, sizes = [], [], []
            for text in texts:
                grams = item_windows(text, n)
                h = memory.of(grams, sum(map(len, grams)))
                size = len(grams[0]) if grams else 0
                keys.append([digest(g) for g in grams])
                hashes.append([int(window_hashes(h[i * size : (i + 1) * size], size).view(np.int64)[0]) for i in range(len(grams))])
                sizes.append(size)
            return keys, hashes, sizes

        return run

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    made = map_rows(items, make, "key array<binary>, hash array<long>, size int", ["text"], ["item_id"])
    each = made.select("item_id", "size", F.explode(F.arrays_zip("key", "hash")).alias("w"))
    # Distinct pairs first, so that a window of very many items is combined before it meets in one row.
    each = each.select(F.col("w.key").alias("key"), F.col("w.hash").alias("hash"), "size", "item_id").distinct()
    return saved(each.groupBy("key", "hash", "size").agg(F.collect_set("item_id").alias("item_ids")), "windows")


class WindowSet:
    """The windows as arrays: hashes in order, their digests, and the numbers of their items."""

    def __init__(self, rows) -> None:
        rows = sorted(rows, key=lambda r: r["hash"] & (1 << 64) - 1)
        self.hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        self.keys = b"".join(bytes(r["key"]) for r in rows)
        self.sizes = sorted({r["size"] for r in rows})
        names = sorted({i for r in rows for i in r["item_ids"]})
        number = {x: k for k, x in enumerate(names)}
        self.names = names
        self.first = np.concatenate(([0], np.cumsum([len(r["item_ids"]) for r in rows]))).astype(np.int64)
        self.items = np.array([number[i] for r in rows for i in r["item_ids"]], np.int32)

    def bits(self) -> np.ndarray:
        """A bitmap of the hashes' low bits, which most windows fail."""
        out = np.zeros(1 << 22, bool)
        out[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return out

    def find(self, value: np.uint64, gram: list[bytes]) -> int | None:
        """Where the window ``gram`` with the hash ``value`` stands, if it does."""
        key, k = digest(gram), int(np.searchsorted(self.hashes, value))
        while k < len(self.hashes) and self.hashes[k] == value:
            if self.keys[16 * k : 16 * k + 16] == key:
                return k
            k += 1
        return None


def _positions(cut: list[list[bytes]], memory: WordHashes):
    """Word hashes of a slice of texts, where each text starts, and where the text of each word ends."""
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    ends = np.cumsum(sizes)
    return memory.of(cut, int(sizes.sum())), ends - sizes, np.repeat(ends, sizes)


def _scanner(sent, cutting: bool):
    def make():
        known, memory = sent.value, WordHashes()
        bits = known.bits()

        def run(texts):
            cut = [words(t) for t in texts]
            h, start, end = _positions(cut, memory)
            spans: list[list[tuple]] = [[] for _ in cut]
            items: list[set] = [set() for _ in cut]
            for n in known.sizes:
                x = window_hashes(h, n)
                likely = np.flatnonzero(bits[(x & np.uint64((1 << 22) - 1)).astype(np.int64)])
                likely = likely[likely + n <= end[likely]]
                place = np.searchsorted(known.hashes, x[likely])
                likely = likely[known.hashes[np.minimum(place, len(known.hashes) - 1)] == x[likely]]
                for at, doc in zip(likely.tolist(), (np.searchsorted(start, likely, side="right") - 1).tolist(), strict=True):
                    i = at - int(start[doc])
                    k = known.find(x[at], cut[doc][i : i + n])
                    if k is not None:
                        spans[doc].append((i, i + n))
                        items[doc].update(known.items[known.first[k] : known.first[k + 1]].tolist())
            hits = [union(s) for s in spans]
            made = [len(w) for w in cut], hits, [sorted(known.names[i] for i in s) for s in items]
            return (*made, [remove_spans(t, s) if s else None for t, s in zip(texts, hits, strict=True)]) if cutting else made

        return run

    return make


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, sorted, with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SCHEMA = "n_words long, hits array<array<int>>, item_ids array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", carry: list[str] | None = None, broadcast_windows: int = BROADCAST_WINDOWS, cutting: bool = False) -> DataFrame:
    """``docs`` (its ``carry`` columns) with n_words, ``hits`` (word ranges inside windows) and ``item_ids`` (as strings, sorted).

    With ``cutting`` also ``cut``: the text without its hits, null where there are none. Null texts and
    texts without words have no windows; an empty benchmark hits nothing; repeated rows and null ids pass
    through; an item that repeats counts once; items with a null id add to ``hits`` only. Extra columns
    pass through, but for those named like a new one, which gives way.
    """
    carry = docs.columns if carry is None else carry
    windows = benchmark_windows(benchmark, n)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("item_ids")), F.lit(0)).alias("ids")).first()
    schema = SCHEMA + (", cut string" if cutting else "")
    if size["n"] <= broadcast_windows and size["ids"] <= IDS_PER_WINDOW * broadcast_windows:
        sent = docs.sparkSession.sparkContext.broadcast(WindowSet(windows.collect()))
        return map_rows(docs, _scanner(sent, cutting), schema, [text_col], carry, chars=1_000_000)
    return _joined(docs, windows, schema, text_col, carry)


def _joined(docs: DataFrame, windows: DataFrame, schema: str, text_col: str, carry: list[str]) -> DataFrame:
    """``find_contamination`` by a shuffle join of the windows of the documents.

    A window that very many documents share is a hot key of the document side only; its join is
    one that AQE splits. Hits meet per document.
    """
    lengths = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most n

    def cutter():
        def run(texts):
            cut = [words(t) for t in texts]
            each = [[(digest(w[i : i + k]), i, i + k) for k in lengths for i in range(len(w) - k + 1)] for w in cut]
            return (each,)

        return run

    def finisher():
        def run(texts, spans, items):
            hits = [union([tuple(s) for s in each or []]) for each in spans]
            return [len(words(t)) for t in texts], hits, [sorted(x or []) for x in items], [remove_spans(t, s) if s else None for t, s in zip(texts, hits, strict=True)]

        return run

    names = [c for c in carry if c not in ("n_words", "hits", "item_ids", "cut")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)))
    rows = saved(rows, "rows")  # a row keeps its number whichever executor reads it
    made = map_rows(rows, cutter, "w array<struct<key:binary,a:int,b:int>>", ["text"], ["row"], chars=200_000)
    found = made.select("row", F.explode("w").alias("w")).select("row", "w.*").join(windows.select("key", "item_ids"), "key")
    spans = found.groupBy("row").agg(F.collect_set(F.array("a", "b")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"))
    out = map_rows(rows.join(spans, "row", "left"), finisher, f"{SCHEMA}, cut string", ["text", "spans", "items"])
    new = [f.split()[0] for f in schema.split(", ")]
    return out.select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(names)), *new)


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_contamination``."""
    return found.select(
        id_col,
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_spans(text: str, hits: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``hits`` and what stands between them; one space is left in each place inside."""
    if not len(hits):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    shape = raw.translate(_KEPT)
    ends, at = [], 0
    for w in shape.split():
        at = shape.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in hits:
        out.append(raw[last : ends[a][0]].rstrip(b" "))
        last = ends[b - 1][1]
    return b" ".join(x for x in [*out, raw[last:].lstrip(b" ")] if x).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without its hit spans; documents of which at least ``drop_share`` of the words are hit go.

    Columns stay as they are but for ``text`` and, where there is one, ``n_chars``.
    """
    columns = docs.columns
    found = find_contamination(docs.toDF(*(f"d{i}" for i in range(len(columns)))), benchmark, n, f"d{columns.index('text')}", None, broadcast_windows, True)
    found = found.where((F.col("n_words") == 0) | (n_hit() < drop_share * F.col("n_words")))
    names = {c: F.col(f"d{i}") for i, c in enumerate(columns)}
    names["text"] = F.coalesce("cut", names["text"])
    if "n_chars" in columns:
        names["n_chars"] = F.coalesce(F.length("cut").cast(docs.schema["n_chars"].dataType), names["n_chars"])
    return found.select(*(names[c].alias(c) for c in columns))
