"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

1. One pass over the texts gives each document the hash of its word sequence, the size of its
   shingle set, band values of its MinHash samples (as many as ``Scheme`` derives) and an odd sketch: a parity bitmap in
   which every MinHash sample toggles one bit. The bits in which two sketches differ estimate how
   many samples differ, precisely so at high similarity.
2. Documents with equal word sequences are one class, represented by the smallest id.
3. Representatives that share a band value are candidates. In each bucket, members are first
   paired with a pivot only; what is confirmed joins the pivot's component. After PIVOT_ROUNDS
   rounds (each with other pivots, in buckets that still hold several components) all remaining
   pairs between different components of a bucket are tested, block against block. So copies never
   expand into all pairs, and no candidate link between different components is lost.
4. A candidate pair is tested by sizes, then by odd sketches, then on the full shingle sets.
5. Components are spread by minimum label with pointer jumping, in tables.

Nothing of the corpus reaches the driver but counts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import deal, map_rows, saved

SHINGLE = 5
#: Jaccard similarity in hundredths from which documents are linked, where the caller names no other.
PERCENT = 85
#: Largest share of links at the threshold that share no band.
MISS = 3e-6
MOST_SAMPLES = 400
SKETCH_BITS = 4096
PIVOT_ROUNDS = 3
#: Members of a bucket that meet in one task in the last round.
BLOCK = 512
#: Ids of candidate documents up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000


class Scheme:
    """Bands, samples and sketch slack for a threshold ``percent``, with their fixed multipliers.

    A band has the most rows with which, in MOST_SAMPLES samples, enough bands fit that links at
    the threshold are missed at most with probability MISS: 40 bands of 8 at 85, 55 of 7 at 80.
    Candidates whose estimated similarity is lower by more than ``slack`` are not confirmed: 4
    deviations of the estimate at the threshold (about 0.020 from the samples, 0.007 from the sketch).
    """

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 99:
            raise ValueError("percent is a threshold from 50 to 99")
        s = percent / 100
        needed = {r: math.ceil(math.log(MISS) / math.log1p(-(s**r))) for r in range(1, 65)}
        self.percent = percent
        self.rows = max(r for r, n in needed.items() if r * n <= MOST_SAMPLES)
        self.bands = needed[self.rows]
        self.samples = k = self.bands * self.rows
        self.slack = math.ceil(4000 * math.sqrt(s * (1 - s) / k + 0.007**2)) / 1000
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(1, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.word_mul = rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
        self.band_mul = rng.integers(1, 1 << 63, self.rows, dtype=np.uint64) | np.uint64(1)
        self.band_add = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)
        self.bit_mul = rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


@lru_cache
def scheme(percent: int = PERCENT) -> Scheme:
    return Scheme(percent)


_WORD_MUL = scheme().word_mul
#: A-Z lower-cased, other bytes as they are.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Words of the folded text; bytes split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: Words whose hashes a task remembers at most.
MEMORY = 100_000


class WordHashes(dict):
    """64-bit hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh64_intdigest(word)
        return value


def shingle_set(w: list[bytes], memory: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``w``; of all words when there are fewer."""
    if len(w) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64) if w else np.zeros(0, np.uint64)
    if len(memory) > MEMORY:
        memory.clear()
    h = np.fromiter(map(memory.__getitem__, w), dtype=np.uint64, count=len(w))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _WORD_MUL[0]
    for j in range(1, SHINGLE):
        s = (s ^ (s >> np.uint64(29))) + h[j : j + n] * _WORD_MUL[j]
    return np.unique(_mix(s))


def minhash(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Minima of the set under the scheme's multiply-add permutations of 32-bit values."""
    use = scheme(percent)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(use.samples, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 512):  # blocks bound the temporary
        part = h[i : i + 512]
        np.minimum(best, (use.mul[:, None] * part[None, :] + use.add[:, None]).min(axis=1), out=best)
    return best


def bands(signature: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    use = scheme(percent)
    parts = (signature.reshape(use.bands, use.rows).astype(np.uint64) * use.band_mul).sum(axis=1, dtype=np.uint64)
    return _mix(parts + use.band_add).view(np.int64)


def odd_sketch(signature: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """SKETCH_BITS parities as 64-bit words: sample i with minimum v toggles the bit that (i, v) hashes to."""
    use = scheme(percent)
    bit = _mix(signature.astype(np.uint64) * use.bit_mul + np.arange(use.samples, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimated(differing, samples: int = scheme().samples, bits: int = SKETCH_BITS):
    """Similarity that the number of differing bits stands for."""
    share = np.clip(1 - 2 * np.asarray(differing, dtype=float) / bits, 1e-9, 1)
    return 1 + bits / (4 * samples) * np.log(share)


def most_differing(similarity: float, samples: int = scheme().samples) -> int:
    """Differing bits up to which the estimate is at least ``similarity``."""
    return max(d for d in range(SKETCH_BITS // 2) if estimated(d, samples) >= similarity)


def _signer(percent: int = PERCENT):
    from hashlib import blake2b

    memory = WordHashes()

    def run(texts):
        keys, sizes, band, sketch = [], [], [], []
        for text in texts:
            w = words(text)
            s = shingle_set(w, memory)
            keys.append(blake2b(b" ".join(w), digest_size=16).digest())
            sizes.append(len(s))
            signature = minhash(s, percent) if len(s) else None
            band.append(bands(signature, percent) if len(s) else [])
            sketch.append(odd_sketch(signature, percent) if len(s) else [])
        return keys, sizes, band, sketch

    return run


def _setter():
    memory = WordHashes()
    return lambda texts: ([shingle_set(words(t), memory).view(np.int64) for t in texts],)


def differing_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def similar(inter: Column, a: Column, b: Column, percent: int = PERCENT) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def could_be(na: str, nb: str, sa: str, sb: str, percent: int = PERCENT) -> Column:
    """Sizes and odd sketches leave a link possible."""
    small, large = F.least(na, nb), F.greatest(na, nb)
    use = scheme(percent)
    return (100 * small >= percent * large) & (differing_bits(sa, sb) <= most_differing(percent / 100 - use.slack, use.samples))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id that has edges.

    Each round an id takes the smallest label among its neighbours and passes it to its own label
    too, so that a whole tree is hooked at its root as soon as one member meets a smaller label;
    then labels jump to their label's label. Trees merge and halve their depth a round, so rounds
    are about logarithmic on chains too (13 for the path 2, 3 .. 3000, 1, simulated), and they go
    on until no label changes. Labels and edges are tables; messages to a hot node or root
    combine before the shuffle.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "seen").alias("now"))
        step = hooked(step)
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("jumped"))
        step = step.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("jumped", "now")).alias("component"))
        step = last = saved(step, "labels", instead_of=last)
        labels = step.select("id", "component")
        if not step.where(F.col("was") != F.col("component")).limit(1).count():
            return labels


def hooked(step: DataFrame) -> DataFrame:
    """``step`` (id, was, now) where the label ``was`` of every id also takes that id's ``now``, if smaller."""
    own = F.struct("id", F.col("was").alias("was"), "now")
    root = F.struct(F.col("was").alias("id"), F.lit(None).cast(step.schema["was"].dataType).alias("was"), F.col("now").alias("now"))
    sent = step.select(F.explode(F.array(own, root)).alias("m"))
    return sent.groupBy("m.id").agg(F.max("m.was").alias("was"), F.min("m.now").alias("now"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; saved) whose full shingle sets are similar enough.

    A document of very many pairs (a pivot) is no hot key: its pairs are dealt over parts.
    """
    both = _with_set(_with_set(pairs, pairs, sets, "a", "b"), pairs, sets, "b", "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(similar(inter, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    sizes = pairs.groupBy(end).agg(F.count("*").alias("members"))
    rows, sets = deal(rows, sets.select(F.col("id").alias(end), F.col("shingles").alias(f"s{end}")), sizes, end, F.xxhash64(other))
    return rows.join(sets, [end, "deal"]).drop("deal")


def _pivot_pairs(placed: DataFrame, mixed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of the ``mixed`` buckets with the likeliest of the pivots of its buckets.

    Pivots bring their sketches along with their buckets, so no join is on a pivot's id but the one
    of the buckets themselves, in which a pivot stands once for each band. Buckets of many are dealt.
    """
    mixed = saved(mixed.select("key", F.col("pivot.id").alias("b"), F.col("pivot.component").alias("pc"), "members"), "pivots")
    pivots = mixed.drop("members").join(known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    placed, pivots = deal(placed, pivots, mixed, "key", F.xxhash64("id"))
    pairs = placed.join(pivots, ["key", "deal"]).where("component != pc").drop("key", "deal", "component", "pc").dropDuplicates(["id", "b"])
    pairs = pairs.join(known.select("id", F.col("n").alias("na"), F.col("sketch").alias("sa")), "id").where(could_be("na", "nb", "sa", "sb", percent))
    best = pairs.groupBy(F.col("id").alias("a")).agg(F.min_by("b", F.struct(differing_bits("sa", "sb"), "b")).alias("b"))
    return best.select("a", "b")


def _remaining_pairs(placed: DataFrame, mixed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components of a bucket that sizes and sketches leave possible.

    Members of a bucket of more than BLOCK are dealt to blocks, and each two blocks meet apart, so
    no task has more than BLOCK times BLOCK pairs of a bucket.
    """
    blocks = mixed.select("key", F.floor((F.col("members") - 1) / BLOCK).cast("int").alias("last"))
    rows = placed.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int"))
    rows = saved(rows.join(known, "id"), "left")
    names = ("id", "component", "n", "sketch", "bands", "block")
    side = lambda tag, low, high: rows.select("key", *(F.col(c).alias(c + tag) for c in names), low.alias("low"), high.alias("high"))
    up = side("a", F.col("block"), F.explode(F.sequence("block", "last")))
    down = side("b", F.explode(F.sequence(F.lit(0), F.col("block"))), F.col("block"))
    # A pair comes out of the first bucket that its members share, and of no other.
    first = F.get(F.filter(F.arrays_zip("bandsa", "bandsb"), lambda x: x["bandsa"] == x["bandsb"]), F.lit(0))["bandsa"]
    pairs = up.join(down, ["key", "low", "high"]).where((F.col("blocka") < F.col("blockb")) | (F.col("ida") < F.col("idb")))
    pairs = pairs.where((F.col("componenta") != F.col("componentb")) & could_be("na", "nb", "sketcha", "sketchb", percent) & (first == F.col("key")))
    return pairs.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def link_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept; links are of similarity ``percent`` / 100 and more.

    Null texts and texts without words have no shingles and are linked with nothing. Ids should
    be unique; rows that repeat an id and text come back as often as they came, and rows without
    an id have no component and are not kept. Extra columns are not read; an empty table gives
    an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = saved(map_rows(rows, lambda: _signer(percent), "ck binary, n_shingles long, bands array<bigint>, sketch array<bigint>", ["text"], ["id"], rows=1000), "signed")
    filled = signed.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # Equal word sequences: one class each, under its smallest id.
    classes = saved(filled.groupBy("ck").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "classes")
    reps = filled.join(classes.select(F.col("ck").alias("k"), F.col("rep").alias("id2")), (F.col("ck") == F.col("k")) & (F.col("id") == F.col("id2"))).dropDuplicates(["id"])
    reps = reps.select("id", F.col("n_shingles").alias("n"), "sketch", "bands")
    buckets = reps.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = saved(buckets.join(shared.select("key"), "key", "left_semi"), "members")
    ids = members.select("id").distinct()
    n_ids = ids.count()
    known = saved(reps.select("id", "n", "sketch", "bands").join(ids, "id", "left_semi"), "sketches")
    texts = rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")
    sets = saved(map_rows(texts, _setter, "shingles array<bigint>", ["text"], ["id"], rows=1000).dropDuplicates(["id"]), "sets")

    labels = ids.select("id", F.col("id").alias("component"))
    for turn in range(PIVOT_ROUNDS + 1):
        placed = members.join(labels, "id")
        mixed = placed.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"),
            F.min_by(F.struct("id", "component"), F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), "id")).alias("pivot"),
        ).where("lo < hi")
        pairs = _pivot_pairs if turn < PIVOT_ROUNDS else _remaining_pairs
        found = saved(_confirmed(saved(pairs(placed, mixed, known, percent), "pairs"), sets, percent), "links")
        labels = merged(labels, found)
    # Copies of one text are one key, so they are dealt; texts without words and rows without an id meet nobody.
    placed = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("ck", F.coalesce("component", "rep").alias("component"))
    full, placed = deal(filled.select("id", "ck", "n_shingles"), placed, classes.select("ck", "members"), "ck", F.xxhash64("id"))
    out = full.join(placed, ["ck", "deal"]).select("id", "n_shingles", "component")
    empty = signed.where((F.col("n_shingles") == 0) | F.col("id").isNull()).select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).alias("component"))
    out = out.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", F.col("component").cast(docs.schema[id_col].dataType).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after ``links`` (a, b), which join whole components.

    Only the links of this round are followed, between components instead of documents, so the
    work of earlier rounds is not repeated.
    """
    if links.isEmpty():
        return labels
    ends = links.join(labels.withColumnsRenamed({"id": "a", "component": "ca"}), "a").join(labels.withColumnsRenamed({"id": "b", "component": "cb"}), "b")
    found = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    found = found.select(F.col("id").alias("component"), F.col("component").alias("lower"))
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return saved(labels.join(found, "component", "left").select("id", F.coalesce("lower", "component").alias("component")), "placed")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest id stays.

    Documents without words stay. Rows that repeat a kept id all stay.
    """
    dropped = link_documents(docs, text_col, id_col, percent).where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(dropped, F.col(id_col) == F.col("__gone"), "left_anti")
