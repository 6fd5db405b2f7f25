"""Exact Jaccard self-join of documents on their word n-grams, as a T-occurrence search (DivideSkip).

A document linked with one of n shingles shares at least T = ceil(percent / 100 * n) of them: in T of its n
inverted lists it occurs. So:

1. One pass over the texts gives each document its set's size, digest and those of its shingles whose
   hash is 0 modulo SPARSE. Equal sets are one class, represented by the smallest id.
2. A class of which more than n - T shingles occur nowhere else has no partner. The sparse shingles
   alone show it for nearly all: those that are in one class only are counted, and more than n - T
   of them rule the class out. What they leave open stays in; nothing is lost.
3. Of the others' sets the shingles whose hash is 0 modulo LISTED become inverted lists, each cut in shards
   by document, so that a list's part is bounded however many documents hold its shingle. Partners differ in n - T
   shingles of the document at most, so they share at least ``need`` = listed shingles - (n - T) of its lists.
   Documents with too few listed shingles for that, and all that could be their partners, have all their shingles listed.
4. A document that is asked searches the lists. Its long lists, L of them by DivideSkip's rule, are put
   aside; the short ones are merged by a heap that skips (``occurrences``), which leaves candidates with
   need - L occurrences. For the rest candidates are only probed: whether one is in a long list, or has a shingle
   that is not listed, is asked, by binary search, of its sorted set, which holds the same answer as the list.
   Before that, a bitmap of the parities of a set's hashes rules candidates out: two bitmaps differ in no more bits than the
   sets differ in shingles. Bitmaps go to the tasks while they are bounded; without them the probes do all the work.
5. Components need not know all links of a group of copies. Of each list that still mixes components one document,
   by a hash, is the pivot; in PIVOT_ROUNDS rounds only pivots of most of their lists are asked, and only for
   documents of other components; their links join components. It has then met all partners
   and leaves the lists, and so does every document with fewer than ``need`` lists that mix components. In the
   last round all that are left are asked.

Only counts reach the driver.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import deal, map_rows, saved
from .neardup import merged

SHINGLE = 3
#: Jaccard similarity in hundredths from which documents are linked.
PERCENT = 90
#: One of so many shingles takes part in the first filter, and one of so many has a list.
SPARSE = 5
LISTED = 3
#: Documents of a shard of the lists.
SHARD = 100_000
PIVOT_ROUNDS = 3
#: DivideSkip's weight of the lists' lengths when it chooses how many are long.
MU = 0.0085
#: Ids up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000

#: Bits of a set's parity bitmap, and documents up to which bitmaps are broadcast (80 bytes each).
PARITIES = 512
BROADCAST_BITMAPS = 1_000_000

#: Bytes that a step of ``word_hashes`` takes, and word bytes from which a word is hashed on its own.
STEP = 1 << 15
_rng = np.random.default_rng(20250117)
_MUL = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # lower-cased
_BASE = int(_rng.integers(1, 1 << 63)) | 1
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, STEP)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), STEP)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` starts, and its 64-bit hash; A-Z count as a-z, and white space parts words.

    A word's hash is its polynomial over random values of its bytes, from differences of prefix sums; words
    of STEP bytes and more, which could be made to collide, are hashed on their own.
    """
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    at = np.zeros(len(edge), dtype=np.uint64)
    total, scale = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    down = [np.ones(1, dtype=np.uint64)]
    for k in range(0, len(b), STEP):
        part = b[k : k + STEP]
        sums = np.concatenate((total, total + scale * np.cumsum(_BYTE[part] * _UP[: len(part)])))
        lo, hi = np.searchsorted(edge, (k, k + len(part)), side="left")
        hi = len(edge) if k + len(part) == len(b) else hi
        at[lo:hi] = sums[edge[lo:hi] - k]
        total, scale = sums[-1:], scale * _UP[-1:] * np.uint64(_BASE)
        down.append(down[-1] * _DOWN[-1:] * _DOWN[1:2])
    out = _mix((at[1::2] - at[0::2]) * _DOWN[starts % STEP] * np.concatenate(down)[starts // STEP])
    for i in np.flatnonzero(ends - starts >= STEP):
        out[i] = xxh64_intdigest(raw[starts[i] : ends[i]].lower())
    return starts, out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words; of all words when there are fewer; none without words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, h = word_hashes(b"\n".join(raw))
    ends = np.cumsum([len(r) + 1 for r in raw])
    cuts = [0, *np.searchsorted(starts, ends)]
    s = h[: max(0, len(h) - SHINGLE + 1)] * _MUL[0]
    for j in range(1, SHINGLE):
        s = (s ^ (s >> np.uint64(29))) + h[j : j + len(s)] * _MUL[j]
    s = _mix(s)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if 0 < b - a < SHINGLE:
            whole = np.zeros(1, dtype=np.uint64) + _SHORT[b - a]
            for x in h[a:b]:
                whole = _mix(whole ^ x)
            out.append(whole)
            continue
        own = np.sort(s[a : max(a, b - SHINGLE + 1)])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def _signer():
    def run(texts):
        sets = shingle_sets(texts)
        keys = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return keys, [len(s) for s in sets], [s[s % np.uint64(SPARSE) == 0].view(np.int64) for s in sets]

    return run


def _setter():
    def run(texts):
        sets = [np.sort(s.view(np.int64)) for s in shingle_sets(texts)]
        return sets, [int((s % LISTED == 0).sum()) for s in sets]

    return run


def occurrences(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, number of lists with it) of the ids that are in at least ``least`` of the sorted ``lists``.

    A heap holds the head of each list. Where the smallest head is in too few lists, the ``least`` - 1
    smallest heads are taken and their lists skip, by binary search, to the head that is then smallest: no id before
    it can be in enough lists.
    """
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    place = [0] * len(lists)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        taken = []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            out.append((top, len(taken)))
            to = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
        for i in taken:
            place[i] = bisect_left(lists[i], to, place[i])
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))
    return out


def required(n: Column, percent: int) -> Column:
    """T: the fewest shingles that a document of ``n`` shares with any that it is linked with."""
    return F.ceil(percent * n / F.lit(100)).cast("long")


def _open_classes(signed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``classes`` that the sparse shingles don't rule out."""
    # Shuffled as they are: few shingles meet twice in a task.
    postings = signed.select(F.xxhash64("ck").alias("c"), F.explode("some").alias("s")).repartition("s")
    alone = postings.groupBy("s").agg(F.min("c").alias("c"), F.max("c").alias("other")).where("c = other")
    alone = alone.groupBy("c").agg(F.count("*").alias("alone"))
    rows = classes.withColumn("c", F.xxhash64("ck")).join(alone, "c", "left")
    return rows.where(F.coalesce("alone", F.lit(0)) <= F.col("n") - required(F.col("n"), percent))


def _prepared(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (id, shingles, listed) with n, ``need``, ``by_all`` (whether need counts all its lists) and ``all`` (whether all are listed)."""
    sets = sets.withColumn("n", F.size("shingles").cast("long"))
    t = required(F.col("n"), percent)
    gap = F.col("n") - t
    sets = sets.withColumn("by_all", F.col("listed") <= gap).withColumn("need", F.when(F.col("listed") <= gap, t).otherwise(F.col("listed") - gap))
    # A partner has no more listed shingles than the other has, and those of its own in which it differs.
    return sets.withColumn("all", F.col("listed") <= gap + F.floor((100 - percent) * F.col("n") / F.lit(percent)))


def _round(sets: DataFrame, labels: DataFrame, shards: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """The lists that mix components, and the documents with at least ``need`` of them.

    lists: (s, shard, ids: array of (id, n, own, component) by id; own: the document counts this list); documents: (id, n,
    component, need, mine: array of (length, s), pivot: whether it is the pivot of most of these).
    """
    is_listed = lambda x: F.pmod(x, F.lit(LISTED)) == 0
    rows = sets.join(labels, "id").select("id", "n", "component", "by_all", F.explode(F.when(F.col("all"), F.col("shingles")).otherwise(F.filter("shingles", is_listed))).alias("s"))
    rows = rows.select("s", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "n", (F.col("by_all") | is_listed(F.col("s"))).alias("own"), "component")
    luck = F.struct(F.xxhash64("id", F.lit(turn)), "id")
    lists = rows.repartition("s", "shard").groupBy("s", "shard").agg(
        F.array_sort(F.collect_list(F.struct("id", "n", "own", "component"))).alias("ids"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(luck).alias("luck")
    )
    if shards == 1:
        lists = lists.where("lo < hi").select("s", "shard", "ids", F.size("ids").cast("long").alias("long"), F.col("luck.id").alias("pivot"))
    else:
        heads = lists.groupBy("s").agg(F.sum(F.size("ids")).alias("long"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("luck")["id"].alias("pivot")).where("lo < hi")
        lists = lists.select("s", "shard", "ids").join(heads.select("s", "long", "pivot"), "s")
    lists = saved(lists, "lists")
    seen = lists.select("s", "long", "pivot", F.explode("ids").alias("m")).where("m.own").select(F.col("m.id").alias("id"), "s", "long", "pivot").repartition("id")
    seen = seen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("long", "s"))).alias("mine"), (2 * F.count_if(F.col("id") == F.col("pivot")) > F.count("*")).alias("pivot"))
    return lists, saved(seen.join(sets.select("id", "n", "need"), "id").join(labels, "id").where(F.size("mine") >= F.col("need")), "open")


def _parities():
    """The parities of the numbers of a set's hashes in PARITIES classes, as bytes."""

    def run(_, shingles):
        out = []
        for own in shingles:
            at = np.asarray(own, dtype=np.int64).view(np.uint64) >> np.uint64(40)
            out.append(np.packbits(np.bincount((at % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes())
        return (out,)

    return run


def _bitmaps(seen: DataFrame, sets: DataFrame):
    """(ids, sizes, bitmaps) of the documents of ``seen``, broadcast; None where they are too many."""
    if seen.count() > BROADCAST_BITMAPS:
        return None
    rows = sets.join(seen.select("id"), "id", "left_semi").withColumn("text", F.lit(""))
    made = map_rows(rows, _parities, "bits binary", ["text", "shingles"], ["id", "n"]).orderBy("id").toArrow()
    bits = np.frombuffer(b"".join(made.column("bits").to_pylist()), dtype=np.uint64).reshape(made.num_rows, PARITIES // 64)
    return seen.sparkSession.sparkContext.broadcast((made.column("id").to_numpy(), made.column("n").to_numpy(), bits))


def _merger(bitmaps, percent: int):
    """Candidates of each document from its short lists; those that bitmaps rule out, or that have no bitmap and so no partner, leave the lists first."""

    def possible(q: int, lists: list[np.ndarray]) -> list[np.ndarray]:
        ids, sizes, bits = bitmaps.value
        own = np.searchsorted(ids, q)
        at = [np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in lists]
        met = np.zeros(len(ids), dtype=bool)
        for i, x in zip(at, lists, strict=True):
            met[i[ids[i] == x]] = True
        r = np.flatnonzero(met)
        differ = np.bitwise_count(bits[r] ^ bits[own]).sum(axis=1, dtype=np.int64)
        met[r] = (100 + percent) * differ <= (100 - percent) * (sizes[r] + sizes[own])
        return [x[met[i] & (ids[i] == x)] for i, x in zip(at, lists, strict=True)]

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            q, least = frame.column(0).to_pylist(), frame.column(3).to_pylist()
            found = []
            for n, (a, few) in enumerate(zip(q, least, strict=True)):
                lists = [x.values.to_numpy() for x in frame.column(2)[n].values]
                lists = possible(a, lists) if bitmaps else lists
                lists = [x.tolist() for x in lists if len(x)]
                if len(lists) >= few:
                    found += [(a, r, k) for r, k in occurrences(lists, few)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["q", "r", "k"])

    return run


def _probe():
    """The number of ``far`` that are in the sorted set of each candidate."""

    def run(_, far, shingles):
        out = []
        for probes, own in zip(far, shingles, strict=True):
            own, probes = np.asarray(own, dtype=np.int64), np.asarray(probes, dtype=np.int64)
            at = np.searchsorted(own, probes)
            out.append(int((own[np.minimum(at, len(own) - 1)] == probes).sum()))
        return (out,)

    return run


def search(asked: DataFrame, lists: DataFrame, sets: DataFrame, percent: int, once: bool = False, bitmaps=None) -> DataFrame:
    """(a, b) of every document ``a`` of ``asked`` and every one of another component that it is linked with.

    ``once``: all documents of the lists are asked, so of a pair the smaller id finds the other.
    """
    longest = F.element_at("mine", F.lit(-1))["long"]
    aside = F.least(F.col("need") - 1, F.ceil(F.col("need") / (MU * F.log2(longest) + 1))).cast("int")
    near = F.size("mine") - aside
    asked = asked.select(F.col("id").alias("q"), F.col("n").alias("nq"), F.col("component").alias("cq"), (F.col("need") - aside).alias("least"), F.transform(F.slice("mine", F.lit(1), near), lambda x: x["s"]).alias("near"))
    short = asked.select("q", "nq", "cq", "least", F.explode("near").alias("s"))
    fits = lambda x: (100 * F.least(x["n"], "nq") >= percent * F.greatest(x["n"], "nq")) & (x["component"] != F.col("cq")) & ((x["id"] > F.col("q")) if once else F.lit(True))
    fetched = short.join(lists.select("s", "shard", "ids"), "s").withColumn("ids", F.transform(F.filter("ids", fits), lambda x: x["id"])).where(F.size("ids") > 0)
    own = fetched.groupBy("q", "shard").agg(F.collect_list("ids").alias("lists"), F.first("least").cast("int").alias("least")).where(F.size("lists") >= F.col("least"))
    found = saved(own.mapInArrow(_merger(bitmaps, percent), "q long, r long, k long"), "candidates")
    far = asked.join(sets.select(F.col("id").alias("q"), "shingles"), "q").select("q", "nq", F.array_except("shingles", "near").alias("far"))
    pairs, far = deal(found, far, found.groupBy("q").agg(F.count("*").alias("members")), "q", F.xxhash64("r"))
    pairs = pairs.join(far, ["q", "deal"]).join(sets.select(F.col("id").alias("r"), F.col("n").alias("nr"), "shingles"), "r")
    pairs = map_rows(pairs.withColumn("text", F.lit("")), _probe, "more long", ["text", "far", "shingles"], ["q", "r", "nq", "nr", "k"])
    both = F.col("k") + F.col("more")
    return pairs.where(100 * both >= percent * (F.col("nq") + F.col("nr") - both)).select(F.col("q").alias("a"), F.col("r").alias("b"))


def join_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id; links are of similarity ``percent`` / 100 and more.

    Null texts and texts without words have no shingles and are linked with nothing; fewer words than
    a shingle has are one. Ids should be unique integers; rows that repeat an id and text come back as often as
    they came, and rows without an id have no component. Extra columns are not read; an empty
    table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sparse = saved(map_rows(rows, _signer, "ck binary, n long, some array<bigint>", ["text"], ["id"]), "sparse")
    filled = (F.col("n") > 0) & F.col("id").isNotNull()
    signed = saved(sparse.select("id", "ck", "n"), "signed")
    classes = saved(signed.where(filled).groupBy("ck").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("members")), "classes")
    ids = saved(_open_classes(sparse.where(filled), classes, percent).select(F.col("rep").alias("id")), "ids", instead_of=sparse)
    n_ids = ids.count()
    texts = rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")
    sets = saved(map_rows(texts, _setter, "shingles array<bigint>, listed long", ["text"], ["id"]), "sets")
    sets = _prepared(sets.dropDuplicates(["id"]), percent)

    labels = ids.select("id", F.col("id").alias("component"))
    left = sets
    for turn in range(PIVOT_ROUNDS + 1):
        lists, seen = _round(left, labels, 1 + n_ids // SHARD, turn)
        if seen.isEmpty():
            break
        last = turn == PIVOT_ROUNDS
        asked = seen if last else seen.where("pivot")
        if asked.isEmpty():
            continue
        links = saved(search(asked, lists, sets, percent, last, _bitmaps(seen, sets)), "links")
        labels = merged(labels, links)
        left = sets.join(seen.where(~F.col("pivot")).select("id"), "id", "left_semi")
    placed = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("ck", F.coalesce("component", "rep").alias("component"))
    full, empty = signed.where(filled).select("id", "ck", "n"), signed.where(~filled | F.col("id").isNull()).select("id", "n")
    full, placed = deal(full, placed, classes.select("ck", "members"), "ck", F.xxhash64("id"))
    out = full.join(placed, ["ck", "deal"]).select("id", "n", "component")
    out = out.unionByName(empty.withColumn("component", F.when(F.col("n") == 0, F.col("id"))))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))
