"""Sessions, cards, reading records, samples of documents and generic unions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- sessions and reading -----------------------------------------------------------------------


def session_rollup(messages: DataFrame) -> DataFrame:
    """(conv_id, library, created, updated, n_messages, n_user, n_chars) of messages with ``ts`` and ``library``.

    A session's library is that of its latest message.
    """
    return messages.groupBy("conv_id").agg(
        F.max_by("library", "ts").alias("library"), F.min("ts").alias("created"), F.max("ts").alias("updated"),
        F.count("*").alias("n_messages"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.sum(F.length("text")).alias("n_chars"),
    )


def save_sessions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored messages with those of every session in ``fresh`` replaced as a whole."""
    return stored.join(fresh.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(fresh)


def conversation_window(messages: DataFrame, turns: int = 6, chars: int = 200, pairs: int = 4, pair_chars: int = 300) -> DataFrame:
    """(conv_id, part, turn, back, role, text): the last user turn (``question``), the last ``pairs`` pairs of turns
    before it (``history``) and the last ``turns`` turns (``recent``); history and recent turns are cut to so many characters, the question is whole; ``back`` counts from 1.

    Null and blank turns are no history.
    """
    asked = messages.withColumn("asked", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    row = lambda df, part, text: df.select("conv_id", F.lit(part).alias("part"), "turn", "back", "role", text.alias("text"))
    head = lambda n: F.substring("text", 1, n)
    question = asked.where("turn = asked").withColumn("back", F.lit(1))
    history = asked.where("turn < asked").where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("back", F.row_number().over(w)).where(F.col("back") <= 2 * pairs)
    recent = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= turns)
    return row(question, "question", F.col("text")).unionByName(row(history, "history", head(pair_chars))).unionByName(row(recent, "recent", head(chars)))


def session_preview(messages: DataFrame, chars: int = 50) -> DataFrame:
    """The latest user message on one line, cut to ``chars`` characters."""
    last = messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    flat = F.regexp_replace("text", "[\r\n]", " ")
    return last.select("conv_id", F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("..."))).otherwise(flat).alias("preview"))


def page_sessions(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """one page of the sessions, the newest first."""
    return sessions.orderBy(F.desc("updated"), F.desc("conv_id")).offset(offset).limit(limit)


def reading_records(events: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Per user and document the first and last time and the count; works on streams (update mode) and tables."""
    kept = events.where(~F.col("document").isin(list(ignored))) if ignored else events
    return kept.groupBy("user_id", "document").agg(F.min("ts").alias("first_read"), F.max("ts").alias("last_read"), F.count("*").alias("read_count"))


def with_totals(page: DataFrame, **totals: DataFrame) -> DataFrame:
    """``page`` with the number of rows of each of ``totals`` as a column."""
    for name, df in totals.items():
        page = page.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row
    return page


def reading_history(records: DataFrame, limit: int) -> DataFrame:
    """latest first, then most read, then first read; with the ``total`` of all records."""
    page = records.orderBy(F.desc("last_read"), F.desc("read_count"), "first_read", "user_id", "document").limit(limit)
    return with_totals(page, total=records)


def continue_reading(records: DataFrame, n: int = 5, reason: str = "read recently") -> DataFrame:
    """each user's ``n`` latest records, with the reason to suggest them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("last_read"), "document")
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("reason", F.lit(reason))


# -- cards --------------------------------------------------------------------------------------


def card_dedup(cards: DataFrame, files: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """One card per trimmed lower-case label, the most important; labels of one character or in ``skip`` go.

    With ``files`` (document), cards none of whose ``sources`` are among them go first.
    """
    if files is not None:
        live = cards.select("card_id", F.explode("sources").alias("document")).join(files.select("document"), "document", "left_semi")
        cards = cards.join(live.select("card_id"), "card_id", "left_semi")
    w = Window.partitionBy("key").orderBy(F.desc("importance"), "card_id")
    kept = cards.withColumn("key", F.lower(F.trim("label"))).where((F.length("key") > 1) & ~F.col("key").isin(list(skip)))
    return kept.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "key")


def card_upsert(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """C14: fresh cards with the stored ``created_at`` where there is one; cards without a fresh one go."""
    old = stored.select("card_id", F.col("created_at").alias("was"))
    return fresh.join(old, "card_id", "left").select("card_id", "label", "importance", F.coalesce("was", now).alias("created_at"), now.alias("updated_at"))


def filter_cards(cards: DataFrame, document: str | None = None, difficulty: str | None = None, text: str = "") -> DataFrame:
    """Cards of the document and difficulty, if given, with ``text`` in front, back or a tag, whatever the case."""
    if document is not None:
        cards = cards.where(F.col("document") == document)
    if difficulty is not None:
        cards = cards.where(F.col("difficulty") == difficulty)
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return cards.where(has(F.col("front")) | has(F.col("back")) | F.exists("tags", has)) if text else cards


def list_cards(cards: DataFrame, text: str = "", limit: int | None = 20) -> DataFrame:
    """cards with ``text`` in label or description by importance, label and latest update; ``limit`` None: all.

    ``total`` is the number of rows given, ``total_all`` that of all cards.
    """
    t = F.lit(text.strip().lower())
    found = cards.where(F.contains(F.lower("label"), t) | F.contains(F.lower("description"), t))
    page = found.orderBy(F.desc("importance"), "label", F.desc("updated_at"), "card_id")
    page = page if limit is None else page.limit(limit)
    return with_totals(page, total=page, total_all=cards)


def review_state(cards: DataFrame) -> DataFrame:
    """Per document the number of cards by difficulty (``new``, ``easy``, ``medium``, ``hard``), of all, and to review again."""
    kinds = ("new", "easy", "medium", "hard")
    pivot = cards.groupBy("document").pivot("difficulty", list(kinds)).count().na.fill(0)
    return pivot.withColumn("cards", sum(F.col(k) for k in kinds)).withColumn("review", F.col("medium") + F.col("hard"))


def review_set(cards: DataFrame) -> DataFrame:
    """The cards to review again."""
    return cards.where(F.col("difficulty").isin("medium", "hard"))


def import_cards(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported cards with both sides that are not stored yet by (front, back), the first of repeats; then the stored ones.

    A difficulty that is none counts as new; ``place`` is 0 for imported cards and 1 for stored ones.
    """
    w = Window.partitionBy("front", "back").orderBy("card_id")
    filled = imported.where((F.trim("front") != "") & (F.trim("back") != "")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    new = filled.join(stored.select("front", "back"), ["front", "back"], "left_anti").select(*stored.columns)
    level = F.when(F.col("difficulty").isin("new", "easy", "medium", "hard"), F.col("difficulty")).otherwise("new")
    return new.withColumn("difficulty", level).withColumn("place", F.lit(0)).unionByName(stored.withColumn("place", F.lit(1)))


# -- samples and cuts of documents --------------------------------------------------------------


def even_sample(rows: DataFrame, cap: int, by: tuple[str, ...] = ("doc_id",), order: str = "chunk_index") -> DataFrame:
    """At most ``cap`` rows of a group at round(i (n - 1) / (cap - 1)), half-even, first and last included."""
    n = F.count("*").over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy(order)
    numbered = rows.withColumn("n", n).withColumn("at", F.row_number().over(w) - 1)
    # Row r is picked when some i rounds to it: only the two nearest i can.
    i = F.col("at") * (cap - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    picked = F.lit(False)
    for k in (F.floor(i), F.ceil(i)):
        picked = picked | (F.bround(k * (F.col("n") - 1) / (cap - 1), 0) == F.col("at"))
    return numbered.where((F.col("n") <= cap) | picked).drop("n", "at")


def sequential_segments(docs: DataFrame, limit: int = 12_000) -> DataFrame:
    """1, 4, 6 or 8 equal segments by length; longer ones become 40 % head, 30 % middle, 30 % tail of ``limit``."""
    n = F.length("text")
    parts = F.when(n <= limit, 1).when(n <= 300_000, 4).when(n <= 800_000, 6).otherwise(8)
    size = F.ceil(n / F.col("parts")).cast("int")
    out = docs.where(n > 0).withColumn("parts", parts).withColumn("size", size)
    out = out.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.substring(F.col("text"), (i * F.col("size") + 1).cast("int"), F.col("size")))).alias("segment", "piece"))
    head, mid, tail = int(limit * 0.4), int(limit * 0.3), int(limit * 0.3)
    m = F.length("piece")
    short = F.concat_ws("\n...\n", F.substring("piece", 1, head), F.substring(F.col("piece"), ((m - mid) / 2 + 1).cast("int"), F.lit(mid)), F.substring(F.col("piece"), (m - tail + 1).cast("int"), F.lit(tail)))
    return out.where(m > 0).select("doc_id", "segment", F.when(m > limit, short).otherwise(F.col("piece")).alias("piece"))


def thesis_sample(docs: DataFrame, limit: int = 12_000) -> DataFrame:
    """Beyond ``limit`` characters the first 15 %, 25 % from 35 % on and the last 15 %, joined and cut."""
    n = F.length("text")
    at = lambda percent: F.floor(n * percent / 100).cast("int")
    joined = F.concat_ws("\n", F.substring(F.col("text"), F.lit(1), at(15)), F.substring(F.col("text"), at(35) + 1, at(25)), F.substring(F.col("text"), n - at(15) + 1, at(15)))
    return docs.select("doc_id", F.when(n > limit, F.substring(joined, 1, limit)).otherwise(F.col("text")).alias("sample"))


def map_groups(chunks: DataFrame, picks: int = 8) -> DataFrame:
    """3, 4, 5 or 6 groups of a document's chunks by their number, ``picks`` even ones of each; (doc_id, chunk_index, grp)."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    k = F.when(F.col("n") <= 100, 3).when(F.col("n") <= 600, 4).when(F.col("n") <= 2000, 5).otherwise(6)
    rows = chunks.withColumn("n", n).withColumn("k", k)
    bounds = F.transform(F.sequence(F.lit(1), F.col("k")), lambda g: F.bround(g * F.col("n") / F.col("k"), 0))
    grouped = rows.withColumn("bounds", bounds).select("doc_id", "chunk_index", F.size(F.filter("bounds", lambda b: b <= F.col("chunk_index"))).alias("grp"))
    return even_sample(grouped, picks, ("doc_id", "grp"))


def rebuild_text(chunks: DataFrame, least: int = 8, most: int = 120, joint: str = "\n") -> DataFrame:
    """A document's chunks in order, each without the longest prefix that repeats the end of the chunk before, joined by line ends."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    # Only the ``most`` characters on either side of a joint are compared, cut off once.
    ends = chunks.select("doc_id", "chunk_index", "chunk", F.substring("chunk", 1, most).alias("head"), F.right("chunk", F.lit(most)).alias("tail"))
    rows = ends.withColumn("before", F.coalesce(F.lag("tail").over(w), F.lit("")))
    fits = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda n: (F.length("before") >= n) & (F.length("head") >= n) & (F.substring(F.col("head"), F.lit(1), n) == F.right(F.col("before"), n)))
    cut = F.coalesce(F.get(fits, F.lit(0)), F.lit(0))
    rows = rows.withColumn("rest", F.substring(F.col("chunk"), cut + 1, F.length("chunk")))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "rest")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["rest"]), joint).alias("text"))


def attach_to_latest(rows: DataFrame, starts: DataFrame, by: str = "doc_id", at: str = "line_no") -> DataFrame:
    """Each row of ``rows`` with the latest start (``at``) not after it, as ``owner``; null before the first."""
    both = rows.select(by, at, F.lit(1).alias("kind"), F.lit(None).cast(starts.schema[at].dataType).alias("start"))
    both = both.unionByName(starts.select(by, at, F.lit(0).alias("kind"), F.col(at).alias("start")))
    w = Window.partitionBy(by).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.last("start", ignorenulls=True).over(w)).where("kind = 1").select(by, at, "owner")


def bucket_headings(headings: DataFrame, least: int = 12) -> DataFrame:
    """More than ``least`` headings of a document go into min(6, ceil(n / 8)) equal buckets."""
    w = Window.partitionBy("doc_id")
    n = F.count("*").over(w)
    rows = headings.withColumn("n", n).withColumn("at", F.row_number().over(w.orderBy("line_no")) - 1)
    buckets = F.least(F.lit(6), F.ceil(F.col("n") / 8))
    size = F.ceil(F.col("n") / buckets)
    return rows.select("doc_id", "line_no", F.when(F.col("n") > least, F.floor(F.col("at") / size)).otherwise(0).cast("long").alias("bucket"))


def highlights(sentences: DataFrame, n: int = 3, width: int = 100) -> DataFrame:
    """The first ``n`` distinct squeezed prefixes of each document's sentences."""
    prefix = F.substring(F.trim(F.regexp_replace("sentence", "[ \t]+", " ")), 1, width)
    rows = sentences.withColumn("prefix", prefix).groupBy("doc_id", "prefix").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


# -- generic unions and maps --------------------------------------------------------------------


def merge_first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of ``frames``; of equal keys the row of the first frame, of it the smallest row."""
    both = None
    for i, df in enumerate(frames):
        part = df.withColumn("__source", F.lit(i))
        both = part if both is None else both.unionByName(part)
    rest = [c for c in both.columns if c not in (key, "__source")]
    best = both.groupBy(key).agg(F.min(F.struct("__source", *rest)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in rest))


def merge_concat(frames: list[DataFrame]) -> DataFrame:
    """The union, duplicates kept."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def dedup_labels(labels: DataFrame) -> DataFrame:
    """One spelling per label whatever the case: the one with the smallest ``ord``."""
    best = labels.groupBy(F.lower("label").alias("key")).agg(F.min(F.struct("ord", "label")).alias("b"))
    return best.select("key", F.col("b.label").alias("label"), F.col("b.ord").alias("ord"))


def map_rows(df: DataFrame, fn: Callable[[dict], object], result: T.DataType) -> DataFrame:
    """``fn`` on every row: the row's columns with result, error (null if none) and seconds.

    A row that fails has a null result; the others are not affected.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("result", result), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            results, errors, seconds = [], [], []
            for row in pdf.itertuples(index=False, name=None):
                began = time.perf_counter()
                try:
                    results.append(fn(dict(zip(names, row, strict=True))))
                    errors.append(None)
                except Exception as e:  # a user's function may raise anything
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                seconds.append(time.perf_counter() - began)
            yield pdf.assign(result=results, error=errors, seconds=seconds)

    return df.mapInPandas(run, schema)


def map_partitions_by_key(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on the rows of every key; a key's rows must fit one task."""
    return df.groupBy(key).applyInPandas(fn, schema)
