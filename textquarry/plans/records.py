"""Registered queries over sessions, cards, events and samples, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import records as r
from ..operators.index import fixed_windows
from ..sources.tables import table


def _messages(spark, sf_dir):
    """Turns in order of writing, each conversation in one of three libraries."""
    m = table(spark, sf_dir, "conversations")
    return m.withColumn("ts", F.col("conv_id") * 1000 + F.col("turn")).withColumn("library", F.concat(F.lit("library"), F.pmod("conv_id", F.lit(3))))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.blank("text").alias("text"))


def _chunks(spark, sf_dir):
    return fixed_windows(table(spark, sf_dir, "documents"))


def _cards(spark, sf_dir):
    """A card per document: its first word, its length as importance, its first line as description."""
    d = table(spark, sf_dir, "documents")
    t = fx.blank("text")
    label = F.regexp_extract(t, "^([A-Za-z]+)", 1)
    kinds = F.array(F.lit("new"), F.lit("easy"), F.lit("medium"), F.lit("hard"), F.lit("odd"))
    return d.select(
        F.col("doc_id").alias("card_id"), label.alias("label"), F.substring_index(t, "\n", 1).alias("description"), F.col("n_chars").alias("importance"),
        F.col("source").alias("document"), F.array("source").alias("sources"), F.array("lang", "source").alias("tags"), (F.col("n_chars") * 7 % 1000).alias("updated_at"),
        F.get(kinds, F.pmod("doc_id", F.lit(5)).cast("int")).alias("difficulty"), label.alias("front"), F.regexp_extract(t, "([A-Za-z]+)[^A-Za-z]*$", 1).alias("back"),
    )


_CARDS = """cards AS (SELECT doc_id AS card_id, regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1) AS label, string_split(coalesce(text, ''), chr(10))[1] AS description, n_chars AS importance,
    source AS document, [source] AS sources, [lang, source] AS tags, n_chars * 7 % 1000 AS updated_at, ['new', 'easy', 'medium', 'hard', 'odd'][doc_id % 5 + 1] AS difficulty,
    regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1) AS front, regexp_extract(coalesce(text, ''), '([A-Za-z]+)[^A-Za-z]*$', 1) AS back FROM documents)"""
_CHUNKS = """x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), chunks AS (SELECT doc_id, i AS chunk_index, substr(t, i * 1800 + 1, 2000) AS chunk FROM (
    SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 200) / 1800), 1)::BIGINT)) AS i FROM x WHERE length(t) > 0))"""
_SENT = """s AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?;])', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s != '') AS ss FROM documents))"""


def session_rollup(spark, sf_dir):
    return r.session_rollup(_messages(spark, sf_dir))


def conversation_window(spark, sf_dir):
    return r.conversation_window(_messages(spark, sf_dir))


def session_preview(spark, sf_dir):
    return r.session_preview(_messages(spark, sf_dir))


def page_sessions(spark, sf_dir):
    return r.page_sessions(session_rollup(spark, sf_dir), 20, 10)


def reading_records(spark, sf_dir):
    """Each event reads a document, the one its value points to."""
    e = table(spark, sf_dir, "events").withColumn("document", F.concat(F.lit("doc"), (F.col("value") * 100).cast("long") % 50))
    return r.reading_records(e, ("doc13",))


def reading_history(spark, sf_dir):
    return r.reading_history(reading_records(spark, sf_dir), 50)


def continue_reading(spark, sf_dir):
    return r.continue_reading(reading_records(spark, sf_dir))


def card_dedup(spark, sf_dir):
    """Cards of sources that have a German document."""
    files = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("document")).distinct()
    return r.card_dedup(_cards(spark, sf_dir), files, ("the",)).select("card_id", "label", "importance", "document")


def card_upsert(spark, sf_dir):
    c = _cards(spark, sf_dir)
    stored = c.where("card_id % 2 = 0").withColumn("created_at", F.col("card_id") * 10)
    return r.card_upsert(stored, c.where("card_id % 3 != 0"), F.lit(7).cast("long"))


def list_cards(spark, sf_dir):
    return r.list_cards(_cards(spark, sf_dir), "TH", 25).select("card_id", "label", "importance", "updated_at", "total", "total_all")


def filter_cards(spark, sf_dir):
    return r.filter_cards(_cards(spark, sf_dir), "src3", "hard", "EN").select("card_id", "front", "back")


def review_state(spark, sf_dir):
    return r.review_state(r.import_cards(_cards(spark, sf_dir).where("false"), _cards(spark, sf_dir)))


def review_set(spark, sf_dir):
    return r.review_set(_cards(spark, sf_dir)).select("card_id", "difficulty")


def save_sessions(spark, sf_dir):
    """Every third conversation is saved again with its user turns only; the turns of each session afterwards."""
    m = _messages(spark, sf_dir)
    saved = r.save_sessions(m, m.where("conv_id % 3 = 0 AND role = 'user'"))
    return r.session_rollup(saved)


def import_cards(spark, sf_dir):
    c = _cards(spark, sf_dir).select("card_id", "front", "back", "difficulty")
    return r.import_cards(c.where("card_id % 2 = 0"), c.where("card_id % 2 = 1"))


def even_sample(spark, sf_dir):
    return r.even_sample(_chunks(spark, sf_dir), 4).select("doc_id", "chunk_index")


def sequential_segments(spark, sf_dir):
    return r.sequential_segments(_docs(spark, sf_dir)).select("doc_id", "segment", F.md5("piece").alias("piece_md5"))


def thesis_sample(spark, sf_dir):
    return r.thesis_sample(_docs(spark, sf_dir), 2000).select("doc_id", F.md5("sample").alias("sample_md5"))


def map_groups(spark, sf_dir):
    return r.map_groups(_chunks(spark, sf_dir))


def rebuild_text(spark, sf_dir):
    """Chunks of 2000 characters that share 100, put together again."""
    return r.rebuild_text(fixed_windows(table(spark, sf_dir, "documents"), 2000, 100)).select("doc_id", F.md5("text").alias("text_md5"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(fx.blank("text"), "\n", -1)).alias("line_no", "line"))


def attach_to_latest(spark, sf_dir):
    """Every line's latest line that starts with a capital vowel."""
    lines = _lines(spark, sf_dir)
    return r.attach_to_latest(lines, lines.where(F.col("line").rlike("^[AEIOU]")))


def bucket_headings(spark, sf_dir):
    return r.bucket_headings(_lines(spark, sf_dir))


def highlights(spark, sf_dir):
    return r.highlights(fx.sentences(_docs(spark, sf_dir))).select("doc_id", "place", F.md5("prefix").alias("prefix_md5"))


def merge_first_wins(spark, sf_dir):
    c = _cards(spark, sf_dir).select("label", "importance")
    return r.merge_first_wins([c.where("importance % 2 = 1"), c], "label")


def merge_concat(spark, sf_dir):
    c = _cards(spark, sf_dir).select("label", "importance")
    return r.merge_concat([c.where("importance % 2 = 1"), c]).groupBy("label").agg(F.count("*").alias("n"))


def dedup_labels(spark, sf_dir):
    return r.dedup_labels(_cards(spark, sf_dir).select("label", F.col("card_id").alias("ord")))


def map_rows(spark, sf_dir):
    """The number of words of every message; empty ones fail on their own."""
    from pyspark.sql.types import LongType

    def words(row):
        if not row["text"]:
            raise ValueError("empty")
        return len(row["text"].split(" "))

    return r.map_rows(_messages(spark, sf_dir).select("conv_id", "turn", "text"), words, LongType()).select("conv_id", "turn", F.col("result").alias("n_words"), "error")


def map_partitions_by_key(spark, sf_dir):
    import pandas as pd

    def last(pdf):
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "last_turn": [pdf["turn"].max()]})

    return r.map_partitions_by_key(_messages(spark, sf_dir).select("conv_id", "turn"), "conv_id", last, "conv_id long, last_turn long")


_MESSAGES = "m AS (SELECT *, conv_id * 1000 + turn AS ts, 'library' || (conv_id % 3) AS library FROM conversations)"
_ROLLED = """SELECT conv_id, arg_max(library, ts) AS library, min(ts) AS created, max(ts) AS updated, count(*) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user,
    sum(length(text)) AS n_chars FROM m GROUP BY conv_id"""
_ROLL = f"WITH {_MESSAGES} {_ROLLED}"
_READ = """SELECT user_id, 'doc' || (trunc(value * 100)::BIGINT % 50) AS document, min(ts) AS first_read, max(ts) AS last_read, count(*) AS read_count FROM events
    WHERE 'doc' || (trunc(value * 100)::BIGINT % 50) != 'doc13' GROUP BY ALL"""
QUERIES = {
    "session_rollup": (session_rollup, _ROLL),
    "save_sessions": (save_sessions, f"WITH {_MESSAGES} {_ROLLED}".replace("FROM conversations", "FROM conversations WHERE conv_id % 3 != 0 OR role = 'user'")),
    "conversation_window": (conversation_window, """WITH a AS (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS asked FROM conversations),
        h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM a WHERE turn < asked AND trim(coalesce(text, ''), ' ') != ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id, 'question' AS part, turn, 1 AS back, role, text FROM a WHERE turn = asked UNION ALL SELECT conv_id, 'history', turn, back, role, substr(text, 1, 300) FROM h WHERE back <= 8
        UNION ALL SELECT conv_id, 'recent', turn, back, role, substr(text, 1, 200) FROM r WHERE back <= 6"""),
    "session_preview": (session_preview, """SELECT conv_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS preview FROM (
        SELECT conv_id, regexp_replace(arg_max(text, turn), '[\\r\\n]', ' ', 'g') AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)"""),
    "page_sessions": (page_sessions, f"SELECT * FROM ({_ROLL}) ORDER BY updated DESC, conv_id DESC LIMIT 20 OFFSET 10"),
    "reading_records": (reading_records, _READ),
    "reading_history": (reading_history, f"SELECT *, (SELECT count(*) FROM ({_READ})) AS total FROM ({_READ}) ORDER BY last_read DESC, read_count DESC, first_read, user_id, document LIMIT 50"),
    "continue_reading": (continue_reading, f"SELECT *, 'read recently' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_read DESC, document) AS place FROM ({_READ})) WHERE place <= 5"),
    "card_dedup": (card_dedup, f"""WITH {_CARDS} SELECT card_id, label, importance, document FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY importance DESC, card_id) AS rn
        FROM cards WHERE length(trim(label)) > 1 AND lower(trim(label)) != 'the' AND document IN (SELECT source FROM documents WHERE lang = 'de')) WHERE rn = 1"""),
    "card_upsert": (card_upsert, f"WITH {_CARDS} SELECT card_id, label, importance, CASE WHEN card_id % 2 = 0 THEN card_id * 10 ELSE 7 END AS created_at, 7::BIGINT AS updated_at FROM cards WHERE card_id % 3 != 0"),
    "list_cards": (list_cards, f"""WITH {_CARDS}, p AS (SELECT * FROM cards WHERE contains(lower(label), 'th') OR contains(lower(description), 'th') ORDER BY importance DESC, label, updated_at DESC, card_id LIMIT 25)
        SELECT card_id, label, importance, updated_at, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM cards) AS total_all FROM p"""),
    "filter_cards": (filter_cards, f"""WITH {_CARDS} SELECT card_id, front, back FROM cards WHERE document = 'src3' AND difficulty = 'hard'
        AND (contains(lower(front), 'en') OR contains(lower(back), 'en') OR len(list_filter(tags, lambda t: contains(lower(t), 'en'))) > 0)"""),
    "review_state": (review_state, f"""WITH {_CARDS}, k AS (SELECT document, CASE WHEN difficulty = 'odd' THEN 'new' ELSE difficulty END AS difficulty FROM (
        SELECT *, row_number() OVER (PARTITION BY front, back ORDER BY card_id) AS rn FROM cards WHERE trim(front) != '' AND trim(back) != '') WHERE rn = 1)
        SELECT document, {', '.join(f"count(*) FILTER (WHERE difficulty = '{k}') AS {k}" for k in ('new', 'easy', 'medium', 'hard'))}, count(*) AS cards,
        count(*) FILTER (WHERE difficulty IN ('medium', 'hard')) AS review FROM k GROUP BY document"""),
    "review_set": (review_set, f"WITH {_CARDS} SELECT card_id, difficulty FROM cards WHERE difficulty IN ('medium', 'hard')"),
    "import_cards": (import_cards, f"""WITH {_CARDS}, st AS (SELECT card_id, front, back, difficulty FROM cards WHERE card_id % 2 = 0),
        im AS (SELECT *, row_number() OVER (PARTITION BY front, back ORDER BY card_id) AS rn FROM cards WHERE card_id % 2 = 1 AND front != '' AND back != '')
        SELECT *, 1 AS place FROM st UNION ALL SELECT card_id, front, back, CASE WHEN difficulty = 'odd' THEN 'new' ELSE difficulty END, 0 FROM im
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM st WHERE st.front = im.front AND st.back = im.back)"""),
    "even_sample": (even_sample, f"""WITH {_CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
        SELECT DISTINCT doc_id, CASE WHEN n <= 4 THEN i ELSE round_even(i * (n - 1) / 3, 0)::BIGINT END AS chunk_index FROM (SELECT doc_id, n, unnest(range(0, least(n, 4))) AS i FROM n)"""),
    "sequential_segments": (sequential_segments, """WITH p AS (SELECT doc_id, text AS t, length(text) AS n, CASE WHEN length(text) <= 12000 THEN 1 WHEN length(text) <= 300000 THEN 4 WHEN length(text) <= 800000 THEN 6 ELSE 8 END AS parts
        FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, i AS segment, substr(t, (i * ceil(n / parts) + 1)::BIGINT, ceil(n / parts)::BIGINT) AS piece FROM (SELECT *, unnest(range(0, parts)) AS i FROM p))
        SELECT doc_id, segment, md5(CASE WHEN length(piece) > 12000 THEN substr(piece, 1, 4800) || chr(10) || '...' || chr(10) || substr(piece, trunc((length(piece) - 3600) / 2 + 1)::BIGINT, 3600) || chr(10) || '...' || chr(10)
        || substr(piece, length(piece) - 3599, 3600) ELSE piece END) AS piece_md5 FROM s WHERE length(piece) > 0"""),
    "thesis_sample": (thesis_sample, """WITH p AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, md5(CASE WHEN n > 2000 THEN substr(substr(t, 1, (n * 15 // 100)) || chr(10) || substr(t, (n * 35 // 100) + 1, (n * 25 // 100)) || chr(10)
        || substr(t, n - (n * 15 // 100) + 1, (n * 15 // 100)), 1, 2000) ELSE t END) AS sample_md5 FROM p"""),
    "map_groups": (map_groups, f"""WITH {_CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks), k AS (SELECT *, CASE WHEN n <= 100 THEN 3 WHEN n <= 600 THEN 4 WHEN n <= 2000 THEN 5 ELSE 6 END AS k FROM n),
        g AS (SELECT doc_id, chunk_index, len(list_filter(range(1, k + 1), lambda g: round_even(g * n / k, 0) <= chunk_index)) AS grp FROM k),
        z AS (SELECT doc_id, grp, count(*) AS n, min(chunk_index) AS start FROM g GROUP BY ALL)
        SELECT DISTINCT doc_id, start + CASE WHEN n <= 8 THEN i ELSE round_even(i * (n - 1) / 7, 0)::BIGINT END AS chunk_index, grp FROM (SELECT *, unnest(range(0, least(n, 8))) AS i FROM z)"""),
    "rebuild_text": (rebuild_text, """WITH c AS (SELECT doc_id, i, substr(text, i * 1900 + 1, 2000) AS chunk FROM (
        SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 100) / 1900), 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)),
        b AS (SELECT *, coalesce(lag(chunk) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM c),
        f AS (SELECT *, coalesce(list_max(list_filter(range(8, 121), lambda n: length(before) >= n AND length(chunk) >= n AND substr(chunk, 1, n) = right(before, n))), 0) AS cut FROM b)
        SELECT doc_id, md5(string_agg(substr(chunk, cut + 1), chr(10) ORDER BY i)) AS text_md5 FROM f GROUP BY doc_id"""),
    "attach_to_latest": (attach_to_latest, """WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))
        SELECT doc_id, line_no, max(CASE WHEN regexp_matches(line, '^[AEIOU]') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS owner FROM l"""),
    "bucket_headings": (bucket_headings, """WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), i AS (SELECT doc_id, n, unnest(range(0, n)) AS line_no FROM l)
        SELECT doc_id, line_no, CASE WHEN n > 12 THEN floor(line_no / ceil(n / least(6, ceil(n / 8))))::BIGINT ELSE 0 END AS bucket FROM i"""),
    "highlights": (highlights, f"""WITH {_SENT}, p AS (SELECT doc_id, substr(trim(regexp_replace(sentence, '[ \\t]+', ' ', 'g'), ' '), 1, 100) AS prefix, min(pos) AS pos FROM s GROUP BY ALL)
        SELECT doc_id, place, md5(prefix) AS prefix_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM p) WHERE place <= 3"""),
    "merge_first_wins": (merge_first_wins, f"WITH {_CARDS} SELECT label, coalesce(min(importance) FILTER (WHERE importance % 2 = 1), min(importance)) AS importance FROM cards GROUP BY label"),
    "merge_concat": (merge_concat, f"WITH {_CARDS} SELECT label, count(*) + count(*) FILTER (WHERE importance % 2 = 1) AS n FROM cards GROUP BY label"),
    "dedup_labels": (dedup_labels, f"WITH {_CARDS} SELECT lower(label) AS key, arg_min(label, card_id) AS label, min(card_id) AS ord FROM cards GROUP BY 1"),
    "map_rows": (map_rows, "SELECT conv_id, turn, CASE WHEN text != '' THEN len(string_split(text, ' ')) END AS n_words, CASE WHEN coalesce(text, '') = '' THEN 'ValueError: empty' END AS error FROM conversations"),
    "map_partitions_by_key": (map_partitions_by_key, "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id"),
}
