"""Token counts without token ids.

A byte-level BPE tokenizer never merges across pre-tokens, so a text's count is the sum of its
pre-tokens' counts. The job

1. counts every pre-token over the whole corpus (combined before the shuffle),
2. lets the tokenizer count the pieces of each *distinct* pre-token once,
3. joins those counts to the per-document pre-token frequencies and sums.

The most frequent pre-tokens (a third of all rows may be one of them) never travel: the head of
the table, at most HEAD_ROWS rows of at most HEAD_CHARS characters and so of bounded size, is
broadcast, and documents sum it before the shuffle. All other pre-tokens are joined by shuffle;
none of them is frequent, so that join has no hot key.

The tokenizer's character classes are of a later Unicode version than Java's. Over all code points they
differ only in characters that Java does not know (class Cn); for these the pattern asks the tokenizer's.
"""

from __future__ import annotations

import os
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: White space as Unicode lists it (Java's own class is ASCII only, and has no U+0085).
WS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The tokenizer's one special string; inside texts it is one token and separates segments.
SPECIAL = r"<\|endoftext\|>"
HEAD_ROWS = 262_144
HEAD_CHARS = 64


@cache
def newer(path: str) -> tuple[str, str]:
    """The letters and the numbers of the tokenizer at ``path`` as ranges of a Java character class.

    Each code point is asked between a letter and a digit. Planes 4 to 16 hold no letters or numbers.
    """
    from tokenizers import Tokenizer

    points = [i for i in range(0x40000) if not 0xD800 <= i <= 0xDFFF]
    probe = "".join(f"a{chr(i)}1\n" for i in points)
    starts = {at for _, (at, _) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(probe)}
    letters = [c for k, c in enumerate(points) if 4 * k + 1 not in starts]
    numbers = [c for k, c in enumerate(points) if 4 * k + 1 in starts and 4 * k + 2 not in starts]

    def ranges(found):
        edges = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
        ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
        return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(edges, ends, strict=True))

    return ranges(letters), ranges(numbers)


def pattern(path: str) -> str:
    """The byte-level pre-tokenizer's pattern for Java.

    The ranges are looked at for characters alone that Java does not know, so others cost nothing more.
    """
    letters, numbers = newer(path)
    letter, number = rf"[\p{{L}}[\p{{Cn}}&&[{letters}]]]", rf"[\p{{N}}[\p{{Cn}}&&[{numbers}]]]"
    other = rf"[[^{WS}\p{{L}}\p{{N}}]&&[\P{{Cn}}[^{letters}{numbers}]]]"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{WS}]+(?![^{WS}])|[{WS}]+"


def pretokens(text: Column, path: str) -> Column:
    """array<string> of the pre-tokens of ``text`` as the tokenizer at ``path`` cuts it, special strings cut out."""
    cut = F.lit(pattern(path))
    return F.when(
        F.contains(text, F.lit("<|endoftext|>")),
        F.flatten(F.transform(F.split(text, SPECIAL, -1), lambda s: F.regexp_extract_all(s, cut, F.lit(0)))),
    ).otherwise(F.regexp_extract_all(text, cut, F.lit(0)))


def _count_pieces(path: str):
    def run(frames):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for pdf in frames:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                found = tokenizer.encode_batch(part["tok"].tolist(), add_special_tokens=False)
                yield part.assign(pieces=[len(e.ids) for e in found])

    return run


def piece_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(tok, freq, pieces): every distinct pre-token of the corpus, its frequency and its piece count."""
    tok = docs.select(F.explode(pretokens(whole_text(text_col), path)).alias("tok"))
    freq = tok.groupBy("tok").agg(F.count("*").alias("freq"))
    return saved(freq.mapInPandas(_count_pieces(path), "tok string, freq long, pieces long"), "pieces")


def head_of(pieces: DataFrame, rows: int = HEAD_ROWS) -> DataFrame:
    """The most frequent pre-tokens, at most ``rows``: those from a frequency on.

    The frequency comes from a histogram over half-octaves, so no sort and no task sees the table.
    """
    octave = F.floor(F.log2("freq") * 2).cast("int")
    hist = pieces.where(F.length("tok") <= HEAD_CHARS).groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect()
    cut, n = None, 0
    for r in hist:  # at most 130 rows
        n += r["count"]
        if n > rows:
            break
        cut = r["o"]
    if cut is None:
        return pieces.limit(0)
    return pieces.where((F.length("tok") <= HEAD_CHARS) & (octave >= cut))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", head_rows: int = HEAD_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens as the tokenizer at ``path`` counts.

    Null texts count as empty (0 tokens). Rows that repeat an id and text are counted once and
    given back as often as they came; rows that share an id but not the text stay apart. An
    empty table gives an empty table; extra columns are not read.
    """
    pieces = piece_table(docs, path, text_col)
    head = head_of(pieces, head_rows)
    text = whole_text(text_col)
    special = F.when(F.contains(text, F.lit("<|endoftext|>")), F.size(F.split(text, SPECIAL, -1)) - 1).otherwise(0).cast("long")
    # What a row has of itself is carried by a leading entry that no pre-token can equal (digits
    # never share one with a control character) and that differs from row to row.
    own = F.coalesce(F.concat(F.lit("\0"), F.col(id_col).cast("string")), F.lit("\0"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), special.alias("special"), F.octet_length(text).cast("long").alias("size"),
        F.concat(F.array(own), pretokens(text, path)).alias("toks"),
    )
    each = rows.select("id", "h", "special", "size", F.posexplode("toks").alias("pos", "tok"))
    each = each.join(F.broadcast(head.select("tok", "pieces")), "tok", "left")
    first = F.col("pos") == 0
    # Head pre-tokens are summed into the row's own entry at once; the others keep their frequency.
    each = each.select(
        "id", "h",
        F.when(first | F.col("pieces").isNotNull(), F.coalesce(F.concat(F.lit("\0"), F.col("id").cast("string")), F.lit("\0"))).otherwise(F.col("tok")).alias("tok"),
        F.when(first, F.col("special")).otherwise(F.coalesce("pieces", F.lit(1))).alias("n"),
        F.when(first, F.col("size")).otherwise(0).alias("size"), F.when(first, 1).otherwise(0).alias("row"),
    )
    freq = each.groupBy("id", "h", "tok").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("row").alias("row"))
    total = freq.join(pieces.select("tok", "pieces"), "tok", "left").groupBy("id", "h")
    total = total.agg(F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n"), F.sum("size").alias("size"), F.sum("row").alias("row"))
    per_row = lambda c: (F.col(c) / F.col("row")).cast("long")
    back = total.select("id", per_row("size").alias("n_bytes"), per_row("n").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "row")))
    return back.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
