"""Secrets in documents, by DataFrame functions alone.

Three base patterns propose assignments, access keys and hexadecimal strings. Beyond them,
long candidate strings are slid over with a window of WINDOW characters; the window's Shannon
entropy is kept by incremental counts (one character enters, one leaves), per class of
characters (hex, base64), and a candidate counts when the best window passes its class's
bound and no allow-list rule suppresses it.

Entropies are whole numbers: with c log2 c rounded to millionths in a table, adding and
removing characters is exact and every engine gets the same sums.

Null texts count as empty; empty texts give zero counts and empty strings; repeated rows and null
ids pass through, extra columns are not read; an empty table gives an empty table. Spans of one kind
cannot tie, as they do not overlap; of several kinds that start together the first listed comes first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, digest, let, located, matches

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
# {16,} and {24,} match just the runs that pass the length checks: a pattern's first start in a
# run takes the whole run, and a later start in it would be shorter still.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Characters that are counted; the class decides which bound holds.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: c * log2(c) in millionths, for counts 0 to WINDOW.
CLOGC = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
#: A window's entropy in bits is log2(WINDOW) - sum(c log2 c) / WINDOW; these are the largest
#: sums that still count, in millionths.
BOUND_BITS = {"hex": 3.05, "base64": 3.85}
BOUND = {k: round(1e6 * WINDOW * (math.log2(WINDOW) - bits)) for k, bits in BOUND_BITS.items()}
#: Strings of these shapes are never secrets.
ALLOW = (
    r"^[A-Za-z]+$",  # a long word
    r"^[0-9]+$",  # a number
    r"(?i)example|sample|placeholder|changeme",
    r"^[=_/+-]+$",  # a ruler
    r"^(?:[a-z]++[-_/])++[a-z]++$",  # slugs and paths
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")


def least_sum(candidate: Column) -> Column:
    """Least sum of c log2 c (millionths) over the windows of ``candidate``; the table's end if shorter.

    The candidate is cut into character codes once; in each step the counts of the two characters that
    enter and leave change and the row of some 80 counts is written anew, so the work is in proportion to the length.
    """
    first, last = ord(min(ALPHABET)), ord(max(ALPHABET))
    table = F.lit(CLOGC)
    zero = F.array_repeat(F.lit(0), last - first + 1)
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - first)

    def step(code, acc, i):
        enters, leaves = F.get(code, i), F.get(code, i - WINDOW)  # none leaves before the window is full
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        n, m = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
        grown = F.get(table, n + 1) - F.get(table, n)
        shrunk = F.coalesce(F.get(table, m - 1) - F.get(table, m), F.lit(0))
        s = F.when(enters.eqNullSafe(leaves), acc["s"]).otherwise(acc["s"] + grown + shrunk)
        best = F.when(i >= WINDOW, F.least(acc["best"], acc["s"])).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), s.cast("int").alias("s"), best.cast("int").alias("best"))

    start = F.struct(zero.alias("counts"), F.lit(0).alias("s"), F.lit(CLOGC[-1]).alias("best"))
    end = lambda n: lambda acc: F.when(n >= WINDOW, F.least(acc["best"], acc["s"])).otherwise(acc["best"])
    return let(codes, lambda code: F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, lambda acc, i: step(code, acc, i), end(F.size(code))))


def suppressed(candidate: Column) -> Column:
    """Whether an allow-list rule says that ``candidate`` is no secret."""
    out = F.lit(False)
    for rule in ALLOW:
        out = out | candidate.rlike(rule)
    return out


def _mixed(c: Column) -> Column:
    """Letters and digits both occur: words and numbers alone are not keys."""
    return c.rlike("[0-9]") & c.rlike("[A-Za-z]")


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, text and an array of (start, end, text) spans per kind.

    Spans of one kind do not overlap; kinds may overlap each other.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    text = F.col("text")
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select(
        "*", matches(text, ASSIGN).alias("m_assign"), matches(text, ACCESS).alias("m_access"),
        matches(text, HEX).alias("m_hex"), matches(text, CANDIDATE).alias("m_entropy"),
    )
    likely = F.exists("m_entropy", lambda c: _mixed(c) & ~suppressed(c))
    out = out.select(
        id_col, "text", "m_assign", "m_access", "m_hex",
        F.when(likely, F.col("m_entropy")).otherwise(F.array().cast("array<string>")).alias("m_entropy"),
    )
    spans = {k: located(text, F.col(f"m_{k}"), p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))}
    out = out.select(id_col, "text", *(s.alias(k) for k, s in spans.items()))
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6)
    maybe = F.filter("entropy", lambda s: _mixed(s["text"]) & ~suppressed(s["text"]))
    out = out.select(id_col, "text", long_enough.alias("assign"), "access", "hex", maybe.alias("entropy"))
    bound = lambda c: F.when(c.rlike("^[0-9a-fA-F]+$"), F.lit(BOUND["hex"])).otherwise(F.lit(BOUND["base64"]))
    strong = F.filter("entropy", lambda s: least_sum(s["text"]) <= bound(s["text"]))
    return out.select(id_col, "text", "assign", "access", "hex", F.when(F.size("entropy") > 0, strong).otherwise(empty).alias("entropy"))


def _ordered(kinds) -> Column:
    """``kind:start:end`` of the spans of ``kinds`` by start, then kind as listed."""
    def keyed(n, kind):
        tag = lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), tag(s).alias("tag")))

    every = F.concat(*(keyed(n, kind) for n, kind in enumerate(kinds)))
    return F.transform(F.array_sort(every), lambda x: x["tag"])


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of ``find_secrets``."""
    return found.select(
        id_col,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        digest(_ordered(BASE_KINDS)).alias("base_sha256"),
        F.concat_ws(",", _ordered(KINDS)).alias("spans"),
    )
