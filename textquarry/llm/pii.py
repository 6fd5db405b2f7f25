"""Personal data in documents, by DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs),
and words shortly before a span, or after it up to the next span of its kind, adjust its score. Everything is a projection of the row: no
shuffle, no Python on the executors, and a row's work does not depend on other rows.

Null texts count as empty; empty texts give zero counts and empty strings; repeated rows and
null ids pass through, extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import digest, located, matches, tagged

# The possessive quantifiers and look-behinds make each pattern linear in the text's length
# without changing what it matches: a run of pattern characters is tried at its start (or where
# the last match ended), because a later start inside the run fails or succeeds with it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: Words that make a kind likelier when they stand shortly before or after a span.
CONTEXT = {
    "email": "(?i)mail|contact|write",
    "ip": "(?i)address|host|server|(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)",
    "card": "(?i)card|visa|credit|payment",
    "phone": "(?i)phone|call|mobile|fax|(?:^|[^a-z0-9])tel(?:[^a-z0-9]|$)",
    "iban": "(?i)iban|account|bank|transfer",
    "ssn": "(?i)ssn|social security",
}
#: Score of a span of each kind before context, and with its checksum confirmed.
BASE_SCORE = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT_BONUS = 0.2
#: The two added kinds are reported from this score on.
MIN_SCORE = 0.6
CONTEXT_CHARS = 40
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(acc, i):
        d = F.substring(number, (n - i + 1).cast("int"), F.lit(1)).cast("int")
        twice = d * 2
        return (acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN-shaped string leaves 1 when its rearranged digits are divided by 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(acc, i):
        c = F.substring(turned, i.cast("int"), F.lit(1))
        digit = c.rlike("[0-9]")
        value = F.when(digit, c.cast("int")).otherwise(F.ascii(c) - 55)
        return ((acc * F.when(digit, F.lit(10)).otherwise(F.lit(100)) + value) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _confirmed(kind: str, spans: Column) -> Column:
    if kind == "ip":
        byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.filter(spans, lambda s: s["text"].rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
    if kind == "card":
        return F.filter(spans, lambda s: F.length(_digits(s["text"])).between(16, 19) & luhn(_digits(s["text"])))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(_digits(s["text"])).between(8, 15))
    if kind == "iban":
        return F.filter(spans, lambda s: mod97(s["text"]))
    return spans


def _score(kind: str, span: Column) -> Column:
    near = span["before"].rlike(CONTEXT[kind]) | span["after"].rlike(CONTEXT[kind])
    return F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, text, and per kind an array of (start, end, text, score) spans.

    The four base kinds are kept whatever their score; ``iban`` and ``ssn`` need MIN_SCORE.
    Ties cannot occur within a kind (its spans do not overlap); kinds may overlap each other.
    """
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    out = out.select("*", *(matches(text, p).alias(f"m_{k}") for k, p in patterns.items()))
    # A card's pattern also meets every number of two digits; only texts with a long enough
    # run of digits are split and located.
    wanted = {"card": F.exists("m_card", lambda m: F.length(m) >= 16)}
    empty = F.array().cast("array<string>")
    out = out.select(
        id_col, "text",
        *((F.when(wanted[k], F.col(f"m_{k}")).otherwise(empty) if k in wanted else F.col(f"m_{k}")).alias(f"m_{k}") for k in patterns),
    )
    out = out.select(id_col, "text", *(_confirmed(k, located(text, F.col(f"m_{k}"), p, CONTEXT_CHARS)).alias(k) for k, p in patterns.items()))

    def scored(kind):
        spans = F.transform(kind, lambda s: F.struct(s["start"], s["end"], s["text"], _score(kind, s).alias("score")))
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)

    return out.select(id_col, "text", *(scored(k).alias(k) for k in patterns))


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of ``find_pii``."""
    base = F.concat(*(tagged(k, F.col(k)) for k in BASE_KINDS))
    every = F.concat(*(tagged(k, F.col(k)) for k in KINDS))
    strong = F.concat(*(F.filter(k, lambda s: s["score"] >= 0.8) for k in KINDS))
    return found.select(
        id_col,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.size(strong).cast("long").alias("n_strong"),
        digest(base).alias("base_sha256"),
        F.concat_ws(",", every).alias("spans"),
    )
