"""Text functions as DataFrame columns: cleaning, gates, routing, headings, keys.

Every function takes and gives columns (or adds columns to a DataFrame), runs inside code
generation and needs no shuffle. Null texts count as empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import HAN, LATIN, Profile


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(text: Column | str) -> Column:
    return F.coalesce(_c(text), F.lit(""))


def share(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match the class ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def infer_domain(name: Column | str, profile: Profile = LATIN, default: str = "default") -> Column:
    """B1: the first domain whose keywords occur in a file's name."""
    out = F.lit(default)
    for label, pattern in reversed(profile.domains):
        out = F.when(F.lower(blank(name)).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def match_files(name: Column | str, filters: list[str]) -> Column:
    """B2: the name is in the list, or contains an entry of at least 10 characters; an empty list keeps all."""
    if not filters:
        return F.lit(True)
    hit = blank(name).isin(filters)
    for f in filters:
        if len(f) >= 10:
            hit = hit | F.contains(blank(name), F.lit(f))
    return hit


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.translate(blank(path), "\\", "/"), "/", -1)


def same_file(a: Column | str, b: Column | str) -> Column:
    """Equal ids, or equal base names whatever the slashes."""
    return (blank(a) == blank(b)) | (base_name(a) == base_name(b))


def clean_text(text: Column | str, profile: Profile = LATIN) -> Column:
    """Drop page marks, notices and lone page numbers, squeeze blank lines, trim."""
    out = blank(text)
    for pattern in profile.cleanup:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, "\n{4,}", "\n\n\n")
    out = F.regexp_replace(out, "(?m)^[ \t]*[0-9]{1,4}[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(out, "^[ \t\r\n]+", ""), "[ \t\r\n]+$", "")


#: Signs that extraction leaves behind: replacement character, private use area, zero-width marks.
STRAY = "[\\x{fffd}\\x{e000}-\\x{f8ff}\\x{200b}\\x{feff}]"


def preprocess(text: Column | str, profile: Profile = LATIN) -> Column:
    """Drop stray glyphs, page marks and book numbers, and end marks, dates, footnotes and page numbers on lines of their own.

    Inline bullets become list lines, and a lone Y that stands for a check mark at a line's end goes.
    """
    out = F.regexp_replace(blank(text), STRAY, "")
    for pattern in profile.preprocess:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, "\n{4,}", "\n\n\n")
    out = F.regexp_replace(out, "(?m)^ {4,}", "  ")
    out = F.regexp_replace(out, "([^ \t\r\n])[ \t]*•[ \t]*", "$1\n- ")
    return F.regexp_replace(out, f"(?m)([{profile.orphan}])Y([ \t]*)$", "$1$2")


def garbled_ratio(text: Column | str) -> Column:
    """Share of characters that are neither Han, ASCII nor full-width, of those that are not space or punctuation."""
    seen = F.regexp_replace(blank(text), "[ \t\r\n.,;:!?，。；：！？“”‘’（）()【】\\[\\]《》、—…·]", "")
    odd = F.regexp_replace(seen, "[ -~\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{ff01}-\\x{ff5e}]", "")
    return F.length(odd) / F.greatest(F.length(seen), F.lit(1))


def script_gate(text: Column | str, char_class: str = "[\\x{4e00}-\\x{9fff}]", least: float = 0.3) -> Column:
    """Blank, or more than ``least`` of all characters are of the class."""
    t = blank(text)
    return (F.trim(t) == "") | (share(t, char_class) / F.greatest(F.length(t), F.lit(1)) > least)


#: Fixed values of the Latin branch of the concept gate.
CONCEPT_WHITELIST = ("transformer", "attention", "embedding", "retrieval")
GENERIC_LABELS = ("the", "and", "this", "that", "with", "from", "chapter", "page", "table")


#: Fixed values of the Han branch of the concept gate: characters that open, close or fill a fragment of a sentence.
HAN_START = "的了是但而并且也都就还这那们等若如之其所将把让没很更最我你他她它"
HAN_END = "的了是在但而并且也都就还这那们个次件名等着过上下中回吗呢吧与其之"
HAN_INSIDE = "的了是在和与及或但而且并也都就还这那们个种等若如之与其所对从向被把让使着过很更最些次件名位"


def valid_concept(label: Column | str, generic: tuple[str, ...] = ()) -> Column:
    """The gate of concept labels.

    Latin labels: whitelist, acronym, inner capital, or letters with digits; 2 to 40 characters, not generic.
    Labels with a Han character: 2 to 16 characters that neither open nor close like a fragment, with at most
    one function character (of four characters none in the middle) and no word of ``generic`` in them.
    """
    c = F.trim(blank(label))
    shape = (
        F.lower(c).isin(*CONCEPT_WHITELIST) | c.rlike("^[A-Z]{2,8}$") | c.rlike("^[A-Za-z]*[a-z][A-Z][A-Za-z]*$")
        | (c.rlike("[A-Za-z]") & c.rlike("[0-9]") & c.rlike("^[A-Za-z0-9-]+$"))
    )
    latin = F.length(c).between(2, 40) & ~F.lower(c).isin(*GENERIC_LABELS) & shape
    fragment = c.rlike(f"^[{HAN_START}]|[{HAN_END}]$") | c.rlike(f"[{HAN_INSIDE}].*[{HAN_INSIDE}]")
    fragment = fragment | ((F.length(c) == 4) & F.substring(c, 2, 2).rlike(f"[{HAN_INSIDE}]"))
    for word in generic:
        fragment = fragment | F.contains(c, F.lit(word))
    return F.when(c.rlike(f"[{HAN}]"), F.length(c).between(2, 16) & ~fragment).otherwise(latin)


def clean_label(label: Column | str) -> Column:
    """Markup characters become spaces, spaces are squeezed; null unless 2 to 60 characters with a letter."""
    c = F.trim(F.regexp_replace(F.regexp_replace(blank(label), "[#*`_>|~\\[\\](){}<\"']", " "), "[ \t\r\n]+", " "))
    return F.when(F.length(c).between(2, 60) & ~c.rlike("^[0-9 .,;:!?%/+-]*$"), c)


def route_questions(queries: DataFrame, text: str = "text", profile: Profile = LATIN) -> DataFrame:
    """One flag per route; ``is_single_overview`` is the overview flag where one document is chosen."""
    flags = {k: blank(text).rlike(p) for k, p in profile.routes.items()}
    single = flags["is_overview"] | blank(text).rlike(profile.single) | flags["is_enumerate"]
    return queries.withColumns(flags | {"is_single_overview": single})


def narrative_expand(question: Column | str, profile: Profile = LATIN) -> Column:
    """The first of the longest terms of a narrative question that are no stopwords, and the history vocabulary; null for others."""
    terms = query_terms(question, profile)
    most = F.array_max(F.transform(terms, lambda t: F.length(t)))
    entity = F.get(F.filter(terms, lambda t: F.length(t) == most), F.lit(0))
    return F.when(blank(question).rlike(profile.routes["is_narrative"]) & entity.isNotNull(), F.concat_ws(" ", entity, *(F.lit(w) for w in profile.history)))


def refine_query(text: Column | str, qualifiers: tuple[str, ...] = ("author", "history", "summary", "review", "meaning")) -> Column:
    """The quoted title and the first qualifier in it, else the first 30 characters."""
    t = blank(text)
    name = F.regexp_extract(t, "《([^》]+)》", 1)
    extra = F.lit("")
    for q in reversed(qualifiers):
        extra = F.when(F.contains(F.lower(t), F.lit(q)), F.lit(" " + q)).otherwise(extra)
    return F.when(name != "", F.concat(name, extra)).otherwise(F.substring(t, 1, 30))


def infer_category(label: Column | str, profile: Profile = LATIN, novel: bool = False) -> Column:
    """The first category whose pattern the label matches, persons between locations and events, else ``concept``."""
    out = F.lit("concept")
    for name, pattern in reversed(profile.categories):
        out = F.when(F.lower(blank(label)).rlike(pattern), F.lit(name)).otherwise(out)
        if name == "event":
            out = F.when(is_person(label, profile, novel), F.lit("person")).otherwise(out)
    return out


def is_person(label: Column | str, profile: Profile = LATIN, novel: bool = False) -> Column:
    """A title and a name; or 2 to 4 Han characters from a surname on (in novels any 3 or 4), not ending like a noun."""
    t = blank(label)
    if profile.titles:
        return t.rlike(profile.titles)
    han = t.rlike(f"^[{HAN}]{{2,4}}$") & ~t.rlike(f"[{profile.noun_ends}]$")
    return han & (t.rlike(f"^[{profile.surnames}]") | (F.lit(novel) & (F.length(t) >= 3)))


def detect_doc_type(text: Column | str, profile: Profile = LATIN) -> Column:
    """Academic with at least 3 hint words in the first 3000 characters and over 1.5 times the novel's; novel with at least 4 and more; else general."""
    head = F.lower(F.substring(blank(text), 1, 3000))
    count = lambda hints: sum((F.contains(head, F.lit(h)).cast("int") for h in hints), F.lit(0))
    a, n = count(profile.academic), count(profile.novel)
    return F.when((a >= 3) & (a > 1.5 * n), "academic").when((n >= 4) & (n > a), "novel").otherwise("general")


def heading_level(line: Column | str, profile: Profile = LATIN) -> Column:
    """Level of a heading line, null for body lines.

    Markdown hashes give their number; ``Chapter n`` 1 and ``Part n`` 0; ``1.2 Title`` its depth up
    to 3; ``1. Title`` 2; special sections 1.
    """
    t = F.trim(blank(line))
    end = t.rlike("[。！？，,：:；;.!?]$")
    return (
        F.when(t.rlike("^#{1,6}[ \t]+[^ \t]"), F.length(F.regexp_extract(t, "^(#{1,6})", 1)))
        .when(t.rlike("(?i)^part +[0-9]+") & (F.length(t) < 200) & ~end, 0)
        .when(t.rlike("(?i)^chapter +[0-9]+") & (F.length(t) < 200) & ~t.rlike("(?i)^chapter +[0-9]+ *[,，]"), 1)
        .when(t.rlike("^第[ ]*[一二三四五六七八九十百0-9]+[ ]*[部篇卷]") & (F.length(t) < 200), 0)
        .when(t.rlike("^第[ ]*[一二三四五六七八九十百0-9]+[ ]*[章节回课分]") & (F.length(t) < 200) & ~t.rlike("^第[^章节回课分]*[章节回课分] *[，,]"), 1)
        .when(t.rlike("^[0-9]+(\\.[0-9]+){1,3}[ \t]+[^ \t]") & (F.length(t) < 60) & ~t.rlike("[。！？，,：:；;]"),
              F.least(F.lit(3), F.length(F.regexp_replace(F.regexp_extract(t, "^([0-9.]+)", 1), "[0-9]", "")) + 1))
        .when(t.rlike("^[0-9]+\\.[ \t]+[^。，,！!？?：:；;、]+$") & (F.length(t) < 30), 2)
        .when(t.isin(*profile.special), 1)
        .cast("int")
    )


def valid_volume_title(title: Column | str) -> Column:
    """2 to 20 characters, no closing punctuation, no date or figure label, at least 2 letters."""
    t = F.trim(blank(title))
    return (
        F.length(t).between(2, 20) & ~t.rlike("[.,;:!?。，；：！？]$") & ~t.rlike("(?i)^(fig|figure|table|图|表)")
        & ~t.rlike("[0-9]{4}[-/年]") & (F.length(F.regexp_replace(t, "[^A-Za-z\\x{4e00}-\\x{9fff}]", "")) >= 2)
    )


def sentence_array(text: Column | str, profile: Profile = LATIN) -> Column:
    """Sentences in order; newlines split, enders split and stay, blanks go."""
    marked = F.regexp_replace(blank(text), f"([{profile.enders}])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n", -1), lambda s: F.trim(s)), lambda s: s != "")


def sentences(docs: DataFrame, text: str = "text", profile: Profile = LATIN) -> DataFrame:
    """One row per sentence, numbered from 0; the document's other columns stay."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(sentence_array(text, profile)).alias("pos", "sentence"))


def abstract_label(label: Column | str) -> Column:
    """Looks like a notion: an abstract ending, or four and more Han characters; names with a middle dot do not."""
    c = F.lower(blank(label))
    return ~c.rlike("[·•]") & (c.rlike("(ness|ity|ism|ment|tion|ance|ence)$") | c.rlike("^[\\x{4e00}-\\x{9fff}]{4,8}$"))


def slugify(label: Column | str) -> Column:
    """H1: lower-case ASCII with dashes; without any, a name from the label's MD5."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(blank(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("concept-"), F.substring(F.md5(blank(label)), 1, 8)))


def heading_id(text: Column | str) -> Column:
    """H2: lower, spaces to dashes, other signs dropped, URL-encoded."""
    t = F.regexp_replace(F.lower(F.trim(blank(text))), "[ \t\r\n]+", "-")
    return F.concat(F.lit("heading-"), F.url_encode(F.regexp_replace(t, "[^\\p{L}\\p{N}_-]", "")))


def canonical_label(label: Column | str, synonyms: dict[str, str] | None = None, nfkc: bool = False) -> Column:
    """H3: without notes in brackets, spaces, dots and dashes; lower case; then its synonym, if it has one.

    With ``nfkc`` compatibility forms are unified first, in Arrow batches; ASCII labels do not need that.
    """
    t = F.regexp_replace(compatible(blank(label)) if nfkc else blank(label), "[（(][^）)]*[)）]", "")
    t = F.lower(F.regexp_replace(t, "[ \t\r\n·•_—　-]+", ""))
    if not synonyms:
        return t
    return F.coalesce(F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))[t], t)


def compatible(text: Column) -> Column:
    """NFKC of a column, which Spark has no function for."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(text)


def focus_score(text: Column | str, focus: str) -> Column:
    """H5: occurrences of the focus term, as a whole word when it is ASCII."""
    t = F.lower(blank(text))
    if focus.isascii():
        padded = F.regexp_replace(t, "[^a-z0-9_]+", "  ")
        return F.regexp_count(F.concat(F.lit(" "), padded, F.lit(" ")), F.lit(f" {focus.lower()} ")).cast("long")
    flat = F.regexp_replace(t, "[-_ ]", "")
    return ((F.length(flat) - F.length(F.replace(flat, F.lit(focus)))) / len(focus)).cast("long")


def infer_relation(a: Column | str, b: Column | str) -> Column:
    """H6: contains, belongs_to, shared_term or related."""
    a, b = F.lower(blank(a)), F.lower(blank(b))
    shared = F.size(F.array_intersect(F.split(a, "[^a-z0-9]+"), F.split(b, "[^a-z0-9]+"))) > 0
    return F.when(F.contains(a, b), "contains").when(F.contains(b, a), "belongs_to").when(shared, "shared_term").otherwise("related")


def parse_time(text: Column | str) -> Column:
    """H7: ISO time to seconds since 1970, 0.0 when it does not parse."""
    return F.coalesce(F.try_to_timestamp(_c(text)).cast("double"), F.lit(0.0))


def han_grams(text: Column | str, sizes: tuple[int, ...] = (2,)) -> Column:
    """All stretches of ``sizes`` characters inside the runs of Han characters."""
    runs = F.regexp_extract_all(blank(text), F.lit(f"[{HAN}]{{2,}}"), F.lit(0))

    def of(n):
        cut = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= n), cut))

    return F.concat(*(of(n) for n in sizes))


def query_terms(text: Column | str, profile: Profile = LATIN, least: int = 2) -> Column:
    """H8: distinct lower-case terms of at least ``least`` characters that are no stopwords, in order; of Han runs their bigrams, last."""
    found = F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    found = found if profile.name == "latin" else F.concat(found, han_grams(text))
    stop = F.array(*(F.lit(w) for w in profile.stopwords)) if profile.stopwords else F.array().cast("array<string>")
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t)))


def query_names(text: Column | str, profile: Profile = LATIN) -> Column:
    """Distinct names of 2 to 4 characters: whole Han runs, or in Latin letters capitalised words that are no stopwords."""
    if profile.name != "latin":
        runs = F.regexp_extract_all(blank(text), F.lit(f"[{HAN}]+"), F.lit(0))
        return F.array_distinct(F.filter(runs, lambda r: F.length(r).between(2, 4)))
    words = F.regexp_extract_all(blank(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{1,3}$") & ~F.lower(w).isin(*profile.stopwords)))


def sentence_words(text: Column | str, profile: Profile = LATIN) -> Column:
    """The distinct words that query terms and names can equal: as they stand, in lower case, and stretches of 2 to 4 Han characters."""
    words = F.regexp_extract_all(blank(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    parts = [words, F.transform(words, lambda w: F.lower(w))] + ([] if profile.name == "latin" else [han_grams(text, (2, 3, 4))])
    return F.array_distinct(F.concat(*parts))


def quoted_phrase(text: Column | str) -> Column:
    """The first phrase of two or more characters in quotation marks, else empty."""
    return F.trim(F.regexp_extract(blank(text), '["“「『]([^"”」』]{2,})["”」』]', 1))


def phrase_terms(text: Column | str, most: int = 8) -> Column:
    """H8: the first ``most`` distinct words of 2 to 4 letters; bigrams of the text when there are none."""
    t = blank(text)
    short = F.filter(query_terms(t), lambda x: F.length(x).between(2, 4) & ~x.rlike("^[0-9]+$"))
    flat = F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    grams = F.when(F.length(flat) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - 1), lambda i: F.substring(flat, i, F.lit(2)))))
    return F.slice(F.when(F.size(short) > 0, short).otherwise(F.coalesce(grams, F.array().cast("array<string>"))), 1, most)


def cache_key(text: Column | str, prefix: str) -> Column:
    """H9: a prefix and the MD5 of the text with squeezed white space."""
    return F.concat(F.lit(prefix + ":"), F.md5(F.trim(F.regexp_replace(blank(text), "[ \t\r\n]+", " "))))


def strip_bad_refs(answer: Column | str, max_local: Column, max_web: Column) -> Column:
    """Drop ``[参考资料N]`` and ``[网页N]`` with a number outside 1 to the limit."""
    t = blank(answer)
    refs = F.array_distinct(F.regexp_extract_all(t, F.lit("\\[(?:参考资料|网页)[0-9]+\\]"), F.lit(0)))

    def step(acc, ref):
        n = F.try_to_number(F.regexp_extract(ref, "([0-9]+)", 1), F.lit("9999999999"))
        limit = F.when(F.contains(ref, F.lit("网页")), max_web).otherwise(max_local)
        return F.when((n >= 1) & (n <= limit), acc).otherwise(F.replace(acc, ref, F.lit("")))

    return F.aggregate(refs, t, step)


def collapse_cjk_spaces(text: Column | str) -> Column:
    """No spaces between Han characters."""
    return F.regexp_replace(blank(text), "(?<=[\\x{4e00}-\\x{9fff}])[ \t]+(?=[\\x{4e00}-\\x{9fff}])", "")


def card_type(kind: Column | str, label: Column | str) -> Column:
    """The node's type, else method for method words, else concept."""
    k = F.trim(blank(kind))
    return F.when(k != "", k).when(F.lower(blank(label)).rlike("method|algorithm|方法|算法|ation$"), "method").otherwise("concept")


def score_to_weight(score: Column | str) -> Column:
    """0.4 + 0.6 score, half-even to 3 decimals; no score is 0."""
    return F.bround(0.4 + 0.6 * F.coalesce(_c(score), F.lit(0.0)), 3)


def edge_label(label: Column | str, src: Column | str, dst: Column | str) -> Column:
    """An edge's label, or ``a→b`` where it is blank."""
    t = F.trim(blank(label))
    return F.when(t != "", t).otherwise(F.concat(blank(src), F.lit("→"), blank(dst)))


def interpret_rewrite(raw: Column | str, query: Column | str) -> Column:
    """struct(rewrite, expansion) of a two-line output; a rewrite of 3 to 80 characters, else the query."""
    lines = F.filter(F.transform(F.split(blank(raw), "\n", -1), lambda s: F.trim(s)), lambda x: x != "")
    one, two = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    ok = F.length(one).between(3, 80)
    return F.struct(F.when(ok, one).otherwise(blank(query)).alias("rewrite"), F.when(F.length(two).between(3, 80), two).otherwise("").alias("expansion"))
