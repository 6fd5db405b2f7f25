"""Quality rules whose cutoffs are certified on labelled documents.

Statistics of each text feed a fixed set of rules (statistic, direction). For every stratum (a
language) and rule, a grid of cutoffs is tested on the labelled holdout: a cutoff is safe when
the exact binomial (Clopper-Pearson) upper bound of its false-rejection rate, among documents
labelled good, is at most ALPHA / number of rules. All cutoffs of all rules and strata are tested at once, so each
test runs at level DELTA / number of tests (Bonferroni): with probability 1 - DELTA the chosen
cutoffs together reject at most ALPHA of a stratum's good documents, in every stratum, however many there are. Of the
safe cutoffs of a rule the one that rejects most documents is used; a rule with no safe cutoff is off.

Counts and cutoffs are tables with a row for each stratum; only the number of strata reaches the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deal, map_rows, saved

#: Most false rejections among a stratum's good documents, over all rules; each rule gets an equal part.
ALPHA = 0.05
DELTA = 0.05
#: Strata up to which their cutoffs are broadcast (under 200 bytes each).
BROADCAST_STRATA = 100_000

#: Rules: name, statistic per thousand, whether large values are bad, and the cutoffs on the grid.
RULES = (
    ("symbols", "1000 * n_symbols / n_words", True, (20, 50, 100, 200, 500, 1000, 2000)),
    ("dup_lines", "1000 * n_dup_lines / n_lines", True, (50, 100, 200, 300, 400, 500)),
    ("repeat_words", "1000 * n_repeat_words / n_words", True, (50, 100, 150, 200, 300, 400)),
    ("long_words", "1000 * word_chars / n_words", True, (7000, 8000, 9000, 10000, 12000)),
    ("short_words", "1000 * word_chars / n_words", False, (2000, 2500, 3000, 3500)),
    ("upper", "1000 * n_upper / word_chars", True, (50, 100, 200, 400)),
    ("few_words", "1000 * n_words", False, (60000, 80000, 100000)),
)

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
_LATIN_CAPITAL = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")


def text_stats(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_upper.

    Bytes split at the six ASCII white-space characters, which are those that separate words.
    Capitals are those of ASCII and Latin-1.
    """
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") + (len(_LATIN_CAPITAL.findall(raw)) if len(raw) > len(text) else 0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(w), chars, count(b"#*$%&|<>"), len(lines), len(lines) - len(set(lines)), repeated_words(w), upper


def repeated_words(w: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(w) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), dtype=bool)
    starts = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def _stats():
    return lambda texts: list(zip(*map(text_stats, texts), strict=True)) if texts else [[]] * 7


def with_stats(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``carry`` columns) with the statistics of ``text_stats``; null texts have no words."""
    return map_rows(docs, _stats, ", ".join(f"{n} long" for n in STATS), [text_col], carry)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rejects(rule, cutoff) -> Column:
    _, value, large, _ = rule
    v = F.expr(re.sub(r" / (\w+)", r" / nullif(\1, 0)", value))
    return F.coalesce(v > cutoff if large else v < cutoff, F.lit(False))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from the term of ``k`` down until terms no longer count."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = [term]
    for i in range(k, 0, -1):
        # Each term is the next one times this ratio, which falls with i.
        term *= i / (n - i + 1) * (1 - p) / p
        terms.append(term)
        if term < 1e-18 * terms[0]:
            break
    return min(1.0, math.fsum(terms))


def is_safe(k: int, n: int, level: float, alpha: float = ALPHA) -> bool:
    """Whether the exact upper bound at ``level`` of k rejections among n good documents is at most ``alpha``."""
    return n > 0 and k < alpha * n and binomial_cdf(k, n, alpha) <= level


def choose_cutoffs(labelled: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs, saved: a row per stratum with a column ``cut<r>`` per rule, null where the rule is off.

    ``labelled`` has the statistics, ``stratum`` and ``quality`` (1: good). One aggregation counts; a
    map over its rows, one per stratum, decides.
    """
    good = F.col("quality") == 1
    grid = [(r, c, cutoff) for r, rule in enumerate(RULES) for c, cutoff in enumerate(rule[3])]
    aggs = [F.count(F.when(good, 1)).alias("n")]
    for r, c, cutoff in grid:
        rejected = _rejects(RULES[r], cutoff) & ~base_failed()
        aggs += [F.count(F.when(rejected & good, 1)).alias(f"g{r}_{c}"), F.count(F.when(rejected, 1)).alias(f"a{r}_{c}")]
    counts = saved(labelled.groupBy(F.col(stratum).alias("stratum")).agg(*aggs), "counts")
    level = delta / max(1, counts.count() * len(grid))

    def make():
        def run(_, n, good, gone):
            out = []
            for own, g, a in zip(n, good, gone, strict=True):
                best: list = [(0, 0, None)] * len(RULES)
                for (r, c, cutoff), k, all_ in zip(grid, g, a, strict=True):
                    if all_ > 0 and is_safe(k, own, level, alpha / len(RULES)):
                        best[r] = max(best[r], (all_, -c, cutoff))
                out.append([b[2] for b in best])
            return [list(x) for x in zip(*out, strict=True)]

        return run

    rows = counts.select("stratum", "n", F.array(*(f"g{r}_{c}" for r, c, _ in grid)).alias("good"), F.array(*(f"a{r}_{c}" for r, c, _ in grid)).alias("gone"), F.lit("").alias("text"))
    return saved(map_rows(rows, make, ", ".join(f"cut{r} int" for r in range(len(RULES))), ["text", "n", "good", "gone"], ["stratum"]), "cutoffs")


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics, base_failed, ``failed_rules`` and kept.

    Labels are joined by ``id_col`` and only their counts are used; a document whose labels
    disagree counts as bad. Null strata share the stratum "". A stratum without labels has no rules but the base. Null texts have no words and fail
    the base; repeated rows each count; an empty ``labels`` leaves every rule off. Of cutoffs that
    reject equally many the milder is used. Columns of ``docs`` named like a new one give way.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*STATS, "base_failed", "failed_rules", "kept")]
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), F.col(id_col).alias("__id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("__text"))
    rows = saved(with_stats(rows, "__text", [*names, "__id", "stratum"]), "stats")
    truth = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"))
    chosen = choose_cutoffs(rows.join(truth, "__id"), alpha=alpha, delta=delta)
    if chosen.count() <= BROADCAST_STRATA:
        rows = rows.join(F.broadcast(chosen), "stratum", "left")
    else:
        sizes = rows.groupBy("stratum").agg(F.count("*").alias("members"))
        rows, chosen = deal(rows, chosen, sizes, "stratum", F.xxhash64("__id", "n_words", "word_chars"))
        rows = rows.join(chosen, ["stratum", "deal"], "left").drop("deal")
    failed = [F.when(_rejects(rule, F.col(f"cut{r}")), F.lit(rule[0])) for r, rule in enumerate(RULES)]
    out = rows.withColumn("base_failed", base_failed())
    out = out.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("stratum", "__id", *(f"cut{r}" for r in range(len(RULES))))
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))
