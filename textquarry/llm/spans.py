"""Positions of regular-expression matches as DataFrame expressions.

Spark's own functions give the matches of a pattern but not where they stand. Splitting the
text at the same pattern gives what lies between the matches, so running sums of both lengths
are the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"
#: Matches that are located in one walk; a walk copies what it has found so far with each step.
BLOCK = 128


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (or of one group of each)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, found: Column, pattern: str, around: int = 0) -> Column:
    """array<SPAN> of the matches ``found``; the text is split only where there are any.

    ``before`` has the last ``around`` characters in front of a match (matches have at least two),
    ``after`` the first that follow it, up to the next match. The matches are walked in blocks, each
    from the sum of the lengths of the blocks before it, so the work grows with the text's length.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    size = F.size(found)
    parts = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(parts, 1, size).alias("p"), F.slice(parts, 2, size).alias("q"))
    cut = lambda s, n: F.substring(s, -n, n) if n else F.lit("")
    width = lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("bigint")

    def blocks(all_pairs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_pairs, (i * BLOCK + 1).cast("int"), F.lit(BLOCK)))

    def starts(each):
        sums = F.transform(each, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, x: n + width(x)))
        return let(sums, lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)))

    def tail(each, i):
        """What stands before block ``i``, from the last ``around`` matches on."""
        last = F.slice(F.get(each, i - 1), F.lit(-min(around, BLOCK)), F.lit(min(around, BLOCK)))
        joined = F.array_join(F.transform(last, lambda x: F.concat(x["p"], x["m"])), "")
        return F.when(i > 0, cut(joined, around)).otherwise(F.lit("")) if around else F.lit("")

    def walk(block, at, before):
        def step(acc, x):
            front = cut(F.concat(acc["tail"], x["p"]), around)
            start = acc["at"] + F.length(x["p"])
            span = F.struct(
                start.cast("bigint").alias("start"), (start + F.length(x["m"])).cast("bigint").alias("end"), x["m"].alias("text"),
                front.alias("before"), (F.substring(x["q"], 1, around) if around else F.lit("")).alias("after"),
            )
            tail = cut(F.concat(acc["tail"], x["p"], x["m"]), around)
            return F.struct((acc["at"] + width(x)).alias("at"), tail.alias("tail"), F.array_append(acc["out"], span).alias("out"))

        first = F.struct(at.alias("at"), before.alias("tail"), empty.alias("out"))
        return F.aggregate(block, first, step, lambda acc: acc["out"])

    def whole(each):
        return let(starts(each), lambda at: F.flatten(F.transform(each, lambda b, i: walk(b, F.get(at, i), tail(each, i)))))

    walked = let(pairs, lambda p: let(blocks(p), whole))
    return F.when(size > 0, walked).otherwise(empty)


def tagged(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of every span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digest(tags: Column) -> Column:
    return F.sha2(F.concat_ws(",", tags), 256)
