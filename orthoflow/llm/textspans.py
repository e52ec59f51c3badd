"""Places of regular-expression matches, as DataFrame expressions.

split() and regexp_extract_all() walk over a text in the same way, so the pieces
between matches and the matches give every place; offsets are in code points and
ends are exclusive. Places are summed in chunks, as an array that grows by one
element is copied each time. Patterns here start only where a match may start and
never back into what they have read, so that very long runs cost linear time and
no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed together.
CHUNK = 64
#: Characters of a cell, from which pieces of a text are taken.
CELL_BITS = 8
CELL = 1 << CELL_BITS
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,left:string,right:string>>"


def nothing() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, kind: str, rank: int, when: Column) -> Column:
    """All leftmost non-overlapping matches of pattern, where `when` says there may be any.

    left and right are the texts up to the match before and after.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["left"])
        end = start + F.length(x["value"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span).cast(SPAN)).alias("out"))

    def summed(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), nothing().alias("out")), step)

    def chunked(pairs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK)), lambda i: F.slice(pairs, i, F.lit(CHUNK)))
        return F.when(F.size(pairs) <= CHUNK, summed(pairs, F.lit(0))["out"]).otherwise(let(parts, offset))

    def offset(parts: Column) -> Column:
        length = lambda acc, x: acc + F.length(x["left"]) + F.length(x["value"])
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), length))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda part, at: summed(part, at)["out"]))

    def placed(pieces: Column) -> Column:
        n = F.size(pieces)
        left, right = F.slice(pieces, F.lit(1), n - 1), F.slice(pieces, F.lit(2), n)
        return let(F.arrays_zip(left.alias("left"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), right.alias("right")), chunked)

    any_ = when & F.coalesce(text.rlike(pattern), F.lit(False))
    return F.when(any_, let(F.split(text, pattern, -1), placed)).otherwise(nothing())


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span shares a character with one of others."""
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def reach(found: Column) -> Column:
    """For each span, by start, the largest end up to it; in chunks as above."""

    def run(ends: Column, at: Column) -> Column:
        return F.aggregate(ends, F.array(at), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))

    def each(parts: Column) -> Column:
        tops = run(F.transform(parts, F.array_max), F.lit(0))
        inside = lambda part, at: F.slice(run(part, at), F.lit(2), F.size(part))
        return F.flatten(F.zip_with(parts, F.slice(tops, F.lit(1), F.size(parts)), inside))

    def chunked(ends: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(ends), F.lit(CHUNK)), lambda i: F.slice(ends, i, F.lit(CHUNK))), each)

    return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(let(F.transform(found, lambda s: s["end"]), chunked))


def clear_of(found: Column, others: Column) -> Column:
    """The spans that share no character with one of others, which are by start.

    Of many others the first one that ends behind a span's start is searched by
    halves: where it starts behind the span, so do all later ones.
    """

    def far(ends: Column) -> Column:
        n = F.size(others)

        def halve(acc: Column, start: Column) -> Column:
            mid = F.shiftright(acc["low"] + acc["high"], 1)
            above = F.get(ends, mid) <= start
            low, high = F.when(above, mid + 1).otherwise(acc["low"]), F.when(above, acc["high"]).otherwise(mid)
            return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(low.alias("low"), high.alias("high")))

        def first(start: Column) -> Column:
            steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
            return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), lambda acc, _: halve(acc, start))["low"]

        return F.filter(found, lambda s: F.coalesce(F.get(others, first(s["start"]))["start"] >= s["end"], F.lit(True)))

    few = F.filter(found, lambda s: ~overlaps(s, others))
    return F.when((F.size(found) == 0) | (F.size(others) == 0), found).when(F.size(others) <= CHUNK, few).otherwise(let(reach(others), far))


def replaced(text: Column, found: Column, by: Callable[[Column, Column], Column]) -> Column:
    """text with by(span, at) in place of each span, by start; at is the largest end before it.

    Pieces are taken from cells of the text, as substring() walks from its start.
    """

    def filled(cells: Column, ends: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.shiftright(a, CELL_BITS)
            near = F.slice(cells, first + 1, F.shiftright(b + (CELL - 1), CELL_BITS) - first)
            return F.substring(F.array_join(near, ""), a - first * CELL + 1, b - a)

        def one(s: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            return F.concat(piece(at, F.greatest(at, s["start"])), by(s, at))

        return F.concat(F.array_join(F.transform(found, one), ""), piece(F.element_at(ends, -1), F.length(text)))

    cells = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(let(cells, lambda c: let(reach(found), lambda ends: filled(c, ends))))
