"""Places of pattern matches and pieces of texts, as column expressions linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block of running sums, and code points of a block of text.
BLOCK = 64
CHUNK = 4096


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, value: Callable[[Column], Column], op: Callable[[Column, Column], Column]) -> Column:
    """For each item, op over the values (not negative integers) of all items before it, from 0.

    Sums inside blocks and sums of blocks are added up apart, so that arrays that grow stay short."""

    def sums(xs: Column, of: Callable[[Column], Column], start: Column) -> Column:
        return F.aggregate(xs, F.array(start.cast("int")), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), of(x)).cast("int"))))

    def blocked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

        def of_blocks(bs: Column) -> Column:
            whole = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: op(a, value(x)).cast("int")))
            starts = sums(whole, lambda t: t, F.lit(0))
            inside = F.zip_with(bs, F.slice(starts, 1, F.size(bs)), lambda b, s: F.slice(sums(b, value, s), 1, F.size(b)))
            return F.flatten(inside)

        return bound(blocks, of_blocks)

    return bound(items, lambda xs: F.when(F.size(xs) > 0, blocked(xs)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Matches with their places and the text up to the match before and after: array of (start, end,
    value, left, right), in code points, end exclusive."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def listed(b: Column) -> Column:
        size = F.transform(b["values"], lambda v, i: F.struct((F.length(F.get(b["gaps"], i)) + F.length(v)).alias("n"), F.length(v).alias("own"), v.alias("value"), F.get(b["gaps"], i).alias("left"), F.get(b["gaps"], i + 1).alias("right")))

        def placed(xs: Column) -> Column:
            return F.zip_with(xs, running(xs, lambda x: x["n"], lambda a, x: a + x), lambda x, at: F.struct((at + x["n"] - x["own"]).alias("start"), (at + x["n"]).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))

        return bound(size, placed)

    return bound(both, listed)


def replaced(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """text with spans (start, kind, end; by start) replaced by their names.

    Spans that overlap an earlier one go with it.  Pieces are cut from short chunks of the text, since
    finding a place in a text means counting through it."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def piece(cs: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        chunk = lambda i: F.coalesce(F.get(cs, i), F.lit(""))
        one = F.substring(chunk(first), a % CHUNK + 1, b - a)
        many = F.concat(F.substring(chunk(first), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(cs, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(chunk(last), F.lit(1), b % CHUNK))
        return F.when(first == last, one).otherwise(many)

    def whole(x: Column) -> Column:
        cs, ss = x["chunks"], x["spans"]
        cover = running(ss, lambda s: s["end"], lambda a, e: F.greatest(a, e))
        parts = F.zip_with(ss, cover, lambda s, at: F.when(s["start"] >= at, F.concat(piece(cs, at, s["start"]), name(s))))
        tail = F.aggregate(ss, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(parts, ""), bound(tail, lambda t: piece(cs, t, F.greatest(t, F.size(cs) * CHUNK))))

    return bound(F.struct(chunks.alias("chunks"), spans.alias("spans")), whole)
