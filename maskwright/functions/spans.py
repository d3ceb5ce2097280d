"""Spans of regular-expression matches as arrays of structs, from built-in expressions only.

Offsets are code points, half-open. A pattern must not match the empty string. The text is only split where it matches.
Arrays are folded block by block, of about the square root of their size, and spans meet only those of their own cluster
of overlaps: a text with thousands of matches takes little more time than its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: higher-order functions are not de-duplicated by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(c: Column) -> Column:
    """c, worked out where it stands: filters on it, also those that explode implies, are not pushed below, where each column
    that it was made from would be written out as often as the next one looks at it."""
    return F.when(F.rand(0) < 2, c)


def blocks(array: Column) -> Column:
    """The array cut into about as many parts as each has elements."""
    n = F.greatest(F.size(array), F.lit(1))
    size = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(1), n, size), lambda at: F.slice(array, at, size))


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Before each element: start merged with all elements before it. merge is associative."""

    def of(parts: Column) -> Column:
        both = lambda a, b: merge(a, b)
        fold = lambda x, upto: F.aggregate(F.slice(x, 1, upto), start, both)
        sums = F.transform(parts, lambda p: F.aggregate(p, start, both))
        inner = lambda sums: F.transform(parts, lambda p, k: let(fold(sums, k), lambda before: F.transform(p, lambda _, i: merge(before, fold(p, i)))))
        return F.flatten(let(sums, inner))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks(values), of))


def placed(x: Column) -> Column:
    """array<struct<start, end, value>> of matches x.m with the gaps x.gap before, between and after them."""
    sizes = F.zip_with(x["m"], F.slice(x["gap"], 1, F.size(x["m"])), lambda m, gap: F.length(m) + F.length(gap))

    def spans(before: Column) -> Column:
        at = lambda i: F.get(before, i) + F.length(F.get(x["gap"], i))
        return F.transform(x["m"], lambda m, i: F.struct(at(i).alias("start"), (at(i) + F.length(m)).alias("end"), m.alias("value")))

    return let(running(sizes, F.lit(0), lambda a, b: a + b), spans)


def match_spans(text: str, pattern: str, hint: str = "") -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches of pattern in column text.

    hint: a string that every match holds; texts without it are not matched at all.
    """
    c, p = F.col(text), F.lit(pattern)
    may = c.contains(hint) & c.rlike(pattern) if hint else c.rlike(pattern)
    found = F.struct(F.regexp_extract_all(c, p, F.lit(0)).alias("m"), F.split(c, pattern, -1).alias("gap"))
    return F.when(F.coalesce(may, F.lit(False)), let(found, placed)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def overlap(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a character."""
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def by_start(spans: Column) -> Column:
    """Spans by start; equal starts in the order of the structs."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))), lambda x: x["s"])


def in_clusters(spans: Column, body: Callable[[Column], Column], touching: bool = False) -> Column:
    """body on each cluster of spans that overlap, directly or through others (or touch), joined: for what only concerns spans that do."""

    def of(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda s: s["end"]), F.lit(-1), F.greatest)
        fresh = lambda s, upto: s["start"] > upto if touching else s["start"] >= upto

        def cut(reach: Column) -> Column:
            first = F.filter(F.transform(ordered, lambda s, i: F.when(fresh(s, F.get(reach, i)), i)), lambda i: i.isNotNull())
            part = lambda first: F.transform(first, lambda a, k: F.slice(ordered, a + 1, F.coalesce(F.get(first, k + 1), F.size(ordered)) - a))
            return F.flatten(F.transform(let(first, part), body))

        return let(reach, cut)

    return F.when(F.size(spans) < 2, body(spans)).otherwise(let(by_start(spans), of))


def beside(text: Column, ordered: Column, one: Callable[[Column, Callable], Column], reach: int = 16) -> Column:
    """one(span, at) on each of the spans, which are sorted by start; at(place, n) gives n characters of the text up to `reach` off the span.

    Characters are looked up within the part of the text that a block of spans lies in, as places are counted from its start.
    """

    def of(part: Column) -> Column:
        low = F.greatest(F.get(part, F.lit(0))["start"] - reach, F.lit(0))
        high = F.array_max(F.transform(part, lambda s: s["end"])) + reach

        def within(x: Column) -> Column:
            at = lambda place, n: x["t"].substr(place - x["low"] + 1, n if isinstance(n, Column) else F.lit(n))
            return F.transform(part, lambda s: one(s, at))

        return let(F.struct(low.alias("low"), text.substr(low + 1, high - low).alias("t")), within)

    return F.flatten(F.transform(F.filter(blocks(ordered), lambda p: F.size(p) > 0), of))
